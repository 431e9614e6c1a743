"""DuckDB SQL for the registered queries, from common table expressions that they share."""

from __future__ import annotations

from quillspark.functions.text import STOP_WORDS
from quillspark.operators.grounding import FALLBACK_ANSWER, NOT_INDEXED_ANSWER

K, SIZE, OVERLAP = 10, 1000, 150
NL = "chr(10)"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tok(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: NOT list_contains({STOP}, x))"


def expand(t: str) -> str:
    return f"list_distinct(list_concat({t}, list_transform(list_filter({t}, lambda x: x LIKE '%s' AND length(x) > 3), lambda x: left(x, length(x) - 1))))"


def slug(t: str, empty: str = "section") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({t}), '[^a-z0-9]+', '-', 'g'), '-'), ''), '{empty}')"


SPACES = r"[\s\x1C-\x1F\x{85}\p{Z}]"

SEC = f"""sec AS (
    SELECT doc_id::VARCHAR AS id, 'doc_' || doc_id || '.md' AS file, coalesce(source, '') AS heading, coalesce(text, '') AS content,
           {tok(f"concat_ws({NL}, source, coalesce(text, ''))")} AS tokens
    FROM documents)"""

CORPUS = f"""{SEC},
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM sec) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
stats AS (SELECT count(*) AS n_sections, coalesce(avg(len(tokens)), 0) AS avg_len, count(DISTINCT file) AS n_files FROM sec),
idf AS (SELECT token, df, ln(1 + (n_sections - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, stats)"""

QTOK = f"""qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS token FROM benchmark) GROUP BY ALL)"""


def lexical(boost: float) -> str:
    return f"""{CORPUS}, {QTOK},
own AS (SELECT id, greatest(len(tokens), 1) AS dl, {tok('heading')} AS heading_tokens FROM sec),
lex AS (
    SELECT query_id, id, sum(idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)))
                             + CASE WHEN list_contains(heading_tokens, token) THEN idf * {boost}::DOUBLE ELSE 0 END) AS score
    FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN own USING (id), stats
    GROUP BY ALL)"""


def top(table: str, k: int | None = K) -> str:
    cut = "" if k is None else f" WHERE rank <= {k}"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {table} WHERE score > 0){cut}"


def _cut(a: str) -> str:
    """Where the child that begins at a ends."""
    low, hard = f"({a} + {SIZE // 2})", f"({a} + {SIZE})"
    window = f"substring(t, ({low} + 1)::INT, {SIZE - SIZE // 2})"
    ends = ", ".join(f"CASE WHEN instr(reverse({window}), {sep}) > 0 THEN {hard} - instr(reverse({window}), {sep}) + 1 END" for sep in (f"{NL} || {NL}", NL, "' .'", "' '"))
    return f"(CASE WHEN {hard} >= n THEN n ELSE coalesce({ends}, {hard}) END)"


CUTS = f"""{SEC},
base AS (SELECT id, file, heading, t, length(t) AS n FROM (
    SELECT id, file, heading, nfc_normalize(replace(replace(content, chr(13) || {NL}, {NL}), chr(13), {NL})) AS t FROM sec)),
cuts(id, idx, a, b) AS (
    SELECT id, 0, 0, {_cut('0')}::INT FROM base
    UNION ALL
    SELECT c.id, c.idx + 1, c.b - {OVERLAP}, {_cut(f'(c.b - {OVERLAP})')}::INT FROM cuts c JOIN base USING (id) WHERE c.b < n)"""

CHILD = f"""{CUTS},
child AS (
    SELECT id || '::chunk-' || idx AS chunk_id, id AS source_id, file, heading, idx, count(*) OVER (PARTITION BY id) AS chunk_count, content,
           CASE WHEN heading <> '' THEN heading || {NL} || {NL} || content ELSE content END AS embedding_text
    FROM (SELECT c.*, file, heading, substring(t, a + 1, b - a) AS content FROM cuts c JOIN base USING (id)))"""

TFIDF = f"""{CHILD},
ctok AS (SELECT chunk_id AS id, source_id, {tok('embedding_text')} AS tokens FROM child),
ctf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM ctok) GROUP BY ALL),
cidf AS (SELECT token, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM (SELECT token, count(*) AS df FROM ctf GROUP BY token), (SELECT count(*) AS n FROM ctok)),
cw AS (SELECT id, token, tf, (tf / max(tf) OVER (PARTITION BY id))::DOUBLE * idf AS weight FROM ctf JOIN cidf USING (token)),
cn AS (SELECT id, sqrt(sum(weight * weight)) AS norm, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms FROM cw GROUP BY id)"""

_QW = """qw0 AS (SELECT query_id, token, (qtf / max(qtf) OVER (PARTITION BY query_id))::DOUBLE * idf AS qw FROM qt JOIN cidf USING (token)),
qw AS (SELECT *, sqrt(sum(qw * qw) OVER (PARTITION BY query_id)) AS qnorm FROM qw0),
kids AS (SELECT query_id, id, sum(qw * weight) / (any_value(qnorm) * any_value(norm)) AS score FROM qw JOIN cw USING (token) JOIN cn USING (id) WHERE norm > 0 GROUP BY ALL)"""

COSINE = f"{TFIDF}, {QTOK}, {_QW}"

#: Both rankers in full, then fused, reranked and compared.
BOTH = f"""{lexical(0.25)}, {TFIDF.replace(SEC + ',', '')}, {_QW},
par AS (SELECT query_id, source_id AS id, max(score) AS score FROM kids JOIN ctok USING (id) GROUP BY ALL),
lr AS ({top('lex', 320)}), vr AS ({top('par', 320)})"""


def fused(name: str, depth: int, k: int | None) -> str:
    cut = "" if k is None else f" WHERE rank <= {k}"
    return f"""{name} AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, least(bm25_rank, vector_rank), id) AS rank FROM (
        SELECT query_id, id, sum(1::DOUBLE / (60 + rank)) AS rrf_score, max(CASE WHEN r = 1 THEN rank END) AS bm25_rank, max(CASE WHEN r = 2 THEN rank END) AS vector_rank,
               max(CASE WHEN r = 1 THEN score END) AS bm25_score, max(CASE WHEN r = 2 THEN score END) AS vector_score
        FROM (SELECT 1 AS r, * FROM lr WHERE rank <= {depth} UNION ALL SELECT 2 AS r, * FROM vr WHERE rank <= {depth}) GROUP BY query_id, id)){cut})"""


def bounded(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} / (1 + {x}) ELSE 0 END"


def features(source: str) -> str:
    return f"""qx AS (SELECT item_id AS query_id, {expand(tok('text'))} AS q FROM benchmark),
sx AS (SELECT id, {expand(tok('heading'))} AS h, {expand(tok('content'))} AS c FROM sec),
fx AS (SELECT *, coverage * 2 + precision * 0.5::DOUBLE + heading_coverage * 0.35::DOUBLE + ({bounded('bm25_score')}) * 0.1::DOUBLE + ({bounded('vector_score')}) * 0.08::DOUBLE + ({bounded('rrf_score')}) * 0.05::DOUBLE AS rerank_score
    FROM (SELECT f.*, len(list_intersect(q, list_concat(h, c))) / len(q)::DOUBLE AS coverage, len(list_intersect(q, list_concat(h, c))) / len(list_distinct(list_concat(h, c)))::DOUBLE AS precision,
                 len(list_intersect(q, h)) / len(q)::DOUBLE AS heading_coverage
          FROM {source} f JOIN sx USING (id) JOIN qx USING (query_id) WHERE len(q) > 0) WHERE coverage > 0),
rr AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, round(rrf_score, 9) DESC, least(bm25_rank, vector_rank), id) AS rerank_rank FROM fx))"""


RERANK = f"{BOTH}, {fused('f12', 48, 12)}, {features('f12')}"

HEADING = r"'^(#{1,6})\s+(.+?)\s*$'"
MARKDOWN = rf"""md AS (
    SELECT 'doc_' || doc_id || '.md' AS file, '# ' || coalesce(source, '') || {NL} || {NL} || array_to_string(list_transform(string_split(text, {NL}), lambda x, i:
        repeat('#', 2 + (i - 1)::INT % 3) || ' ' || array_to_string(string_split(x, ' ')[1:3], ' ') || {NL} || {NL} || x), {NL} || {NL}) AS text
    FROM documents),
ln0 AS (SELECT file, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) - 1 AS pos FROM md),
ln1 AS (SELECT *, nullif(length(regexp_extract(line, {HEADING}, 1)), 0) AS lvl, trim(trim(trim(regexp_extract(line, {HEADING}, 2)), '#')) AS h FROM ln0),
ln2 AS (SELECT file, pos, line, lvl, max(CASE WHEN lvl IS NOT NULL THEN pos END) OVER w AS hp,
    last_value(lvl IGNORE NULLS) OVER w AS at_lvl, last_value(CASE WHEN lvl IS NOT NULL THEN h END IGNORE NULLS) OVER w AS heading,
    {', '.join(f"coalesce(max(CASE WHEN lvl = {k} THEN pos END) OVER w, -1) AS p{k}, last_value(CASE WHEN lvl = {k} THEN h END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))}
    FROM ln1 WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ln3 AS (SELECT *, list_filter([{', '.join(f"CASE WHEN p{k} >= 0 AND p{k} > greatest(-2{''.join(f', p{j}' for j in range(1, k))}) THEN h{k} END" for k in range(1, 7))}], lambda x: x IS NOT NULL) AS path FROM ln2),
ps0 AS (SELECT file, hp AS pos, any_value(heading) AS heading, any_value(path) AS path, regexp_replace(regexp_replace(string_agg(line, {NL} ORDER BY pos) FILTER (WHERE lvl IS NULL), '^\s+', ''), '\s+$', '') AS content
    FROM ln3 WHERE at_lvl > 1 GROUP BY file, hp),
ps1 AS (SELECT *, {slug('heading')} AS slug FROM ps0 WHERE content <> ''),
ps AS (SELECT *, file || '#' || slug || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY file, slug ORDER BY pos) AS nth FROM ps1))"""

SNAPS = """lab AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
old AS (SELECT 'doc_' || doc_id AS path, coalesce(text, '') AS content FROM documents),
new AS (SELECT 'doc_' || doc_id AS path, CASE WHEN quality = 0 THEN lower(coalesce(text, '')) ELSE coalesce(text, '') END AS content FROM documents LEFT JOIN lab USING (doc_id) WHERE coalesce(toxic, 0) = 0
        UNION ALL SELECT 'item_' || item_id, text FROM benchmark),
diff AS (SELECT path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NOT NULL AND o.content = n.content THEN 'skipped' ELSE 'changed' END AS status
         FROM old o FULL JOIN new n USING (path))"""

ANSWERS = r"""ans AS (SELECT doc_id AS query_id, ['doc_' || doc_id, 'src_' || source] AS ranked, CASE lang WHEN 'en' THEN 'A [Source: src_' || source || '] b [Source: doc_' || doc_id || '].'
        WHEN 'fr' THEN 'A [Source: doc_' || doc_id || '] b [ source: x' WHEN 'de' THEN 'A [Source: unknown].' ELSE text END AS answer FROM documents),
cit AS (SELECT *, regexp_extract_all(coalesce(answer, ''), '\[Source: ([^\[\]\r\n]+)\]', 1) AS cited,
        regexp_matches(regexp_replace(coalesce(answer, ''), '\[Source: ([^\[\]\r\n]+)\]', chr(1), 'g'), '(?i)\[\s*source') AS malformed FROM ans),
chk AS (SELECT *, len(cited) > 0 AND NOT malformed AND len(list_filter(cited, lambda x: NOT list_contains(ranked, x))) = 0 AS valid FROM cit)"""

CACHE = """kids AS (SELECT vec_id::VARCHAR AS chunk_id, label, sha256((CASE WHEN label = 0 THEN 'new:' ELSE 'old:' END) || vec_id) AS content_hash,
        label NOT IN (0, 1) AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS hit FROM embeddings)"""

FEATURES = f"""ft AS (SELECT id, unnest(list_concat(list_concat(tokens, list_transform(list_filter(tokens, lambda x: x LIKE '%s' AND length(x) > 3), lambda x: left(x, length(x) - 1))),
        list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1]))) AS f FROM sec),
bk AS (SELECT id, (('0x' || left(sha256(f), 8))::BIGINT % 256)::INT AS bucket, count(*) AS n FROM ft GROUP BY ALL)"""


#: Of vectors of any length.
COS = """list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))"""

PROMPTS = f"""{RERANK}, pr AS (SELECT query_id, to_json({{'question': any_value(text), 'selected_sections': list({{'source': id, 'heading': heading, 'score': round(rerank_score, 6), 'text': content}} ORDER BY rerank_rank)}}) AS prompt
    FROM rr JOIN sec USING (id) JOIN benchmark ON item_id = query_id WHERE rerank_rank <= 3 GROUP BY query_id)"""


def W(ctes: str, body: str, recursive: bool = False) -> str:  # noqa: N802
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"



def AFTER(tables: str) -> str:
    """The same over the corpus after the clean-up."""
    sections = f"{SNAPS}, sec AS (SELECT path AS id, path AS file, '' AS heading, content, {tok('content')} AS tokens FROM new)"
    return tables.replace(SEC, sections)


ORACLE_SQL = {
    "tokenize": W(SEC, "SELECT id, len(tokens)::INT AS n_tokens, sha256(array_to_string(tokens, ' ')) AS digest FROM sec"),
    "token_counts": W(CORPUS, "SELECT id, token, tf FROM tf"),
    "doc_freq": W(CORPUS, "SELECT token, df FROM df"),
    "corpus_stats": W(CORPUS, "SELECT n_sections, round(avg_len, 6) AS avg_len, n_files FROM stats"),
    "bm25_idf": W(CORPUS, "SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "bm25_topk": W(lexical(0), f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('lex')})"),
    "bm25_heading_boost": W(lexical(0.25), f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('lex')})"),
    "query_validation": f"SELECT conv_id, turn, coalesce(length(regexp_replace(regexp_replace(text, '^{SPACES}+', ''), '{SPACES}+$', '')) BETWEEN 1 AND 2000, false) AS valid FROM conversations",
    "fts_match_candidates": W(f"{CORPUS}, {QTOK}", "SELECT query_id, count(*) AS n_matches, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT query_id, id FROM qt JOIN tf USING (token)) GROUP BY query_id"),
    "tfidf_idf": W(TFIDF, "SELECT token, df, round(idf, 6) AS idf FROM cidf", True),
    "tfidf_weights": W(TFIDF, "SELECT id, token, tf, round(weight, 6) AS weight FROM cw", True),
    "tfidf_norms": W(TFIDF, "SELECT id, round(norm, 6) AS norm, n_tokens, n_terms FROM cn", True),
    "tfidf_cosine_topk": W(COSINE, f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('kids')})", True),
    "hash_embedding_buckets": W(f"{SEC}, {FEATURES}", "SELECT id, bucket, n FROM bk"),
    "hash_embedding_search": W(
        f"""{SEC}, {FEATURES}, qs AS (SELECT item_id AS id, {tok('text')} AS tokens FROM benchmark), {FEATURES.replace('ft AS', 'qft AS').replace('bk AS', 'qbk AS').replace('FROM sec', 'FROM qs').replace('FROM ft', 'FROM qft')},
nn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM bk GROUP BY id), qn AS (SELECT id AS query_id, sqrt(sum(n * n)) AS qnorm FROM qbk GROUP BY id),
dots AS (SELECT q.id AS query_id, b.id, sum(q.n * b.n) AS dot FROM qbk q JOIN bk b USING (bucket) GROUP BY ALL),
sc AS (SELECT query_id, id, dot / (qnorm * norm) AS score FROM dots JOIN nn USING (id) JOIN qn USING (query_id))""",
        f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('sc')})",
    ),
    "dense_ip_topk": W(f"sc AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)", f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('sc')})"),
    "dense_parent_max": W(f"sc AS (SELECT q.vec_id AS query_id, e.label AS id, max({COS}) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 GROUP BY ALL)", f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('sc')})"),
    "rrf_fusion": W(f"{BOTH}, {fused('f', 320, None)}", "SELECT query_id, id, round(rrf_score, 6) AS rrf_score, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, rank::INT AS rank FROM f", True),
    "hybrid_rrf": W(f"{BOTH}, {fused('f', 40, 10)}", "SELECT query_id, id, round(rrf_score, 6) AS rrf_score, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, rank::INT AS rank FROM f", True),
    "rrf_outer_join": W(BOTH, "SELECT query_id, id, l.rank::INT AS bm25_rank, v.rank::INT AS vector_rank FROM lr l FULL JOIN vr v USING (query_id, id)", True),
    "rerank_features": W(f"{BOTH}, {fused('f10', 40, 10)}, {features('f10')}", "SELECT query_id, id, round(coverage, 6) AS coverage, round(precision, 6) AS precision, round(heading_coverage, 6) AS heading_coverage, round(rerank_score, 6) AS rerank_score FROM fx", True),
    "rerank_topk": W(RERANK, "SELECT query_id, id, rerank_rank::INT AS rerank_rank, round(rerank_score, 6) AS rerank_score, round(rrf_score, 6) AS rrf_score FROM rr WHERE rerank_rank <= 3", True),
    "compare_stages": W(
        f"{RERANK}, {fused('f3', 12, 3)}",
        """SELECT query_id, 'lexical' AS stage, rank::INT AS pos, id, round(score, 6) AS score FROM lr WHERE rank <= 3
UNION ALL SELECT query_id, 'vector', rank::INT, id, round(score, 6) FROM vr WHERE rank <= 3
UNION ALL SELECT query_id, 'hybrid', rank::INT, id, round(rrf_score, 6) FROM f3
UNION ALL SELECT query_id, 'reranked', rerank_rank::INT, id, round(rerank_score, 6) FROM rr WHERE rerank_rank <= 3""",
        True,
    ),
    "answerable_gate": W(RERANK, "SELECT query_id, count(*) AS n_hits, count(*) FILTER (WHERE coalesce(bm25_score >= 0.75, false) OR coalesce(vector_score >= 0.05, false)) AS n_answerable FROM rr WHERE rerank_rank <= 3 GROUP BY query_id", True),
    "parse_sections": W(MARKDOWN, f"SELECT id, file, heading, array_to_string(path, ' > ') AS path, len({tok(f'array_to_string(path, {NL}) || {NL} || content')})::INT AS n_tokens, sha256(content) AS content_hash FROM ps"),
    "heading_paths": W(MARKDOWN, "SELECT file, pos::INT AS pos, lvl::INT AS lvl, array_to_string(path, ' > ') AS path FROM ln3 WHERE lvl IS NOT NULL"),
    "slug_numbers": W(MARKDOWN, "SELECT id, pos::INT AS pos FROM ps"),
    "child_bounds": W(CUTS, "SELECT id, idx::INT AS chunk_index, a::INT AS start, b::INT AS stop FROM cuts", True),
    "child_records": W(CHILD, "SELECT chunk_id, source_id, idx::INT AS chunk_index, chunk_count::INT AS chunk_count, length(content)::INT AS n_chars, sha256(embedding_text) AS content_hash FROM child", True),
    "chunk_overlap_check": W(CHILD, "SELECT source_id, idx::INT AS chunk_index, right(was, 150) = left(content, 150) AS shares_overlap FROM (SELECT *, lag(content) OVER (PARTITION BY source_id ORDER BY idx) AS was FROM child) WHERE was IS NOT NULL", True),
    "content_hashes": W(SEC, f"SELECT id, sha256(nfc_normalize(replace(replace(CASE WHEN heading <> '' THEN heading || {NL} || {NL} || content ELSE content END, chr(13) || {NL}, {NL}), chr(13), {NL}))) AS content_hash FROM sec"),
    "file_fingerprints": W(SNAPS, "SELECT path, strlen(content)::BIGINT AS size, 0::BIGINT AS mtime_ns, sha256(content) AS content_hash FROM old"),
    "index_diff": W(SNAPS, "SELECT path, status FROM diff"),
    "index_run_stats": W(SNAPS, "SELECT count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM diff"),
    "index_upsert": W(SNAPS, "SELECT path, sha256(content) AS content_hash FROM old JOIN diff USING (path) WHERE status = 'skipped' UNION ALL SELECT path, sha256(content) FROM new JOIN diff USING (path) WHERE status = 'changed'"),
    "cache_hits": W(CACHE, "SELECT chunk_id, content_hash, 64::INT AS dimension FROM kids WHERE hit"),
    "cache_misses": W(CACHE, "SELECT chunk_id, content_hash FROM kids WHERE NOT hit"),
    "cache_replace": W(CACHE, "SELECT 'ns' AS namespace_fingerprint, chunk_id, content_hash FROM kids UNION ALL SELECT 'other', chunk_id, sha256('old:' || chunk_id) FROM kids"),
    "cache_violations": "SELECT * FROM (VALUES ('duplicate ids', 0::BIGINT), ('wrong dimension', (SELECT count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64)), ('not finite', (SELECT count(*) FROM embeddings WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0)), ('checksum', (SELECT count(*) FROM embeddings WHERE label = 1))) v(\"check\", n)",
    "wiki_lines": W(SEC, f"SELECT file, id, '- [' || id || '] — ' || heading || CASE WHEN p <> '' THEN {NL} || '  - ' || p ELSE '' END AS entry FROM (SELECT *, left(trim(regexp_replace(content, '{SPACES}+', ' ', 'g')), 160) AS p FROM sec)"),
    "wiki_preview": W(SEC, f"SELECT id, left(trim(regexp_replace(content, '{SPACES}+', ' ', 'g')), 160) AS preview FROM sec"),
    "citations_extract": W(ANSWERS, "SELECT query_id, generate_subscripts(cited, 1)::INT - 1 AS pos, unnest(cited) AS cited FROM chk"),
    "citations_valid": W(ANSWERS, f"SELECT query_id, malformed, valid, sha256(CASE WHEN valid THEN answer ELSE '{FALLBACK_ANSWER}' END) AS answer_digest FROM chk"),
    "cited_sources": W(ANSWERS, "SELECT query_id, generate_subscripts(s, 1)::INT - 1 AS pos, unnest(s) AS source FROM (SELECT query_id, list_filter(ranked, lambda x: list_contains(cited, x)) AS s FROM chk WHERE valid)"),
    "source_payload": W(RERANK, "SELECT query_id, id AS source, heading, round(rerank_score, 6) AS score, sha256(content) AS content_digest, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank, rerank_rank::INT AS rerank_rank FROM rr JOIN sec USING (id) WHERE rerank_rank <= 3", True),
    "filename_slug": "SELECT conv_id, turn, coalesce(nullif(trim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 64), '-'), ''), 'answer') AS slug FROM conversations",
    "section_slug": W(SEC, f"SELECT id, {slug('content')} AS slug FROM sec"),
    "manifest_counts": W(CHILD, "SELECT count(*) AS n_chunks, count(DISTINCT source_id) AS n_sections, count(DISTINCT file) AS n_files FROM child", True),
    "child_violations": W(CHILD, "SELECT v.* FROM (VALUES ('empty id', (SELECT count(*) FROM child WHERE chunk_id = '' OR source_id = '')), ('long id', (SELECT count(*) FROM child WHERE strlen(chunk_id) > 8192)), ('hash form', 0::BIGINT), ('hash value', 0::BIGINT), ('unsafe path', (SELECT count(*) FROM child WHERE starts_with(file, '/') OR contains(file, '..'))), ('duplicate id', (SELECT count(*) FROM (SELECT chunk_id FROM child GROUP BY chunk_id HAVING count(*) > 1)))) v(\"check\", n)", True),
    "index_compare": W(SNAPS, "SELECT count(*) FILTER (WHERE n.path IS NULL) AS missing, count(*) FILTER (WHERE o.path IS NULL) AS unexpected, count(*) FILTER (WHERE length(o.content) <> length(n.content)) AS different FROM old o FULL JOIN new n ON o.path = n.path"),
    "token_hashes": f"SELECT item_id AS query_id, sha256('[' || array_to_string(list_transform(list_sort(list_distinct(t)), lambda x: '[\"' || x || '\",' || len(list_filter(t, lambda y: y = x)) || ']'), ',') || ']') AS token_hash FROM (SELECT item_id, {tok('text')} AS t FROM benchmark)",
    "index_build": W(
        f"{CORPUS}, {TFIDF.replace(SEC + ',', '')}",
        """SELECT 'sections' AS "table", count(*) AS n FROM sec UNION ALL SELECT 'children', count(*) FROM child UNION ALL SELECT 'stats', 1 UNION ALL SELECT 'postings', count(*) FROM tf
UNION ALL SELECT 'terms', count(*) FROM df UNION ALL SELECT 'child_counts', count(*) FROM ctf UNION ALL SELECT 'child_terms', count(*) FROM cidf UNION ALL SELECT 'child_postings', count(*) FROM ctf""",
        True,
    ),
    "stored_sections": W(SEC, "SELECT file, id, len(tokens)::INT AS n_tokens, sha256(content) AS content_hash FROM sec"),
    "chat_answers": W(
        f"{RERANK}, good AS (SELECT query_id, list(id ORDER BY rerank_rank) AS ids FROM rr WHERE rerank_rank <= 3 AND (coalesce(bm25_score >= 0.75, false) OR coalesce(vector_score >= 0.05, false)) GROUP BY query_id)",
        f"SELECT item_id AS query_id, coalesce(len(ids), 0)::INT AS n_ranked, coalesce(ids[1], '') AS sources, CASE WHEN ids IS NULL THEN '{FALLBACK_ANSWER}' ELSE 'See the source. [Source: ' || ids[1] || ']' END AS final_answer FROM benchmark LEFT JOIN good ON query_id = item_id",
        True,
    ),
    "hybrid_k20": W(f"{BOTH}, {fused('f80', 320, 80)}, {features('f80')}", "SELECT query_id, id, rerank_rank::INT AS rerank_rank, round(rerank_score, 6) AS rerank_score FROM rr WHERE rerank_rank <= 20", True),
    "not_indexed": f"SELECT item_id AS query_id, '{NOT_INDEXED_ANSWER}' AS final_answer, 0::INT AS n_sources, false AS indexed FROM benchmark",
    "k_validation": "SELECT conv_id, turn, coalesce(turn * 5 BETWEEN 1 AND 20, false) AS valid FROM conversations",
    "unit_vectors": "SELECT vec_id AS id, round(embedding[1]::DOUBLE / norm, 6) AS first, 1.0::DOUBLE AS square FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)",
    "child_identities": W(
        CHILD,
        """SELECT chunk_id, sha256(embedding_text) AS content_hash, sha256(to_json({'content': content, 'content_hash': sha256(embedding_text), 'embedding_text': embedding_text, 'file': file, 'heading': heading, 'heading_path': CASE WHEN heading = '' THEN []::VARCHAR[] ELSE [heading] END,
 'heading_prefix_version': 'heading-path-v1', 'id': chunk_id, 'source_id': source_id, 'splitter_version': 'child-v1'})) AS section_hash FROM child""",
        True,
    ),
    "child_parents": W(CHILD, "SELECT chunk_id, source_id AS parent FROM child", True),
    "wiki_files": W(SEC, f"SELECT file, sha256('## ' || file || {NL} || {NL} || string_agg('- [' || id || '] — ' || heading || CASE WHEN p <> '' THEN {NL} || '  - ' || p ELSE '' END, {NL} ORDER BY id) || {NL}) AS digest FROM (SELECT *, left(trim(regexp_replace(content, '{SPACES}+', ' ', 'g')), 160) AS p FROM sec) GROUP BY file"),
    "wiki_sink": W(SEC, "SELECT file, count(DISTINCT file) AS n FROM sec GROUP BY file"),
    "json_index": W(SEC, "SELECT id, len(tokens)::INT AS n_tokens, sha256(content) AS content_hash FROM sec"),
    "cache_sink": "SELECT 'ns' AS namespace_fingerprint, count(*) AS n, min(vec_id::VARCHAR) AS least FROM embeddings WHERE label <> 0 UNION ALL SELECT 'other', count(*), min(vec_id::VARCHAR) FROM embeddings",
    "embedded_children": W(
        f"{SEC}, {FEATURES}, unit AS (SELECT id, n / sqrt(sum(n * n) OVER (PARTITION BY id))::DOUBLE AS v FROM bk), sums AS (SELECT id, sum(v::FLOAT::DOUBLE) AS total FROM unit GROUP BY id)",
        "SELECT id AS chunk_id, 256::INT AS dimension, 'float32-le-v1' AS vector_encoding, CASE WHEN id::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE round(coalesce(total, 0), 4) END AS total FROM sec LEFT JOIN sums USING (id)",
    ),
    "namespaces": r"""SELECT sha256(j) AS fingerprint, j AS canonical_json FROM (SELECT DISTINCT '{"base_url":"http://localhost","distance_strategy":"cosine-similarity","embedding_model":"' || lang || '","metric":"inner-product","normalization":"l2","policy":{"heading_prefix_version":"heading-path-v1","overlap":150,"separators":["\n\n","\n",". "," "],"size":1000,"splitter_version":"child-v1"},"provider_kind":"table","requested_dimension":null,"resolved_dimension":64,"version":1}' AS j FROM documents WHERE lang <> '')""",
    "vector_checks": W(
        f"""{TFIDF}, recs AS (SELECT DISTINCT id, source_id::BIGINT AS s FROM ctf JOIN ctok USING (id)),
given AS (SELECT id, s FROM recs WHERE s % 11 <> 0 UNION ALL SELECT id, s FROM recs WHERE s % 11 <> 0 AND s % 7 = 0)""",
        """SELECT 'duplicate id' AS "check", count(*) AS n FROM (SELECT id FROM given GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT unnest(['empty id', 'duplicate token', 'empty token', 'bad idf']), 0
UNION ALL SELECT 'bad weight', count(*) FROM ctf WHERE length(token) = 4
UNION ALL SELECT 'token outside vocabulary', count(*) FROM ctf WHERE length(token) = 6
UNION ALL SELECT 'weights without record', count(*) FROM ctf JOIN recs USING (id) WHERE s % 11 = 0
UNION ALL SELECT 'wrong norm', count(*) FROM given WHERE s % 13 = 0""",
        True,
    ),
    "dense_generation": W(f"sc AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)", f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('sc', 3)})"),
    "prompt_json": W(PROMPTS, "SELECT query_id, prompt FROM pr", True),
    "segment_bm25": W(AFTER(lexical(0.25)), f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('lex')})"),
    "segment_cosine": W(AFTER(COSINE), f"SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM ({top('kids')})", True),
    "segment_terms": W(AFTER(CORPUS), "SELECT token, df, round(idf, 6) AS idf FROM idf"),
    "segment_totals": W(AFTER(TFIDF), "SELECT (SELECT count(*) FROM sec) AS n_sections, (SELECT round(avg(len(tokens)), 6) FROM sec) AS avg_len, (SELECT count(DISTINCT file) FROM sec) AS n_files, (SELECT count(*) FROM child) AS n_children", True),
    "segment_files": W(SNAPS, "SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS content_hash FROM new"),
    "stream_reindex": W(AFTER(CORPUS), "SELECT id, len(tokens)::INT AS n_tokens, sha256(content) AS content_hash FROM sec"),
    "segment_candidates": W(AFTER(f"{CORPUS}, {QTOK}"), "SELECT query_id, count(*) AS n_matches, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT query_id, id FROM qt JOIN tf USING (token)) GROUP BY query_id"),
}
ORACLE_SQL["dense_ball_topk"] = ORACLE_SQL["dense_ip_topk"]
