"""Operators by themselves: round trips, brute force, and behaviour that the queries' digests don't show."""

import itertools
import random
import zipfile

import numpy as np
import pytest

from quillspark.llm import byte_bpe, html_extract, media, ngram_join, quality_ranking, quality_rules, sharding, token_ids, toxicity
from quillspark.llm.common import new_path, table

# token ids


@pytest.mark.parametrize("bits", [5, 8, 18])
def test_code_lengths_are_the_best_of_their_limit(bits):
    counts = np.array([0, 50, 1, 1, 2, 3, 5, 8, 13, 21, 0, 34])
    lengths = token_ids.code_lengths(counts, bits)
    used = counts > 0
    assert (lengths[~used] == 0).all() and lengths.max() <= bits and sum(2.0 ** -lengths[used].astype(float)) <= 1
    if bits == 18:  # plain Huffman
        heap, cost = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert cost == int((lengths * counts).sum())


def test_limit_below_the_alphabet_is_an_error():
    with pytest.raises(ValueError):
        token_ids.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("docs", [[0], [1], [5, 0, 300, 128, 129, 1], [3000]])
def test_blocks_round_trip(docs):
    n = np.array(docs)
    ids = (np.random.default_rng(1).zipf(1.4, n.sum()) % 999).astype(np.uint16)
    lengths = token_ids.code_lengths(np.bincount(np.append(ids, [0, 1]), minlength=999))
    raw, first, offsets = token_ids.pack(ids, n, lengths, token_ids.canonical_codes(lengths))
    assert (token_ids.unpack(raw.tobytes(), n, offsets, token_ids.decoding_table(lengths)) == ids).all()
    assert len(raw) == first[-1]


def test_ids_come_back_from_files_and_damage_is_found(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    docs, path = table(spark, sf, "documents", "doc_id", "text"), new_path(spark, "ids")
    token_ids.write_token_ids(docs, path, spec)
    t = Tokenizer.from_str(spec)
    want = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_ids.read_blocks(spark, path).collect()} == want
    blocks = spark.read.parquet(f"{path}/blocks")
    bad = blocks.withColumn("payload_crc32", blocks["payload_crc32"] + 1)
    bad.write.parquet(f"{path}-bad/blocks")
    spark.read.parquet(f"{path}/codebook").write.parquet(f"{path}-bad/codebook")
    with pytest.raises(Exception, match="damaged"):
        token_ids.read_blocks(spark, f"{path}-bad").collect()


def test_very_many_documents_of_one_id_or_none_go_to_many_shards(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "BLOCK_IDS", 20)
    monkeypatch.setattr(token_ids, "SHARD_IDS", 100)
    rows = [(None, f"no id {k}") for k in range(150)] + [(7, "same text")] * 150 + [(k, f"text {k}") for k in range(-20, 60)]
    random.Random(1).shuffle(rows)
    spec, path = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read(), new_path(spark, "ids")
    token_ids.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, spec, 1)
    got = sorted(token_ids.read_blocks(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    t, at = Tokenizer.from_str(spec), 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=key) == sorted(((i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in rows), key=key)
    blocks = spark.read.parquet(f"{path}/blocks").selectExpr("shard", "doc_ids[0] AS a", "doc_ids[size(doc_ids) - 1] AS b").collect()
    assert len({r["shard"] for r in blocks if r["a"] is None}) > 1 and len({r["shard"] for r in blocks if r["a"] == r["b"] == 7}) > 1


def test_encoder_forgets_and_stays_right(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_ids, "MEMO_BYTES", 1 << 13)
    enc = token_ids.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    pick = random.Random(2)
    for _ in range(60):
        texts = [" ".join(pick.choice(["the", "The,", "naïve", "x's", "12", "a-b", "…", "word!!", "ZEBRA.", "über", "ﬁ", "İx"]) + pick.choice(["", "s", ".."]) for _ in range(30)) for _ in range(3)]
        ids, n = enc.encode(texts)
        assert ids.tolist() == [i for t in texts for i in enc.tokenizer.encode(t, add_special_tokens=False).ids] and n.sum() == len(ids)


def test_special_tokens_are_those_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    t, enc = Tokenizer.from_str(spec), token_ids.WordEncoder(spec)
    for text in ("hello <|endoftext|> world <|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <| endoftext |>", "x<|", "<|>", "don't L'ÉTÉ × a÷b"):
        assert enc.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


# byte-level BPE


def bpe_and_own():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_matches_of_any_kind_are_coded_as_they_should(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 1 << 14)
    bpe, own = bpe_and_own()
    pick = random.Random(8)
    letters = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyzABC", k=n))
    texts = [letters(3000), "a" * 5000, "x " + "-" * 5001, "abc" * 1500, "".join(pick.choices(["the", "ing", "tion", "re"], k=1500)), " " * 900 + "x", "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(1500)), letters(257), letters(256), ""]
    for some in (texts, texts[::-1]):
        (ids, n), (raw, m) = bpe.encode(some)
        want = [own.encode_ordinary(t) for t in some]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert raw.tobytes() == "".join(some).encode() and m.tolist() == [len(t.encode()) for t in some]


def test_a_megabyte_of_letters_ends():
    bpe, own = bpe_and_own()
    text = "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    assert bpe.encode([text])[0][0].tolist() == own.encode_ordinary(text)


# toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["abcd", "abcde", "bbcda", "aabbccdde"]
    automaton = toxicity.Automaton(dict.fromkeys(terms, False))
    allowed = {t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0 for t in terms}
    pick = random.Random(4)
    words = {"".join(pick.choice("abcdex") for _ in range(pick.randint(0, 10))) for _ in range(3000)} | {t[:k] + c + t[k + d :] for t in terms for k in range(len(t)) for c in ("", "x", "a") for d in (0, 1)}
    for w in words:
        near = [edits(w, t) for t in terms if edits(w, t) <= allowed[t]]
        got = automaton.match(w)
        assert (got is None) == (not near) and (not near or got[1] == min(near)), w


def test_stems_match_any_ending():
    automaton = toxicity.Automaton({"vequ": True, "moron": False})
    assert automaton.match("vequorama") == ("vequ", 0) and automaton.match("veq") is None and automaton.match("morron") == ("moron", 1)


def trained():
    pick = random.Random(5)
    words = ["tree", "house", "river", "stone", "cloud", "light", "paper", "green"]
    prose = lambda: " ".join(pick.choice(words) for _ in range(30))
    return toxicity.fit([(False, prose()) for _ in range(200)] + [(True, f"{prose()} moron {prose()}") for _ in range(40)] + [(True, f"{prose()} scumbag. {prose()}") for _ in range(40)])


def test_misspelled_terms_are_caught_and_quotations_score_less():
    model = trained()
    bare, quoted, clean = (model.score(f"tree house {x} river stone") for x in ("moron", 'she said "moron" loudly', "cloud"))
    assert bare >= toxicity.REJECT > clean and quoted < bare
    assert all(model.score(f"tree {x} house") > clean for x in ("morron", "mor0n", "m-o-r-o-n", "scumbeg", "SCUMBAGS!"))
    assert model.score("") == pytest.approx(clean) and model.score("paper") == pytest.approx(clean)


def test_words_that_clean_documents_hold_once_tell_by_their_number():
    pick = random.Random(6)
    syllables = {"de": "ach ber ein zu lich sch", "fr": "ré eux qu ell pa ou", "es": "bo men te co jar do"}

    def prose(lang, term, hits):
        words = ["".join(pick.choices(syllables[lang].split(), k=3)) + pick.choice("nrsm") for _ in range(60)]
        return " ".join([*words[:20], *(term + pick.choice(("", "ax", "ib", "um")) for _ in range(hits)), *words[20:]])

    terms = {"de": "wurzgram", "fr": "vilquox", "es": "ruinzat"}
    draw = lambda lang, toxic: prose(lang, terms[lang], pick.randint(2, 6) if toxic else int(pick.random() < 0.2))
    model = toxicity.fit([(toxic, draw(lang, toxic)) for lang in terms for toxic in [True] * 30 + [False] * 150])
    for lang in terms:
        found = {toxic: sum(model.score(draw(lang, toxic)) >= toxicity.REJECT for _ in range(100)) for toxic in (True, False)}
        assert found[True] >= 85 and found[False] <= 3, (lang, found)


def test_telling_words_survive_common_ones_and_stems():
    common = " ".join(f"common{k}" for k in range(350))
    docs = [(False, common)] * 20 + [(True, f"{common} moron")] * 5 + [(True, f"{common} vequorama")] * 5
    bags = toxicity.Bags(docs)
    lexicon = toxicity.learn_lexicon(bags, np.ones(len(docs), bool))
    assert lexicon["moron"] is False and lexicon["vequorama"] is False and not any(w.startswith("common") for w in lexicon)
    assert toxicity.Automaton(lexicon).match("veqourama") == ("vequorama", 2)


def test_terms_are_counted_as_they_stand():
    pick = random.Random(11)
    words = ["".join(pick.choices("abcd", k=pick.randint(2, 7))) for _ in range(40)]
    docs = [(pick.random() < 0.4, " ".join(pick.choices(words, k=pick.randint(0, 60)))) for _ in range(60)]
    bags, which = toxicity.Bags(docs), np.array([pick.random() < 0.7 for _ in docs])
    present, hits = bags.counts(which), bags.counts(which, True)
    for k, t in enumerate(bags.terms):
        own = [sum(t in toxicity.terms_of(w) for w in text.split()) for (_, text), c in zip(docs, which) if c]
        assert present[k] == sum(n > 0 for n in own) and hits[k] == sum(min(n, toxicity.COUNTED) for n in own)
    held = {t for t in {t for w in words for t in toxicity.terms_of(w)} if sum(label and any(t in toxicity.terms_of(w) for w in text.split()) for label, text in docs) >= 2}
    assert set(bags.terms) == held


def test_features_of_a_text_by_brute_force():
    import math

    model = toxicity.fit([(False, f"tree house river w{k}") for k in range(40)] + [(True, f"tree moron x{k}") for k in range(20)] + [(True, f"house scumbagger y{k}") for k in range(20)])
    lexicon = {"moron": 1, "scumbagger": 2}
    pick = random.Random(13)
    for _ in range(300):
        chunks = [pick.choice(["tree", "house", "moron", "morom", "scumbagger", "scumbaggr", "scmbagr", '"moron"', '"said', 'so"', "river,"]) for _ in range(pick.randint(0, 25))]
        x, hits = [0] * 6, []
        for k, chunk in enumerate(chunks):
            word = chunk.strip('",')
            near = [edits(word, t) for t, most in lexicon.items() if edits(word, t) <= most]
            if near:
                before = " ".join(chunks[max(0, k - 8) : k]) + " " + chunk[: chunk.index(word)]
                after = chunk[chunk.index(word) + len(word) :] + " " + " ".join(chunks[k + 1 : k + 9])
                x[1 + 2 * (min(near) > 0) + (before.count('"') % 2 == 1 and '"' in after)] = 1
                hits.append(k)
        x[0], x[5] = 1, math.log1p(max((sum(k - 8 <= j < k for j in hits) for k in hits), default=0))
        assert model.features(" ".join(chunks))[:6].tolist() == pytest.approx(x), chunks


def test_without_labels_nothing_is_toxic():
    assert toxicity.fit([]).score("moron") < toxicity.REJECT


# media


def test_png_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        raw = bytes(range(256)) * 20
        size, payload = media.from_png(media.to_png(raw[:n]))
        assert size == n and payload.rstrip(b" ")[:n] == raw[:n].rstrip(b" ") and len(payload) % 192 == 0 and payload
    broken = bytearray(media.to_png(b"abc"))
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_byte_ranges_share_members_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 3000)
    path = str(tmp_path / "a")
    df = spark.createDataFrame([(k, "x" * k) for k in range(300)], "doc_id long, text string").coalesce(2)
    media.write_archives(df, path)
    reader = media.ArchiveReader(path, media.read_archives(spark, path).schema)
    parts = reader.partitions()
    found = [k for p in parts for b in reader.read(p) for k in b.column(0).to_pylist()]
    assert len(parts) > 4 and sorted(found) == list(range(300))
    assert sorted(r["doc_id"] for r in media.read_archives(spark, path).collect()) == list(range(300))


def test_members_are_tried_again_by_offset(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    media.write_archives(spark.createDataFrame([(k, "x" * k) for k in range(5)], "doc_id long, text string").coalesce(1), path)
    reader = media.ArchiveReader(path, media.read_archives(spark, path).schema)
    real, failed = media.read_member, []

    def flaky(f, member):
        if member.filename.startswith("2-") and len(failed) < 2:
            failed.append(1)
            raise OSError("lost")
        return real(f, member)

    monkeypatch.setattr(media, "read_member", flaky)
    assert [k for p in reader.partitions() for b in reader.read(p) for k in b.column(0).to_pylist()] == list(range(5)) and len(failed) == 2
    (archive,) = [p for p in (tmp_path / "a").iterdir() if p.suffix == ".zip"]
    with zipfile.ZipFile(archive) as z:
        at = z.infolist()[3].header_offset + 60
    raw = bytearray(archive.read_bytes())
    raw[at] ^= 255
    archive.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        [list(reader.read(p)) for p in reader.partitions()]


# n-gram join


def test_rtree_loses_no_pair():
    pick = np.random.default_rng(6)
    base = [pick.integers(0, 1 << 60, 200).astype(np.uint64) for _ in range(30)]
    sets = []
    for b in base:
        for _ in range(8):
            x = b.copy()
            k = pick.integers(0, 40)
            x[:k] = pick.integers(0, 1 << 60, k)
            sets.append(np.unique(x[: pick.integers(150, 201)]))
    n = np.array([len(x) for x in sets])
    tree = ngram_join.RTree(ngram_join.points_of([ngram_join.point(x) for x in sets]), n)
    fine = [np.frombuffer(ngram_join.fine_point(x), np.uint64) for x in sets]
    left = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        if ngram_join.enough(len(np.intersect1d(sets[a], sets[b])), n[a], n[b]):
            assert ngram_join.may_link(fine[a], fine[b], n[a], n[b])
    points = ngram_join.points_of([ngram_join.point(x) for x in sets])
    for a in range(len(sets)):
        found = set(tree.search(points[a], n[a]).tolist())
        linked = {b for b in range(len(sets)) if ngram_join.enough(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])}
        assert linked <= found
        left += len(found)
    assert left < len(sets) ** 2 / 2  # and it does leave many out


def test_pairs_are_given_at_their_first_common_key():
    pick = random.Random(15)
    keys = [np.array(sorted(pick.sample(range(30), pick.randint(1, 9)))) if pick.random() < 0.9 else None for _ in range(40)]
    for key in range(30):
        held = [k for k in range(40) if keys[k] is None or key in keys[k]]
        for q in held:
            found = np.array([k for k in held if k != q], np.int64)
            got = ngram_join.first_common(key, keys, q, found).tolist()
            assert got == [keys[q] is None or keys[f] is None or min(set(keys[q].tolist()) & set(keys[f].tolist())) == key for f in found.tolist()]


def test_fine_points_of_different_widths():
    elements = ngram_join.splitmix(np.arange(900, dtype=np.uint64) * np.uint64(7919))
    sets = [elements[:60], elements[:70], elements[:90], elements[500:560]]
    fine = ngram_join.FinePoints(ngram_join.pa.array([ngram_join.fine_point(x) for x in sets]))
    assert len(set(fine.width.tolist())) > 1
    n = np.array([len(x) for x in sets])
    assert fine.left(np.array([0, 1, 0, 1]), np.array([1, 2, 3, 3]), n).tolist() == [True, True, False, False]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = ["", "one  two\nthree " * 50, " ", "x" * 300 + " y", "four"]
    hashes, at = ngram_join.word_hashes(texts)
    for piece in (1, 7, 64):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        again, there = ngram_join.word_hashes(texts)
        assert (again == hashes).all() and (there == at).all()


def test_no_link_is_lost_where_ids_clash_or_lack(spark):
    from .test_queries import components

    pick = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    base = [pick.choice(words) for _ in range(100)]
    near = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(base))
    other = " ".join(pick.choice(words) for _ in range(40))
    # 5 has two texts that don't link but by way of a row without id, and an empty one
    rows = [(1, near(99)), (5, near(98, 99)), (5, other), (5, ""), (None, near(0)), (None, other), (9, near(0, 1)), (12, other + " more"), (None, None), (7, " ".join(words[:30]))]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, n, c) for i, n, c in components([(i, x, None) for i, x in rows])]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("few,block,carried", [(1, 1024, 64), (1, 2, 64), (1, 1024, 3), (48, 1024, 64)])
def test_blocks_and_trees_give_the_same_components(spark, monkeypatch, few, block, carried):
    from .test_queries import components

    monkeypatch.setattr(ngram_join, "CARRIED_KEYS", carried)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HASHES", 1)
    pick = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    passage = [pick.choice(words) for _ in range(40)]
    rows = []
    for family in range(6):
        base = [pick.choice(words) for _ in range(60)]
        for _ in range(7):
            text = base[:]
            for _ in range(pick.randint(0, 3)):
                text[pick.randrange(len(text))] = pick.choice(words)
            rows.append((len(rows), " ".join(text + (passage if pick.random() < 0.5 else [])), "s"))
    got = ngram_join.linked(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(components(rows))


def test_components_of_long_paths(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 101)]
    got = {r["rep"]: r["label"] for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 103: 100}


# sharding


def test_rebalancing_moves_few_slots_and_keeps_versions(spark):
    pick = random.Random(8)
    sizes = {v: pick.randint(1, 1000) for v in range(sharding.SLOTS)}
    first = sharding.assign(sizes, 40)
    load = lambda m, n: [sum(sizes[v] for v in m if m[v] == s) for s in range(n)]
    assert max(load(first, 40)) < 1.01 * sum(sizes.values()) / 40
    grown = sharding.rebalance(first, sizes, 41)
    moved = sum(first[v] != grown[v] for v in first)
    assert max(load(grown, 41)) < 1.03 * sum(sizes.values()) / 41 and moved < 2 * sharding.SLOTS / 41 + 80
    assert set(sharding.rebalance(grown, sizes, 30).values()) == set(range(30))
    path = new_path(spark, "map")
    sharding.store_map(spark, path, first, 1)
    assert sharding.rebalanced(spark, path, sizes, 41) == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sharding.store_map(spark, path, grown, 2)
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path).collect()} == grown
    assert {r["vslot"]: r["shard"] for r in sharding.load_map(spark, path, 1).collect()} == first


def test_rebalancing_evens_out_the_first_map():
    pick = random.Random(9)
    sizes = {v: int(pick.paretovariate(1.5) * 1000) for v in range(sharding.SLOTS)}
    edited = sharding.rebalance({v: v % 40 for v in range(sharding.SLOTS)}, sizes, 40, slack=0.0, even=True)
    load = [sum(sizes[v] for v in edited if edited[v] == s) for s in range(40)]
    assert max(load) <= max(1.01 * sum(sizes.values()) / 40, max(sizes.values()))


def test_equal_rows_of_one_slot_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    docs = spark.createDataFrame([(None, "same")] * 200 + [(k, "x" * k) for k in range(50)], "doc_id long, text string").repartition(8)
    rows = sharding.written(sharding.sized(docs), "sizes")
    sums = sharding.slot_bytes(rows)
    mapping = spark.createDataFrame([(v, v % 3) for v in range(sharding.SLOTS)], sharding.MAP)
    got = sharding.placed(rows, mapping, {v: n for v, (_, n) in sums.items()}).collect()
    assert len(got) == 250
    for s in range(3):
        of = sorted(r["slot"] for r in got if r["shard"] == s)
        assert of == list(range(len(of)))


# html


def pages_of(*bodies):
    return [html_extract.stream(html_extract.parse(f"<html><body>{b}</body></html>")) for b in bodies]


def test_wrapper_has_groups_options_and_slots():
    w = html_extract.infer(pages_of("<nav>same</nav><div class=x><h2>a</h2><p>b</p></div>", "<nav>same</nav><div class=x><h2>c</h2><p>d</p><p>e</p></div><div class=y>f</div>"))
    assert str(w) == "<#page><html><body><nav>text</><div.x><h2>#text</>(<p>#text</>)+</>(<div.y>text</>)?</></></>"


def test_repeated_runs_of_several_parts_fold():
    one = "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"
    assert "(<dt>text</>)+(<dd>text</>)+" in str(html_extract.infer(pages_of(one, one)))
    assert "(<dt>text</>)+(<dd>#text</>)+" in str(html_extract.infer(pages_of(one, one.replace("f", "g"))))


def test_boilerplate_goes_and_prose_stays():
    page = """<body><div id="top-menu"><a href=x>Home</a> <a href=y>About</a></div><div class="cookie-notice">We use cookies</div>
    <div class="story"><h1>T</h1><p>First <i>para</i>graph with  text.</p><ul><li>one<li>two</ul><form><input>Search</form><p>Second &lt;b&gt;.</p>
    <div class="comments"><p>I disagree, at some length, with all of this and more</p></div></div><aside>Related things</aside><footer>(c)</footer>"""
    assert html_extract.extract(page, None) == "T First paragraph with text. one two Second <b>."


def test_a_wrapper_that_does_not_fit_gives_way():
    known = {"path": ["#page", "html", "body", "div.gone"], "usual": 9, "goes": [], "constant": []}
    assert html_extract.extract("<body><article><p>text</p></article></body>", known) == "text"


def test_every_template_of_a_host_keeps_its_article(spark):
    """A host whose many pages have the article in div.content, and few in div.story beside a teaser in div.content."""
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    legal = f"<div class=legal>{text('legal', 200)}</div>"
    want = {k: text(k, 60) for k in range(300)}
    rare = [k for k in want if k % 100 == 7]
    html = {k: f"<body><div class=content><p>{t}</p></div>{legal}</body>" for k, t in want.items()}
    html |= {k: f"<body><div class=content><p>teaser {k}</p></div><div class=story><p>{want[k]}</p></div>{legal}</body>" for k in rare}
    # the same containers, the article in the other one
    html |= {k + 1: f"<body><div class=content><p>{want[k + 1]}</p></div><div class=story><p>teaser</p></div>{legal}</body>" for k in rare[:1]}
    pages = spark.createDataFrame([(k, f"http://hot.example/{k}", h) for k, h in html.items()], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()} == want


@pytest.mark.parametrize("depth", [70, 20_000])
def test_articles_below_many_wrappers_are_found(depth):
    body = "<div class=content><p>teaser</p></div>" + "<div>" * depth + "<div class=story><p>the article itself</p></div><div class=more>more</div>"
    assert html_extract.extract(f"<body>{body}</body>", None) == "the article itself"
    same = html_extract.infer(pages_of(body, body))
    assert str(same).count("<div>") == depth and html_extract.article_path(same)[-1] == "div.story"
    assert str(html_extract.loaded(html_extract.dumped(same))) == str(same)


def test_alignment_is_a_common_run_and_takes_what_is_alone():
    pick = random.Random(12)
    for size in (5, 40, 200):
        for _ in range(60):
            x, y = ([pick.choice("abcdefghijklmnopqrstuvwxyz") + str(pick.randint(0, size // 8)) for _ in range(pick.randint(0, size))] for _ in range(2))
            y = y if pick.random() < 0.5 else [v for v in x if pick.random() < 0.8]
            pairs = html_extract.in_step(x, y)
            assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert len(html_extract.in_step(list("abcxdef"), list("abcdef"))) == 6
    wide = [f"k{k}" for k in range(50_000)]
    assert len(html_extract.in_step(wide, wide[::2] + ["new"])) == 25_000 and html_extract.in_step(wide, wide[::-1])


def story(k, n, word="w"):
    return " ".join(f"{word}{k}x{i}" for i in range(n))


@pytest.mark.parametrize("article", ["article", "div class=c7", "section"])
def test_slots_decide_without_names(spark, monkeypatch, article):
    """Menu, advert, legal text and footer of no telling names: the wrapper's slots alone tell the story."""
    monkeypatch.setattr(html_extract, "HINTS", frozenset())
    legal = f"<div class=c5><p>{story('legal', 90)}</p><p>{story('more', 90)}</p></div>"
    page = lambda k: f"<body><div class=c1><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></div><div class=c2>offer {k} today</div><{article}><h1>Title {k}</h1><p>{story(k, 40)}</p><p>{story(-k, 30)}</p></{article.split()[0]}>{legal}<div class=c6>&copy; {k} all</div></body>"
    pages = spark.createDataFrame([(k, "http://h.example/x", page(k)) for k in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()}
    assert got == {k: f"Title {k} {story(k, 40)} {story(-k, 30)}" for k in range(12)}


def test_the_wrapper_changes_what_a_page_gives():
    bodies = [f"<div class=a><p>{story('legal', 60)}</p></div><div class=b><p>{story(k, 25)}</p></div>" for k in range(6)]
    wrapper = html_extract.infer(pages_of(*bodies))
    known = html_extract.decide(wrapper, 6)
    assert known["path"][-1] == "div.b" and len(known["constant"]) == 1
    page = f"<html><body>{bodies[0]}</body></html>"
    assert html_extract.extract(page, known) == story(0, 25) and html_extract.extract(page, None) != story(0, 25)


def test_short_articles_and_constant_blocks_inside():
    bodies = [f"<div class=c><p>{story(k, 50 if k else 1)}</p><div class=x>Read it in our app</div></div><div class=y>{story(k, 8, 'ad')}</div>" for k in range(5)]
    known = html_extract.decide(html_extract.infer(pages_of(*bodies)), 5)
    got = [html_extract.extract(f"<html><body>{b}</body></html>", known) for b in bodies]
    assert got == [story(k, 50 if k else 1) for k in range(5)]


def test_equal_articles_of_a_template_stay():
    bodies = [f"<div class=ad>offer {story(k, 4)}</div><article><h1>T</h1><p>{story('same', 50)}</p></article>" for k in range(4)]
    known = html_extract.decide(html_extract.infer(pages_of(*bodies)), 4)
    assert html_extract.extract(f"<html><body>{bodies[0]}</body></html>", known) == f"T {story('same', 50)}"


def test_wide_pages_take_little_memory_and_time():
    import time
    import tracemalloc

    bodies = ["".join(f"<section class={c}{''.join(pick.choices('abcdefghij', k=6))}>t{k}</section>" for k in range(8000)) for c, pick in (("p", random.Random(1)), ("q", random.Random(2)))]
    bodies = [*bodies, *bodies]
    tracemalloc.start()
    began = time.time()
    wrapper = html_extract.infer(pages_of(*bodies))
    assert tracemalloc.get_traced_memory()[1] < 120e6 and time.time() - began < 60
    tracemalloc.stop()
    assert len(wrapper.parts[0].parts[0].parts) >= 16_000


# quality


def test_js_distance(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias(str(k)) for k, (p, q) in enumerate((([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 1.0], [1.0, 1.0])))]).first()
    m, p, q = [0.625, 0.375], [0.75, 0.25], [0.5, 0.5]
    js = sum((sum(a * np.log2(a / b) for a, b in zip(x, m)) / 2) for x in (p, q))
    assert list(row) == pytest.approx([0, 1, 0, np.sqrt(js)])


def test_junk_is_rejected_and_prose_kept(spark):
    pick = random.Random(9)
    words = ["the", "of", "and", "to", "in"] + ["".join(pick.choice("abcdefghijklmnoprstu") for _ in range(pick.randint(4, 9))) for _ in range(500)]
    prose = lambda: " ".join(pick.choice(words[:5]) if pick.random() < 0.4 else pick.choice(words) for _ in range(150)) + "."
    rows = [(k, prose(), "en") for k in range(60)]
    rows += [(100, prose().upper(), "en"), (101, " | ".join(prose().split()), "en"), (102, " ".join(f"{w}%%%" for w in prose().split()), "en"), (103, "spam " * 200, "en"), (104, "too short", "en")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k in range(60)) and not any(got[k] for k in range(100, 105))


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_each_language_has_its_own_reference_and_small_ones_none(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_LANGUAGES", broadcast, raising=False)
    pick = random.Random(7)
    prose = lambda *words: " ".join(pick.sample(words * 10, k=10 * len(words)))
    rows = [(k, prose("the", "of", "and", "house", "river", "stone"), "en") for k in range(60)]
    rows += [(1000 + g, prose("και", "το", "να", "σπίτι", "ποτάμι", "πέτρα"), "el") for g in range(4)]  # 240 words in all
    many = [(2000 + 40 * n + k, prose(f"q{n}", f"z{n}", "мост", "вода", "поле", "дерево"), f"l{n}") for n in range(205) for k in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows + many, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows + many) and [k for k, kept in got.items() if not kept] == []


def test_ranking_prefers_what_labels_prefer():
    pick = random.Random(10)
    prose = lambda: " ".join(pick.choice(["tree", "house", "river", "stone", "cloud"]) + str(pick.randint(0, 99)) for _ in range(40))
    model = quality_ranking.fit([(True, prose()) for _ in range(60)] + [(False, prose().upper() + "!!") for _ in range(20)])
    assert model.score(prose()) > 0.5 > model.score(prose().upper() + "!!")
    assert quality_ranking.fit([]).score("x") == 0.5 and 0 <= model.score("") <= 1


def test_ranking_is_the_best_of_its_loss_and_cuts_at_the_quantile():
    pick = random.Random(14)
    prose = lambda n: " ".join(pick.choice(["tree", "house", "river", "stone", "cloud"]) + str(pick.randint(0, 99)) for _ in range(n))
    docs = [(True, prose(pick.randint(20, 60))) for _ in range(70)] + [(False, prose(pick.randint(5, 40)) + "!" * pick.randint(0, 9)) for _ in range(30)]
    model = quality_ranking.fit(docs)
    x = model.design(np.array([quality_ranking.features(t) for _, t in docs]))
    good, bad = x[:70], x[70:]
    rng, n = np.random.default_rng(quality_ranking.SEED), quality_ranking.EACH * 70
    a, b = (np.concatenate([rng.permutation(k) for _ in range(-(-n // k))])[:n] for k in (70, 30))
    d = good[a] - bad[b]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality_ranking.RIDGE / len(docs) * (w @ w) / 2
    best = loss(model.weights)
    assert all(loss(model.weights + 0.02 * rng.standard_normal(len(model.weights))) >= best - 1e-9 for _ in range(200))
    assert sum(model.score(t) < 0.5 for _, t in docs) == 30
