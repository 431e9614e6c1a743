r"""Quality rules (op 8): distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of its language's commonest words are compared with those of the language
(summed over all documents) by the Jensen-Shannon distance (base 2, 0 to 1). A document is rejected if a distance is above

    CHAR_LIMIT                               for character classes, from MIN_CHARS characters on
    WORD_LIMIT + WORD_NOISE / sqrt(n_words)  for words, from MIN_WORDS words on: short texts stray further by chance

and, before that, by the base rules: fewer than 20 words, or over 30 % of the words in 8-word windows found twice or more.

References: one per language with at least MIN_REFERENCE words, however many; up to BROADCAST_LANGUAGES are broadcast, more are joined
by a shuffle. Documents of smaller languages have distances 0, so only the base rules judge them.

Repeated windows are found within each row: the hashes of a document's windows are sorted, and equal neighbours mark their places.
Nothing but the references' counts is shuffled, up to that bound: words are counted per language before they move.

Defined results: a null text has no words, so fails the base rules; a null language is a language of its own; a very long text is
judged whole, in one row; of equally common words the first by code points count; repeated rows are judged alike; an empty
table gives no rows; extra columns are handed on by judged() and otherwise not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, dropped, table, written

MIN_WORDS_BASE, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_CHARS, MIN_WORDS, CHAR_LIMIT, WORD_LIMIT, WORD_NOISE = 100, 50, 0.30, 0.22, 0.6
#: Commonest words per language (bins of the histogram; all others are one more), least words of a language with a reference, references broadcast at most.
COMMON, MIN_REFERENCE, BROADCAST_LANGUAGES = 12, 2000, 10_000
#: Character classes, taken out of the text one after the other; what is left is a class too.
CLASSES = {"lower": "[a-z]+", "space": WORD_SPLIT, "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "punct": r"[!-/:-@\[-`{-~]+"}


def _length(c):
    return F.length(c).cast("long")


def _words(text="text"):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def _chars(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with columns that serve the counts of CLASSES and of the rest, and these counts."""
    out, last, counts = docs.withColumn("_t", F.coalesce("text", F.lit(""))), "_t", []
    for name, pattern in CLASSES.items():
        out = out.withColumn(f"_{name}", F.regexp_replace(last, pattern, ""))
        counts.append(_length(last) - _length(f"_{name}"))
        last = f"_{name}"
    return out, [*counts, _length(last)]


def measured(docs: DataFrame) -> DataFrame:
    """docs with: words, chars (counts of CLASSES and the rest), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    out, counts = _chars(docs)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.select(*docs.columns, F.array(*counts).alias("chars"), _words("_t").alias("words"), lines.alias("_lines"))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, window_hashes(F.col("words"))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_hashes", hashes)
    repeats = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), repeated_words(F.col("_hashes"))).otherwise(F.lit(0))
    chars = F.col("chars")
    return out.select(*docs.columns, "chars", "words", n.cast("long").alias("n_words"), (F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x) - chars[1]).alias("word_chars"), chars[4].alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"))


def window_hashes(words):
    """A hash of each window of WINDOW (a power of two) words, from those of windows of half its width."""

    def doubled(width):
        def run(h):
            n = F.size(h) - width
            return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + width, n), lambda x, y: F.xxhash64(x, y))

        return run

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        hashes = F.transform(F.array(hashes), doubled(width))[0]  # bound to a lambda variable, so it's made once
        width *= 2
    return hashes


def repeated_words(hashes):
    """Words in windows whose hash occurs twice or more. Each array is bound to a lambda variable, so it's made once."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def starts(s):
        n = F.size(s)
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p):
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(p, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

    return F.transform(F.transform(F.array(F.sort_array(placed)), starts), covered)[0]


def references(docs: DataFrame) -> DataFrame:
    """(ref, all, ref_chars, best) per language of docs (text, lang) with enough words: sums of words and chars, and its commonest words."""
    words = docs.select(F.col("lang").alias("ref"), F.explode(_words()).alias("word"))
    counts = words.groupBy("ref", "word").agg(F.count("*").alias("n"))  # before lower-casing: as exact, and on fewer strings
    counts = written(counts.groupBy("ref", F.lower("word").alias("word")).agg(F.sum("n").alias("n")), "word-counts")
    all_ = counts.groupBy("ref").agg(F.sum("n").alias("all")).where(F.col("all") >= MIN_REFERENCE)
    order = Window.partitionBy("ref").orderBy(F.desc("n"), "word")
    best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= COMMON)
    best = best.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("best"))
    rows, chars = _chars(docs.select("text", F.col("lang").alias("ref")))
    sums = rows.select("ref", *[c.alias(f"c{i}") for i, c in enumerate(chars)]).groupBy("ref").agg(F.array(*[F.sum(f"c{i}") for i in range(len(chars))]).alias("ref_chars"))
    found = written(all_.alias("t").join(best.alias("b"), F.expr("t.ref <=> b.ref")).join(sums.alias("s"), F.expr("t.ref <=> s.ref")).select("t.ref", "t.all", "ref_chars", "best"), "references")
    dropped(counts)
    return found


def js_distance(p, q):
    """Of two arrays of counts; 0 where either has none."""
    total_p, total_q = (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) for x in (p, q))
    shares = F.zip_with(p, q, lambda x, y: F.struct((x / F.greatest(total_p, F.lit(1.0))).alias("p"), (y / F.greatest(total_q, F.lit(1.0))).alias("q")))

    def part(x, s):
        return F.when(x > 0, x * F.log2(x * 2 / (s["p"] + s["q"]))).otherwise(0.0)

    total = F.aggregate(shares, F.lit(0.0), lambda a, s: a + part(s["p"], s) + part(s["q"], s))
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(total / 2, F.lit(0.0)))).otherwise(0.0)


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang and any others) with the measures, char_distance, word_distance, base_failed and kept."""
    rows = measured(docs)
    refs = references(docs.select("text", "lang"))
    words = F.transform("best", lambda b: b["word"])
    counts = F.transform("best", lambda b: b["n"].cast("double"))
    rest = F.col("all").cast("double") - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    refs = refs.select("ref", F.transform("ref_chars", lambda x: x.cast("double")).alias("ref_chars"), F.coalesce(words, F.array().cast("array<string>")).alias("common"), F.coalesce(F.concat(counts, F.array(rest)), F.array(F.col("all").cast("double"))).alias("ref_words"))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    rows = rows.alias("r").join(refs.alias("f"), F.expr("r.lang <=> f.ref"), "left").select("r.*", "f.ref_chars", "f.common", "f.ref_words")
    # each word stands between two spaces of its own; taking one out shortens the text by its length and 2 (in bytes)
    rows = rows.withColumn("_spaced", F.concat(F.lit(" "), F.lower(F.array_join("words", "  ")), F.lit(" ")))
    found = F.transform("common", lambda w: ((F.octet_length("_spaced") - F.octet_length(F.replace(F.col("_spaced"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("double"))
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_hist", F.concat("_found", F.array(F.col("n_words").cast("double") - F.aggregate("_found", F.lit(0.0), lambda a, x: a + x))))
    rows = rows.withColumn("char_distance", F.coalesce(js_distance(F.transform("chars", lambda x: x.cast("double")), F.col("ref_chars")), F.lit(0.0))).withColumn("word_distance", F.coalesce(js_distance(F.col("_hist"), F.col("ref_words")), F.lit(0.0)))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    base_failed = (F.col("n_words") < MIN_WORDS_BASE) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    strays = ((n_chars >= MIN_CHARS) & (F.col("char_distance") > CHAR_LIMIT)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > F.lit(WORD_LIMIT) + F.lit(WORD_NOISE) / F.sqrt("n_words")))
    return rows.select(*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", base_failed.alias("base_failed"), (~base_failed & ~F.coalesce(strays, F.lit(False))).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject.

    A filter is otherwise pushed below the measures and repeats their whole expressions, one within the other; it isn't
    where a column beside them (the row's place) is not deterministic and takes part in the condition.
    """
    rows = judged(docs).select(*docs.columns, "kept", F.monotonically_increasing_id().alias("_place"))
    return rows.where("kept AND _place >= 0").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
