"""Scalar text functions as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that search ignores.
STOP_WORDS = ("a", "an", "and", "are", "can", "do", "does", "for", "from", "how", "i", "is", "it", "my", "of", "the", "to", "what", "when", "which")
#: Fixed value: the least score to answer from, by ranker.
MIN_LEXICAL_SCORE, MIN_VECTOR_SCORE = 0.75, 0.05

#: Unicode white space, as a Java character class.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """Lower-cased runs of a-z and 0-9 without stop words, in order, with repeats."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def section_slug(heading) -> Column:
    slug = F.regexp_replace(F.lower(_col(heading)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def file_slug(text, most: int = 64) -> Column:
    """For file names: like a section's, at most so many characters, never empty."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, most), "^-+|-+$", "")
    return F.when(slug == "", F.lit("answer")).otherwise(slug)


def normalize_newlines(text) -> Column:
    return F.replace(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no normalizer, so texts go through Arrow, but only those with characters from U+0300 on: all before are as they are."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def normalize(text) -> Column:
    """Line ends as LF and Unicode NFC."""
    return nfc(normalize_newlines(text))


def strip(text) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(_col(text), f"^{SPACE}+|{SPACE}+$", "")


def heading_context(path, heading=None) -> Column:
    """The non-empty parts of a heading path joined by ' > ', in NFC; the heading itself if none is left."""
    parts = F.filter(F.transform(_col(path), lambda p: strip(normalize_newlines(p))), lambda p: p != "")
    joined = F.concat_ws(" > ", parts)
    return nfc(joined if heading is None else F.when(F.size(parts) > 0, joined).otherwise(strip(normalize_newlines(heading))))


def embedded_text(context, content) -> Column:
    return F.when(_col(context) != "", F.concat(_col(context), F.lit("\n\n"), _col(content))).otherwise(_col(content))


def content_hash(text) -> Column:
    return F.sha2(_col(text), 256)


def preview(content, most: int = 160) -> Column:
    """White space runs as one space, cut."""
    return F.substring(strip(F.regexp_replace(_col(content), f"{SPACE}+", " ")), 1, most)


def expanded_terms(tokens) -> Column:
    """Distinct tokens, and those of over three letters that end in s also without it."""
    tokens = _col(tokens)
    singular = F.transform(F.filter(tokens, lambda t: t.endswith("s") & (F.length(t) > 3)), lambda t: F.left(t, F.length(t) - 1))
    return F.array_distinct(F.concat(tokens, singular))


def bounded(score) -> Column:
    """x / (1 + x); 0 where x is null, not positive or not finite."""
    x = _col(score)
    return F.when((x > 0) & (x < F.lit(float("inf"))), x / (F.lit(1.0) + x)).otherwise(0.0)


def hash_features(tokens) -> Column:
    """Tokens, their singulars, and pairs of neighbours joined by '_'."""
    t = _col(tokens)
    singular = F.transform(F.filter(t, lambda x: x.endswith("s") & (F.length(x) > 3)), lambda x: F.left(x, F.length(x) - 1))
    after = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), after, lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(t, singular, pairs)


def hash_bucket(feature, dimension: int = 256) -> Column:
    """The first four bytes of SHA-256, big-endian, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(_col(feature), 256), 1, 8), 16, 10).cast("long") % dimension).cast("int")


def inner_product(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector) -> Column:
    """In double, divided by its norm; a zero vector stays; a value that isn't finite is an error."""
    v = _col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(bad, F.raise_error(F.lit("vector values must be finite"))).otherwise(F.transform(v, lambda x: (x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))))


def parent_of(child_id) -> Column:
    """What stands before the last '::chunk-'."""
    return F.regexp_replace(_col(child_id), "::chunk-(?!.*::chunk-).*$", "")


def token_hash(tokens) -> Column:
    """SHA-256 of the compact JSON of sorted [token, count] pairs."""
    t = _col(tokens)
    pairs = F.transform(F.array_sort(F.array_distinct(t)), lambda x: F.concat(F.lit('["'), x, F.lit('",'), F.size(F.filter(t, lambda y: y == x)).cast("string"), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")), 256)
