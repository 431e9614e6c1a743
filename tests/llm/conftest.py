import datetime as dt
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LONG = "the quick brown fox jumps over the lazy dog, again. " * 400 + "x" * 5000 + " end\n" + "line of words here\n" * 50


def documents():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies; and columns whose names operators use."""
    texts = [None, "", "  \n\t ", LONG, "one two three", "Naïve café – 東京 😀 don't stop", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z", "you moron, you utter moron", LONG, "<|endoftext|> x  y\x1cz \r\n tab\tend "]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", None][k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "an id is missing here", "en", "s1", 3), (None, None, None, None, None)]
    extra = {n: ["?"] * len(rows) for n in ("score", "n", "key", "words", "rep", "label", "size", "row", "vslot")}
    schema = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    return pa.table({**{name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(schema)}, **extra})


def labels():
    return pa.table({"doc_id": pa.array([0, 3, 4, 5, 6, 8, 9, None, 999], pa.int64()), "quality": pa.array([0, 1, 1, 1, None, 0, 1, 1, 0], pa.int32()), "toxic": pa.array([0, 0, 0, 0, None, 1, 0, 1, 1], pa.int32()), "score": ["?"] * 9})


def pages():
    html = [None, "", "no tags & <b>none</b>", "<html><body><nav>menu</nav><article><p>a  b<p>c&eacute;</article></body>", "<p>" * 3000 + "deep" + "</p>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000, "<article>" + "<p>word word</p>" * 3000 + "</article>"]
    return pa.table({"page_id": pa.array([1, 2, None, 4, 5, 6, 7], pa.int64()), "url": ["http://a.x/1", "http://a.x/2", "http://a.x/3", None, "//b.y/p?q", "not a url", "http://a.x/4"], "html": html, "host": ["?"] * 7, "path": ["?"] * 7, "text": ["?"] * 7})


def others():
    """Items, clicks and sales: nulls, repeated rows, and columns whose names operators use."""
    at = [dt.datetime(2024, 1, 1, h) for h in (0, 1, 7)]
    extra = {n: ["?"] * 4 for n in ("key", "s", "e", "n", "cls", "item")}
    return {
        "benchmark": pa.table({"item_id": pa.array([1, 1, None, 4], pa.int64()), "text": ["one two", "one two", "moron don't", None], **extra}),
        "clicks": pa.table({"client_id": pa.array([1, 1, None, 2], pa.int64()), "ts": pa.array([at[0], at[0], at[1], None], pa.timestamp("us")), "kind": ["error", None, "x", "x"], **extra}),
        "sales": pa.table({"sale_id": pa.array([1, 1, None, 4], pa.int64()), "client_id": pa.array([1, 1, 1, None], pa.int64()), "status": ["open", "open", None, "done"], "sold_at": pa.array([at[0], at[0], at[1], at[2]], pa.timestamp("us")), **extra}),
        "sale_lines": pa.table({"sale_id": pa.array([1, None, 4, 9], pa.int64()), "shipped_at": pa.array([at[2], at[2], None, at[0]], pa.timestamp("us")), **extra}),
    }


def _save(folder, empty):
    for name, t in (("documents", documents()), ("labels", labels()), ("pages", pages()), *others().items()):
        pq.write_table(t.slice(0, 0) if empty else t, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return _save(tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return _save(tmp_path_factory.mktemp("empty"), True)


@pytest.fixture(scope="session")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
