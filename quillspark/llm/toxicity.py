"""Toxicity (op 2): a learned lexicon as a trie, intersected with Levenshtein automata, and context windows around each hit.

Lexicon: words and word beginnings (stems, four letters or more) that labelled toxic documents have and others don't, chosen greedily
until they cover the toxic documents. Automaton: the trie's nodes with the edits spent so far are the states; they are determinised
as words are run, so a word leaves after the few letters that tell it from every term. Terms of 5 letters allow one edit,
of 9 two; stems and short terms none. Spellings with digits for letters or with marks inside count as one edit.

Suspects: words and stems that clean documents hold too, but less often. Each weighs the logarithm of how much oftener toxic documents
hold it, by number; every hit counts, as clean documents hold them once and toxic ones several times.

Context: a hit is quoted if a quotation is open at its word, within WINDOW words; further hits in its window add to it. A logistic
model over (exact, near) x (bare, quoted) hits, the densest window, and the weight of all suspects in the text and in its heaviest window
is fitted with prior weights that hold where labels tell nothing. It is fitted on documents that its lexicon and suspects weren't learned
from (FOLDS), then given those of all documents.

Labels are learned from a bounded sample, never from held-out rows: SAMPLE labelled documents in order of their ids' digests, less
those that would take the sample beyond SAMPLE_BYTES of text. Nothing else is bounded; the lexicon holds what the sample gives.
Defined results: null or empty text has no hits and gets the base score; a very long text is scored whole, its words one after the
other; of an id with several texts the least is learned from; terms that tell alike are chosen by length, then code points; repeated
rows score alike; without labels of both kinds the lexicon is empty; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, held_out, release, table
from .units import gathered, slices

#: Labelled documents to learn from and bytes of their texts, at most; words on each side of a hit, least score to reject, cost of a false alarm in the lexicon's choice.
SAMPLE, SAMPLE_BYTES, WINDOW, REJECT, FALSE = 6000, 64 << 20, 8, 0.7, 20
#: Words a worker remembers the hits of, beyond which it starts anew.
CACHED = 200_000
MARKS = ".,;:!?\"'()[]{}<>«»“”„‘’…*_~`|/\\#%&+=-–—"
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
OPENING, CLOSING = "«“„‘", "»”’"
#: Weights before any label is seen, and how strongly they are held: bias, exact, exact quoted, near, near quoted, density, suspects, suspects in a window.
PRIOR, HOLD = np.array([-3.0, 4.5, 1.5, 2.5, 0.5, 1.0, 0.0, 0.0]), 0.5
#: Suspects: how much oftener toxic documents hold one, hits counted per document, documents' worth of doubt, least toxic documents; folds to fit on.
OFTENER, COUNTED, DOUBT, LEAST, FOLDS = 3.0, 8, 2.0, 3, 3


class Automaton:
    """Words within the allowed edits of a term. match(word): (term, edits) or None."""

    def __init__(self, terms: dict[str, bool]):
        """terms: term -> whether it is a stem, that any letters may follow."""
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, int, bool] | None] = [None]
        self.most = [0]
        for term, stem in terms.items():
            edits = 0 if stem else 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            if self.term[node] is None or stem:
                self.term[node] = (term, edits, stem)
        self.letters = {c for x in self.children for c in x}
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.always: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        todo, seen = list(nodes), set(nodes)
        while todo:  # a letter of the term that the word lacks
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.most[child] and (child, e + 1) not in seen:
                    seen.add((child, e + 1))
                    todo.append((child, e + 1))
        key = frozenset(x for x in seen if not any((x[0], e) in seen for e in range(x[1])))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = sorted((e, *self.term[n]) for n, e in key if self.term[n] and e <= self.term[n][1])
            self.accepts.append((ends[0][1], ends[0][0]) if ends else None)
            stems = [x for x in ends if x[3]]
            self.always.append((stems[0][1], stems[0][0]) if stems else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            for letter, child in self.children[node].items():
                if letter != c and e < self.most[child]:
                    out.add((child, e + 1))
            if e < self.most[node]:
                out.add((node, e + 1))
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        state, stem = self.start, None
        for c in word:
            if c not in self.letters:
                c = ""  # one stands for all letters that no term has
            to = self.next[state].get(c)
            if to is None:
                to = self.next[state][c] = self._step(state, c)
            if to < 0:
                return stem
            state = to
            stem = stem or self.always[state]
        return self.accepts[state] or stem


def plain(chunk: str) -> str:
    return chunk.strip(MARKS)


class Scorer:
    def __init__(self, lexicon: dict[str, bool], innocent: frozenset[str], suspects: dict[tuple[str, bool], float], weights: np.ndarray):
        self.automaton, self.innocent, self.suspects, self.weights = Automaton(lexicon), innocent, suspects, weights
        self.known: dict[str, tuple[tuple[str, int] | bool, float] | bool] = {}

    def hit(self, chunk: str) -> tuple[str, int] | bool:
        word = plain(chunk)
        found = self.automaton.match(word)
        if found is None and word and not word.isalpha():
            other = "".join(c for c in word.translate(LOOKALIKE) if c.isalpha())
            if other != word and len(other) >= 4 and sum(c.isalpha() for c in word) * 2 >= len(word):
                found = self.automaton.match(other)
                found = (found[0], 1) if found and found[1] == 0 else None
        if found and found[1] > 0 and word in self.innocent:
            return False
        return found or False

    def suspicion(self, chunk: str) -> float:
        return max((self.suspects.get(t, 0.0) for t in terms_of(plain(chunk))), default=0.0)

    def look(self, chunk: str) -> tuple[tuple[str, int] | bool, float] | bool:
        """The hit and the weight as a suspect, or False for neither."""
        hit, weight = self.hit(chunk), self.suspicion(chunk)
        return (hit, weight) if hit or weight else False

    def features(self, text: str) -> np.ndarray:
        chunks = text.lower().split()
        known = self.known
        got = list(map(known.get, chunks))
        if None in got:
            if len(known) > CACHED:
                known.clear()
            for c in {c for c, g in zip(chunks, got) if g is None}:
                known[c] = self.look(c)
            got = [self.look(c) if g is None else g for c, g in zip(chunks, map(known.get, chunks))]
        x = np.zeros(len(PRIOR))
        x[0] = 1
        if not any(got):
            return x
        places = [k for k, g in enumerate(got) if g and g[0]]
        for k in places:
            near, quoted = got[k][0][1] > 0, self._quoted(chunks, k)
            x[1 + 2 * near + quoted] = 1
        ahead = 0
        for i, k in enumerate(places):
            while places[ahead] < k - WINDOW:
                ahead += 1
            x[5] = max(x[5], i - ahead)
        x[5] = math.log1p(x[5])
        weighed = [(k, g[1]) for k, g in enumerate(got) if g and g[1]]
        ahead, window = 0, 0.0
        for k, weight in weighed:
            window += weight
            while weighed[ahead][0] < k - WINDOW:
                window -= weighed[ahead][1]
                ahead += 1
            x[7] = max(x[7], window)
        x[6:] = math.log1p(sum(w for _, w in weighed)), math.log1p(x[7])
        return x

    @staticmethod
    def _quoted(chunks: list[str], k: int) -> bool:
        """Whether a quotation opens before and closes after word k in its window."""
        before, after = " ".join(chunks[max(0, k - WINDOW) : k]), " ".join(chunks[k + 1 : k + 1 + WINDOW])
        core = plain(chunks[k])
        own_before, _, own_after = chunks[k].partition(core) if core else (chunks[k], "", "")
        before, after = f"{before} {own_before}", f"{own_after} {after}"
        pairs = max((before.rfind(c) for c in OPENING), default=-1) > max((before.rfind(c) for c in CLOSING), default=-1)
        return (pairs and any(c in after for c in CLOSING + "“")) or (before.count('"') % 2 == 1 and '"' in after)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def terms_of(word: str) -> list[tuple[str, bool]]:
    """The word and its stems, as the lexicon and the suspects have them."""
    return [(word, False), *((word[:n], True) for n in range(4, min(len(word), 9)))] if len(word) >= 3 else []


class Bags:
    """Documents as numbers of words, and the terms (words and stems) that two toxic ones or more hold: arrays, so a sample fits beside its texts."""

    def __init__(self, docs: list[tuple[bool, str]]):
        self.label = np.array([label for label, _ in docs], bool)
        index: dict[str, int] = {}
        self.ids, self.numbers = [], []
        for _, text in docs:
            own = Counter(w for w in map(plain, text.lower().split()) if len(w) >= 3)
            self.ids.append(np.fromiter((index.setdefault(w, len(index)) for w in own), np.int32, len(own)))
            self.numbers.append(np.minimum(np.fromiter(own.values(), np.int64, len(own)), 255).astype(np.uint8))
        self.words = list(index)
        seen: Counter = Counter()
        for ids, toxic in zip(self.ids, self.label):
            if toxic:
                seen.update({t for i in ids.tolist() for t in terms_of(self.words[i])})
        self.terms = sorted(t for t, k in seen.items() if k >= 2)
        of = {t: k for k, t in enumerate(self.terms)}
        found = [[of[t] for t in terms_of(w) if t in of] for w in self.words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat, start = np.fromiter((k for ks in found for k in ks), np.int32, int(lengths.sum())), np.cumsum(lengths) - lengths
        # per document its terms, and how often it has each (COUNTED at most)
        self.held, self.hits = [], []
        for ids, numbers in zip(self.ids, self.numbers):
            n = lengths[ids]
            own, at = np.unique(gathered(flat, start[ids], n), return_inverse=True)
            self.held.append(own)
            self.hits.append(np.minimum(np.bincount(at, np.repeat(numbers, n), len(own)), COUNTED).astype(np.uint8))

    def counts(self, which: np.ndarray, hits: bool = False) -> np.ndarray:
        """Documents (or hits in them) of those chosen that hold each term."""
        chosen = np.flatnonzero(which)
        held = np.concatenate([np.zeros(0, np.int32), *(self.held[k] for k in chosen)])
        return np.bincount(held, np.concatenate([np.zeros(0), *(self.hits[k] for k in chosen)]) if hits else None, len(self.terms))

    def word_counts(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int32), *(self.ids[k] for k in np.flatnonzero(which))]), minlength=len(self.words))


def learn_suspects(bags: Bags, which: np.ndarray) -> dict[tuple[str, bool], float]:
    """Terms that the chosen toxic documents hold OFTENER times as often as the others, or more, and the logarithm of it."""
    toxic, clean = which & bags.label, which & ~bags.label
    if not toxic.any() or not clean.any():
        return {}
    doubt = DOUBT / toxic.sum()
    weight = np.log((bags.counts(toxic, True) / toxic.sum() + doubt) / (bags.counts(clean, True) / clean.sum() + doubt))
    good = (bags.counts(toxic) >= max(LEAST, toxic.sum() // 400)) & (weight >= math.log(OFTENER))
    return {bags.terms[k]: float(weight[k]) for k in np.flatnonzero(good)}


def learn_lexicon(bags: Bags, which: np.ndarray) -> dict[str, bool]:
    """Greedy cover of the chosen toxic documents by terms that others hardly have, and whole words that are telling."""
    toxic, clean = which & bags.label, which & ~bags.label
    if not toxic.any() or not clean.any():
        return {}
    held, others, least = bags.counts(toxic), bags.counts(clean), max(2, toxic.sum() // 400)
    good = np.flatnonzero((held >= least) & (held * (clean.sum() / toxic.sum()) >= 25 * (others + 0.5)))
    left: dict[int, set] = {int(k): set() for k in good}
    for d in np.flatnonzero(toxic):
        for k in np.intersect1d(bags.held[d], good, assume_unique=True).tolist():
            left[k].add(int(d))
    out: dict[str, bool] = {}
    while left:
        # what it would wrongly reject weighs as much as FALSE of what it finds
        at, ks = max(left.items(), key=lambda x: (len(x[1]) - FALSE * others[x[0]], not bags.terms[x[0]][1], len(bags.terms[x[0]][0]), bags.terms[x[0]][0]))
        if len(ks) - FALSE * others[at] < least:
            break
        term, stem = bags.terms[at]
        out[term] = stem
        left = {k: rest for k, r in left.items() if (rest := r - ks)}
    # words under a stem too, as stems allow no edits
    telling = np.flatnonzero((held >= max(4, 0.02 * toxic.sum())) & (others == 0))
    more = sorted(w for w, stem in (bags.terms[k] for k in telling) if not stem and len(w) >= 4 and w not in out)
    return out | dict.fromkeys(more, False)


def learned(bags: Bags, which: np.ndarray) -> Scorer:
    """A scorer with the lexicon and suspects of the chosen documents, and prior weights."""
    lexicon = learn_lexicon(bags, which)
    automaton, known = Automaton(lexicon), bags.word_counts(which & ~bags.label)
    guilty = bags.word_counts(which & bags.label)
    # words near to a term that clean documents have as they are
    harmless = frozenset(w for w, n, g in zip(bags.words, known.tolist(), guilty.tolist()) if n and g <= 3 * n and (m := automaton.match(w)) and m[1] > 0)
    return Scorer(lexicon, harmless, learn_suspects(bags, which), PRIOR.copy())


def fit(docs: list[tuple[bool, str]]) -> Scorer:
    """docs: label and whole text."""
    bags = Bags(docs)
    # what is learned from a document fits it too well: each fold's features come from the other folds
    x, y = np.zeros((len(docs), len(PRIOR))), bags.label.astype(float)
    fold = np.zeros(len(docs), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    for f in range(FOLDS if len(set(y)) == 2 else 0):
        scorer = learned(bags, fold != f)
        for k in np.flatnonzero(fold == f):
            x[k] = scorer.features(docs[k][1])
    w = PRIOR.copy()
    for _ in range(50 if len(set(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + HOLD * np.eye(len(w)), x.T @ (p - y) + HOLD * (w - PRIOR))
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    scorer = learned(bags, np.ones(len(docs), bool))
    scorer.weights = w
    return scorer


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bool, str]]:
    """Whole texts of a bounded sample of labelled documents that aren't held out; the least digests of ids, so reruns agree."""
    ids = labels.where(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    first = ids.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # sample rows, without texts
    taken, total = [], 0
    for r in first:
        if total + r["size"] <= most_bytes:
            taken.append((r["doc_id"], bool(r["label"])))
            total += r["size"]
    if not taken:
        return []
    of = docs.sparkSession.createDataFrame([(i,) for i, _ in taken], "doc_id long")
    rows = docs.join(F.broadcast(of), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()  # most_bytes at most
    texts = {r["doc_id"]: r["text"] for r in rows}
    return [(label, texts[i]) for i, label in sorted(taken)]


def trained(docs: DataFrame, labels: DataFrame, label: str, fitted):
    """fitted(labelled documents); what the driver held for it goes back to the system."""
    model = fitted(labelled(docs, labels, label))
    release()
    return model


def score_texts(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """docs with a column score: model.score(text) of the whole text (null: empty)."""
    import uuid

    key, schema = uuid.uuid4().hex, docs.select(*keep).schema.add("score", "double")

    def run(batches):
        mine = held(("scorer", key), lambda: model)  # one per worker process, so its memo is kept over tasks
        for batch in batches:
            for at, texts in slices(batch.column(batch.num_columns - 1)):
                scores = pa.array([mine.score(t) for t in texts.to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), scores], names=schema.fieldNames())

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic", fit)
    return score_texts(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
