"""Toxicity scores: a lexicon learned from labels, matched with Levenshtein automata, weighed by its context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import real_id, row_key
from .workspace import tune

#: Labelled rows that the lexicon and the weights are fitted on at most, and words that a worker remembers.
FIT_ROWS, REMEMBER = 20_000, 500_000
#: Shortest word that may be misspelled by one edit, lengths of stems, words to each side that count as context.
FUZZY, STEMS, WINDOW = 5, (3, 4, 5, 6, 7, 8), 6
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile("[\"“”„«»]")


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    #: Learned words that a stem begins; as written they match by their stem.
    replaced: dict[str, float] = {}
    #: Words near which hits are mostly reported or discussed: they stand by the hits of documents that aren't toxic.
    reporting: frozenset[str] = frozenset()


class Matcher:
    """The product of the lexicon's trie with Levenshtein automata for one edit, determinised as words need it.

    A state is a set of (trie node, edits so far); a word ends its walk at the first empty set.  Words that a stem replaces
    are entries too, and a stem is one that accepts any word it begins with one edit within the stem.
    """

    def __init__(self, lexicon: Lexicon, fuzzy: int = FUZZY):
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.weight = {**lexicon.stems, **lexicon.replaced, **lexicon.words}
        for word in sorted(self.weight):
            if len(word) >= fuzzy:
                node = 0
                for c in word:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.entry):
                        self.children.append({})
                        self.entry.append(None)
                        self.stem.append(None)
                if word in lexicon.stems:
                    self.stem[node] = word
                if word in lexicon.words or word in lexicon.replaced:
                    self.entry[node] = word
        self.start = self._close({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.known: dict[str, tuple[str, float] | None] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """Add what a left-out letter of the entry reaches."""
        return frozenset(states | {(n, 1) for s, e in states if e == 0 for n in self.children[s].values()})

    def _move(self, states: frozenset, c: str) -> frozenset:
        found = self.moves.get((states, c))
        if found is None:
            after = set()
            for s, e in states:
                if c in self.children[s]:
                    after.add((self.children[s][c], e))
                if e == 0:
                    after.add((s, 1))  # a letter too many
                    after.update((n, 1) for n in self.children[s].values())  # another letter
            found = self._close(after)
            if len(self.moves) > REMEMBER:
                self.moves.clear()
            self.moves[states, c] = found
        return found

    def near(self, word: str) -> str | None:
        """An entry within one edit of the word, the least in order if there are several, or else the first stem within one edit of its beginning."""
        states, stem = self.start, None
        for c in word:
            states = self._move(states, c)
            if not states:
                return stem
            stem = stem or min((self.stem[s] for s, _ in states if self.stem[s]), default=None)
        return min((self.entry[s] for s, _ in states if self.entry[s]), default=None) or stem

    def match(self, word: str) -> tuple[str, float] | None:
        """(kind, weight) of a lower-case word: exact, stem or fuzzy."""
        if word in self.known:
            return self.known[word]
        found = None
        if word in self.lexicon.words:
            found = ("exact", self.lexicon.words[word])
        else:
            for k in STEMS:
                if word[:k] in self.lexicon.stems and len(word) >= k:
                    found = ("stem", self.lexicon.stems[word[:k]])
                    break
            if found is None and (entry := self.near(word)):
                found = ("fuzzy", self.weight[entry])
        if len(self.known) > REMEMBER:
            self.known.clear()
        self.known[word] = found
        return found


FEATURES = ("exact", "stem", "fuzzy", "quoted", "weight", "density")


def features(matcher: Matcher, text: str, window: int = WINDOW) -> np.ndarray:
    """Logarithmic counts of hits by kind; hits inside quotation marks or near words that report count as quoted."""
    out = np.zeros(len(FEATURES))
    lowered = text.lower()
    words = _WORD.findall(lowered)
    if not any([matcher.match(w) for w in set(words)]):
        return out
    quotes = [m.start() for m in _QUOTES.finditer(lowered)]
    spots = [m.start() for m in _WORD.finditer(lowered)]
    weight, opened = 0.0, 0
    for i, w in enumerate(words):
        found = matcher.match(w)
        if not found:
            continue
        while opened < len(quotes) and quotes[opened] < spots[i]:
            opened += 1
        around = words[max(0, i - window) : i] + words[i + 1 : i + 1 + window]
        if opened % 2 and opened < len(quotes) or not matcher.lexicon.reporting.isdisjoint(around):
            out[3] += 1
        else:
            out[FEATURES.index(found[0])] += 1
            weight += found[1] * (0.5 if found[0] == "fuzzy" else 1)
    out[:4] = np.log1p(out[:4])
    out[4] = math.log1p(weight)
    out[5] = weight / math.sqrt(len(words))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each word (w) or stem (s)."""
    for batch in batches:
        count: dict[tuple[str, str], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            for key in {("w", w) for w in words} | {("s", w[:k]) for w in words for k in STEMS if len(w) >= k}:
                count.setdefault(key, [0, 0])[toxic] += 1
        keys, values = list(count), list(count.values())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[0] for v in values], pa.int64())], ["kind", "term", "bad", "good"])


def _contexts(lexicon: Lexicon):
    """Documents of either label that have a hit by each word within the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall((text or "").lower())
                hits = [i for i, w in enumerate(words) if matcher.match(w)]
                near = {w for i in hits for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]}
                # the empty word counts the documents with hits
                for w in near | ({""} if hits else set()):
                    count.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *[pa.array([v[k] for v in count.values()], pa.int64()) for k in (1, 0)]], ["term", "bad", "good"])

    return run


def learn_reporting(labelled: DataFrame, lexicon: Lexicon, odds: float = 2.0) -> frozenset[str]:
    """Words by the hits of at least three documents that aren't toxic, and surely oftener than by those of toxic ones.

    Surely: the log odds less twice their standard error are above ``odds`` less 1 and the odds above ``odds``.
    """
    counts = labelled.select("text", "toxic").mapInArrow(_contexts(lexicon), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = counts.where("good >= 3 or term = ''").collect()
    total = next((r for r in rows if r.term == ""), None)
    if total is None:
        return frozenset()
    ratio = lambda r: math.log((r.good + 0.5) / (total.good + 1)) - math.log((r.bad + 0.5) / (total.bad + 1))
    return frozenset(r.term for r in rows if r.term and ratio(r) > odds and ratio(r) - 2 * math.sqrt(1 / (r.good + 0.5) + 1 / (r.bad + 0.5)) > odds - 1)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """Words and stems that toxic documents hold and others don't, from (text, toxic); their number is bounded by the labelled rows'."""
    totals = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({}, {})
    counts = labelled.select("text", "toxic").mapInArrow(_terms, "kind string, term string, bad long, good long").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    rows = counts.withColumn("odds", odds).where((F.col("bad") >= max(3, 0.002 * bad)) & (F.col("odds") > 3)).collect()
    words = {r.term: r for r in sorted(rows) if r.kind == "w"}
    most: dict[str, int] = {}
    for t, w in words.items():
        for k in STEMS:
            most[t[:k]] = max(most.get(t[:k], 0), w.bad)
    stems: dict[str, float] = {}
    # the surest first: odds less their standard error
    sure = lambda r: r.odds - math.sqrt(1 / (r.bad + 0.5) + 1 / (r.good + 0.5))
    for r in sorted((r for r in rows if r.kind == "s"), key=lambda r: (-sure(r), r.term)):
        # a stem must explain more documents than any one word that it begins
        if r.bad > 1.3 * most.get(r.term, 0) and not any(r.term.startswith(t) or t.startswith(r.term) for t in stems):
            stems[r.term] = r.odds
    kept = {t: r.odds for t, r in words.items() if not any(t[:k] in stems for k in STEMS)}
    return Lexicon(kept, stems, {t: r.odds for t, r in words.items() if t not in kept})


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * (len(w) - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            x = [features(matcher, t or "").tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit lexicon and weights on at most ``rows`` labelled documents (those with the least hashes of their ids).

    ``labels`` holds doc_id and toxic and must be without rows that are held out.  Rows without an id or a label are left
    out; of several labels the largest counts.
    """
    spark = docs.sparkSession
    tune(spark)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = spark.createDataFrame(chosen.toPandas(), "doc_id long, toxic int") if rows else chosen
    # at most ``rows`` ids
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    lexicon = learn_lexicon(some)
    lexicon = lexicon._replace(reporting=learn_reporting(some, lexicon))
    got = some.mapInArrow(_with_features(lexicon), "x array<double>, toxic int").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicon, np.array([8.0 if len(y) and y.max() == 1 else -8.0] + [0.0] * len(FEATURES)))
    return Model(lexicon, fit_weights(np.array(got.column("x").to_pylist()), y))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            x = np.array([features(matcher, t or "") for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ model.weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(p), *batch.columns[1:]], ["score", *batch.schema.names[1:]])

    return run


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with a column toxicity_score (0 to 1) in the end; only the text is looked at.

    Null or empty text has no hits and gets the score of such texts.  Columns keep their names; a column that is
    already named toxicity_score is replaced.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c != "toxicity_score"]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    src = docs.select(F.col(text_col).cast("string").alias("text"), row.alias("row"))
    out = src.mapInArrow(_score(model), f"score double, row {src.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("score").alias("toxicity_score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): the model learns from labels of rows that aren't held out."""
    model = fit(docs, labels.where(~held_out()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
