"""Toxicity by maximum-scoring segments over token log-odds.

Learning: of a bounded sample of labelled documents, less those that share the smallest hash of their word pairs with
another, as near copies do, every feature is counted once a document. A word's features are itself and its first and
last three to six letters. Each feature's log-odds between toxic and clean documents is shrunk by a Dirichlet prior in
proportion to its overall frequency; those that stand out by ``OUTSTANDING`` standard deviations form the lexicon.

Scoring: a token scores the largest log-odds of its features in the lexicon; any other scores a little below zero, by
how much rarer such tokens are in toxic documents. One linear scan (all maximal scoring subsequences) finds every
toxic passage. The best passage of n tokens of clean text follows an extreme-value law, P(S < x) = exp(-K n e^(-lambda x)):
lambda and K are fitted to the best passages of the sample's clean documents, each scored by a lexicon of the other half
of the sample, which hasn't seen it. So a passage of score S is expected K n e^(-lambda S) times in clean text. The best
passage's normalised score, lambda S - ln(K n), gives a probability by a logistic curve fitted to the same scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, learned_on, remembered

#: Labelled documents of each class that the model is fitted on at most: those of smallest hash.
SAMPLE = 2500
#: Features that are learned at most: those that stand out most. Each stands in several of the sample's toxic documents.
LEXICON = 20_000
#: Documents of each class in each half of the sample, with fewer of which the halves aren't scored by one another.
FOLD = 10
OUTSTANDING = 3.0
PRIOR = 10.0
EDGES = (3, 4, 5, 6)
#: Log-odds that a feature of the lexicon has at least and counts for at most.
LEAST, LARGEST = 1.5, 6.0
#: A passage is reported if it is expected less often than this in clean text.
SIGNIFICANT = 0.05
#: Words whose scores a worker remembers.
REMEMBERED = 200_000

#: Documents with a feature, clean (c) and toxic (t), in each half of the sample.
COUNTS = ("c0", "c1", "t0", "t1")

_TOKEN = re.compile(r"[^\W_]+")


def features(token: str) -> list[str]:
    """A token's features: itself, and its beginnings and ends, marked by a dash."""
    return [token, *(f"{token[:n]}-" for n in EDGES if n < len(token)), *(f"-{token[-n:]}" for n in EDGES if n < len(token))]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -20.0

    def key(self) -> int:
        return xxhash.xxh64_intdigest(repr(sorted(self.lexicon.items())))

    def word(self, raw: str) -> float:
        """Score of a white-space separated word: that of its best token."""
        return max((self.lexicon.get(f, 0.0) for t in _TOKEN.findall(raw.lower()) for f in features(t)), default=0.0)

    def passages(self, text: str | None, known: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, all maximal scoring segments as (first word, end, score))."""
        words = (text or "").split()
        if len(known) > REMEMBERED:
            known.clear()
        got = np.fromiter(map(known.get, words, repeat(-1.0)), np.float64, len(words))
        for i in np.flatnonzero(got < 0).tolist():
            w = words[i]
            if w not in known:
                known[w] = self.word(w)
            got[i] = known[w]
        at = np.flatnonzero(got > 0)
        return len(words), segments(at.tolist(), got[at].tolist(), self.other)

    def normal(self, n, score):  # noqa: ANN001, ANN201
        """lambda S - ln(K n), of numbers or arrays."""
        return self.decay * score - np.log(self.scale * np.maximum(n, 1))

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -40, 40))))


def segments(at: list[int], score: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences of a sequence that scores ``score`` at ``at`` and ``other`` (below 0) elsewhere.

    Each entry of the stack is a candidate with the total before it and up to its end; a new one swallows those back to
    the last whose total before is smaller, if that one's total at its end is smaller as well.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, last = 0.0, 0
    for i, s in zip(at, score):
        total += other * (i - last)
        first, before = i, total
        total += s
        last = i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, before, total))
    return [(a, b, high - low) for a, b, low, high in stack]


def labelled(labels: DataFrame, modulus: int, out: int) -> DataFrame:
    """(doc_id, toxic) of each labelled document that may be learned from; where labels contradict one another, toxic."""
    allowed = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learned_on("doc_id", modulus, out))
    return allowed.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, modulus: int, out: int) -> DataFrame:
    """(text, toxic, half) of at most SAMPLE documents of each class, of those that may be learned from; near copies are in one half."""
    marked = labelled(labels, modulus, out)
    parts = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    ids = cut(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # 2 * SAMPLE ids
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return cut(texts.mapInArrow(_keyed, "text string, toxic int, key long").dropDuplicates(["toxic", "key"]).select("text", "toxic", (F.col("key") % 2).cast("int").alias("half")))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for text in b.column("text"):
            tokens = _TOKEN.findall((text.as_py() or "").lower())
            keys.append(min((xxhash.xxh64_intdigest(f"{p} {w}") for p, w in zip(["", *tokens], tokens)), default=0) >> 1)
        yield pa.RecordBatch.from_pydict({"text": b.column("text"), "toxic": b.column("toxic"), "key": pa.array(keys, pa.int64())})


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {}
        for text, label, half in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("half").to_pylist()):
            tokens = set(_TOKEN.findall((text.as_py() or "").lower()))
            for f in {f for t in tokens for f in features(t)}:
                counts.setdefault(f, [0, 0, 0, 0])[2 * label + half] += 1
        cols = {"feature": pa.array(counts, pa.string())} | {n: pa.array([c[k] for c in counts.values()], pa.int64()) for k, n in enumerate(COUNTS)}
        yield pa.RecordBatch.from_pydict(cols)


def _odds(y0: Column, y1: Column, n0: int, n1: int) -> tuple[Column, Column]:
    """Shrunk log-odds of a feature that stands in y0 of n0 clean and y1 of n1 toxic documents, and by how many standard deviations it stands out."""
    if not n0 or not n1:
        return F.lit(0.0), F.lit(0.0)
    prior, half = F.lit(PRIOR) * (y0 + y1) / F.lit(float(n0 + n1)), F.lit(0.5)  # half of a document that hasn't the feature, even if all have it
    odds = F.log((y1 + prior) / F.greatest(F.lit(n1 + PRIOR) - y1 - prior, half)) - F.log((y0 + prior) / F.greatest(F.lit(n0 + PRIOR) - y0 - prior, half))
    seen = y0 + y1 > 0
    return F.when(seen, odds).otherwise(0.0), F.when(seen, odds / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))).otherwise(0.0)


def extremes(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """(lambda, K) of the law that the best passages of clean texts of n words follow, by maximum likelihood.

    A text without any passage says that its best is below the least of all. A weak prior draws lambda to 1, where scores
    are log-odds as they should be; without texts both are 1.
    """
    if not len(n):
        return 1.0, 1.0
    n, hit = np.maximum(n, 1).astype(float), best > 0
    found = np.where(hit, best, best[hit].min() if hit.any() else 1.0)
    count = hit.sum() + 0.5

    def rate(decay: float) -> float:
        return count / (n * np.exp(-decay * found)).sum()

    def likelihood(decay: float) -> float:
        return count * (np.log(decay) + np.log(rate(decay))) - decay * best[hit].sum() + 5 * (np.log(decay) - decay)

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(80):  # by golden sections of a single peak
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (a, high) if likelihood(np.exp(a)) < likelihood(np.exp(b)) else (low, b)
    decay = float(np.exp((low + high) / 2))
    return decay, float(rate(decay))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) by Newton's method, with a weak penalty on the slope."""
    center, width = x.mean(), x.std() + 1e-9
    z = np.stack([(x - center) / width, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + np.array([0.01, 0.0]) * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.01, 1e-6])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / width), float(w[1] - w[0] * center / width)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, out: int = 0) -> Model:
    """A model from documents whose crc32(doc_id as text) modulo ``modulus`` isn't ``out``, and their labels.

    Without labelled documents of both classes, it finds everything clean.
    """
    sample = _sample(docs, labels, modulus, out)
    sizes = {(r["toxic"], r["half"]): r["count"] for r in sample.groupBy("toxic", "half").count().collect()}
    size = [[sizes.get((k, half), 0) for half in (0, 1)] for k in (0, 1)]
    if not sum(size[0]) or not sum(size[1]):
        return Model()
    found = sample.mapInArrow(_document_counts, f"feature string, {', '.join(f'{c} long' for c in COUNTS)}").groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # of the whole sample, and of each half
    parts = [_odds(F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), sum(size[0]), sum(size[1])), *(_odds(F.col(f"c{k}"), F.col(f"t{k}"), size[0][k], size[1][k]) for k in (0, 1))]
    strong = [F.when((z > OUTSTANDING) & (odds > LEAST), F.least(odds, F.lit(LARGEST))) for odds, z in parts]
    found = found.select("feature", F.greatest(*(z for _, z in parts)).alias("z"), *(x.alias(n) for x, n in zip(strong, ("all", "half0", "half1"))))
    rows = found.where(F.coalesce("all", "half0", "half1").isNotNull()).orderBy(F.desc("z"), "feature").limit(LEXICON).collect()
    model = Model({r["feature"]: r["all"] for r in rows if r["all"] is not None})
    if not model.lexicon:
        return Model()
    apart = min(map(min, size)) >= FOLD
    others = [{r["feature"]: r[f"half{1 - k}"] for r in rows if r[f"half{1 - k}"] is not None} if apart else model.lexicon for k in (0, 1)]

    # how often tokens of clean and toxic documents score what
    lexicon = dict(model.lexicon)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = Model(lexicon), {}
        for b in batches:
            counts: dict[float, list[int]] = {}
            for text, label in zip(b.column("text"), b.column("toxic").to_pylist()):
                for w in (text.as_py() or "").split():
                    if w not in known:
                        known[w] = round(own.word(w), 3)
                    counts.setdefault(known[w], [0, 0])[label] += 1
            yield pa.RecordBatch.from_pydict({"score": pa.array(counts, pa.float64())} | {n: pa.array([c[k] for c in counts.values()], pa.int64()) for k, n in enumerate(("clean", "toxic"))})

    tallied = sample.mapInArrow(tally, "score double, clean long, toxic long").groupBy("score").agg(F.sum("clean"), F.sum("toxic")).collect()
    n0, n1 = (float(sum(r[k] for r in tallied)) for k in (1, 2))
    scores = [r for r in tallied if r[0] > 0]
    clean = np.array([float(r[1]) for r in scores])
    toxic = np.array([float(r[2]) for r in scores])
    p0 = (clean + toxic / toxic.sum()) / (n0 + 1)  # one more token, dealt like the toxic ones
    p1 = min(0.5, toxic.sum() / n1)
    model.other = float(np.log((1 - p1) / (1 - min(p0.sum(), p1 / 2))))
    below = model.other

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = [Model(words, below) for words in others], ({}, {})
        for b in batches:
            n, score = [], []
            for text, half in zip(b.column("text"), b.column("half").to_pylist()):
                size, got = own[half].passages(text.as_py(), known[half])
                n.append(size)
                score.append(max((s for *_, s in got), default=0.0))
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64()), "toxic": b.column("toxic")})

    points = sample.mapInArrow(best, "n long, score double, toxic int").collect()  # 2 * SAMPLE numbers
    n, top, y = (np.array([float(r[k]) for r in points]) for k in range(3))
    model.decay, model.scale = extremes(n[y == 0], top[y == 0])
    x = model.normal(n, top)
    share = labelled(labels, modulus, out).agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]  # of toxic documents; the sample has its own
    model.slope, model.intercept = _logistic(x, y, np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y))
    return model


OUT = "doc_id long, score double, passages array<struct<start:int,end:int,score:double,expected:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row of ``docs`` (doc_id, text), over whole texts.

    score is between 0 and 1, higher where label 1 is likelier; passages are the significant ones, by word positions.
    Null texts count as empty. Repeated rows are scored alike. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(("scores", model.key()), dict)
        for b in batches:
            score, kept = [], []
            for text in b.column("text"):
                n, found = model.passages(text.as_py(), known)
                score.append(model.probability(model.normal(n, max((s for *_, s in found), default=0.0))))
                expected = [(a, z, s, float(np.exp(-model.normal(n, s)))) for a, z, s in found]
                kept.append([{"start": a, "end": z, "score": s, "expected": e} for a, z, s, e in expected if e <= SIGNIFICANT])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(score, pa.float64()), "passages": pa.array(kept, kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row of ``docs`` (doc_id, text), by a model that learned from the others.

    held_out is false for a null doc_id. Null texts count as empty; rows are kept whole, and repeated ones score alike;
    where labels of a document contradict one another, it counts as toxic. An empty table gives an empty result.
    Without labels of both classes every score is near 0. Other columns are ignored.
    """
    scored = score(docs, train(docs, labels))
    held = F.coalesce(~learned_on("doc_id", 5, 0), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more; all columns are kept, whatever their names, and no text is shuffled.

    Null texts count as empty and stay; repeated rows stay or go together. Without labels of both classes all stay; an
    empty table gives an empty result.
    """
    model = train(docs, labels)

    @F.pandas_udf("boolean")
    def clean(texts):  # noqa: ANN001, ANN202
        known = remembered(("scores", model.key()), dict)
        found = (model.passages(t, known) for t in texts)
        return texts.__class__([model.probability(model.normal(n, max((s for *_, s in f), default=0.0))) < 0.5 for n, f in found], dtype=bool)

    return docs.where(clean(F.col("text")))
