"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of ``WINDOW`` bytes, all of it. Each byte has a learned vector; filters of several widths
run over a window's vectors, the maximum over the window is taken of each filter, and a linear layer with softmax
scores the languages. A text's score is the mean over its windows, weighted by their bytes. The network is trained by
Adam on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, learned_on, uniform

WINDOW = 192
WIDTHS = (2, 3, 4)
#: Filters of each width, and length of a byte's vector.
FILTERS, VECTOR = 8, 6
#: Labelled documents that the network is trained on for each language at most (those of smallest hash), and windows of each, dealt over its text.
SAMPLE, PIECES = 600, 6
#: Languages that are learned at most, those of most documents, and windows of all of them together: of more languages, each has fewer documents.
LANGUAGES, ROOM = 500, 120_000
STEPS, BATCH, RATE, PENALTY = 500, 128, 0.004, 1e-4
#: Windows that are scored at a time.
TOGETHER = 64

WEIGHTS = ("vectors", "filters", "bias", "out", "offset")

_LETTER = regex.compile(r"\p{L}")


def cut_up(text: str) -> list[bytes]:
    """All windows of a text, in lower case; the last may be shorter."""
    raw = text.lower().encode()
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def as_array(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)


@dataclass
class Network:
    """``vectors`` (256, VECTOR), ``filters`` (widest * VECTOR, filters), ``bias``, ``out`` (filters, languages), ``offset``."""

    languages: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, widest * VECTOR): the vectors of the bytes that each place of the filters sees."""
        x = self.vectors[windows]
        places = WINDOW - max(WIDTHS) + 1
        return np.concatenate([x[:, k : k + places] for k in range(max(WIDTHS))], axis=2)

    def respond(self, windows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window."""
        c = self.columns(windows)
        return np.maximum((c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(windows), -1, self.filters.shape[1]).max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), TOGETHER):
            z = self.respond(windows[i : i + TOGETHER]) @ self.out + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy of windows and the positions of their languages, with a weak penalty on ``out``, and its gradients."""
        n, wide = self.filters.shape[1], self.filters.shape[0] // self.vectors.shape[1]
        every, rows = np.arange(len(windows)), np.arange(len(windows))[:, None]
        c = self.columns(windows)
        r = (c.reshape(-1, c.shape[2]) @ self.filters).reshape(len(windows), -1, n)
        top = r.argmax(1)
        high = np.take_along_axis(r, top[:, None, :], 1)[:, 0] + self.bias
        h = np.maximum(high, 0)
        z = h @ self.out + self.offset
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[every, labels] + 1e-30).mean() + PENALTY / 2 * (self.out**2).sum())
        p[every, labels] -= 1
        p /= len(windows)
        dh = (p @ self.out.T) * (high > 0)
        best = c[rows, top]  # (windows, filters, wide * VECTOR)
        dbest = (dh[:, :, None] * self.filters.T[None]).reshape(len(windows), n, wide, -1)
        vectors = np.zeros_like(self.vectors)
        np.add.at(vectors, windows[rows[:, :, None], top[:, :, None] + np.arange(wide)], dbest)
        return loss, {"vectors": vectors, "filters": np.einsum("bf,bfk->kf", dh, best), "bias": dh.sum(0), "out": h.T @ p + PENALTY * self.out, "offset": p.sum(0)}

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 for null texts and those without a letter."""
        fine = [bool(self.languages) and bool(t) and _LETTER.search(t) is not None for t in texts]
        name, score = ["und"] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, bytes]] = []
        total = np.zeros((len(texts), max(1, len(self.languages))))

        def settle() -> None:
            if held:
                at = np.array([i for i, _ in held])
                weight = np.array([len(w) for _, w in held], dtype=np.float64)
                np.add.at(total, at, self.probabilities(as_array([w for _, w in held])) * weight[:, None])
                held.clear()

        for i, t in enumerate(texts):
            if fine[i]:
                held += [(i, w) for w in cut_up(t)]
                if len(held) >= 16 * TOGETHER:
                    settle()
        settle()
        for i in np.flatnonzero(fine):
            p = total[i] / total[i].sum()
            name[i], score[i] = self.languages[int(p.argmax())], float(min(1.0, p.max()))
        return name, score


def fit(languages: list[str], windows: list[bytes], labels: np.ndarray, seed: int = 11) -> Network:
    """A network trained on windows and the positions of their languages."""
    rng = np.random.default_rng(seed)
    wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
    seen = np.concatenate([np.repeat(np.arange(wide) < w, VECTOR)[:, None] @ np.ones((1, FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        (rng.normal(0, 0.3, (wide * VECTOR, n)) * seen).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    first = {k: np.zeros_like(getattr(net, k)) for k in WEIGHTS}
    second = {k: np.zeros_like(getattr(net, k)) for k in WEIGHTS}
    x, groups = as_array(windows), [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
        _, grads = net.gradients(x[pick], labels[pick])
        grads["filters"] *= seen
        for k in WEIGHTS:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _unlearned() -> Network:
    return Network([], *(np.zeros(0, np.float32) for _ in WEIGHTS))


def sample(docs: DataFrame, modulus: int, out: int) -> DataFrame:
    """(doc_id, lang, text): one document for each of at most SAMPLE ids of each language, of those that may be learned from.

    However many rows an id has, it counts once for a language, and its smallest text with a letter is taken.
    """
    letters = F.col("text").rlike(r"\p{L}")
    allowed = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & letters & learned_on("doc_id", modulus, out)).select("doc_id", "lang", "text")
    counts = cut(allowed.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    each = max(1, min(SAMPLE, ROOM // (PIECES * max(1, counts.count()))))
    # by chance no more than a few times the sample of each language
    place = uniform("doc_id")
    near = allowed.join(F.broadcast(counts), "lang").where(place * F.col("n") < 4.0 * each).select("doc_id", "lang").distinct()  # LANGUAGES rows
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    ids = cut(near.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang"))
    picked = allowed.join(F.broadcast(ids), ["doc_id", "lang"])  # ROOM / PIECES ids
    return picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, modulus: int = 4, out: int = 2) -> Network:
    """A network from the text and lang of documents whose crc32(doc_id as text) modulo ``modulus`` isn't ``out``.

    Documents without lang, doc_id or a letter teach nothing; without any that do, every text is ``und``.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, part = [], []
            for name, text in zip(b.column("lang").to_pylist(), b.column("text")):
                t = text.as_py()
                if t and _LETTER.search(t):
                    every = cut_up(t)
                    own = [every[i] for i in sorted({len(every) * k // PIECES for k in range(PIECES)})]
                    lang += [name] * len(own)
                    part += own
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "part": pa.array(part, pa.binary())})

    rows = sample(docs, modulus, out).select("lang", "text").mapInArrow(windows, "lang string, part binary").collect()  # ROOM windows
    rows = sorted((r["lang"], bytes(r["part"])) for r in rows)
    names = sorted({lang for lang, _ in rows})
    if not names:
        return _unlearned()
    number = {name: k for k, name in enumerate(names)}
    return fit(names, [w for _, w in rows], np.array([number[lang] for lang, _ in rows]))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text), over whole texts.

    A null text, and one without a letter, is ``und`` with score 0. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                name, score = net.judge(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(name, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang), by a network that learned from the others.

    held_out is false for a null doc_id. Rows are kept whole, repeated or not, and repeated ones are judged alike; of
    languages that score the same, the first by name. An empty table gives an empty result. Other columns are ignored.
    """
    held = F.coalesce(~learned_on("doc_id", 4, 2), F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the texts that are in no language (``und``): null texts, and those without a letter.

    All columns are kept, whatever their names, and no text is shuffled. Repeated rows stay or go together. Where no
    language can be learned every text goes; an empty table gives an empty result.
    """
    net = train(docs)

    @F.pandas_udf("boolean")
    def known(texts):  # noqa: ANN001, ANN202
        kept: list[bool] = []
        for i in range(0, len(texts), 256):
            kept += [name != "und" for name in net.judge(list(texts[i : i + 256]))[0]]
        return texts.__class__(kept, dtype=bool)

    return docs.where(known(F.col("text")))
