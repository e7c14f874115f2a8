"""Harmonic packing of token sequences.

Whole sequences are cut off a document first, which leaves a rest shorter than a sequence. A rest of r tokens is of
class k if capacity / (k + 1) < r <= capacity / k, and a bin of class k takes exactly k rests. Whatever such a bin
leaves free is at most capacity / (k + 1), less than any rest of its class, so the head of the next rest fills it
exactly; the tail goes on as a rest of its own, smaller, class. So every closed bin is full. Classes of ``LAST`` and
more share one class whose bins take rests until one is cut.

Each task packs the rows that it reads, on its own and without a shuffle: at most a bin's worth of rests is open per
class. What is open when the rows end is put into bins end to end, and the last of these is cut into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered

CAPACITY = 4096
END = 2
LAST = 64
#: Words whose ids a worker remembers (0.2 KB each); when there are more, it forgets those that came up least.
REMEMBERED = 600_000

#: Letters below this one are the same in all versions of Unicode.
LATIN = "\u0250"
#: The letters in which byte-level models write bytes: printable ones for themselves, the others from U+0100 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Texts by which tokenizers are told apart that keep case, white space, accents, or stops and line feeds with what is beside them.
TEXTS = ("Hello World. Foo", "a b  c", " a", "a ", "A, b.\n\tc d.", "x\u00a0y z", "don't stop. It's I'LL", "3.14, 1,000. x1y2", "ÄÖÜ é e\u0301", "a...b ,c.", "\u4e2d\u6587 \u3042", "the the\n\n\nthe", "https://a.b/c?d=e, f_g", "\u2028a\x85b \x1c c", "\ud83d\ude00 x\u200by".encode("utf-16", "surrogatepass").decode("utf-16"), "<|x|> [INST] <s>", "#hash @at $5.", "")
PROBES = ("a", "the", "unlikeliest", "straße", "éàüñçœ", "zzqqxxjjkk", "ſłøđ")

_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


class Words:
    """Token ids of texts, one white-space separated word at a time.

    The tokenizer drops white space, and none of its tokens and special strings reaches over any, so the ids of a text
    are those of its words in turn; it also lower-cases, and takes a full stop or comma between a letter and white
    space by itself. So a text is lower-cased (A-Z, unless it may hold special strings) and such stops stand alone
    before it is split, which leaves fewer different words. Each is encoded once; the ids are in one flat array.

    A word of Latin letters alone goes through the tokenizer's normalisation and splitting unchanged, so the byte-pair
    model takes it directly, in the letters that stand for its bytes. That a tokenizer is of that kind is tried out first:
    one that keeps case or white space, or whose special strings reach over it, is given whole texts instead.
    """

    def __init__(self, path: str, remember: int = REMEMBERED, end: int = END):
        self.remember, self.end = remember, end
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.content.split()[1:]]
        self.mark = special[0] if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if special else None
        self.model = self.tokenizer.model
        self.direct = type(self.model).__name__ == "BPE" and all(self._whole(w) == self._letters(w) for w in PROBES)
        self._clear()
        self.apart = self._try()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.size, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _try(self) -> bool:
        """True if the words' ids in turn are those of the whole, for texts that tell tokenizers apart."""
        self.apart = True
        try:
            return all(self.encode(t)[:-1].tolist() == self._whole(t) for t in (*PROBES, *TEXTS))
        except ValueError:
            return False

    def forget(self) -> None:
        """Keeps the words that came up most, up to half of what fits."""
        n = len(self.known)
        least = max(2, int(np.partition(self.hits[:n], n - self.remember // 2)[n - self.remember // 2]) + 1)
        keep = np.flatnonzero(self.hits[:n] >= least)
        size = self.size[keep]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[keep] - ends + size, size)]
        new = np.full(n, -1)
        new[keep] = np.arange(len(keep))
        self.known = {w: int(new[i]) for w, i in self.known.items() if new[i] >= 0}
        self.start[: len(keep)], self.size[: len(keep)], self.hits[: len(keep)] = ends - size, size, 0
        self.ids[: len(flat)], self.used = flat, len(flat)

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _letters(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))]

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words and adds them to what is known; those that aren't plain go in one text, with a special string between them."""
        order, flat, sizes = [], [], []
        if self.direct:
            rest = []
            for w in words:
                text = w.decode()
                if text.isalpha() and (text.isascii() or (max(text) < LATIN and is_normalized("NFC", text))) and text == text.lower():
                    ids = self._letters(text)
                    order.append(w)
                    flat += ids
                    sizes.append(len(ids))
                else:
                    rest.append(w)
            words = rest
        flat, sizes = [np.array(flat, np.uint32)], [np.array(sizes, np.int64)]
        together = [w for w in words if self.mark is not None and b"<|" not in w]
        if together:
            joined = b"".join([self.mark.encode().join(together), self.mark.encode()]).decode()
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(got == self.mark_id)
            if len(ends) != len(together):
                raise ValueError("the tokenizer doesn't keep special strings apart")
            flat.append(got[got != self.mark_id])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        alone = words if self.mark is None else [w for w in words if b"<|" in w]
        for w in alone:
            ids = self._whole(w.decode())
            flat.append(np.array(ids, np.uint32))
            sizes.append(np.array([len(ids)]))
        ids, size = np.concatenate(flat), np.concatenate(sizes)
        order += [*together, *alone]
        at, n = len(self.known), len(order)
        while at + n > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at : at + n], self.size[at : at + n], self.hits[at : at + n] = self.used + np.cumsum(size) - size, size, 0
        self.used += len(ids)
        self.known.update(zip(order, range(at, at + n)))

    def encode(self, text: str | bytes) -> np.ndarray:
        """The ids of a text, or of its UTF-8, and the end id."""
        raw = text.encode() if isinstance(text, str) else text
        if not self.apart:
            return np.array([*self._whole(raw.decode()), self.end], np.uint32)
        words = (raw if b"<|" in raw else _STOP.sub(rb" \1", raw.lower())).split()
        if len(self.known) > self.remember:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            at[new] = [self.known[words[i]] for i in new]
        np.add.at(self.hits, at, 1)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = np.empty(total + 1, np.uint32)
        out[:total] = self.ids[np.arange(total) + np.repeat(self.start[at] - ends + size, size)]
        out[total] = self.end
        return out


class Bins:
    """Packs pieces of documents; ``rows`` gathers (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.rows, self.sequence = capacity, [], 0
        self.open: dict[int, list[tuple]] = {}
        self.width: dict[int, int] = {}

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.capacity
        for at in range(0, whole, self.capacity):
            self._close([(doc, at, ids[at : at + self.capacity], n)])
        if whole < n:
            self._rest((doc, whole, ids[whole:], n))

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, ids, n, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def _rest(self, piece: tuple | None) -> None:
        while piece is not None:
            k = min(self.capacity // len(piece[2]), LAST)
            held = self.open.setdefault(k, [])
            room = self.capacity - self.width.get(k, 0)
            if len(piece[2]) < room or (len(held) < k and len(piece[2]) == room and k < LAST):
                held.append(piece)
                self.width[k] = self.width.get(k, 0) + len(piece[2])
                if self.width[k] == self.capacity:
                    self._close(self.open.pop(k))
                    self.width[k] = 0
                return
            doc, start, ids, n = piece
            self._close([*self.open.pop(k), (doc, start, ids[:room], n)])
            self.width[k] = 0
            piece = (doc, start + room, ids[room:], n) if len(ids) > room else None

    def finish(self) -> None:
        """Closes what is open: end to end, the last bin in powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.width = {}, {}
        total = sum(len(p[2]) for p in left)
        while total:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            total -= room
            taken = []
            while room:
                doc, start, ids, n = left.pop(0)
                taken.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, ids[room:], n))
                room -= len(taken[-1][2])
            self._close(taken)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, with_ids: bool, remember: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = remembered(("words", path, remember, end), lambda: Words(path, remember, end)), Bins()
        base = TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            doc, start, ids, n, sequence, offset = zip(*bins.rows)
            bins.rows = []
            cols = {
                "doc_id": pa.array(doc, pa.int64()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(list(map(len, ids)), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in ids], pa.int64()),
                "doc_tokens": pa.array(n, pa.int64()),
                "sequence_id": pa.array([base + s for s in sequence], pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(cols)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                bins.add(doc, words.encode(text.as_py() or b""))
                if len(bins.rows) >= 4096:
                    yield rows()
        bins.finish()
        if bins.rows:
            yield rows()

    return run


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False, remember: int = REMEMBERED, end: int = END) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text), packed into sequences of at most CAPACITY tokens.

    ``tokenizer`` is the path of a tokenizers file. A document's tokens are the ids of its text, without special tokens
    added, and ``end``; a null text counts as empty. Each token lies in exactly one piece, pieces
    of a sequence follow one another from offset 0, and every sequence is either full or a power of two long. A null
    or repeated doc_id is packed like any other. ``with_ids`` adds the piece's ids; ``remember`` trades a worker's
    memory for time. Other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packer(tokenizer, with_ids, remember, end), OUT + (", ids array<int>" if with_ids else ""))
