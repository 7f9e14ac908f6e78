"""Runs of repeated words (maximal periodicities) by block convolution.

A run is a stretch with smallest period q, at least ``max(least, 2 q)`` words long, that no neighbouring
word extends keeping period q. Periods are sought by dyadic scales: for q in [P, 2P) the text is cut into
blocks of at most P/2 words, one at every P/2. The words of a run that have an equal one q further on
are at least q in a row, so they hold a whole block, and that block occurs again exactly q words on.
For every block the sum of squared differences to the text at all distances of the scale is
sum(x*x) + sum(y*y) - 2 * correlation, the correlation of all blocks by number-theoretic transforms modulo
65537 (a fold instead of a division); where it is zero the block may stand. Equal words give zero whatever
their numbers are, so no occurrence is missed; a zero by accident of the modulus dies in the extension, which
compares words. Distances seed extensions to both sides, and an extension of the needed length is a run.

Left out before the transforms are only blocks that can't have an occurrence in their window, as their
first three words have none there. A distance that is a multiple of the period of a run found before that
holds a whole period isn't extended again (the stretch's smallest period is the run's), so texts of one
word stay linear in each scale. A task holds documents of about ``TOGETHER`` words at once, or a single
longer one.

Edge cases: a null text is an empty one; documents without a run keep their words; a null id is a
document like others; rows that repeat are each given; other columns are left out. An empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ship

PRIME = 65537
LARGEST = 1 << 14  # of a transform
TOGETHER = 1 << 18  # words searched together
CELLS = 1 << 16  # numbers transformed together
PROBE = 16  # words that all seeds are extended by at first


def fold(t: np.ndarray) -> np.ndarray:
    """``t`` modulo 65537 up to a multiple: 2**16 is -1 there."""
    return (t & 0xFFFF) - (t >> 16)


class Transform:
    """Transforms of ``size`` numbers modulo 65537, a row each; spectra are in bit-reversed order."""

    def __init__(self, size: int):
        root = pow(3, (PRIME - 1) // size, PRIME)
        self.size, self.over = size, pow(size, -1, PRIME)
        self.forth, self.back = {}, {}
        half = size // 2
        while half:
            step = pow(root, size // (2 * half), PRIME)
            for table, w in ((self.forth, step), (self.back, pow(step, -1, PRIME))):
                table[half] = np.array([pow(w, j, PRIME) for j in range(half)], np.int64)
            half //= 2

    def spectrum(self, rows: np.ndarray) -> np.ndarray:
        a = rows
        for half in sorted(self.forth, reverse=True):
            pairs = a.reshape(len(rows), -1, 2, half)
            u, v = pairs[:, :, 0], pairs[:, :, 1]
            a = np.stack([u + v, fold((u - v) * self.forth[half])], axis=2)
        return fold(fold(a.reshape(len(rows), self.size)))

    def inverse(self, spectra: np.ndarray) -> np.ndarray:
        a = spectra
        for half in sorted(self.back):
            pairs = a.reshape(len(spectra), -1, 2, half)
            u, v = pairs[:, :, 0], fold(pairs[:, :, 1] * self.back[half])
            a = np.stack([u + v, u - v], axis=2)
        return fold(fold(a.reshape(len(spectra), self.size))) * self.over


_TRANSFORMS: dict[int, Transform] = {}


def transform(size: int) -> Transform:
    if size not in _TRANSFORMS:
        _TRANSFORMS[size] = Transform(size)  # at most 12 tables, together smaller than 1 MB
    return _TRANSFORMS[size]


def scales(longest: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first distance, distances, words between blocks, block words, transform size) for documents of up to
    ``longest`` words."""
    yield 1, 7, 3, 3, 16
    p = 8
    while 2 * p <= longest:
        size = min(2 * p, LARGEST)
        for first in range(p, 2 * p, size // 2):
            yield first, size // 2, p // 2, size // 4, size
        p *= 2


class Texts:
    """Documents one after the other: the number of each word, and where each document begins and ends."""

    def __init__(self, documents: list[np.ndarray]):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.words = np.concatenate([np.zeros(0, np.int64), *documents])
        self.begins = np.cumsum(sizes) - sizes
        self.ends = self.begins + sizes
        n = len(self.words)
        self.residue = np.concatenate([self.words % PRIME, np.zeros(2 * LARGEST, np.int64)])
        self.squares = np.concatenate([[0], np.cumsum(self.residue**2)])
        # numbers of three words in a row (across the end of a document too; such blocks are never asked for)
        kinds = int(self.words.max(initial=0)) + 1
        pair = np.unique(self.words[:-1] * kinds + self.words[1:], return_inverse=True)[1] if n > 1 else np.zeros(0, np.int64)
        triple = np.unique(pair[:-1] * kinds + self.words[2:], return_inverse=True)[1] if n > 2 else np.zeros(0, np.int64)
        self.triple = triple
        self.placed = np.sort(triple * np.int64(n + 1) + np.arange(len(triple)))
        # the run reaching furthest over each word: its end and period
        self.reach, self.period = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.runs: list[dict[tuple[int, int], int]] = [{} for _ in documents]

    def blocks(self, first: int, count: int, stride: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, document) of the blocks whose first words stand in their window again."""
        room = self.ends - self.begins - first - size
        per = np.where(room >= 0, room // stride + 1, 0)
        document = np.repeat(np.arange(len(per)), per)
        at = self.begins[document] + stride * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        if not len(at):
            return at, document
        n = np.int64(len(self.words) + 1)
        asked = self.triple[at] * n + at + first
        where = np.searchsorted(self.placed, asked)
        found = self.placed[np.minimum(where, len(self.placed) - 1)]
        there = (where < len(self.placed)) & (found < asked + count)
        # the next place must be of the same words, which the bound shows unless it wraps to other words
        there &= found // n == self.triple[at]
        return at[there], document[there]

    def seeds(self, first: int, count: int, stride: int, block: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, document, distance) of the blocks' occurrences at the scale's distances."""
        at, document = self.blocks(first, count, stride, block)
        ntt, out = transform(size), []
        rows = max(1, CELLS // size)
        for k in range(0, len(at), rows):
            begin, doc = at[k:k + rows], document[k:k + rows]
            x = np.zeros((len(begin), size), np.int64)
            x[:, -np.arange(block) % size] = self.residue[begin[:, None] + np.arange(block)]
            y = np.zeros((len(begin), size), np.int64)
            span = count + block - 1
            y[:, :span] = self.residue[begin[:, None] + first + np.arange(span)]
            correlation = ntt.inverse(fold(ntt.spectrum(x) * ntt.spectrum(y)))[:, :count]
            other = begin[:, None] + first + np.arange(count)
            last = len(self.squares) - 1
            left = (self.squares[begin + block] - self.squares[begin])[:, None]
            right = self.squares[np.minimum(other + block, last)] - self.squares[np.minimum(other, last)]
            zero = ((left + right - 2 * correlation) % PRIME == 0) & (other + block <= self.ends[doc][:, None])
            row, q = np.nonzero(zero)
            out.append((begin[row], doc[row], q + first))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def probe(self, at: np.ndarray, doc: np.ndarray, q: np.ndarray, block: int, least: int) -> np.ndarray:
        """Whether each seed may become a run: equal over the whole block, and not stopped too early on both sides."""
        begin, end, last = self.begins[doc], self.ends[doc] - q, len(self.words) - 1
        same = np.ones(len(at), bool)
        got = np.zeros(len(at), np.int64)
        for t in range(min(block, PROBE)):
            same &= self.words[at + t] == self.words[at + t + q]
        open_left, open_right = same.copy(), same.copy()
        for t in range(1, PROBE + 1):
            left = at - t
            open_left &= (left >= begin) & (self.words[np.maximum(left, 0)] == self.words[np.maximum(left, 0) + q])
            right = at + block - 1 + t
            open_right &= (right < end) & (self.words[np.minimum(right, last)] == self.words[np.minimum(right + q, last)])
            got += open_left.astype(np.int64) + open_right
        return same & (open_left | open_right | (got + block >= np.maximum(q, least - q)))

    def extend(self, at: int, q: int, begin: int, end: int) -> tuple[int, int]:
        """The words around ``at`` that equal the one q further on, as [from, to)."""
        w = self.words
        to, step = at, 32
        while to < end - q:
            far = min(to + step, end - q)
            differs = w[to:far] != w[to + q:far + q]
            if differs.any():
                to += int(differs.argmax())
                break
            to, step = far, step * 2
        start, step = at, 32
        while start > begin:
            far = max(start - step, begin)
            differs = (w[far:start] != w[far + q:start + q])[::-1]
            if differs.any():
                start -= int(differs.argmax())
                break
            start, step = far, step * 2
        return start, to

    def search(self, least: int) -> list[list[tuple[int, int, int]]]:
        """The (start, length, period) of each document's runs, by start and period."""
        for first, count, stride, block, size in scales(int((self.ends - self.begins).max(initial=0))):
            at, doc, q = self.seeds(first, count, stride, block, size)
            known = (self.reach[at] >= at + q) & (q % self.period[at] == 0) & (self.period[at] < q)
            at, doc, q = at[~known], doc[~known], q[~known]
            if not len(at):
                continue
            may = self.probe(at, doc, q, block, least)
            at, doc, q = at[may], doc[may], q[may]
            order = np.lexsort((at, q))
            done = (-1, -1)  # (distance, word up to which its stretches are known)
            for a, d, p in zip(at[order].tolist(), doc[order].tolist(), q[order].tolist(), strict=True):
                if (p == done[0] and a < done[1]) or (self.reach[a] >= a + p and self.period[a] < p and p % self.period[a] == 0):
                    continue
                begin, end = int(self.begins[d]), int(self.ends[d])
                start, to = self.extend(a, p, begin, end)
                done = (p, to)
                stop = to + p
                if stop - start >= max(least, 2 * p) and (start, stop) not in self.runs[d]:  # smaller periods came first
                    self.runs[d][start, stop] = p
                    further = self.reach[start:stop] < stop
                    self.reach[start:stop][further] = stop
                    self.period[start:stop][further] = p
        return [sorted((s - int(b), e - s, p) for (s, e), p in found.items()) for found, b in zip(self.runs, self.begins, strict=True)]


def runs_of(documents: list[np.ndarray], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """The runs of documents given as arrays of word numbers (equal words have equal numbers, from 0)."""
    return Texts(documents).search(least)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words is kept: of every run its first period is."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return kept


def planted_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place when the words from g % n on repeat 3 to 10 times, for ids with
    crc32 % 10 = 0, where g = crc32 // 10; None for others and for a null id."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text",
                  replant: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs by start and period, text of the kept words joined by one space) of every row;
    ``replant(id, n)`` may give the places whose words to read instead of the text's own order."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                numbers: dict[bytes, int] = {}
                documents, begin, held = [], at, 0
                while at < len(batch) and (held < TOGETHER or at == begin):
                    words = (texts[at].as_py() or b"").split()  # splits at exactly \x20 and \x09-\x0D
                    own = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
                    places = replant(ids[at].as_py(), len(own)) if replant else None
                    documents.append(own if places is None else own[places])
                    held, at = held + len(own), at + 1
                vocabulary = list(numbers)
                found = runs_of(documents, least)
                kept = [b" ".join([vocabulary[i] for i in d[kept_words(len(d), runs)].tolist()]) for d, runs in zip(documents, found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, at - begin), pa.array([len(d) for d in documents], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], run_type),
                    pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "text"])

    return rows.mapInArrow(search, f"doc_id {kind}, n_words long, runs {RUNS}, text string")
