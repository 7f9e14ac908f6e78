"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of the prefix's encoding: the
token that ends there and stands validly after the last token of what precedes it. Whether two
tokens may stand side by side depends on the pair alone, so one array ``last`` holds the encodings
of all prefixes. Appending bytes extends the array; an edit recomputes it from the edit to the
place where as many entries as the longest token is long agree with the old ones again.

Texts are first split by the tokenizer's pattern, each match encoded by itself, as the tiktoken
library does. The rank table is bounded by the vocabulary file and sent to the executors once.

Edge cases: a null text is the empty text (no ids; the hashes are those of no bytes); a very long
text is encoded whole, one match at a time; repeated rows are encoded one by one; other columns of
the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import ship

CACHED = 120_000  # encoded matches a worker keeps, in each of two generations
CHUNK = 1 << 21  # characters of text whose new matches are encoded together
PAIR = 1 << 32
PAIRS = 300_000  # judged pairs kept


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, with the merge that makes each token and the longest token's length."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._pairs: dict[int, bool] = {}
        self.reachable: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
                self.reachable[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.reachable.get(token[:cut]), self.reachable.get(token[cut:])
                if a is not None and b is not None and self._fits(a, b):
                    self.merge[a, b] = rank
                    self.parts[rank] = (a, b)
                    self.reachable[token] = rank
                    break
        self.suffixes = {b[i:]: -1 for b in self.reachable for i in range(1, len(b))} | self.reachable
        self.longest = max(map(len, ranks), default=1)

    def _fits(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the seam, latest first; a merge across the seam that
        would have come before the one undone means that the pair can't stand."""
        parts, bound = self.parts, len(self.bytes_of) + 1
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = parts[left], parts[right]
            left_whole, right_whole = a[0] == a[1] == left, b[0] == b[1] == right
            if left_whole and right_whole:
                return True
            if not left_whole and (right_whole or left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def fits(self, left: int, right: int) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        fit = self._pairs[left * PAIR + right] = self._fits(left, right)
        return fit


def extend(vocabulary: Vocabulary, data: bytes, last: list[int], stop: int) -> None:
    """Fill ``last`` for the prefixes up to ``stop`` bytes; it holds those of shorter ones. The
    suffixes of a prefix are tried from the shortest on, as long as some token ends in them."""
    get, known = vocabulary.suffixes.get, vocabulary._pairs.get
    for end in range(len(last), stop + 1):
        start = end - 1
        while True:
            token = get(data[start:end])
            if token is None:
                raise ValueError(f"the vocabulary has no token for byte {data[end - 1]}")
            if token >= 0:
                if not start:
                    last.append(token)
                    break
                before = last[start]
                fit = known(before * PAIR + token)
                if fit or fit is None and vocabulary.fits(before, token):
                    last.append(token)
                    break
            start -= 1


class PrefixTable:
    """The encodings of all prefixes of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the entries of earlier prefixes stay."""
        self.data += more
        extend(self.vocabulary, self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; returns the entries recomputed."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start + 1]
        agree = done = 0
        for end in range(start + 1, len(self.data) + 1):
            extend(self.vocabulary, self.data, self.last, end)
            done += 1
            was = end - shift
            agree = agree + 1 if was > stop and old[was] == self.last[-1] else 0
            if agree >= self.vocabulary.longest:
                self.last += old[was + 1:]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes (all, if None)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> Iterator[list[int]]:
    """The ids of each of the sorted ``pieces``. One table serves them all: it keeps the entries of
    the bytes that a piece shares with the one before it. A piece that is itself a token is that
    token."""
    lengths = {r: len(b) for b, r in vocabulary.ranks.items()}
    data, last = b"", [-1]
    for piece in pieces:
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            yield [whole]
            continue
        common, most = 0, min(len(data), len(piece))
        while common < most and data[common] == piece[common]:
            common += 1
        del last[common + 1:]
        data, at, out = piece, len(piece), []
        extend(vocabulary, data, last, at)
        while at:
            out.append(last[at])
            at -= lengths[last[at]]
        yield out[::-1]


class Codec:
    """Whole texts to ids and back, with a bounded cache of encoded matches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.raw = {str(r): b for r, b in vocabulary.bytes_of.items()}

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids of each text, joined by one space."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            split = [self.split(t) for t in texts[i:j]]
            if len(self.new) >= CACHED:
                self.old, self.new = self.new, {}
            here, long = self.new, {}  # long: matches too long to be kept for other texts
            missing = []
            for p in set().union(*split).difference(here):
                if (known := self.old.get(p)) is not None:
                    here[p] = known
                else:
                    missing.append((p.encode(), p))
            missing.sort()
            for (_, p), ids in zip(missing, encode_pieces(self.vocabulary, [b for b, _ in missing]), strict=True):
                (here if len(p) <= 64 else long)[p] = " ".join(map(str, ids))
            get = here.__getitem__ if not long else lambda p, h=here, m=long: h.get(p) or m[p]
            for ps in split:
                yield " ".join(map(get, ps))
            i = j

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.split(" "))) if ids else b""


def codec_on_worker(shared, pattern: str) -> Codec:
    """One codec for each Python worker, reused by its tasks. It hangs on the broadcast value, so its caches go from
    the worker with the broadcast, once a task comes that doesn't use it."""
    vocabulary = shared.value
    held = vars(vocabulary).setdefault("codecs", {})
    if pattern not in held:
        held[pattern] = Codec(vocabulary, pattern)
    return held[pattern]


def share_vocabulary(spark: SparkSession, path: str):
    """The vocabulary as a broadcast variable (its size is that of the vocabulary file)."""
    return spark.sparkContext.broadcast(Vocabulary(load_ranks(path)))


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids) of each document, from its whole
    text. ``round_trip``: the decoded bytes are those of the text. One pass, no shuffle."""
    ship(docs.sparkSession)
    shared = share_vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_on_worker(shared, pattern)
        for text_ids, texts in slices(batches):
            rows = []
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                raw = codec.decode(ids)
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest(),
                             raw == text.encode(), *([np.array(ids.split(), np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names).assign(**{id_col: text_ids})[[id_col, *names]]

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[str]]]:
        """Ids and texts of at most CHUNK characters, or of one longer text."""
        for b in batches:
            texts, at = b["text"].tolist(), 0
            while at < len(texts):
                begun, size = at, 0
                while at < len(texts) and (at == begun or size + len(texts[at]) <= CHUNK):
                    size += len(texts[at])
                    at += 1
                yield b[id_col].iloc[begun:at].reset_index(drop=True), texts[begun:at]

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *(["ids"] if with_ids else [])]
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)
