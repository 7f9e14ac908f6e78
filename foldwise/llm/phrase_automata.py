"""Removal of passages that recur, word by word, found by sharded Aho-Corasick automata.

A word goes if a window of ``window`` words that covers it starts anywhere else too (windows are judged on
the input). The steps, none of which holds more than a shard or a document in a task:

1. Candidates. Every window has an anchor, the least hash among its runs of ``gram`` words, so equal windows
   have equal anchors and neighbouring windows mostly share one. The windows of one anchor at one place are
   a stretch (at most 2 * window - gram words). Anchors are counted over all documents; stretches whose
   anchor stands once can't recur and end here. Texts are read again only for the others.
2. Stretches of equal text become one row with a count before they are dealt out. An anchor with more than
   ``MOST`` different stretches (a common line with ever other words around it) is refined: its windows get
   the anchor longer by half of what is missing, to the left or to the right, until the longer anchors are
   rarer; after at most log2(window) rounds the anchor is the window itself. So no group grows with the data.
3. Dictionary. Anchors are dealt to shards of about ``SHARD`` stretches. A shard confirms, word for word,
   the windows that occur twice or more, joins neighbouring ones to passages and compiles these with
   pyahocorasick (a word is a letter).
4. Search. All documents' stretches of the shard are streamed through its automaton, which gives the covered
   places; those meet the documents by the digests of stretch and text.

Texts equal byte for byte share one key (128 bits of hash), as do equal stretches.

Edge cases: a null text has no words; a text shorter than the window keeps all; rows that repeat are
occurrences of each other, so all their windows go (also rows without an id); places in one document count
like places in two; other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ship, write_shared

WINDOW = 35
GRAM = 12  # words of an anchor
MOST = 2000  # different stretches of an anchor that stay together
SHARD = 8000  # stretches of a shard
TOGETHER = 1 << 18  # words hashed together
COMMON = 100_000  # anchors that are broadcast at most, by their share of all places
BROADCAST_BYTES = 32 << 20  # of places that are broadcast to the texts; beyond, texts are shuffled

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes, in order."""
    h = (left * _MIX[0]) ^ (right + _MIX[1])
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words (fewer than ``size`` words: none)."""
    if len(words) < size:
        return words[:0]
    done, out = 0, None
    power, step = words, 1
    while step <= size:  # runs of 1, 2, 4 ... words; those of the bits of ``size`` are put together
        if size & step:
            out = power if out is None else joined_hash(out[:len(out) - step], power[done:])
            done += step
        power, step = joined_hash(power[:-step], power[step:]) if len(power) > step else power[:0], step * 2
    return out


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of the least one (the first of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def first_of(a, b):
        return np.where(values[b] < values[a], b, a)

    place, size = np.arange(len(values)), 1
    while size * 2 <= width:
        place, size = first_of(place[:len(place) - size], place[size:]), size * 2
    rest = width - size
    return first_of(place[:n], place[rest:rest + n])


def stretches(documents: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, place of the anchor) of every stretch, places counted
    within the document."""
    sizes = np.array([len(d) for d in documents], np.int64)
    begins = np.cumsum(sizes) - sizes
    hashes = np.array([h for d in documents for h in map(xxhash.xxh3_64_intdigest, d)], np.uint64)
    grams = gram_hashes(hashes, gram)
    places = least_places(grams, window - gram + 1)
    document = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    windows = np.arange(len(document)) - np.repeat(np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0)) + begins[document]
    if not len(windows):
        return (np.zeros(0, np.int64),) * 5
    own = places[windows]
    heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (document[1:] != document[:-1])])
    tails = np.r_[heads[1:], len(own)] - 1
    doc = document[heads]
    return doc, grams[own[heads]].view(np.int64), windows[heads] - begins[doc], windows[tails] - begins[doc], own[heads] - begins[doc]


def keys_of(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text, of different seeds."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def split(text) -> list[bytes]:
    return (text.as_py() or b"").split()  # splits at exactly \x20 and \x09-\x0D


PLACES = "anchor long, k1 long, k2 long, first int, last int, place int"


def places_with(window: int, gram: int):
    """Texts (k1, k2, text) to their stretches' places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2), 0
            while at < len(batch):
                begin, documents, held = at, [], 0
                while at < len(batch) and (held < TOGETHER or at == begin):
                    documents.append(split(texts[at]))
                    held, at = held + len(documents[-1]), at + 1
                doc, anchor, first, last, place = stretches(documents, window, gram)
                rows = pa.array(doc + begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(v.astype(np.int32)) for v in (first, last, place)]],
                    names=["anchor", "k1", "k2", "first", "last", "place"])

    return run


STRETCHES = "key long, gram_from int, gram_to int, text binary, k1 long, k2 long, at int"


def record(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_STRETCH = [("key", pa.int64()), ("gram_from", pa.int32()), ("gram_to", pa.int32()), ("text", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())]


def cut_with(window: int, gram: int):
    """Texts (k1, k2, text, wanted) to the rows of their wanted stretches."""
    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, text, wanted in zip(*[batch.column(c) for c in range(4)], strict=True):
                words = split(text)
                for s in wanted.as_py():
                    first, place = s["first"], s["place"]
                    rows.append((s["anchor"], place - first, place - first + gram, b" ".join(words[first:s["last"] + window]), k1.as_py(), k2.as_py(), first))
                if len(rows) > 20000:
                    yield record(rows, _STRETCH)
                    rows = []
            yield record(rows, _STRETCH)

    return run


def refine_with(window: int):
    """Stretches to smaller ones of longer anchors: of the words that a window has beside its anchor, at least
    half (rounded up) stand on one side."""
    def run(batches):
        for batch in batches:
            rows = []
            for _, g0, g1, text, k1, k2, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.split()
                last = len(words) - window
                half = (window - (g1 - g0) + 1) // 2
                right = g1 + window - (g1 - g0) - half + 1
                bound = g0 - half  # windows up to here have ``half`` words to the left of the anchor
                for first, to, a, b in ((0, min(last, bound), g0 - half, g1), (max(0, bound + 1), last, g0, right)):
                    if first <= to:
                        key = xxhash.xxh3_64_intdigest(b" ".join(words[a:b]), seed=b - a) - 2**63
                        rows.append((key, a - first, b - first, b" ".join(words[first:to + window]), k1, k2, at + first))
            yield record(rows, _STRETCH)

    return run


def confirmed(stretch_words: list[tuple], counts: list[int], keys: list[int], window: int) -> list[tuple]:
    """The passages of windows that occur twice or more among stretches; equal windows have equal keys."""
    passages, by_key = set(), {}
    for n, k in enumerate(keys):
        by_key.setdefault(k, []).append(n)
    for members in by_key.values():
        if len(members) == 1 and counts[members[0]] > 1:
            passages.add(stretch_words[members[0]])
            continue
        seen: Counter = Counter()
        for n in members:
            words = stretch_words[n]
            for s in range(len(words) - window + 1):
                seen[words[s:s + window]] += counts[n]
        for n in members:
            words, start = stretch_words[n], None
            for s in range(len(words) - window + 2):
                if s <= len(words) - window and seen[words[s:s + window]] > 1:
                    start = s if start is None else start
                elif start is not None:
                    passages.add(words[start:s - 1 + window])
                    start = None
    return sorted(passages)


def compiled(passages: list[tuple]):
    """The automaton of passages (tuples of word numbers), or None of none."""
    import ahocorasick

    if not passages:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in passages:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return automaton


def covered(automaton, words: tuple) -> list[tuple[int, int]]:
    """The places [from, to) of ``words`` in occurrences of the automaton's passages, joined where they meet."""
    out: list[tuple[int, int]] = []
    for end, length in automaton.iter(words):
        low, high = end - length + 1, end + 1
        while out and out[-1][1] >= low:
            low = min(low, out.pop()[0])
        out.append((low, high))
    return out


FOUND = "s1 long, s2 long, low int, high int"


def search_with(window: int):
    """A shard's stretches (key, text, s1, s2, n) to what its automaton covers of each."""
    def run(shard: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        words = [tuple([numbers.setdefault(w, len(numbers)) for w in t.split()]) for t in shard["text"].to_pylist()]
        automaton = compiled(confirmed(words, shard["n"].to_pylist(), shard["key"].to_pylist(), window))
        rows = []
        if automaton is not None:
            for w, s1, s2 in zip(words, shard["s1"].to_pylist(), shard["s2"].to_pylist(), strict=True):
                rows += [(s1, s2, low, high) for low, high in covered(automaton, w)]
        return pa.Table.from_batches([record(rows, [("s1", pa.int64()), ("s2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])])

    return run


def grouped_stretches(rows: DataFrame, window: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(all stretches, their different texts with counts), refined until no anchor has more than ``most`` texts."""
    kept, different = [], []
    while True:
        texts = write_shared(rows.groupBy("key", "gram_from", "gram_to", "text").agg(F.count("*").alias("n")), "texts")
        crowded = write_shared(texts.groupBy("key").agg(F.count("*").alias("texts"), F.max(F.col("gram_to") - F.col("gram_from")).alias("gram"))
                               .where((F.col("texts") > most) & (F.col("gram") < window)).select(F.col("key").alias("crowded")), "crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*kept, rows]), reduce(DataFrame.unionByName, [*different, texts])
        apart = lambda df, how: df.join(crowded, df["key"] == crowded["crowded"], how)
        kept.append(apart(rows, "left_anti"))
        different.append(apart(texts, "left_anti"))
        rows = write_shared(apart(rows, "left_semi").mapInArrow(refine_with(window), STRETCHES), "refined")


def to_texts(texts: DataFrame, places: DataFrame, column: str, how: str, limit: int) -> DataFrame:
    """``texts`` (k1, k2, ...) with ``places`` (k1, k2 and an array): the places are broadcast if their measured
    size (96 bytes a row, 64 an entry of the array, as objects) is within ``limit``, else texts are shuffled."""
    bytes_ = places.agg(F.coalesce(F.sum(F.size(column).cast("long") * 64 + 96), F.lit(0))).first()[0]
    return texts.join(F.broadcast(places) if bytes_ <= limit else places.hint("shuffle_merge"), ["k1", "k2"], how)


def recurring_places(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST, shard: int = SHARD,
                     broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(k1, k2, spans): for the keys of each text the word places [low, high) covered by recurring windows."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("binary")
    texts = docs.select(*keys_of(text), text.alias("text")).where("text IS NOT NULL")
    places = write_shared(texts.mapInArrow(places_with(window, gram), PLACES), "places")
    again = write_shared(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "again")
    # at most COMMON anchors stand more often than that share of all places: those are broadcast, so that no key of the
    # shuffle join holds more than the share
    common = F.broadcast(again.where(F.col("n") > places.count() / COMMON).select("anchor"))
    met = places.join(common, "anchor", "left_semi").unionByName(
        places.join(common, "anchor", "left_anti").join(again.select("anchor"), "anchor", "left_semi"))
    wanted = met.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "first", "last", "place")).alias("wanted"))
    wanted = write_shared(wanted, "wanted")
    cut = to_texts(texts, wanted, "wanted", "inner", broadcast_bytes).select("k1", "k2", "text", "wanted")
    rows = write_shared(cut.mapInArrow(cut_with(window, gram), STRETCHES), "stretches")
    rows, different = grouped_stretches(rows, window, most)
    digest = [F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(1), F.col("text")).alias("s2")]
    shards = max(1, -(-different.count() // shard))
    found = (different.select("key", "text", *digest, "n", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
             .groupBy("shard").applyInArrow(search_with(window), FOUND))
    found = write_shared(found, "found")
    spans = rows.select("k1", "k2", "at", *digest).distinct().join(found, ["s1", "s2"])
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))).alias("spans"))
    return write_shared(spans, "spans")


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = MOST,
                     shard: int = SHARD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row: the kept words joined by one space."""
    spans = recurring_places(docs, text_col, window, gram, most, shard, broadcast_bytes)
    text = F.col(text_col).cast("binary")
    texts = docs.select(*keys_of(text), F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = split(t)
                stays = np.ones(len(words), bool)
                for s in spans.as_py() or ():
                    stays[s["low"]:s["high"]] = False
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()] if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "text"])

    joined = to_texts(texts, spans, "spans", "left", broadcast_bytes).select("doc_id", "text", "spans")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, text string")
