"""Near-duplicate groups by ProbMinHash, banding and verification.

A document is a bag of shingles of five words, each weighted by its count. The similarity is the
probability Jaccard index of the two bags, which counts shingles by their share of the document and
equals the Jaccard index where no shingle repeats. ProbMinHash: each shingle sends arrivals of a
Poisson process at a rate of its weight, each arrival strikes one register, and a register keeps
the shingle that struck first; a shingle stops as soon as its next arrival comes after the last
register's. Two documents agree on a register with the probability of their similarity.

Links are pairs of 0.8 or more that share a band, groups are what links connect:

1. texts of the same words collapse to the least id (a hash of the words, any number of copies);
2. in each bucket every member is verified against two leaders, the bucket's best connected member
   and its least id (linear in the bucket), and verified links are joined into components;
3. members of a bucket that are in different components by then are verified against each other in
   blocks of bounded size. So all links are found that share a band, and the pairs of a large group
   are never written out.

25 bands of 5 registers: a pair of similarity 0.8 is missed with a probability of 0.00005.

Edge cases: texts without words (null, empty, only marks) are groups of their own; fewer than five
words are one shingle; rows without an id can't be named and get a null class; rows that repeat an id
and a text are one document; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import broadcast_up_to, ship, write_shared
from foldwise.llm.components import connected_components

WORD = re.compile(r"\w+")
SHINGLE, LEAST = 5, 0.8
BANDS, BAND_ROWS = 25, 5
REGISTERS = BANDS * BAND_ROWS
ELEMENTS = 1 << 16  # shingles sketched together
WORDS_KEPT = 60_000  # word hashes that a worker keeps
BLOCK_A, BLOCK_B = 128, 512  # documents of one verification block
BROADCAST_IDS = 2_000_000  # ids with hashes (24 bytes) sent to the texts; more of them meet the texts in a shuffle
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, known: Words) -> np.ndarray:
    return np.array([known[w] for w in WORD.findall(text.lower())], np.uint64)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, counts) of the runs of five words; all words, if there are fewer."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n if len(words) else 0, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = (out + words[i:i + n]) * _M1 + _GOLD
    return np.unique(mix(out), return_counts=True)


def sketch(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of ``docs`` bags given as flat arrays: docs x registers, the element that struck
    each register first."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint64)
    time, turn = np.zeros(len(doc)), 0
    last = np.full(docs, np.inf)
    while len(doc):
        turn += 1
        u = mix(element + np.uint64(turn * int(_GOLD) % 2**64))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * registers + (mix(u ^ _M2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        struck = first[slot] == time
        winner[slot[struck]] = element[struck]
        if turn <= 8 or turn % 8 == 0:
            open_ = np.unique(doc)
            last[open_] = first.reshape(docs, registers)[open_].max(1)
            on = time < last[doc]
            doc, element, weight, time = doc[on], element[on], weight[on], time[on]
    return winner.reshape(docs, registers)


def bands(winners: np.ndarray) -> np.ndarray:
    """A hash of each band of registers; docs x bands."""
    rows = winners.reshape(len(winners), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, rows.shape[:2]).copy()
    for i in range(BAND_ROWS):
        out = mix(out + rows[:, :, i])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two (sorted elements, weights) bags, in n log n: elements sorted
    by the ratio of their weights, the sums of maxima are prefix and suffix sums."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])] = a[1]
    y[np.searchsorted(union, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    left, right = np.cumsum(x), y.sum() - np.cumsum(y)
    both = (x > 0) & (y > 0)
    return float(np.sum(1.0 / (left[both] / x[both] + right[both] / y[both])))


def document_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, key, bands): the number of words, a 128-bit hash of them, and the band hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for b in batches:
            ids, texts = b["id"].tolist(), b["text"].tolist()
            at = 0
            while at < len(ids):
                n_words, keys, sizes, elements, weights, begun = [], [], [], [], [], at
                total = 0
                while at < len(ids) and total < ELEMENTS:
                    words = word_hashes(texts[at], known)
                    n_words.append(len(words))
                    keys.append(xxhash.xxh3_128_digest(words.tobytes()))
                    e, w = shingles(words)
                    elements.append(e)
                    weights.append(w)
                    sizes.append(len(e))
                    total += len(e)
                    at += 1
                doc = np.repeat(np.arange(len(sizes)), sizes)
                found = bands(sketch(doc, np.concatenate(elements), np.concatenate(weights).astype(np.float64), len(sizes)))
                yield pd.DataFrame({"id": ids[begun:at], "words": n_words, "key": keys, "bands": list(found)})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id IS NOT NULL").mapInPandas(
        run, "id long, words int, key binary, bands array<long>")


def bags(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, elements, weights) of the documents of ``ids`` (id, key)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                words = [word_hashes(t, known) for t in part["text"]]
                own = [xxhash.xxh3_128_digest(w.tobytes()) == k for w, k in zip(words, part["key"], strict=True)]  # an id may have several texts
                pairs = [shingles(w) for w, o in zip(words, own, strict=True) if o]
                if pairs:
                    yield pd.DataFrame({"id": part["id"][own], "elements": [e.view(np.int64) for e, _ in pairs], "weights": [w.astype(np.int32) for _, w in pairs]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(ids, "id").mapInPandas(run, "id long, elements array<long>, weights array<int>").dropDuplicates(["id"])


def _bag(elements, weights) -> tuple[np.ndarray, np.ndarray]:
    e = np.asarray(elements, np.int64).view(np.uint64)
    return e, np.asarray(weights, np.float64)


def verify_pairs(pairs: DataFrame, bag: DataFrame, least: float = LEAST) -> DataFrame:
    """The (a, b) of ``pairs`` whose similarity is at least ``least``."""

    @F.pandas_udf("double")
    def score(e1: pd.Series, w1: pd.Series, e2: pd.Series, w2: pd.Series) -> pd.Series:
        return pd.Series([similarity(_bag(a, b), _bag(c, d)) for a, b, c, d in zip(e1, w1, e2, w2, strict=True)], dtype=float)

    one = bag.select(F.col("id").alias("a"), F.col("elements").alias("e1"), F.col("weights").alias("w1"))
    two = bag.select(F.col("id").alias("b"), F.col("elements").alias("e2"), F.col("weights").alias("w2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", score("e1", "w1", "e2", "w2").alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def verify_block(left: pd.DataFrame, right: pd.DataFrame, least: float = LEAST) -> pd.DataFrame:
    """Links between two blocks of (id, comp, elements, weights). The mass of the shared elements
    bounds the similarity on either side, so only pairs that share enough are computed."""
    out = []
    if len(left) and len(right):
        ids, comps = right["id"].to_numpy(), right["comp"].to_numpy()
        other = [_bag(e, w) for e, w in zip(right["elements"], right["weights"], strict=True)]
        element = np.concatenate([e for e, _ in other])
        share = np.concatenate([w / w.sum() for _, w in other])
        owner = np.repeat(np.arange(len(other)), [len(e) for e, _ in other])
        order = np.argsort(element, kind="stable")
        element, share, owner = element[order], share[order], owner[order]
        for i, comp, e, w in zip(left["id"], left["comp"], left["elements"], left["weights"], strict=True):
            mine = _bag(e, w)
            lo, hi = np.searchsorted(element, mine[0], "left"), np.searchsorted(element, mine[0], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            theirs = np.bincount(owner[at], share[at], len(other))
            ours = np.bincount(owner[at], np.repeat(mine[1] / mine[1].sum(), n), len(other))
            for j in np.flatnonzero((np.minimum(theirs, ours) >= least - 1e-9) & (comps != comp)):
                if (s := similarity(mine, other[j])) >= least - 1e-12:
                    out.append((i, int(ids[j]), s))
    return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": float})


def remaining_links(buckets: DataFrame, comps: DataFrame, bag: DataFrame, least: float = LEAST) -> DataFrame:
    """Links between members of one bucket that are neither its leaders nor yet in one component.
    Each bucket's largest component is its home; the other members (its guests) are compared with
    the home's members and with the home's other guests, once for all buckets, in blocks."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    members = buckets.join(comps, buckets["rep"] == comps["node"]).join(sizes, "comp").select("bucket", "rep", "comp", "size")
    home = members.groupBy("bucket").agg(F.max(F.struct("size", "comp"))["comp"].alias("home"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket", "home")
    guests = write_shared(members.join(home, "bucket").where("comp <> home").select("home", "rep", "comp").distinct(), "guests")
    hosts = guests.select("home").distinct()
    hosted = comps.join(hosts, comps["comp"] == hosts["home"], "left_semi").select(F.col("comp").alias("home"), F.col("node").alias("rep"), "comp")
    everyone = write_shared(hosted.unionByName(guests), "hosted")
    blocks = lambda rows, name, size: rows.groupBy("home").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    counts = blocks(guests, "na", BLOCK_A).join(blocks(everyone, "nb", BLOCK_B), "home")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = guests.join(counts, "home").select("home", place("na").alias("i"), F.explode(spread("nb")).alias("j"), "rep", "comp")
    right = everyone.join(counts, "home").select("home", F.explode(spread("na")).alias("i"), place("nb").alias("j"), "rep", "comp")
    names = ["home", "i", "j", "id", "comp", "elements", "weights"]
    left, right = (x.join(bag.withColumnRenamed("id", "rep"), "rep").select("home", "i", "j", "rep", "comp", "elements", "weights").toDF(*names) for x in (left, right))
    return left.groupBy("home", "i", "j").cogroup(right.groupBy("home", "i", "j")).applyInPandas(
        lambda a, b: verify_block(a, b, least), "a long, b long, similarity double").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, class_id, copies, links): the least id of each document's group, the documents of exactly
    its words, and the verified links of its text to other texts."""
    ship(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    own = write_shared(document_bands(docs, id_col, text_col), "bands")
    texts = write_shared(own.where("words > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "texts")
    spread = texts.select("rep", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = write_shared(spread.join(full, "bucket"), "buckets")
    score = buckets.groupBy("rep").agg(F.sum("n").alias("score"))
    ends = write_shared(score.join(texts.select("rep", "key"), "rep"), "ends")
    ranked = buckets.join(ends.select("rep", "score"), "rep").select("bucket", "rep", "score")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep")))["rep"].alias("best"), F.min("rep").alias("low")).select("bucket", (-F.col("best")).alias("best"), "low")
    led = write_shared(buckets.join(leaders, "bucket").select("bucket", "rep", "best", "low"), "led")
    star = led.select("rep", F.explode(F.array_distinct(F.array("best", "low"))).alias("leader")).where("rep <> leader")
    pairs = star.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    bag = write_shared(bags(docs, broadcast_up_to(ends.select(F.col("rep").alias("id"), "key"), BROADCAST_IDS), id_col, text_col), "bags")
    links = write_shared(verify_pairs(pairs, bag, least), "links")
    comps = connected_components(links, ends.select(F.col("rep").alias("node"), F.col("rep").alias("comp")))
    more = write_shared(remaining_links(led.where("rep <> best AND rep <> low").select("bucket", "rep"), comps, bag, least), "links")
    comps = connected_components(more, comps)
    found = links.unionByName(more)
    degree = found.select(F.col("a").alias("rep")).union(found.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    named = texts.join(comps, texts["rep"] == comps["node"], "left").join(degree, "rep", "left").select(
        "key", F.coalesce("comp", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    classes = own.where("words > 0").select("id", "key").join(named, "key").select("id", "class_id", "copies", "links")
    single = own.where("words = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return classes.unionByName(single).unionByName(nameless).withColumnRenamed("id", id_col)
