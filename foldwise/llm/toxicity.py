"""Toxicity by noisy-channel deobfuscation and a classifier of the restored text.

Parts of a text that may hide words - letters next to digits or signs that stand for letters, letters
repeated three times and more, single letters set apart - become character lattices: each sign may be
one of the letters it stands for, a run one or two letters, a gap a word break or nothing. Viterbi
decoding under a character trigram model of all documents picks the reading; the rest of the text
is left as it is. The restored text is scored by a logistic model of the words and word beginnings
(4 to 6 letters) that it holds.

Learned with Spark: the trigram counts of all documents (a fixed table of A**3 cells); the share of
toxic rows among all labelled training rows; and, from at most ``SAMPLE`` labelled training rows of
each class (those of the least id hashes, one for each set of similar texts), the features that stand
out and their weights. ``MOST`` bounds the features. Labels outside the training rows are never read.

Edge cases: empty and null texts score as texts without any feature; texts are read whole; with no
labels, or of one class alone, the score is the share of toxic rows (0.5 without labels); rows that
repeat an id are scored one by one, and a row's label is toxic if any of its id's is; other columns
of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import id_remainder, ship, write_shared

#: Letters that signs may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c"}
SIGN_COST, KEEP_COST, RUN_COST, JOIN_COST, BREAK_COST = 1.0, 25.0, 0.5, 0.5, 2.0
ALPHABET = 96
SAMPLE, MOST = 3000, 4000
CACHED = 60_000
WORD = re.compile(r"\w+")
_SET = re.escape("".join(c for c in SIGNS if not c.isdigit()))
#: A word with a sign or digit among letters or a run of three; or at least four single letters set apart alike.
HIDDEN = re.compile(rf"(?<![\w{_SET}])[\w{_SET}](?:([ .\-_*])[\w{_SET}])(?:\1[\w{_SET}]){{2,}}(?![\w{_SET}])"
                    rf"|\w*(?:[^\W\d_][{_SET}0-9]+[^\W\d_]|(?<!\w)[@$0-9][^\W\d_]{{2}}|([^\W\d_])\2\2)(?:[{_SET}]*\w)*")
#: Where a text may hold such parts beside its words: signs between word characters or before two letters (any part
#: with a sign begins so or ends in a word character), or single letters set apart, as in ``HIDDEN``.
SIGNED = re.compile(rf"(?<=\w)[{_SET}]+\w|[@$](?=[^\W\d_]{{2}})")
APART = re.compile(rf"(?<![\w{_SET}])[\w{_SET}](?:([ .\-_*])[\w{_SET}])(?:\1[\w{_SET}]){{2,}}(?![\w{_SET}])")


def alphabet() -> np.ndarray:
    """Number of each character below 0x250: letters 1 to 95 in order (letters beyond share the last), 0 for all else."""
    out = np.zeros(0x250, np.int64)
    for i, c in enumerate(sorted({chr(c).lower() for c in range(0x250) if chr(c).isalpha() and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250})):
        out[ord(c)] = min(i + 1, ALPHABET - 1)
    return out


NUMBER = alphabet()


def numbers(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, NUMBER[np.minimum(points, 0x24F)], 0)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of three characters in a row over all documents, words set apart by one break."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for i in range(0, len(texts), 256):
                n = numbers(" ".join(["", *texts[i:i + 256], ""]).lower())
                n = n[np.concatenate([[True], (n[1:] > 0) | (n[:-1] > 0)])]
                total += np.bincount((n[:-2] * ALPHABET + n[1:-1]) * ALPHABET + n[2:], minlength=len(total))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"cell": hit, "n": total[hit]})

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(ALPHABET**3)
    got = rows.toArrow()  # at most A**3 rows
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(ALPHABET, ALPHABET, ALPHABET)


class Restorer:
    """Viterbi decoding of character lattices under the trigram model."""

    def __init__(self, trigrams: np.ndarray):
        one = (trigrams.sum((0, 1)) + 1) / (trigrams.sum() + ALPHABET)
        two = (trigrams.sum(0) + 50 * one) / (trigrams.sum((0, 2))[:, None] + 50)
        three = (trigrams + 20 * two[None]) / (trigrams.sum(2, keepdims=True) + 20)
        self.cost = -np.log(three).astype(np.float32)
        self.seen: dict[str, str] = {}
        self.plain: dict[str, tuple[str, ...]] = {}

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """(output, cost) arcs of each run of like characters."""
        gaps = len(text) >= 7 and all(c in " .-_*" and c == text[1] for c in text[1::2])
        arcs, i = [], 0
        while i < len(text):
            c, j = text[i], i + 1
            if gaps and i % 2:
                arcs.append([("", JOIN_COST), (" ", BREAK_COST)])
                i += 1
                continue
            while not gaps and j < len(text) and text[j] == c:
                j += 1
            n, letters = j - i, SIGNS.get(c, "")
            if letters:
                arcs.append([(x * k, SIGN_COST) for x in letters for k in range(1, min(n, 2) + 1)] + [(c * n, KEEP_COST)] + ([(" ", 2.0)] if c in "!|+(" else []))
            elif c.isalpha():
                arcs.append([(c, RUN_COST if n > 1 else 0.0)] + ([(c * 2, 0.0 if n == 2 else RUN_COST)] if n > 1 else []))
            else:
                arcs.append([(" ", 0.0)])
            i = j
        return arcs

    def decode(self, text: str) -> str:
        known = self.seen.get(text)
        if known is not None:
            return known
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for arcs in [*self.lattice(text), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for out, cost in arcs:
                    total, x, y = score + cost, a, b
                    for c in out:
                        z = ord(c)
                        z = int(NUMBER[z]) if z < 0x250 else 0
                        if z or y:  # one break between words
                            total += float(self.cost[x, y, z])
                            x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (path, out))
            best = new
        path, parts = min(best.values(), key=lambda v: v[0])[1], []
        while path is not None:
            parts.append(path[1])
            path = path[0]
        out = "".join(reversed(parts)).strip()
        if len(text) <= 64:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            self.seen[text] = out
        return out

    def restore(self, text: str) -> str:
        """The lower-cased text with its hidden words in plain letters."""
        return HIDDEN.sub(lambda m: self.decode(m[0]), text.lower())

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text. Only texts with signs or letters set apart are restored
        as a whole; else what is hidden is inside single words, each of which is looked at once."""
        low = text.lower()
        if SIGNED.search(low) or APART.search(low):
            return set(WORD.findall(self.restore(low)))
        out: set[str] = set()
        for w in set(WORD.findall(low)):
            plain = self.plain.get(w)
            if plain is None:
                if len(self.plain) >= 2 * CACHED:
                    self.plain.clear()
                plain = self.plain[w] = (w,) if not HIDDEN.search(w) else tuple(WORD.findall(self.restore(w)))
            out.update(plain)
        return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


def similar_key(words: list[str]) -> int:
    """The least hash of three words in a row: similar texts mostly share it."""
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i:i + 3])) >> 1 for i in range(max(1, len(words) - 2))), default=0)


class Classifier:
    """score = logistic(bias + weights of the features present)."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.of = bias, weights, {}

    def score(self, words: set[str]) -> float:
        """``words``: those of the restored text."""
        hit: set[str] = set()
        for w in words:
            own = self.of.get(w)
            if own is None:
                if len(self.of) >= 2 * CACHED:
                    self.of.clear()
                own = self.of[w] = tuple(f for f in features(w) if f in self.weights)
            if own:
                hit.update(own)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in sorted(hit))))))


def fit(docs: DataFrame, labels: DataFrame, restorer: Restorer, id_col: str, text_col: str, label_col: str) -> Classifier:
    """``labels``: training labels alone."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        p = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Classifier(math.log(p / (1 - p)), {})
    ids = None
    for y in (0, 1):
        own = marked.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
        ids = own if ids is None else ids.unionByName(own)
    shared = spark.sparkContext.broadcast(restorer)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "key": [similar_key(WORD.findall(t.lower())) for t in b["text"]],
                                "words": [sorted(shared.value.words(t)) for t in b["text"]]})

    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(write_shared(ids, "ids")), id_col).select(F.col(id_col).alias("id"), "y", "text").mapInPandas(read, "id long, y int, key long, words array<string>")  # at most 2 * SAMPLE ids
    rows = write_shared(rows.dropDuplicates(["id"]).withColumn("first", F.min("id").over(Window.partitionBy("key"))).where("id = first").drop("first"), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, words in zip(b["y"], b["words"], strict=True):
                found[y].update({f for w in words for f in features(w)})
        for y, counts in found.items():
            if counts:
                yield pd.DataFrame({"y": y, "feature": list(counts), "n": list(counts.values())}).astype({"n": "int64", "y": "int32"})

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = size.get(0, 0) + 1, size.get(1, 0) + 1
    sums = rows.mapInPandas(count, "y int, feature string, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    strength = (F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("c") + 0.5) / clean)) * F.sqrt(F.col("t") + F.col("c"))
    chosen = sums.where("t + c >= 5").withColumn("s", strength).where(F.abs("s") >= 6).orderBy(F.desc(F.abs("s")), "feature").limit(MOST).collect()
    if not chosen:
        return Classifier(math.log((n[1] + 0.5) / (n[0] + 0.5)), {})
    place = {r["feature"]: i for i, r in enumerate(chosen)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "hit": [sorted({place[f] for w in words for f in features(w) if f in place}) for words in b["words"]]})

    held = rows.select("y", "words").mapInPandas(present, "y int, hit array<int>").toPandas()  # at most 2 * SAMPLE rows
    weights, bias = logistic(held["hit"].tolist(), held["y"].to_numpy(np.float64), len(place))
    prior = math.log((n[1] + 0.5) / (n[0] + 0.5)) - math.log(toxic / clean)
    return Classifier(bias + prior, {f: float(weights[i]) for f, i in place.items()})


def logistic(hits: list[list[int]], y: np.ndarray, k: int, rounds: int = 1500, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of 0/1 features by accelerated gradient steps."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.array([i for h in hits for i in h], np.int64)
    w, b, ahead, ahead_b, n = np.zeros(k), 0.0, np.zeros(k), 0.0, len(y)
    most = max((len(h) for h in hits), default=0) + 1  # the curvature is at most that of `most` separate features
    step, step_b = 1 / (0.25 * most * np.bincount(col, minlength=k) + ridge), 1 / (0.25 * most * n)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + np.bincount(row, ahead[col], n), -30, 30)))
        new = ahead - step * (np.bincount(col, (p - y)[row], k) + ridge * ahead)
        new_b = ahead_b - step_b * (p - y).sum()
        ahead, ahead_b = new + t / (t + 3) * (new - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new, new_b
    return w, b


def toxicity_scorer(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> Callable[[Column], Column]:
    """Learn from ``docs`` and ``labels``; returns a function from a text column to a score column.
    ``train``: condition on ``labels`` for the rows to learn from (default: crc32 of the id modulo 5 is
    not 0)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(id_col, text_col)
    restorer = Restorer(count_trigrams(docs, text_col))
    own = labels.where(id_remainder(F.col(id_col)) != 0 if train is None else train).select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("int").alias(label_col))
    shared = spark.sparkContext.broadcast((restorer, fit(docs, own, restorer, id_col, text_col, label_col)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        restorer, model = shared.value
        return pd.Series([model.score(restorer.words(t)) for t in texts], dtype=float)

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row."""
    score = toxicity_scorer(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(id_col, score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
