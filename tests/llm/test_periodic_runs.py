import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from foldwise.llm.periodic_runs import PRIME, Transform, collapse_runs, kept_words, planted_tail, runs_of
from foldwise.llm.queries import op13_runs

from .cases import LONG, clash, documents, no_documents


def brute(words, least=12):
    """Every maximal stretch of every period, kept if no smaller period has the same one."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t < n - q:
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t < n - q and words[t] == words[t + q]:
                t += 1
            if t + q - s >= max(least, 2 * q):
                found.setdefault((s, t + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_transform_gives_correlations():
    rng = np.random.default_rng(1)
    for size in (16, 64, 1024):
        t = Transform(size)
        x, y = rng.integers(0, PRIME, (3, size)), rng.integers(0, PRIME, (3, size))
        got = t.inverse(t.spectrum(x) * t.spectrum(y)) % PRIME
        for k in range(3):
            want = [sum(int(x[k, i]) * int(y[k, (j - i) % size]) for i in range(size)) % PRIME for j in range(0, size, 7)]
            assert got[k, ::7].tolist() == want


def test_runs_equal_brute_force():
    rng = random.Random(2)
    texts = [[], [0], [0] * 11, [0] * 12, [0] * 500, [0, 1] * 6, [0, 1] * 5 + [0], list(range(6)) * 2, list(range(7)) * 2, [5, 5, 6] * 100]
    fib = ([0], [0, 1])
    while len(fib[1]) < 700:
        fib = (fib[1], fib[1] + fib[0])
    texts.append(fib[1])
    texts.append([bin(i).count("1") % 2 for i in range(512)])
    for _ in range(250):
        n, kinds = rng.randint(1, 260), rng.choice([1, 2, 3, 5, 40, 70000])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            s, p = rng.randrange(n), rng.randint(1, 70)
            e = min(n, s + rng.randint(1, 4 * p))
            for i in range(s + p, e):
                w[i] = w[i - p]
        texts.append(w)
    # numbers that are equal modulo the prime aren't equal words
    texts.append([i * PRIME for i in range(40)])
    for group in (texts, *[[t] for t in texts[:60]]):
        assert runs_of([np.array(t, np.int64) for t in group]) == [brute(t) for t in group]


def test_periods_beyond_the_largest_transform():
    rng = np.random.default_rng(4)
    unit = rng.integers(0, 9, 20011)
    words = np.concatenate([rng.integers(0, 9, 777), unit, unit, unit[:30], [9, 9]])
    long_ones = [r for r in runs_of([words])[0] if r[2] > 5000]
    assert len(long_ones) == 1 and long_ones[0][2] == 20011 and long_ones[0][1] >= 40052 and long_ones[0][0] <= 777


def collapsed(doc_id, text):
    words = (text or "").split() if text is None or text.isascii() else [w for w in text.replace("\n", " ").split(" ") if w]
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n, orig = h // 10, len(words), words
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [orig[i] if i < a else orig[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))), "en") for i in range(300)]
    rows += [(i, "x" * (i % 3) + " one two\tthree\nfour " * (i % 9), "en") for i in range(300, 400)] + [(7, rows[7][1], "en"), (400, None, None), (None, "a b " * 9, "en"), (401, "é漢 😀 " * 8, "fr")]
    clash(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_runs(spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)
    assert got == sorted((collapsed(i, t) for i, t, _ in rows), key=repr)


def test_given_documents(spark):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in whole.collect()]
    got = {r["doc_id"]: r for r in op13_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [(i, t) for i, t in texts if len((t or "").split()) < 700]
    assert len(got) == len(texts) and len(short) > 100
    for i, t in short[:120]:
        assert tuple(got[i][c] for c in COLUMNS) == collapsed(i, t)


def test_what_every_operator_takes(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in collapse_runs(documents(spark)).collect()}
    n = len(LONG.split())
    assert [tuple(r) for r in got[6, n]["runs"]] == [(0, n, 7)] and got[6, n]["text"] == "some words of a very long text"
    assert got[3, 0]["runs"] == [] and got[3, 0]["text"] == "" and (None, 0) in got
    assert collapse_runs(documents(spark)).where("doc_id = 1").count() == 2
    assert collapse_runs(no_documents(spark)).count() == 0 and collapse_runs(documents(spark)).where(F.col("runs").isNull()).count() == 0


def test_kept_words_and_planted_tails():
    assert kept_words(10, [(1, 6, 2), (4, 6, 3)]).tolist() == [True] * 3 + [False] * 7
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert ids and all(planted_tail(i, 50) is None for i in range(200) if i not in ids) and planted_tail(ids[0], 0) is None
    assert planted_tail(None, 9) is None
