import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foldwise.llm import phrase_automata as pa_
from foldwise.llm.phrase_automata import compiled, confirmed, covered, gram_hashes, least_places, remove_recurring, stretches
from foldwise.llm.queries import op12_phrases

from .cases import LONG, clash, documents, no_documents


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=35):
    """(id, words, removed, kept text) of rows (id, text), by counting all windows."""
    docs = [(i, words_of(t)) for i, t in rows]
    count = {}
    for _, w in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for i, w in docs:
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s:s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def corpus(rng, n=160, vocabulary=60):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    lines = [[word() for _ in range(rng.choice([14, 20, 30, 34, 35, 36, 90]))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(lines)
            a = rng.randrange(len(line))
            w += line[a:] if rng.random() < 0.4 else line
            w += [word() for _ in range(rng.randint(0, 20))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, n, 9)] + [(5, rows[5][1])]
    rows += [(2000, "a " * 200), (2001, "b c d " * 30), (2002, None), (2003, "b c d " * 13), (None, rows[7][1]), (2004, "é漢 " * 40)]
    return rows


def got_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "text").collect()), key=repr)


def test_equals_counting_all_windows(spark):
    rows = corpus(random.Random(1))
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    assert got_of(remove_recurring(df)) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 1000


def test_crowded_anchors_small_shards_and_shuffled_texts(spark):
    rng = random.Random(2)
    line = [f"l{i}" for i in range(34)]  # one word short of a window, in every text
    rows = [(i, " ".join([f"x{i}"] * 3 + line[:rng.choice([20, 34])] + [f"y{rng.randrange(3)}" for _ in range(20)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)
    assert got_of(remove_recurring(df, most=3, shard=10, broadcast_bytes=0)) == want
    assert got_of(remove_recurring(df, most=1, shard=1)) == want
    assert got_of(remove_recurring(df)) == want


def test_other_windows(spark):
    rows = corpus(random.Random(3), 60, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram, most in ((8, 3, 2), (13, 13, 2)):
        assert got_of(remove_recurring(df, window=window, gram=gram, most=most)) == brute(rows, window)


def test_hashes_and_places():
    rng = np.random.default_rng(5)
    w = rng.integers(0, 3, 300).astype(np.uint64)
    for size in (1, 2, 3, 7, 12, 16):
        h, seen = gram_hashes(w, size), {}
        assert len(h) == 301 - size
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(w[i:i + size].tolist()), v) == v
        assert len(set(seen.values())) == len(seen)
    for width in (1, 2, 5, 8, 24):
        assert least_places(w, width).tolist() == [i + int(w[i:i + width].argmin()) for i in range(301 - width)]
    assert len(gram_hashes(w[:3], 12)) == 0 and len(least_places(w[:3], 24)) == 0


def test_stretches_hold_every_window_once():
    rng = random.Random(4)
    docs = [[b"%d" % rng.randrange(9) for _ in range(n)] for n in (0, 5, 34, 35, 36, 400, 70)] + [[b"a"] * 90]
    doc, anchor, first, last, place = stretches(docs, 35, 12)
    windows = [(d, w) for d, f, t in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True) for w in range(f, t + 1)]
    assert sorted(windows) == [(d, w) for d, x in enumerate(docs) for w in range(len(x) - 34)]
    for d, a, f, t, p in zip(doc.tolist(), anchor.tolist(), first.tolist(), last.tolist(), place.tolist(), strict=True):
        assert t <= p and p + 12 <= f + 35
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in docs[d][p:p + 12]], np.uint64)
        assert gram_hashes(h, 12).view(np.int64).tolist() == [a]


def test_automaton_of_confirmed_passages():
    base = tuple(range(50))
    texts = [base, base[3:45], (*base[:36], 99)]
    passages = confirmed(texts, [1, 1, 1], [7, 7, 7], 35)
    assert passages == [base[0:36], base[3:45]]
    automaton = compiled(passages)
    assert [covered(automaton, t) for t in texts] == [[(0, 45)], [(0, 42)], [(0, 36)]]
    assert confirmed([base], [2], [1], 35) == [base] and confirmed([base], [1], [1], 35) == [] and compiled([]) is None


def test_what_every_operator_takes(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in remove_recurring(documents(spark)).collect()}
    n = len(LONG.split())
    assert got[6, n]["n_removed"] == n and got[6, n]["text"] == "" and got[3, 0]["text"] == "" and (None, 0) in got
    assert got[1, 7]["n_removed"] == 0 and remove_recurring(documents(spark)).count() == documents(spark).count()
    assert remove_recurring(no_documents(spark)).count() == 0


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op12_phrases(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = sorted(((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and sum(r[2] for r in want) > 0
    assert got.where(F.col("kept_sha256").isNull()).count() == 0 and pa_.WINDOW == 35
