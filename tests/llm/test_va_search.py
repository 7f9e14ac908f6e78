import random

from pyspark.sql import functions as F

from foldwise.llm.va_search import top_k

from .cases import clash


def brute(rows, k):
    out = set()
    valid = [(i, v) for i, v in rows if i is not None and v and None not in v]
    for q, a in {(i, tuple(v)) for i, v in valid if i % 100 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in valid if i != q and len(v) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_equals_brute_force_with_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-40, 40) for _ in range(8)]) for i in range(900)] + [(1000 + i, [3] * 8) for i in range(30)]
    rows += [(2000, None), (2001, [1, None] + [0] * 6), (2100, [7] * 8), (2200, [1, 2]), (2300, [4, 4]), (None, [1] * 8), (2400, [10**9] * 8), (2401, [0] * 8)]
    df = clash(spark.createDataFrame(rows, "id long, vec array<long>"))
    for block in (512, 3):
        got = {tuple(r) for r in top_k(df, df.where("id % 100 = 0"), 10, block=block).collect()}
        assert got == brute(rows, 10)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "id long, vec array<long>")
    assert [tuple(r) for r in top_k(df, df.where("id = 0"), 10).collect()] == [(0, 1, 1, 11)]
    assert top_k(df.limit(0), df.limit(0), 10).count() == 0
    assert top_k(df, df.where(F.lit(False)), 10).count() == 0
