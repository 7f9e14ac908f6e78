import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from foldwise.llm.bit_whiten import LIMBS, Space, limbs, scatter, whitened_rows, whole_vectors
from foldwise.llm.queries import op11_whiten

from .cases import clash


def test_scatter_equals_products_of_integers():
    rng = random.Random(3)
    for bits, n, d in ((1, 1, 1), (3, 63, 4), (9, 64, 5), (12, 200, 7), (40, 130, 3), (63, 70, 3)):
        rows = [[rng.randint(-(1 << bits), (1 << bits) - 1) for _ in range(d)] for _ in range(n)]
        for r in rows:
            r[-1] = 17  # a dimension without any bits
        s, q = scatter(np.array(rows, np.int64))
        assert s.tolist() == [sum(r[i] for r in rows) for i in range(d)]
        assert q.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


def test_limbs_add_up():
    for v in (0, 1, -1, 2**40, -(2**130) + 5, 2**150):
        assert len(limbs(v)) == LIMBS and sum(x << 32 * k for k, x in enumerate(limbs(v))) == v


def brute(vectors):
    """(n, sums, exact covariance) of the distinct vectors."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    off = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit]
    cov = [[sum(v[i] * v[j] for v in off) / n**3 for j in range(d)] for i in range(d)]
    return fit, sums, np.array(cov)


def check(rows, got, components=4):
    vectors = [v for _, v in rows]
    fit, sums, cov = brute(vectors)
    n, d = len(fit), len(fit[0])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == len(rows) * min(components, d)
    want = {}
    for i, v in rows:
        x = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums, strict=True)])
        want.setdefault(i, []).append((x @ u[:, :components] / np.sqrt(e[:components]), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))))
    signs = {}
    for r in got:
        c = r["component"] - 1
        (w, deviation), *_ = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - e[c] / cov.trace()) < 1e-9 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(w[c])) < 1e-7 * (1 + abs(w[c]))
        if abs(w[c]) > 1e-3:
            assert signs.setdefault(c, np.sign(r["whitened"]) == np.sign(w[c])) == (np.sign(r["whitened"]) == np.sign(w[c]))


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [rng.randint(-300, 300) + 50 * (i % 3) * (k == 2) + (40 * k if k < 3 else 0) * rng.randint(0, 9) for k in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(5, rows[5][1])]  # copies fit once, rows stay
    df = clash(spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(5))
    check(rows, whitened_rows(df.drop("id"), id_col="vec_id").collect())


def test_what_takes_no_part_and_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [1.0, 0.25]), (3, None), (4, [0.1, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (None, [0.0, 1.0]),
            (8, [2.0, 0.0]), (9, [1.0]), (10, [1.0]), (11, [-inf, 0.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = whole_vectors(df, "vec_id", "embedding")
    assert {r["id"]: r["vec"] for r in whole.collect()}[1] == [128, -1]
    got = whitened_rows(whole).collect()
    two = [r for r in got if r["vec_id"] not in (9, 10)]
    check([(1, [128, -1]), (2, [256, 64]), (None, [0, 256]), (8, [512, 0])], two)
    one = [r for r in got if r["vec_id"] in (9, 10)]
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None)] * 2


def test_flat_components_and_numbers_beyond_longs(spark):
    line = [(i, [i, 2 * i, 0]) for i in range(9)]
    got = whitened_rows(spark.createDataFrame(line, "id long, vec array<long>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r["identity_error"] < 1e-9 for r in got) and abs(got[0]["explained"] - 1) < 1e-12
    huge = [(1, [2**62, 0]), (2, [-(2**62), 1]), (3, [5, -7])]
    got = {(r["vec_id"], r["component"]): r["deviation"] for r in whitened_rows(spark.createDataFrame(huge, "id long, vec array<long>")).collect()}
    assert got[1, 1] is None and got[3, 1] == (3 * 5 - 5) ** 2 + (3 * -7 + 6) ** 2
    s = Space(3, [5, -6], np.array([[2**125 + 25, -(2**62) - 35], [-(2**62) - 35, 50]], object), 2)
    border = np.array([[1012333333, 0], [1012333334, 3]], np.int64)
    assert s.deviation(border)[0].tolist() == [sum((3 * x - t) ** 2 for x, t in zip(v, s.sums, strict=True)) for v in border.tolist()]


def test_empty_tables_and_the_query(spark):
    assert whitened_rows(clash(spark.createDataFrame([], "id long, vec array<long>"))).count() == 0
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["id"], r["vec"]) for r in whole_vectors(table, "vec_id", "embedding").collect()]
    got = op11_whiten(spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:4] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint")]
    check(rows, got.collect())
    assert got.where(F.col("whitened").isNull()).count() == 0
