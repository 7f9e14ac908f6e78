"""Queries: profiling and target association (PROF*, ASSOC*, SEL2-3, F11, REP4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import profile as pf
from foldwise.operators.selection import redundancy_clusters, redundancy_survivors
from foldwise.plans.inputs import base
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import with_base

NUM = ["price", "bal", "price_n", "score"]
CAT = ["seg", "pri"]
DT = ["t"]
ALL = NUM + CAT + DT


def _union(parts):
    return "\nUNION ALL\n".join(parts)


@register("profile_missing", with_base() + _union([
    f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_missing, "
    f"round(coalesce((count(*) - count({c})) / nullif(count(*), 0)::DOUBLE, 0.0), 6) AS pct_missing FROM base"
    for c in ALL]))
def q_profile_missing(spark, sf):
    p = pf.profile_missing(base(spark, sf), ALL)
    return p.select("column_name", "n", "n_missing", r6("pct_missing").alias("pct_missing"))


@register("profile_distinct", with_base() + _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) <= 1 AS is_constant FROM base"
    for c in ALL]))
def q_profile_distinct(spark, sf):
    return pf.profile_distinct(base(spark, sf), ALL)


def _num_sql(c):
    return f"""SELECT '{c}' AS column_name,
  round(coalesce(min({c}), 0.0), 6) AS min, round(coalesce(max({c}), 0.0), 6) AS max,
  round(coalesce(avg({c}), 0.0), 6) AS mean,
  round(CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0.0 END, 6) AS std,
  round(CASE WHEN count({c}) > 2 THEN (sum(power({c} - mu, 3)) / count({c})) / nullif(power(sum(power({c} - mu, 2)) / count({c}), 1.5), 0) ELSE 0.0 END, 6) AS skew,
  round(CASE WHEN count({c}) > 3 THEN (sum(power({c} - mu, 4)) / count({c})) / nullif(power(sum(power({c} - mu, 2)) / count({c}), 2), 0) - 3 ELSE 0.0 END, 6) AS kurtosis
FROM base, (SELECT avg({c}) AS mu FROM base) m"""


@register("profile_numeric", with_base() + _union([_num_sql(c) for c in NUM]))
def q_profile_numeric(spark, sf):
    p = pf.profile_numeric(base(spark, sf), NUM)
    return p.select("column_name", *[r6(c).alias(c) for c in ("min", "max", "mean", "std", "skew", "kurtosis")])


@register("profile_quantiles", with_base() + _union([
    f"SELECT '{c}' AS column_name, " + ", ".join(
        f"round(quantile_cont({c}, {q}), 6) AS {nm}" for nm, q in pf.QUANTILE_LEVELS.items()) + " FROM base"
    for c in NUM]))
def q_profile_quantiles(spark, sf):
    q = pf.profile_quantiles(base(spark, sf), NUM, "row_id")
    return q.select("column_name", *[r6(nm).alias(nm) for nm in pf.QUANTILE_LEVELS])


TOPV_SQL = with_base(f"""
vc AS ({_union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM base WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in CAT])})""") + f"""
SELECT column_name, value, n, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rk FROM vc)
WHERE rk <= {pf.TOP_VALUES_LIMIT}"""


@register("profile_top_values", TOPV_SQL)
def q_profile_top_values(spark, sf):
    t = pf.profile_top_values(base(spark, sf), CAT)
    return t.select("column_name", "value", "n", F.col("rk").cast("bigint").alias("rk"))


@register("profile_datetime", with_base() + _union([
    f"SELECT '{c}' AS column_name, min({c}) AS min_ts, max({c}) AS max_ts, "
    f"round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400e6, 6) AS span_days FROM base" for c in DT]))
def q_profile_datetime(spark, sf):
    d = pf.profile_datetime(base(spark, sf), DT)
    return d.select("column_name", "min_ts", "max_ts", r6("span_days").alias("span_days"))


@register("positive_rate", with_base() + "SELECT round(avg(y), 6) AS positive_rate, count(*) AS n FROM base")
def q_positive_rate(spark, sf):
    return base(spark, sf).agg(r6(F.avg("y")).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def _assoc_sql(c):
    return f"""SELECT '{c}' AS column_name,
  round(CASE WHEN count(*) >= 10 AND min({c}) < max({c}) AND min(y) < max(y) THEN corr({c}, y) END, 6) AS corr
FROM base WHERE {c} IS NOT NULL AND y IS NOT NULL"""


@register("assoc_numeric", with_base() + _union([_assoc_sql(c) for c in NUM]))
def q_assoc_numeric(spark, sf):
    a = pf.assoc_numeric(base(spark, sf), NUM, "y")
    return a.select("column_name", r6("corr").alias("corr"))


CT_SQL = _union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, y, count(*) AS n "
                 f"FROM base WHERE {c} IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3" for c in CAT])


@register("contingency", with_base() + CT_SQL)
def q_contingency(spark, sf):
    return pf.contingency(base(spark, sf), CAT, "y")


@register("assoc_cramers_v", with_base(f"ct AS ({CT_SQL})", """
j AS (SELECT ct.*, sum(n) OVER (PARTITION BY column_name, value) AS R,
             sum(n) OVER (PARTITION BY column_name, y) AS C FROM ct)""") + """
SELECT column_name,
  round(CASE WHEN count(DISTINCT value) >= 2 AND count(DISTINCT y) >= 2 AND sum(n) >= 10 THEN
    sqrt(greatest(sum(n) * (sum(n::DOUBLE * n / (R::DOUBLE * C)) - 1), 0) / sum(n)
         / least(count(DISTINCT value) - 1, count(DISTINCT y) - 1)) END, 6) AS v
FROM j GROUP BY column_name""")
def q_assoc_cramers_v(spark, sf):
    v = pf.cramers_v(pf.contingency(base(spark, sf), CAT, "y"), "y")
    return v.select("column_name", r6("v").alias("v"))


_V_CTES = (f"ct AS ({CT_SQL})", """
j AS (SELECT ct.*, sum(n) OVER (PARTITION BY column_name, value) AS R, sum(n) OVER (PARTITION BY column_name, y) AS C FROM ct)""", """
v AS (SELECT column_name, CASE WHEN count(DISTINCT value) >= 2 AND count(DISTINCT y) >= 2 AND sum(n) >= 10 THEN
    sqrt(greatest(sum(n) * (sum(n::DOUBLE * n / (R::DOUBLE * C)) - 1), 0) / sum(n) / least(count(DISTINCT value) - 1, count(DISTINCT y) - 1)) END AS association
  FROM j GROUP BY column_name)""")
RECORD_SQL = with_base(
    "k AS (" + _union([f"SELECT '{c}' AS column_name, '{k}' AS kind" for k, cs in (("numeric", NUM), ("categorical", CAT), ("datetime", DT)) for c in cs]) + ")",
    "miss AS (" + _union([f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM base" for c in ALL]) + ")",
    "num AS (" + _union([_num_sql(c) for c in NUM]) + ")",
    "qu AS (" + _union([f"SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {nm}" for nm, q in pf.QUANTILE_LEVELS.items()) + " FROM base" for c in NUM]) + ")",
    "top AS (" + _union([f"(SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS top_value, count(*) AS top_n FROM base WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)" for c in CAT]) + ")",
    *_V_CTES, "assoc AS (" + _union([_assoc_sql(c) for c in NUM]) + "\nUNION ALL SELECT column_name, round(association, 6) FROM v)",
    "dt AS (" + _union([f"SELECT '{c}' AS column_name, min({c}) AS min_ts, max({c}) AS max_ts FROM base" for c in DT]) + ")") + """
SELECT k.column_name, k.kind, n, n_missing, n_unique, n_unique <= 1 AS is_constant, mean, std, min, max, skew, kurtosis, p1, p25, p50, p75, p99,
       top_value, top_n, min_ts, max_ts, assoc.corr AS association
FROM k LEFT JOIN miss USING (column_name) LEFT JOIN num USING (column_name) LEFT JOIN qu USING (column_name) LEFT JOIN top USING (column_name)
  LEFT JOIN assoc USING (column_name) LEFT JOIN dt USING (column_name)"""


@register("profile_record", RECORD_SQL)
def q_profile_record(spark, sf):
    r = pf.profile_record(base(spark, sf), ALL, "row_id", "y")
    numbers = [*("mean", "std", "min", "max", "skew", "kurtosis"), *pf.QUANTILE_LEVELS, "association"]
    return r.select("column_name", "kind", "n", "n_missing", "n_unique", "is_constant", "top_value", "top_n", "min_ts", "max_ts", *[r6(c).alias(c) for c in numbers])


CORR_COLS = ["price", "bal", "price_n", "score", "price2"]
PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
PAIRS_SQL = _union([
    f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN var_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 "
    f"AND var_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN corr({a}, {b}) END, 6) AS corr FROM b2"
    for a, b in PAIRS])
CORR_SQL = with_base("b2 AS (SELECT *, price * 2 AS price2 FROM base)") + PAIRS_SQL
CLUSTER_CTES = [
    "b2 AS (SELECT *, price * 2 AS price2 FROM base)",
    f"pairs AS ({PAIRS_SQL})",
    """edges AS (SELECT a, b FROM pairs WHERE abs(corr) >= 0.95 UNION SELECT b, a FROM pairs WHERE abs(corr) >= 0.95)""",
    "nodes AS (" + _union([f"SELECT '{c}' AS f" for c in CORR_COLS]) + ")",
    """reach AS (
  WITH RECURSIVE r(f, g) AS (SELECT f, f FROM nodes UNION SELECT r.f, e.b FROM r JOIN edges e ON r.g = e.a)
  SELECT f, min(g) AS cluster FROM r GROUP BY f)"""]
CLUSTER_SQL = with_base(*CLUSTER_CTES) + "\nSELECT cluster, f AS feature FROM reach"
# Importance of each column = |corr with y| over complete rows; first listed wins ties.
SURV_SQL = with_base(*CLUSTER_CTES, "b2_imp AS (SELECT * FROM b2 WHERE price_n IS NOT NULL)",
                     "imp AS (" + _union([f"SELECT '{c}' AS f, {i} AS pos, round(abs(corr({c}, y)), 12) AS importance FROM b2_imp"
                                          for i, c in enumerate(CORR_COLS)]) + ")") + """
SELECT cluster, arg_max(r.f, (i.importance, -i.pos)) AS survivor
FROM reach r JOIN imp i ON r.f = i.f GROUP BY cluster"""


def corr_frame(spark, sf):
    return base(spark, sf).withColumn("price2", F.col("price") * 2)


@register("correlation_pairs", CORR_SQL)
def q_correlation_pairs(spark, sf):
    c = pf.correlation_pairs(corr_frame(spark, sf), CORR_COLS)
    return c.select("a", "b", r6("corr").alias("corr"))


@register("redundancy_clusters", CLUSTER_SQL)
def q_redundancy_clusters(spark, sf):
    return redundancy_clusters(corr_frame(spark, sf), CORR_COLS, 0.95)


@register("redundancy_survivors", SURV_SQL)
def q_redundancy_survivors(spark, sf):
    df = corr_frame(spark, sf)
    clusters = redundancy_clusters(df, CORR_COLS, 0.95)
    complete = df.where(F.col("price_n").isNotNull())
    imp = pf.assoc_numeric(complete, CORR_COLS, "y", min_rows=0).select(
        F.col("column_name").alias("feature"), F.abs("corr").alias("importance"))
    return redundancy_survivors(clusters, imp, CORR_COLS)
