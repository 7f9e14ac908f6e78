"""Queries: online/offline parity replay (PAR*, F8, F9, UDF2, JOIN7, SRT4, SRT6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import h_duckdb
from foldwise.operators import features as fx
from foldwise.operators import parity as par
from foldwise.operators import scan
from foldwise.operators.splits import sample_positions
from foldwise.plans.inputs import ev, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import with_base, with_ev

SEED = 0
ISCLOSE_SQL = "(abs(off - onl) <= 1e-12 + 1e-9 * abs(onl))"


def _sizes_sql(sizes):
    return "(SELECT unnest([" + ", ".join(str(s) for s in sizes) + "]) AS batch_size) sz"


def _summary(d):
    s = par.summarize(d)
    return s.select("batch_size", "n_checked", "n_mismatch", r6("max_abs_diff").alias("max_abs_diff"))


def seg_lookup(spark, sf):
    """Compliant feature: dev-fitted mean price per segment, global mean default."""
    p = prepared(spark, sf)
    f = fx.GroupStat(name="offline", key="seg", value="price", default="global")
    params = fx.full_fit(f, p, "row_id")
    return par.join_params(p, params, "seg", "seg_mean_price"), par.lookup_feature("seg_mean_price"), f.transform(p.select("row_id", "seg"), params)


LOOKUP_CTES = [
    "dev AS (SELECT seg, avg(price) AS m FROM prepared WHERE split = 'dev' AND seg IS NOT NULL GROUP BY seg)",
    "dflt AS (SELECT avg(price) AS g FROM prepared WHERE split = 'dev')",
    "offl AS (SELECT p.row_id, coalesce(dev.m, dflt.g) AS off FROM prepared p LEFT JOIN dev USING (seg) CROSS JOIN dflt)",
    f"sh AS (SELECT row_id, seg, row_number() OVER (ORDER BY {h_duckdb('row_id', SEED)}, row_id) - 1 AS pos FROM prepared)",
    f"""onl AS (SELECT row_id, batch_size, pos // batch_size AS batch,
                coalesce((SELECT avg(price) FROM prepared q WHERE q.split = 'dev' AND q.seg = sh.seg), (SELECT g FROM dflt)) AS onl
              FROM sh, {_sizes_sql(par.IID_BATCH_SIZES)})""",
    f"d AS (SELECT onl.*, off, {ISCLOSE_SQL} AS matched, abs(off - onl) AS abs_diff FROM onl JOIN offl USING (row_id))"]
SUMMARY_SQL = """SELECT batch_size, count(*) AS n_checked, count(*) FILTER (WHERE NOT matched) AS n_mismatch,
       round(max(abs_diff), 6) AS max_abs_diff FROM d GROUP BY batch_size"""


@register("parity_iid", with_base(*LOOKUP_CTES) + SUMMARY_SQL)
def q_parity_iid(spark, sf):
    p, feat, offline = seg_lookup(spark, sf)
    return _summary(par.replay(p, feat, offline, "row_id", seed=SEED))


def cat_lookup(spark, sf):
    e = ev(spark, sf)
    f = fx.GroupStat(name="offline", key="cat", value="x", default="global")
    params = f.fit(e)
    return par.join_params(e, params, "cat", "cat_mean_x"), par.lookup_feature("cat_mean_x"), f.transform(e.select("row_id", "cat"), params)


EV_LOOKUP_CTES = [
    "means AS (SELECT cat, avg(x) AS m FROM ev GROUP BY cat)",
    "offl AS (SELECT row_id, m AS off FROM ev JOIN means ON ev.cat IS NOT DISTINCT FROM means.cat)",
    "sh AS (SELECT row_id, cat, row_number() OVER (ORDER BY t, row_id) - 1 AS pos FROM ev)",
    f"""onl AS (SELECT row_id, batch_size, pos // batch_size AS batch, (SELECT avg(x) FROM ev q WHERE q.cat = sh.cat) AS onl
              FROM sh, {_sizes_sql(par.TEMPORAL_BATCH_SIZES)})""",
    f"d AS (SELECT onl.*, off, {ISCLOSE_SQL} AS matched, abs(off - onl) AS abs_diff FROM onl JOIN offl USING (row_id))"]


@register("parity_temporal", with_ev(*EV_LOOKUP_CTES) + SUMMARY_SQL)
def q_parity_temporal(spark, sf):
    e, feat, offline = cat_lookup(spark, sf)
    return _summary(par.replay(e, feat, offline, "row_id", time_col="t"))


RANK_CTES = [
    f"sh AS (SELECT row_id, price, row_number() OVER (ORDER BY {h_duckdb('row_id', SEED)}, row_id) - 1 AS pos FROM base)",
    f"b AS (SELECT sh.*, sz.batch_size, pos // sz.batch_size AS batch FROM sh, {_sizes_sql(par.IID_BATCH_SIZES)})",
    """offl AS (SELECT row_id, (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0)
                 / count(*) OVER () AS off FROM base)""",
    """onl AS (SELECT row_id, batch_size, pos,
                (rank() OVER (PARTITION BY batch_size, batch ORDER BY price)
                 + (count(*) OVER (PARTITION BY batch_size, batch, price) - 1) / 2.0)
                / count(*) OVER (PARTITION BY batch_size, batch) AS onl FROM b)""",
    f"d AS (SELECT onl.*, offl.off, {ISCLOSE_SQL} AS matched, abs(off - onl) AS abs_diff FROM onl JOIN offl USING (row_id))"]


def rank_diffs(spark, sf):
    p = prepared(spark, sf).select("row_id", "price")
    offline = par.offline_pct_rank(p, "row_id", "price")
    return par.replay(p, par.rank_in_call("rank_pct", "price"), offline, "row_id", seed=SEED)


@register("parity_rank_mismatch", with_base(*RANK_CTES) + """
SELECT batch_size, count(*) AS n_checked, count(*) FILTER (WHERE NOT matched) AS n_mismatch,
       round(max(abs_diff), 6) AS max_abs_diff FROM d GROUP BY batch_size""")
def q_parity_rank_mismatch(spark, sf):
    return _summary(rank_diffs(spark, sf))


@register("parity_summary", with_base(*RANK_CTES) + """
SELECT count(*) AS n_checked, count(*) FILTER (WHERE NOT matched) AS n_mismatch,
       round(max(abs_diff), 6) AS max_abs_diff, count(*) FILTER (WHERE NOT matched) = 0 AS matched FROM d""")
def q_parity_summary(spark, sf):
    d = rank_diffs(spark, sf)
    s = par.summarize(d, by=[])
    return s.select("n_checked", "n_mismatch", r6("max_abs_diff").alias("max_abs_diff"),
                    (F.col("n_mismatch") == 0).alias("matched"))


@register("parity_examples", with_base(*RANK_CTES) + """
SELECT batch_size, pos, row_id, round(off, 6) AS offline, round(onl, 6) AS online FROM d WHERE NOT matched
ORDER BY batch_size, pos, row_id LIMIT 10""")
def q_parity_examples(spark, sf):
    ex = par.examples(rank_diffs(spark, sf), "row_id")
    return ex.select("batch_size", "pos", "row_id", r6("offline").alias("offline"), r6("value").alias("online"))


CUM_CTES = [
    "c AS (SELECT row_id, t, CAST(round(x * 100) AS DOUBLE) AS cents FROM ev)",
    "sh AS (SELECT *, row_number() OVER (ORDER BY t, row_id) - 1 AS pos FROM c)",
    f"b AS (SELECT sh.*, sz.batch_size, pos // sz.batch_size AS batch FROM sh, {_sizes_sql(par.TEMPORAL_BATCH_SIZES)})",
    "offl AS (SELECT row_id, sum(cents) OVER (ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS off FROM c)",
    """onl AS (SELECT row_id, batch_size, batch, pos,
                sum(cents) OVER (PARTITION BY batch_size, batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS onl FROM b)""",
    f"d AS (SELECT onl.*, offl.off, {ISCLOSE_SQL} AS matched, abs(off - onl) AS abs_diff FROM onl JOIN offl USING (row_id))"]


def cumsum_diffs(spark, sf):
    e = ev(spark, sf).select("row_id", "t", F.round(F.col("x") * 100).cast("double").alias("cents"))
    offline = par.offline_cumsum(e, "row_id", "t", "cents")
    return par.replay(e, par.cumsum_in_call("cum_cents", "cents"), offline, "row_id", time_col="t")


@register("parity_cumsum_mismatch", with_ev(*CUM_CTES) + """
SELECT batch_size, count(*) AS n_checked, count(*) FILTER (WHERE NOT matched) AS n_mismatch,
       round(max(abs_diff), 6) AS max_abs_diff FROM d GROUP BY batch_size""")
def q_parity_cumsum_mismatch(spark, sf):
    return _summary(cumsum_diffs(spark, sf))


@register("parity_diff", with_ev(*CUM_CTES) + """
SELECT row_id, batch, round(off, 6) AS offline, round(onl, 6) AS online, matched FROM d WHERE batch_size = 50""")
def q_parity_diff(spark, sf):
    d = cumsum_diffs(spark, sf).where(F.col("batch_size") == 50)
    return d.select("row_id", "batch", r6("offline").alias("offline"), r6("value").alias("online"), "matched")


@register("transform_many", with_ev(*CUM_CTES) + """
SELECT batch_size, count(DISTINCT batch) AS n_jobs, count(*) AS n_rows, round(sum(onl), 6) AS sum_value
FROM d GROUP BY batch_size""")
def q_transform_many(spark, sf):
    """UDF2 directly: every job's rows in one Python pass per partition."""
    e = ev(spark, sf).select("row_id", "t", F.round(F.col("x") * 100).cast("double").alias("cents"))
    b = par.assign_batches(par.replay_order(e, "row_id", "t"), par.TEMPORAL_BATCH_SIZES)
    out = par.transform_many(b, par.cumsum_in_call("cum_cents", "cents"), "row_id", ["batch_size", "batch"])
    return out.groupBy("batch_size").agg(F.count_distinct("batch").alias("n_jobs"),
                                         F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value")).alias("sum_value"))


TRUNC_CTES = [
    "o AS (SELECT row_id, cat, x, CAST(round(x * 100) AS DOUBLE) AS cents, row_number() OVER (ORDER BY t, row_id) - 1 AS pos, count(*) OVER () AS n FROM ev)",
    f"""sp AS (SELECT DISTINCT CASE WHEN (SELECT max(n) FROM o) <= {scan.MAX_TRUNCATED_POSITIONS} THEN i
                  ELSE CAST(floor(i * ((SELECT max(n) FROM o)::DOUBLE / {scan.MAX_TRUNCATED_POSITIONS}::DOUBLE)) AS BIGINT) END AS pos
             FROM (SELECT unnest(range(0, CAST(least((SELECT max(n) FROM o), {scan.MAX_TRUNCATED_POSITIONS}) AS BIGINT))) AS i))"""]
SEEN_CTES = [
    "pr AS (SELECT o.* FROM sp JOIN o USING (pos))",
    """seen AS (SELECT pr.pos, pr.row_id, pr.cat, sum(o.cents) AS cum, avg(o.x) AS mean,
                (count(*) FILTER (WHERE o.cents < pr.cents) + (count(*) FILTER (WHERE o.cents = pr.cents) + 1) / 2.0) / count(o.cents) AS rnk
              FROM pr JOIN o ON o.pos <= pr.pos GROUP BY pr.pos, pr.row_id, pr.cat)""",
    """whole AS (SELECT row_id, sum(cents) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, avg(x) OVER () AS mean,
                 (rank() OVER (ORDER BY cents) + (count(*) OVER (PARTITION BY cents) - 1) / 2.0) / count(*) OVER () AS rnk,
                 avg(x) OVER (PARTITION BY cat) AS looked FROM o)""",
    """pairs AS (
      SELECT 'cat_mean_x' AS feature, pos, looked AS off, (SELECT avg(x) FROM ev q WHERE q.cat = seen.cat) AS onl FROM seen JOIN whole USING (row_id)
      UNION ALL SELECT 'rank_pct', pos, whole.rnk, seen.rnk FROM seen JOIN whole USING (row_id)
      UNION ALL SELECT 'cum_cents', pos, whole.cum, seen.cum FROM seen JOIN whole USING (row_id)
      UNION ALL SELECT 'mean_x', pos, whole.mean, seen.mean FROM seen JOIN whole USING (row_id))"""]


def truncated_diffs(spark, sf):
    """PAR3 of four features: the compliant lookup, the rank in the call (F8), the running sum (F9) and the mean of
    the call; each with its offline value."""
    e, looked, offline = cat_lookup(spark, sf)
    e = e.withColumn("cents", F.round(F.col("x") * 100).cast("double"))
    mean = e.agg(F.avg("x").alias("offline"))
    checks = [(looked, offline), (par.rank_in_call("rank_pct", "cents"), par.offline_pct_rank(e, "row_id", "cents")),
              (par.cumsum_in_call("cum_cents", "cents"), par.offline_cumsum(e, "row_id", "t", "cents")),
              (par.mean_in_call("mean_x", "x"), e.select("row_id").crossJoin(mean))]  # one row
    diffs = [par.compare(off, scan.truncated_replay(e, f, "row_id", "t"), "row_id").withColumn("feature", F.lit(f.name)) for f, off in checks]
    return reduce(DataFrame.unionByName, diffs)


@register("parity_truncated", with_ev(*TRUNC_CTES, *SEEN_CTES) + f"""
SELECT feature, count(*) AS n_positions, count(*) FILTER (WHERE NOT {ISCLOSE_SQL}) AS n_mismatch, round(max(abs(off - onl)), 6) AS max_abs_diff
FROM pairs GROUP BY feature""")
def q_parity_truncated(spark, sf):
    """PAR3: up to 200 positions, each feature seeing the rows up to there. The rank and the mean mismatch; a running
    sum in time order sees the same rows either way and is caught by the batches of PAR2 (``parity_verdict``)."""
    s = par.summarize(truncated_diffs(spark, sf), by=["feature"])
    return s.select("feature", F.col("n_checked").alias("n_positions"), "n_mismatch", r6("max_abs_diff").alias("max_abs_diff"))


@register("parity_truncated_values", with_ev(*TRUNC_CTES, *SEEN_CTES) + """
SELECT feature, pos, round(off, 6) AS offline, round(onl, 6) AS online FROM pairs""")
def q_parity_truncated_values(spark, sf):
    return truncated_diffs(spark, sf).select("feature", "pos", r6("offline").alias("offline"), r6("value").alias("online"))


@register("parity_verdict", with_ev(*CUM_CTES[:5], *TRUNC_CTES, *SEEN_CTES) + f"""
, diffs AS (SELECT 'cum_cents' AS feature, {ISCLOSE_SQL} AS matched FROM onl JOIN offl USING (row_id)
  UNION ALL SELECT feature, {ISCLOSE_SQL} FROM pairs WHERE feature = 'cum_cents')
SELECT feature, count(*) AS n_checked, count(*) FILTER (WHERE NOT matched) AS n_mismatch, count(*) FILTER (WHERE NOT matched) = 0 AS matched
FROM diffs GROUP BY feature""")
def q_parity_verdict(spark, sf):
    """PAR2 and PAR3 together, as one temporal replay of the running sum (F9): batches restart the sum."""
    e = ev(spark, sf).select("row_id", "t", F.round(F.col("x") * 100).cast("double").alias("cents"))
    f, offline = par.cumsum_in_call("cum_cents", "cents"), par.offline_cumsum(e, "row_id", "t", "cents")
    return par.temporal_replay(e, f, offline, "row_id", "t").select("feature", "n_checked", "n_mismatch", (F.col("n_mismatch") == 0).alias("matched"))


@register("sample_positions", with_ev(*TRUNC_CTES) + """
SELECT sp.pos, o.row_id FROM sp JOIN o USING (pos)""")
def q_sample_positions(spark, sf):
    from foldwise.operators.rank import dist_rank
    e = ev(spark, sf)
    r = dist_rank(e.select("row_id", "t"), ["t", "row_id"], rank_col="_r", total_col="_n")
    pos = r.select("_n").limit(1).select(F.explode(sample_positions(F.col("_n"), scan.MAX_TRUNCATED_POSITIONS)).alias("pos"))
    return r.join(F.broadcast(pos), (F.col("_r") - 1) == F.col("pos")).select("pos", "row_id")
