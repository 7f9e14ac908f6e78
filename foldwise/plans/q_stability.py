"""Queries: drift and stability (STB*, AGG1, WIN1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalar import classify_psi, psi_term
from foldwise.operators import stability as st
from foldwise.operators.splits import time_windows
from foldwise.plans.inputs import ev, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import CLASSIFY, edges_cte, psi_sql, with_base, with_ev
from foldwise.session import materialize

N_WINDOWS = 6
BOOT_ITER = 20


def ev_windows(spark, sf):
    """Events with their equal-count time window, written once: the numeric and the
    categorical stability branches both read it."""
    e = ev(spark, sf).select("row_id", "t", "x", "cat")
    return materialize(time_windows(e, "t", "row_id", N_WINDOWS, window_col="win"), "ev_windows")


EVW = f"evw AS (SELECT *, CAST(ntile({N_WINDOWS}) OVER (ORDER BY t, row_id) - 1 AS INTEGER) AS win FROM ev)"


@register("time_windows", with_ev(EVW) + """
SELECT win, count(*) AS n, min(t) AS min_t, max(t) AS max_t FROM evw GROUP BY win""")
def q_time_windows(spark, sf):
    return ev_windows(spark, sf).groupBy("win").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("min_t"), F.max("t").alias("max_t"))


@register("psi_bin_edges", with_ev(EVW, edges_cte("ed", "(SELECT * FROM evw WHERE win = 0)", "x")) + """
SELECT CAST(i - 1 AS INTEGER) AS bin, round(edges[i], 6) AS lo, round(edges[i + 1], 6) AS hi
FROM ed, range(1, CAST(n_bins + 1 AS BIGINT)) r(i)""")
def q_psi_bin_edges(spark, sf):
    w = ev_windows(spark, sf)
    e = st.bin_edges(w.where(F.col("win") == 0), "x", "row_id")
    ex = e.select(F.posexplode(F.arrays_zip(F.slice("edges", 1, F.col("n_bins")),
                                            F.slice("edges", 2, F.col("n_bins")))).alias("bin", "z"))
    return ex.select(F.col("bin").cast("int").alias("bin"), r6("z.0").alias("lo"), r6("z.1").alias("hi"))


HIST_CTES = [EVW, edges_cte("ed", "(SELECT * FROM evw WHERE win = 0)", "x"),
             """binned AS (SELECT evw.win, len(list_filter(ed.inner_e, lambda e: e <= evw.x)) AS bin
                FROM evw, ed WHERE evw.x IS NOT NULL)""",
             """grid AS (SELECT w.win, b.bin FROM (SELECT DISTINCT win FROM evw WHERE x IS NOT NULL) w,
                (SELECT unnest(range(0, CAST(n_bins AS BIGINT))) AS bin FROM ed) b)""",
             """hist AS (SELECT g.win, CAST(g.bin AS INTEGER) AS bin, count(binned.bin) AS n FROM grid g
                LEFT JOIN binned ON g.win = binned.win AND g.bin = binned.bin GROUP BY 1, 2)"""]


@register("psi_histogram", with_ev(*HIST_CTES) + "\nSELECT win, bin, n FROM hist")
def q_psi_histogram(spark, sf):
    _, counts = st.time_window_counts(ev_windows(spark, sf), "x", "row_id", "win")
    return counts.select("win", F.col("bin").cast("int").alias("bin"), F.col("n").cast("bigint").alias("n"))


PSI_NUM_SQL = with_ev(*HIST_CTES, """
pc AS (SELECT bin, sum(n) FILTER (WHERE win = 0) AS ref_n, sum(n) FILTER (WHERE win > 0) AS cur_n
       FROM hist GROUP BY bin)""", f"ps AS ({psi_sql('pc', [])})") + f"""
SELECT round(psi, 6) AS psi, {CLASSIFY.format(v='psi')} AS flag FROM ps"""


@register("psi_numeric", PSI_NUM_SQL)
def q_psi_numeric(spark, sf):
    w = ev_windows(spark, sf)
    p = st.psi_numeric(w, "x", "row_id", F.col("win") == 0, F.col("win") > 0)
    return p.select(r6("psi").alias("psi"), classify_psi("psi").alias("flag"))


CSI_SQL = with_ev(EVW, """
cc AS (SELECT CAST(cat AS VARCHAR) AS bin, count(*) FILTER (WHERE win = 0) AS ref_n,
              count(*) FILTER (WHERE win > 0) AS cur_n FROM evw WHERE cat IS NOT NULL GROUP BY 1)""",
                  f"ps AS ({psi_sql('cc', [])})") + f"""
SELECT round(coalesce(psi, 0.0), 6) AS csi, {CLASSIFY.format(v='coalesce(psi, 0.0)')} AS flag FROM ps"""


@register("csi_categorical", CSI_SQL)
def q_csi_categorical(spark, sf):
    w = ev_windows(spark, sf)
    c = st.csi(w, "cat", "row_id", F.col("win") == 0, F.col("win") > 0)
    return c.select(r6("csi").alias("csi"), "flag")


OOT_CTES = [*HIST_CTES,
            """oc AS (SELECT h.win, h.bin, r.n AS ref_n, h.n AS cur_n FROM hist h
                      JOIN hist r ON r.win = 0 AND r.bin = h.bin WHERE h.win > 0)""",
            f"onum AS ({psi_sql('oc', ['win'])})",
            """cg AS (SELECT w.win, c.bin FROM (SELECT DISTINCT win FROM evw WHERE win > 0 AND cat IS NOT NULL) w,
                      (SELECT DISTINCT CAST(cat AS VARCHAR) AS bin FROM evw WHERE cat IS NOT NULL) c)""",
            """cn AS (SELECT win, CAST(cat AS VARCHAR) AS bin, count(*) AS n FROM evw WHERE cat IS NOT NULL GROUP BY 1, 2)""",
            """ccc AS (SELECT g.win, g.bin, coalesce(r.n, 0) AS ref_n, coalesce(c.n, 0) AS cur_n FROM cg g
                       LEFT JOIN cn c ON c.win = g.win AND c.bin = g.bin
                       LEFT JOIN cn r ON r.win = 0 AND r.bin = g.bin
                       WHERE coalesce(r.n, 0) > 0 OR coalesce(c.n, 0) > 0)""",
            f"ocat AS ({psi_sql('ccc', ['win'])})",
            """oot AS (SELECT 'x' AS feature, 'window_' || win AS label, psi AS value FROM onum
                       UNION ALL SELECT 'cat', 'window_' || win, psi FROM ocat)"""]


def oot_values(spark, sf):
    w = ev_windows(spark, sf)
    _, counts = st.time_window_counts(w, "x", "row_id", "win")
    num = st.temporal_oot(counts, "win").withColumn("feature", F.lit("x"))
    cat = st.temporal_oot_categorical(w, "cat", "win").withColumn("feature", F.lit("cat"))
    return num.unionByName(cat).select("feature", "label", "value")


@register("temporal_oot_stability", with_ev(*OOT_CTES) + "\nSELECT feature, label, round(value, 6) AS value FROM oot")
def q_temporal_oot_stability(spark, sf):
    return oot_values(spark, sf).select("feature", "label", r6("value").alias("value"))


@register("psi_classify", with_ev(*OOT_CTES) + f"""
SELECT feature, label, {CLASSIFY.format(v='value')} AS flag FROM oot""")
def q_psi_classify(spark, sf):
    return oot_values(spark, sf).select("feature", "label", classify_psi("value").alias("flag"))


@register("stability_report", with_ev(*OOT_CTES) + f"""
SELECT feature, round(max(value), 6) AS csi, arg_max(label, (value, label)) AS worst_label,
       {CLASSIFY.format(v='max(value)')} AS flag
FROM oot GROUP BY feature""")
def q_stability_report(spark, sf):
    r = st.stability_report(oot_values(spark, sf))
    return r.select("feature", r6("csi").alias("csi"), "worst_label", "flag")


BOOT_FRAC = 0.4
BOOT_SQL = with_ev(
    edges_cte("ed", "ev", "x"),
    """binned AS (SELECT row_id, len(list_filter(ed.inner_e, lambda e: e <= ev.x)) AS bin FROM ev, ed WHERE ev.x IS NOT NULL)""",
    f"""it AS (SELECT unnest(range(0, {BOOT_ITER})) AS iteration)""",
    """numbers AS (SELECT iteration, row_id,
        ('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|' || (iteration // 4)), CAST(8 * (iteration % 4) + 1 AS BIGINT), 8))::BIGINT AS number FROM ev, it)""",
    f"""drawn AS (SELECT iteration, row_id FROM numbers
        QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY number, row_id) <= CAST(floor((SELECT count(*) FROM ev) * {BOOT_FRAC}::DOUBLE) AS BIGINT))""",
    """grid AS (SELECT it.iteration, b.bin FROM it, (SELECT unnest(range(0, CAST(n_bins AS BIGINT))) AS bin FROM ed) b)""",
    """cur AS (SELECT iteration, bin, count(*) AS cur_n FROM drawn JOIN binned USING (row_id) GROUP BY iteration, bin)""",
    """ref AS (SELECT bin, count(*) AS ref_n FROM binned GROUP BY bin)""",
    """bc AS (SELECT g.iteration, g.bin, coalesce(ref_n, 0) AS ref_n, coalesce(cur_n, 0) AS cur_n
             FROM grid g LEFT JOIN ref USING (bin) LEFT JOIN cur ON cur.iteration = g.iteration AND cur.bin = g.bin)""",
    f"ps AS ({psi_sql('bc', ['iteration'])})") + """
SELECT CAST(iteration AS INTEGER) AS iteration, round(psi, 6) AS value FROM ps"""


@register("bootstrap_stability", BOOT_SQL)
def q_bootstrap_stability(spark, sf):
    b = st.bootstrap_stability(ev(spark, sf), "x", "row_id", BOOT_ITER, BOOT_FRAC)
    return b.select(F.col("iteration").cast("int").alias("iteration"), r6("value").alias("value"))


DEC_CTES = [edges_cte("ed", "(SELECT * FROM prepared WHERE split = 'dev')", "score"),
            """bd AS (SELECT p.split, len(list_filter(ed.inner_e, lambda e: e < p.score)) AS decile,
                      len(list_filter(ed.inner_e, lambda e: e <= p.score)) AS bin FROM prepared p, ed WHERE p.score IS NOT NULL)""",
            """per AS (SELECT decile, count(*) FILTER (WHERE split = 'dev') AS r, count(*) FILTER (WHERE split = 'holdout') AS c
                       FROM bd GROUP BY decile)""",
            """pgrid AS (SELECT b.bin, count(bd.bin) FILTER (WHERE bd.split = 'dev') AS ref_n,
                                count(bd.bin) FILTER (WHERE bd.split = 'holdout') AS cur_n
                         FROM (SELECT unnest(range(0, CAST(n_bins AS BIGINT))) AS bin FROM ed) b
                         LEFT JOIN bd ON bd.bin = b.bin GROUP BY b.bin)""",
            f"ps AS ({psi_sql('pgrid', [])})"]


@register("score_decile_stability", with_base(*DEC_CTES) + f"""
SELECT CAST(decile AS INTEGER) AS decile, round(r / greatest((SELECT sum(r) FROM per), 1)::DOUBLE, 6) AS reference_pct,
       round(c / greatest((SELECT sum(c) FROM per), 1)::DOUBLE, 6) AS current_pct,
       round(ps.psi, 6) AS psi, {CLASSIFY.format(v='ps.psi')} AS flag
FROM per, ps WHERE r > 0 OR c > 0""")
def q_score_decile_stability(spark, sf):
    p = prepared(spark, sf)
    s = st.score_decile_stability(p, "score", "row_id", F.col("split") == "dev", F.col("split") == "holdout")
    return s.select(F.col("decile").cast("int").alias("decile"), r6("reference_pct").alias("reference_pct"),
                    r6("current_pct").alias("current_pct"), r6("psi").alias("psi"), "flag")


TR_CTES = [edges_cte("ed", "base", "score"),
           """bd AS (SELECT CAST(year(b.t) AS VARCHAR) AS bucket, b.y,
                     len(list_filter(ed.inner_e, lambda e: e < b.score)) AS decile FROM base b, ed WHERE b.score IS NOT NULL)""",
           """rates AS (SELECT bucket, CAST(decile AS INTEGER) AS decile, avg(CAST(y AS DOUBLE)) AS rate FROM bd
                        GROUP BY GROUPING SETS ((decile), (bucket, decile)))"""]


def rates_frame(spark, sf):
    b = prepared(spark, sf).withColumn("yr", F.year("t").cast("string"))
    return st.target_rate_by_decile(b, "score", "y", "row_id", bucket_col="yr")


@register("target_rate_by_decile", with_base(*TR_CTES) + "\nSELECT bucket, decile, round(rate, 6) AS rate FROM rates")
def q_target_rate_by_decile(spark, sf):
    r = rates_frame(spark, sf)
    return r.select("bucket", F.col("decile").cast("int").alias("decile"), r6("rate").alias("rate"))


@register("decile_monotonic", with_base(*TR_CTES) + """
SELECT coalesce(bool_and(ok), true) AS is_monotonic FROM (
  SELECT coalesce(rate >= lag(rate) OVER (ORDER BY decile) - 1e-9, true) AS ok FROM rates WHERE bucket IS NULL)""")
def q_decile_monotonic(spark, sf):
    r = rates_frame(spark, sf).where(F.col("bucket").isNull())
    return st.is_non_decreasing(r, "decile")


@register("psi_from_proportions", """
WITH c AS (SELECT l_returnflag AS bin, count(*) FILTER (WHERE l_linenumber = 1) AS ref_n,
                  count(*) FILTER (WHERE l_linenumber > 1) AS cur_n FROM lineitem GROUP BY 1),
p AS (SELECT bin, ref_n / greatest(sum(ref_n) OVER (), 1)::DOUBLE AS e, cur_n / greatest(sum(cur_n) OVER (), 1)::DOUBLE AS a FROM c)
SELECT bin, round(e, 6) AS expected_pct, round(a, 6) AS actual_pct,
       round((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4)), 6) AS term
FROM p""")
def q_psi_from_proportions(spark, sf):
    from pyspark.sql import Window
    from foldwise.sources.tables import table
    li = table(spark, sf, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("bin")).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("ref_n"), F.count_if(F.col("l_linenumber") > 1).alias("cur_n"))
    w = Window.partitionBy()  # one row per category: a handful of rows
    p = (c.withColumn("e", F.col("ref_n") / F.greatest(F.sum("ref_n").over(w), F.lit(1)))
         .withColumn("a", F.col("cur_n") / F.greatest(F.sum("cur_n").over(w), F.lit(1))))
    return p.select("bin", r6("e").alias("expected_pct"), r6("a").alias("actual_pct"),
                    r6(psi_term("e", "a")).alias("term"))
