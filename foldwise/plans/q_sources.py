"""Queries: scans, joins, feature store, scalar functions, profile tables and candidate
templates (SRC1-4, JOIN1-2, PRJ4, PRJ8, PROF8, REP4, F11, FN3, FN4, FN7)."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalar import isclose, missing_category, safe_name
from foldwise.operators import features as fx
from foldwise.operators import profile as pf
from foldwise.operators.joins import TableSpec, join_with_lineage, raw_feature_frame
from foldwise.operators.target import column_kind, column_role
from foldwise.plans.inputs import K, base, prepared
from foldwise.plans.registry import r6, register
from foldwise.plans.sqlkit import with_base
from foldwise.session import checkpoint_dir
from foldwise.sources.feature_store import FeatureStore
from foldwise.sources.tables import TABLES, load_tables, read_table, table


def _u(parts):
    return "\nUNION ALL\n".join(parts)


@register("scan_parquet", """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1""")
def q_scan_parquet(spark, sf):
    o = read_table(spark, f"{sf}/orders.parquet")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("o_totalprice"), 2).alias("total_price"))


@register("scan_csv", """
SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1""")
def q_scan_csv(spark, sf):
    """SRC1: the same rows through a CSV file with a header, read with a schema and, for its types, without one."""
    folder = os.path.join(checkpoint_dir(spark), "csv-" + uuid.uuid4().hex)
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    c.write.option("header", True).csv(folder)
    given = read_table(spark, folder, c.schema)
    guessed = read_table(spark, folder)
    if [f.dataType for f in guessed.schema.fields][1:] != [f.dataType for f in c.schema.fields][1:]:
        raise ValueError(f"types read from the file: {guessed.schema.simpleString()}")
    return given.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("load_tables", _u([f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES]))
def q_load_tables(spark, sf):
    """SRC2: every table of the folder, opened lazily, and its rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in load_tables(spark, sf).items()]
    return reduce(DataFrame.unionByName, counts)


@register("left_join_partial_coverage", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_left_join_partial_coverage(spark, sf):
    j = join_with_lineage([TableSpec("documents", table(spark, sf, "documents").select("doc_id", "lang"), "primary"),
                           TableSpec("labels", table(spark, sf, "labels").select("doc_id", "quality"),
                                     join_key="doc_id")])
    return j.df.select("doc_id", "lang", "quality")


@register("left_join_collision_rename", """
SELECT d.doc_id, d.lang, s.lang AS side_lang, s.source AS side_source
FROM documents d LEFT JOIN (SELECT doc_id, upper(lang) AS lang, source FROM documents WHERE doc_id % 3 <> 0) s
ON d.doc_id = s.doc_id""")
def q_left_join_collision_rename(spark, sf):
    """A side table (a partial projection of documents) shares ``lang`` and ``source``
    with the primary; both arrive prefixed ``side_``, the primary keeps its names, and the
    lineage maps (side, lang) to ``side_lang``."""
    d = table(spark, sf, "documents")
    side = d.where(F.col("doc_id") % 3 != 0).select("doc_id", F.upper("lang").alias("lang"), "source")
    j = join_with_lineage([TableSpec("documents", d.select("doc_id", "lang", "source"), "primary"),
                           TableSpec("side", side, join_key="doc_id")])
    assert j.lineage[("side", "lang")] == "side_lang"
    return j.df.select("doc_id", "lang", "side_lang", "side_source")


NULLKEY_SQL = """
SELECT n.n_nationkey, r.r_name
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS rk FROM nation) n
LEFT JOIN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END AS rk, r_name FROM region) r
ON n.rk IS NOT DISTINCT FROM r.rk"""


@register("left_join_null_safe", NULLKEY_SQL)
def q_left_join_null_safe(spark, sf):
    """JOIN2: null keys match null keys (the pandas merge behaviour) with ``<=>``."""
    n = table(spark, sf, "nation").select(
        "n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.lit(None)).otherwise(F.col("n_regionkey")).alias("rk"))
    r = table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") == 4, F.lit(None)).otherwise(F.col("r_regionkey")).alias("rk"), "r_name")
    j = join_with_lineage([TableSpec("nation", n, "primary"), TableSpec("region", r, join_key="rk")], null_safe=True)
    return j.df.select("n_nationkey", "r_name")


# dataset configuration for the raw feature frame and the profile: orders is primary
# (target o_orderstatus, id o_orderkey, time o_orderdate), customer joins on o_custkey;
# lineitem aggregates per order join as a partial-coverage side table.
DATASET = {"target_table": "orders", "target_column": "o_orderstatus", "id_columns": ["o_orderkey"],
           "time_column": "o_orderdate", "ignore": ["o_custkey", "c_name"]}


def dataset_tables(spark, sf):
    orders = table(spark, sf, "orders")
    cust = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    li = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
          .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("o_totalprice")))
    return [TableSpec("orders", orders, "primary"), TableSpec("customer", cust, join_key="o_custkey"),
            TableSpec("lines", li, join_key="o_orderkey")]


@register("raw_feature_frame", """
SELECT o.o_orderkey, o.o_orderpriority, o.o_totalprice, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
       li.n_lines, li.lines_o_totalprice
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS lines_o_totalprice FROM lineitem GROUP BY 1) li
ON o.o_orderkey = li.l_orderkey""")
def q_raw_feature_frame(spark, sf):
    """PRJ4: role=feature columns of every table under their joined names; the side
    table's ``o_totalprice`` collides with the primary's and is selected as
    ``lines_o_totalprice`` through the lineage."""
    specs = dataset_tables(spark, sf)
    j = join_with_lineage(specs)
    feats = []
    for t in specs:
        for c in t.df.columns:
            if c == t.join_key:
                continue
            role = column_role(c, t.name, DATASET["target_table"], DATASET["target_column"],
                               DATASET["id_columns"], DATASET["time_column"], DATASET["ignore"])
            if role == "feature":
                feats.append((t.name, c))
    out = raw_feature_frame(j, feats, id_cols=["o_orderkey"])
    return out.select("o_orderkey", "o_orderpriority", "o_totalprice", "c_nationkey", "c_acctbal", "c_mktsegment",
                      "n_lines", "lines_o_totalprice")


@register("prepare_categoricals", with_base() + """
SELECT coalesce(CAST(CASE WHEN row_id % 13 = 0 THEN NULL ELSE seg END AS VARCHAR), '__missing__') AS value, count(*) AS n
FROM base GROUP BY 1""")
def q_prepare_categoricals(spark, sf):
    b = base(spark, sf).withColumn("seg", F.when(F.col("row_id") % 13 == 0, F.lit(None)).otherwise(F.col("seg")))
    return b.groupBy(missing_category("seg", b).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ feature store
def _store(spark):
    return FeatureStore(spark, os.path.join(checkpoint_dir(spark), "store-" + uuid.uuid4().hex))


@register("feature_store_roundtrip", with_base(f"""
tr AS (SELECT f.fold, p.seg AS k, avg(CAST(p.y AS DOUBLE)) AS m
       FROM prepared p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)""") + """
SELECT p.row_id, round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.m, 0.5) END, 6) AS value
FROM prepared p LEFT JOIN tr ON p.seg = tr.k AND p.fold = tr.fold""")
def q_feature_store_roundtrip(spark, sf):
    """SRC3: save an OOF column under an unsafe name, load it back by partition."""
    st = _store(spark)
    oof = fx.compute_oof(fx.GroupStat(name="te", key="seg", value="y", uses_target=True, default=0.5),
                         prepared(spark, sf), "row_id", K)
    st.save("run/1", "te seg?", oof, "row_id", "te")
    return st.load("run/1", "te seg?").select("row_id", r6("value").alias("value"))


@register("feature_store_bind", with_base(f"""
tr AS (SELECT f.fold, p.seg AS k, avg(CAST(p.y AS DOUBLE)) AS m
       FROM prepared p, (SELECT DISTINCT fold FROM prepared WHERE fold IS NOT NULL) f
       WHERE p.fold IS NOT NULL AND p.fold <> f.fold AND p.seg IS NOT NULL GROUP BY 1, 2)""") + """
SELECT p.row_id, p.y, round(CASE WHEN p.fold IS NOT NULL THEN coalesce(tr.m, 0.5) END, 6) AS te_seg,
       round(price / nullif(bal, 0), 6) AS price_by_bal
FROM prepared p LEFT JOIN tr ON p.seg = tr.k AND p.fold = tr.fold""")
def q_feature_store_bind(spark, sf):
    """JOIN5 on saved columns: a frame and two features, read in the same buckets."""
    st, p = _store(spark), prepared(spark, sf)
    st.save_frame("r1", "orders", p.select("row_id", "y"), "row_id")
    te = fx.GroupStat(name="te", key="seg", value="y", uses_target=True, default=0.5)
    st.save("r1", "te_seg", fx.compute_oof(te, p, "row_id", K), "row_id", "te")
    st.save("r1", "price_by_bal", p.select("row_id", F.try_divide("price", "bal").alias("v")), "row_id", "v")
    bound = st.bind("r1", ["te_seg", "price_by_bal"], frame="orders")
    return bound.select("row_id", "y", r6("te_seg").alias("te_seg"), r6("price_by_bal").alias("price_by_bal"))


@register("feature_store_list", """
SELECT * FROM (VALUES ('freq_pri'), ('te_seg')) t(feature_name)
WHERE (SELECT count(*) FROM orders) > 0""")
def q_feature_store_list(spark, sf):
    """SRC4: three features saved, one deleted; the listing is sorted."""
    st = _store(spark)
    p = prepared(spark, sf)
    feats = {"te_seg": fx.GroupStat(name="v", key="seg", value="y", uses_target=True, default=0.5),
             "freq_pri": fx.GroupStat(name="v", key="pri", kind="frequency"),
             "gm_seg": fx.GroupStat(name="v", key="seg", value="price")}
    for name, f in feats.items():
        st.save("r1", name, fx.compute_oof(f, p, "row_id", K), "row_id", "v")
    st.delete("r1", "gm_seg")
    assert st.exists("r1", "te_seg") and not st.exists("r1", "gm_seg")
    return st.list_features("r1")


# ------------------------------------------------------------------ scalar functions
@register("fn_isclose", with_base("""
c AS (SELECT price AS a,
             CASE WHEN row_id % 11 = 0 THEN NULL WHEN row_id % 7 = 0 THEN price * (1 + 1e-7) ELSE price * (1 + 1e-10) END AS b
      FROM base)""") + """
SELECT count(*) FILTER (WHERE (a IS NULL AND b IS NULL) OR (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) <= 1e-12 + 1e-9 * abs(b))) AS n_close,
       count(*) FILTER (WHERE NOT ((a IS NULL AND b IS NULL) OR (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) <= 1e-12 + 1e-9 * abs(b)))) AS n_not_close
FROM c""")
def q_fn_isclose(spark, sf):
    b = base(spark, sf)
    bb = (F.when(F.col("row_id") % 11 == 0, F.lit(None))
          .when(F.col("row_id") % 7 == 0, F.col("price") * (1 + 1e-7)).otherwise(F.col("price") * (1 + 1e-10)))
    c = b.select(F.col("price").alias("a"), bb.alias("b")).withColumn("m", isclose("a", "b"))
    return c.agg(F.count_if("m").alias("n_close"), F.count_if(~F.col("m")).alias("n_not_close"))


@register("fn_safe_name", """
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM pages""")
def q_fn_safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_name("url").alias("safe"))


@register("fn_json_records", """
SELECT event_id AS row_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract(props, '$.k') AS BIGINT) = CAST(json_extract(props, '$.k') AS BIGINT) AS roundtrip_ok
FROM events""")
def q_fn_json_records(spark, sf):
    """FN7: read a field of a JSON payload and round-trip a record through JSON text."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rec = F.to_json(F.struct(F.col("event_id"), k.alias("k")))
    back = F.from_json(rec, "event_id bigint, k bigint")
    return e.select(F.col("event_id").alias("row_id"), k.alias("k"),
                    F.coalesce((back["k"] == k) & (back["event_id"] == F.col("event_id")),
                               k.isNull()).alias("roundtrip_ok"))


# ------------------------------------------------------------------ profile tables
def profile_tables(spark, sf):
    """PROF8: one row per (table, column): role, kind, rows, missing, distinct values;
    one wide aggregation per table."""
    parts = []
    for spec in dataset_tables(spark, sf):
        df = spec.df
        cols = df.columns
        kinds = pf.kinds(df)
        miss = pf.profile_missing(df, cols)
        dist = pf.profile_distinct(df, cols)
        roles = spark.createDataFrame(
            [(c, column_role(c, spec.name, DATASET["target_table"], DATASET["target_column"], DATASET["id_columns"],
                             DATASET["time_column"], DATASET["ignore"]), kinds[c]) for c in cols],
            "column_name string, role string, kind string")  # schema metadata
        parts.append(roles.join(miss, "column_name").join(dist, "column_name")
                     .withColumn("table_name", F.lit(spec.name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _prof_sql(tname, rel, cols_roles):
    return _u([f"SELECT '{tname}' AS table_name, '{c}' AS column_name, '{role}' AS role, '{kind}' AS kind, "
               f"count(*) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM {rel}"
               for c, role, kind in cols_roles])


PROF_TABLES_SQL = _u([
    _prof_sql("orders", "orders", [("o_orderkey", "id", "numeric"), ("o_custkey", "ignore", "numeric"),
                                   ("o_orderstatus", "target", "categorical"), ("o_totalprice", "feature", "numeric"),
                                   ("o_orderdate", "time", "datetime"), ("o_orderpriority", "feature", "categorical")]),
    _prof_sql("customer", "customer", [("c_custkey", "ignore", "numeric"), ("c_name", "ignore", "categorical"),
                                       ("c_nationkey", "feature", "numeric"), ("c_acctbal", "feature", "numeric"),
                                       ("c_mktsegment", "feature", "categorical")]),
    _prof_sql("lines", "(SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, sum(l_quantity) AS o_totalprice FROM lineitem GROUP BY 1)",
              [("o_orderkey", "id", "numeric"), ("n_lines", "feature", "numeric"), ("o_totalprice", "feature", "numeric")])]).replace(
    "'customer' AS table_name, 'c_custkey' AS column_name", "'customer' AS table_name, 'o_custkey' AS column_name")


@register("profile_tables", PROF_TABLES_SQL)
def q_profile_tables(spark, sf):
    p = profile_tables(spark, sf)
    return p.select("table_name", "column_name", "role", "kind", "n", "n_missing", "n_unique")


DIGEST_SQL = ("SELECT table_name, column_name, printf('%s [%s, %s] missing=%.3f unique=%d', column_name, role, kind, "
              "n_missing / greatest(n, 1)::DOUBLE, n_unique) AS line FROM (" + PROF_TABLES_SQL + ") WHERE role <> 'ignore'")


@register("profile_digest", DIGEST_SQL)
def q_profile_digest(spark, sf):
    """REP4: one text line per non-ignored column."""
    p = profile_tables(spark, sf).where(F.col("role") != "ignore")
    line = F.format_string("%s [%s, %s] missing=%.3f unique=%d", F.col("column_name"), F.col("role"), F.col("kind"),
                           F.col("n_missing") / F.greatest(F.col("n"), F.lit(1)), F.col("n_unique"))
    return p.select("table_name", "column_name", line.alias("line"))


# ------------------------------------------------------------------ candidate templates
TEMPLATES_SQL = f"""
WITH feat AS (SELECT * FROM ({PROF_TABLES_SQL}) WHERE role = 'feature')
SELECT 'group_mean' AS template, a.column_name AS a, b.column_name AS b FROM (SELECT DISTINCT column_name, kind FROM feat) a
  JOIN (SELECT DISTINCT column_name, kind FROM feat WHERE n_unique >= 2) b ON a.kind = 'numeric' AND b.kind = 'categorical'
UNION ALL
SELECT 'ratio', a.column_name, b.column_name FROM (SELECT DISTINCT column_name FROM feat WHERE kind = 'numeric') a
  JOIN (SELECT DISTINCT column_name FROM feat WHERE kind = 'numeric') b ON a.column_name < b.column_name
UNION ALL
SELECT DISTINCT t, column_name, NULL FROM feat, (VALUES ('frequency'), ('target_encoding')) x(t) WHERE kind = 'categorical' AND n_unique >= 2"""


def candidate_templates(profile, max_cardinality=None, max_missing_share=None):
    """deterministic candidate features from profile rows, one for each column of the tables; pairs are
    of column names, not of data rows. ``max_cardinality`` bounds the categories of a grouping column and
    ``max_missing_share`` the missing share of any; neither does unless given."""
    feat = profile.where(F.col("role") == "feature")
    if max_missing_share is not None:
        feat = feat.where(F.col("n_missing") < max_missing_share * F.greatest(F.col("n"), F.lit(1)))
    groups = feat.where((F.col("kind") == "categorical") & (F.col("n_unique") >= 2))
    some = groups if max_cardinality is None else groups.where(F.col("n_unique") <= max_cardinality)
    numbers = feat.where(F.col("kind") == "numeric").select(F.col("column_name").alias("a")).distinct()
    others, no = numbers.withColumnRenamed("a", "b"), F.lit(None).cast("string").alias("b")
    named = lambda name, rows: rows.select(F.lit(name).alias("template"), "a", "b").distinct()
    single = lambda rows: rows.select(F.col("column_name").alias("a"), no)
    return (named("group_mean", numbers.join(some.select(F.col("column_name").alias("b"))))
            .unionByName(named("ratio", numbers.join(others, F.col("a") < F.col("b"))))
            .unionByName(named("frequency", single(groups))).unionByName(named("target_encoding", single(some))))


@register("candidate_templates", TEMPLATES_SQL)
def q_candidate_templates(spark, sf):
    return candidate_templates(profile_tables(spark, sf))


__all__ = ["column_kind"]
