"""Feature contract and out-of-fold computation (UDF1, UDF4, OOF1-6, F1-F10).

A feature is ``fit`` = an aggregate of training rows into a params table and
``transform`` = a row-wise projection plus a join with params. The fit never sees the
rows it is applied to.

Out-of-fold without a loop (X2): for sum/count style fits, the fit on "all dev rows
except fold i" adds up the other folds' partials. One ``groupBy(key)`` with map-side
partial aggregation gives every fold's params, for all features on that key; the row side
joins them on (key, fold). Fits that are not fold-additive fall back to k filtered fits
planned as one union.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.scalar import MISSING_CATEGORY, nan_to_null

# ----------------------------------------------------------------------------------
# contract


class Feature:
    """``name``, ``required_columns``, ``fit(train) -> params``,
    ``transform(rows, params) -> rows + name``. ``uses_target`` features get the
    target column in ``fit`` only; ``transform`` never sees it (PRJ5, PRJ6)."""

    name: str = "feature"
    required_columns: tuple[str, ...] = ()
    uses_target: bool = False
    output_type: str = "double"

    def fit(self, train: DataFrame) -> DataFrame | None:  # pragma: no cover - interface
        return None

    def transform(self, rows: DataFrame, params: DataFrame | None) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    # fold-additive features implement these two instead of a per-fold fit
    fold_additive: bool = False


def validate_feature(feature, df: DataFrame, target_col: str | None = None) -> None:
    """Registration check (UDF1): everything that is wrong with a feature, in one error."""
    wrong = []
    name = getattr(feature, "name", None)
    if not (isinstance(name, str) and name):
        wrong.append("it has no name")
    wrong += [f"{m} is not callable" for m in ("fit", "transform") if not callable(getattr(feature, m, None))]
    needed = tuple(getattr(feature, "required_columns", ()) or ())
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        wrong.append(f"the table lacks {', '.join(absent)}")
    if target_col in needed:
        wrong.append(f"it reads the target {target_col}; set uses_target and take it in fit only")
    if wrong:
        raise ValueError(f"feature {name!r}: " + "; ".join(wrong))


def _fit_input(feature: Feature, df: DataFrame, id_col: str, target_col: str | None) -> DataFrame:
    cols = list(dict.fromkeys([id_col, *feature.required_columns]))
    if feature.uses_target and target_col:
        cols.append(target_col)
    return df.select(*cols)


def _transform_input(feature: Feature, df: DataFrame, id_col: str) -> DataFrame:
    return df.select(*dict.fromkeys([id_col, *feature.required_columns]))


# ----------------------------------------------------------------------------------
# fold-additive group statistics (F1, F2, F3)


@dataclass
class GroupStat(Feature):
    """Per-``key`` mean of ``value`` (F1 group mean; F2 target encoding when ``value`` is
    the target) or per-key share of training rows (F3 frequency encoding).

    ``default``: ``"global"`` = the training rows' overall mean; a number = constant for
    unseen / null keys. Null keys never form a group (pandas ``groupby`` drops them)."""

    name: str = "group_mean"
    key: str = "key"
    value: str | None = None
    kind: str = "mean"  # mean | frequency
    default: str | float = "global"
    uses_target: bool = False
    output_type: str = "double"
    fold_additive: bool = True
    required_columns: tuple[str, ...] = field(default=())

    def __post_init__(self):
        cols = [self.key] if self.uses_target or self.value is None else [self.key, self.value]
        self.required_columns = tuple(cols)

    # partial aggregates: (sum, count) per key; frequency uses the row count
    def _partials(self) -> list[Column]:
        if self.kind == "frequency":
            return [F.count(F.lit(1)).cast("double").alias("_s"), F.count(F.lit(1)).alias("_c")]
        v = nan_to_null(F.col(self.value).cast("double"))
        return [F.sum(v).alias("_s"), F.count(v).alias("_c")]

    def _finish(self, s: Column, c: Column, gs: Column, gc: Column, n_rows: Column) -> Column:
        """value from key totals (s, c), global totals (gs, gc) and training rows."""
        if self.kind == "frequency":
            return F.coalesce(s / F.nullif(n_rows.cast("double"), F.lit(0.0)), F.lit(0.0))
        if self.default == "global":
            fallback = gs / F.nullif(gc.cast("double"), F.lit(0.0))
        else:
            fallback = F.lit(float(self.default))
        return F.when(c > 0, s / c.cast("double")).otherwise(fallback)

    def fit(self, train: DataFrame) -> DataFrame:
        """Params table ``(key, value)`` plus one default row with a null key."""
        per_key = train.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*self._partials())
        glob = train.agg(*self._partials(), F.count(F.lit(1)).alias("_n"))
        joined = per_key.crossJoin(glob.select(F.col("_s").alias("_gs"), F.col("_c").alias("_gc"),
                                               "_n"))  # right side is one row
        keyed = joined.select(F.col(self.key).alias("key"),
                              self._finish(F.col("_s"), F.col("_c"), F.col("_gs"), F.col("_gc"),
                                           F.col("_n")).alias("value"))
        default = glob.select(F.lit(None).cast(keyed.schema["key"].dataType).alias("key"),
                              self._default_value(F.col("_s"), F.col("_c"), F.col("_n")).alias("value"))
        return keyed.unionByName(default)

    def _default_value(self, gs: Column, gc: Column, n: Column) -> Column:
        if self.kind == "frequency":
            return F.lit(0.0)
        if self.default == "global":
            return gs / F.nullif(gc.cast("double"), F.lit(0.0))
        return F.lit(float(self.default))

    def transform(self, rows: DataFrame, params: DataFrame) -> DataFrame:
        """Lookup with default (JOIN3, FN8). Params are one row per key; Spark/AQE picks
        broadcast when the table is small, a shuffle join otherwise."""
        keyed = params.where(F.col("key").isNotNull()).select(F.col("key").alias("_pk"),
                                                               F.col("value").alias("_pv"))
        dflt = params.where(F.col("key").isNull()).select(F.col("value").alias("_pd"))
        out = rows.join(keyed, F.col(self.key) == F.col("_pk"), "left").drop("_pk")
        out = out.crossJoin(F.broadcast(dflt))  # exactly one row
        return out.withColumn(self.name, F.coalesce(F.col("_pv"), F.col("_pd"))).drop("_pv", "_pd")

    def _fold_partials(self, k: int, fold_col: str) -> list[tuple[str, Column]]:
        """Per-fold sums ``_s<i>`` and counts ``_c<i>`` as 2k conditional aggregates of one pass."""
        f = F.col(fold_col)
        if self.kind == "frequency":
            s = [F.count_if(f == i).cast("double") for i in range(k)]
            c = [F.count_if(f == i) for i in range(k)]
        else:
            v = nan_to_null(F.col(self.value).cast("double"))
            s = [F.sum(F.when(f == i, v)) for i in range(k)]
            c = [F.count(F.when(f == i, v)) for i in range(k)]
        return [(f"_s{i}", x) for i, x in enumerate(s)] + [(f"_c{i}", x) for i, x in enumerate(c)]

    def oof(self, df: DataFrame, fold_col: str = "fold", k: int | None = None) -> DataFrame:
        """The out-of-fold value of every dev row, null on holdout rows; see ``oof_group_stats``."""
        return oof_group_stats(df, [self], fold_col, k)


def _other_folds(columns: list[Column], own: int) -> Column:
    """Sum of the other folds' partials, added up directly: a total less the own fold would cancel where
    values differ by many orders of magnitude, and give NaN with infinities."""
    rest = [F.coalesce(c, F.lit(0)) for j, c in enumerate(columns) if j != own]
    return sum(rest[1:], rest[0]) if rest else F.coalesce(columns[own] * 0, F.lit(0))


def oof_group_stats(df: DataFrame, features: list[GroupStat], fold_col: str = "fold", k: int | None = None) -> DataFrame:
    """``df`` with the out-of-fold column of every feature. One aggregate per key column, shared by the
    features on it, gives every fold's partials; exploded to (key, fold) rows of other-fold sums they
    meet the rows once per key column, which also spreads a hot key over k partitions. The fallbacks of
    all features come from one more aggregate without a key (k rows, broadcast)."""
    if k is None:
        k = int(df.agg(F.max(fold_col)).first()[0]) + 1
    dev = df.where(F.col(fold_col).isNotNull())
    f, kept = F.col(fold_col), list(df.columns)

    def partials() -> list[Column]:
        return [c.alias(f"{c_name}_{n}") for n, x in enumerate(features) for c_name, c in x._fold_partials(k, fold_col)]

    def others(n: int, i: int) -> list[Column]:
        return [_other_folds([F.col(f"{p}{j}_{n}") for j in range(k)], i).alias(f"{t}_{n}") for p, t in (("_s", "_ts"), ("_c", "_tc"))]

    def by_fold(numbers: list[int], rows: str) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(i).alias("_f"), *[c for n in numbers for c in others(n, i)],
                                           *([_other_folds([F.col(f"_n{j}") for j in range(k)], i).alias("_ntr")] if rows else [])) for i in range(k)]))

    every = list(range(len(features)))
    whole = dev.agg(*partials(), *[F.count_if(f == i).alias(f"_n{i}") for i in range(k)]).select(by_fold(every, "rows"))
    whole = whole.withColumnsRenamed({f"_t{x}_{n}": f"_g{x}_{n}" for n in every for x in "sc"})  # k rows
    out = df.join(F.broadcast(whole), f == F.col("_f"), "left").drop("_f")
    for key in dict.fromkeys(x.key for x in features):
        own = [n for n in every if features[n].key == key]
        sums = dev.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_pk")).agg(
            *[c.alias(f"{name}_{n}") for n in own for name, c in features[n]._fold_partials(k, fold_col)])
        params = sums.select("_pk", by_fold(own, "")).withColumnRenamed("_f", "_pf")
        out = out.join(params, (F.col(key) == F.col("_pk")) & (f == F.col("_pf")), "left").drop("_pk", "_pf")
    values = [F.when(f.isNotNull(), x._finish(F.coalesce(F.col(f"_ts_{n}"), F.lit(0.0)), F.coalesce(F.col(f"_tc_{n}"), F.lit(0)),
                                              F.col(f"_gs_{n}"), F.col(f"_gc_{n}"), F.col("_ntr"))).alias(x.name) for n, x in enumerate(features)]
    names = [x.name for x in features]
    return out.select(*[c for c in kept if c not in names], *values)


# ----------------------------------------------------------------------------------
# row-wise features (F4-F7) and a fold-decomposable fit (F6 min time)


@dataclass
class Expression(Feature):
    """A fit-free row-wise feature: ``expr`` is a Column over ``required_columns``."""

    name: str = "expr"
    expr: Column | None = None
    required_columns: tuple[str, ...] = ()
    output_type: str = "double"

    def fit(self, train: DataFrame) -> None:
        return None

    def transform(self, rows: DataFrame, params=None) -> DataFrame:
        return rows.withColumn(self.name, self.expr.cast(self.output_type))

    def oof(self, df: DataFrame, fold_col: str = "fold") -> DataFrame:
        return df.withColumn(self.name, F.when(F.col(fold_col).isNotNull(),
                                               self.expr.cast(self.output_type)))


def ratio(name: str, a: str, b: str) -> Expression:
    """a / b, null when b is 0 or null."""
    return Expression(name=name, expr=F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")),
                      required_columns=(a, b))


def product(name: str, a: str, b: str) -> Expression:
    """F5 numeric interaction."""
    return Expression(name=name, expr=F.col(a).cast("double") * F.col(b).cast("double"),
                      required_columns=(a, b))


def cross(name: str, *cols: str) -> Expression:
    """F5 categorical interaction: ``a|b`` with missing placeholders."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)) for c in cols]
    return Expression(name=name, expr=F.concat_ws("|", *parts), required_columns=tuple(cols),
                      output_type="string")


@dataclass
class DaysSinceStart(Feature):
    """days from the earliest training timestamp to the row's own timestamp. The
    fit is ``min(t)``; min over "all folds but i" is the min of the other folds' mins,
    so the out-of-fold fit is exact from a k-row table."""

    name: str = "days_since_start"
    time_col: str = "t"
    required_columns: tuple[str, ...] = ()
    fold_additive: bool = True

    def __post_init__(self):
        self.required_columns = (self.time_col,)

    def fit(self, train: DataFrame) -> DataFrame:
        return train.agg(F.min(self.time_col).alias("t0"))

    def transform(self, rows: DataFrame, params: DataFrame) -> DataFrame:
        out = rows.crossJoin(F.broadcast(params))  # one row
        return out.withColumn(self.name, _days(F.col(self.time_col), F.col("t0"))).drop("t0")

    def oof(self, df: DataFrame, fold_col: str = "fold") -> DataFrame:
        mins = df.where(F.col(fold_col).isNotNull()).groupBy(fold_col).agg(F.min(self.time_col).alias("_m"))
        other = (mins.alias("a").crossJoin(mins.alias("b"))  # k x k rows
                 .where(F.col(f"a.{fold_col}") != F.col(f"b.{fold_col}"))
                 .groupBy(F.col(f"a.{fold_col}").alias("_f")).agg(F.min("b._m").alias("_t0")))
        out = df.join(F.broadcast(other), F.col(fold_col) == F.col("_f"), "left")
        return out.withColumn(self.name, _days(F.col(self.time_col), F.col("_t0"))).drop("_f", "_t0")


def _days(t: Column, t0: Column) -> Column:
    return (F.unix_micros(t.cast("timestamp")) - F.unix_micros(t0.cast("timestamp"))) / F.lit(86400e6)


# ----------------------------------------------------------------------------------
# generic path and assembly (OOF1-OOF4)


def compute_oof(feature: Feature, df: DataFrame, id_col: str, k: int, fold_col: str = "fold",
                target_col: str | None = None) -> DataFrame:
    """``(id, feature.name)`` for every row; dev rows get their out-of-fold value,
    holdout rows null (Q12). Fold-additive features use one aggregate; others run k
    filtered fits in one union plan."""
    if isinstance(feature, GroupStat):
        return feature.oof(df, fold_col, k).select(id_col, feature.name)
    if getattr(feature, "fold_additive", False) or isinstance(feature, Expression):
        return feature.oof(df, fold_col).select(id_col, feature.name)
    parts = []
    for i in range(k):
        train = _fit_input(feature, df.where(F.col(fold_col).isNotNull() & (F.col(fold_col) != i)),
                           id_col, target_col)
        val = _transform_input(feature, df.where(F.col(fold_col) == i), id_col)
        parts.append(feature.transform(val, feature.fit(train)).select(id_col, feature.name))
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    return df.select(id_col).join(vals, id_col, "left")


def full_fit(feature: Feature, df: DataFrame, id_col: str, split_col: str = "split",
             target_col: str | None = None) -> DataFrame | None:
    """OOF2: params fitted on dev rows only, for serving."""
    dev = df.where(F.col(split_col) == "dev")
    return feature.fit(_fit_input(feature, dev, id_col, target_col))


def transform_new(feature: Feature, rows: DataFrame, params: DataFrame | None, id_col: str) -> DataFrame:
    """OOF3: apply stored params, never refit."""
    return feature.transform(_transform_input(feature, rows, id_col), params).select(id_col, feature.name)


def assemble(df: DataFrame, id_col: str, features: list[Feature], k: int, fold_col: str = "fold",
             target_col: str | None = None) -> DataFrame:
    """OOF4/JOIN5: ``df`` with one out-of-fold column per feature, on the rows themselves. Group
    statistics share an aggregate per key, row-wise features are projections; only a fit that is not
    fold-additive comes back by the row id."""
    stats = [f for f in features if isinstance(f, GroupStat)]
    out = oof_group_stats(df, stats, fold_col, k) if stats else df
    for f in features:
        if isinstance(f, GroupStat):
            continue
        if isinstance(f, PandasFit):
            out = f.oof(out, fold_col, k)
        elif getattr(f, "fold_additive", False) or isinstance(f, Expression):
            out = f.oof(out, fold_col)
        else:
            out = out.join(compute_oof(f, df, id_col, k, fold_col, target_col), id_col, "left")
    return out


def oof_coverage(oof: DataFrame, df: DataFrame, id_col: str, value_col: str,
                 fold_col: str = "fold") -> DataFrame:
    """OOF6: one value per input row, unique ids, values exactly on dev rows."""
    j = df.select(id_col, fold_col).join(oof, id_col, "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(id_col).alias("n_ids"),
        F.count_if(F.col(fold_col).isNotNull() & F.col(value_col).isNotNull()).alias("n_dev_valued"),
        F.count_if(F.col(fold_col).isNull() & F.col(value_col).isNotNull()).alias("n_holdout_valued"))


def memoised_encoding(df: DataFrame, key: str, y_col: str, fold_col: str = "fold",
                      name: str = "te_leaky", default: float = 0.5) -> DataFrame:
    """F10 negative control: the params of the first fold's fit are reused for every
    fold, so rows of folds 1..k-1 are looked up in a table fitted on themselves."""
    dev = df.where(F.col(fold_col).isNotNull())
    p0 = (dev.where((F.col(fold_col) != 0) & F.col(key).isNotNull())
          .groupBy(key).agg(F.avg(F.col(y_col).cast("double")).alias("_p")))
    out = df.join(p0, key, "left")
    return out.withColumn(name, F.when(F.col(fold_col).isNotNull(),
                                       F.coalesce(F.col("_p"), F.lit(default)))).drop("_p")


# ----------------------------------------------------------------------------------
# arbitrary fits in pandas over pre-aggregated rows (UDF4)


@dataclass
class PandasFit(Feature):
    """A fit whose last step is pandas code. ``partials`` are additive Spark aggregates
    (sums, counts) computed per (key, fold) with map-side partial aggregation; the
    training partials of fold i are the sums over the other folds. ``finish(train,
    glob)`` turns a frame of training partials (one row per key) plus the dict of
    global training partials into the feature values. It runs in ``applyInPandas``
    grouped by a hash bucket of the key, so every group holds a bounded slice of the
    keys (never one group per fold or per table)."""

    name: str = "pandas_fit"
    key: str = "key"
    partials: dict = field(default_factory=dict)
    finish: object = None
    default: float = 0.0
    uses_target: bool = False
    buckets: int | None = None
    required_columns: tuple[str, ...] = ()

    def oof(self, df: DataFrame, fold_col: str = "fold", k: int | None = None) -> DataFrame:
        import pandas as pd
        from foldwise.session import ship_package
        spark = df.sparkSession
        ship_package(spark)
        if k is None:
            k = int(df.agg(F.max(fold_col)).first()[0]) + 1
        names = list(self.partials)
        dev = df.where(F.col(fold_col).isNotNull())
        g = dev.where(F.col(self.key).isNotNull()).groupBy(self.key, fold_col).agg(
            *[e.alias(n) for n, e in self.partials.items()])
        per_fold = {r[fold_col]: r for r in dev.groupBy(fold_col).agg(
            *[e.alias(n) for n, e in self.partials.items()]).collect()}  # k rows
        glob = {i: {n: sum(float(per_fold[j][n] or 0) for j in per_fold if j != i) for n in names}
                for i in range(k)}
        buckets = self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        key_type = df.schema[self.key].dataType.simpleString()
        finish, key, default = self.finish, self.key, self.default

        def fit_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            keys = pd.Index(pdf[key].unique())
            for i in range(k):  # the other folds' partials, added up directly
                train = pdf[pdf[fold_col] != i].groupby(key)[names].sum().reindex(keys).fillna(0.0)
                vals = pd.Series(finish(train, glob[i]), index=train.index).astype("float64")
                out.append(pd.DataFrame({"_pk": train.index, "_pf": i, "_pv": vals.to_numpy()}))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
                {"_pk": pd.Series(dtype="object"), "_pf": pd.Series(dtype="int32"), "_pv": pd.Series(dtype="float64")})

        bucketed = g.withColumn("_b", F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)))
        params = bucketed.groupBy("_b").applyInPandas(fit_bucket, f"_pk {key_type}, _pf int, _pv double")
        defaults = spark.createDataFrame([(i, float(finish(pd.DataFrame([{n: 0.0 for n in names}]), glob[i])[0])
                                           if default is None else float(default)) for i in range(k)],
                                         "_f int, _pd double")  # k rows
        rows = df.join(params, (F.col(self.key) == F.col("_pk")) & (F.col(fold_col) == F.col("_pf")), "left")
        rows = rows.join(F.broadcast(defaults), F.col(fold_col) == F.col("_f"), "left")
        out = rows.withColumn(self.name, F.when(F.col(fold_col).isNotNull(), F.coalesce(F.col("_pv"), F.col("_pd"))))
        return out.drop("_pk", "_pf", "_pv", "_f", "_pd")


def smoothed_target_encoding(name: str, key: str, y: str, m: float = 10.0) -> PandasFit:
    """F2 with m-estimate smoothing towards the training prior:
    (sum_y + m * prior) / (count + m); an unseen key gets the prior."""
    def finish(train, glob):
        prior = glob["sy"] / glob["n"] if glob["n"] else 0.5
        return (train["sy"] + m * prior) / (train["n"] + m)
    return PandasFit(name=name, key=key, partials={"sy": F.sum(F.col(y).cast("double")),
                                                    "n": F.count(F.lit(1)).cast("double")},
                     finish=finish, default=None, uses_target=True, required_columns=(key,))


def coerce_output(df: DataFrame, col: str) -> DataFrame:
    """OOF5: a feature column becomes double when every non-null value parses as a
    number (one aggregate pass), otherwise it stays text."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.NumericType):
        return df.withColumn(col, c.cast("double"))
    bad = df.agg(F.count_if(c.isNotNull() & c.try_cast("double").isNull()).alias("b")).first()["b"]
    return df.withColumn(col, c.try_cast("double")) if bad == 0 else df


def categorical_columns(df: DataFrame, raw_categoricals: list[str], features: list[Feature]) -> list[str]:
    """PRJ13: raw categorical columns plus engineered features declared categorical
    (string output), restricted to the columns present in the frame."""
    engineered = [f.name for f in features if getattr(f, "output_type", "double") in ("string", "category")]
    return [c for c in dict.fromkeys([*raw_categoricals, *engineered]) if c in df.columns]
