"""Model training, scoring and attribution (ML1-ML5, SHAP1-2, SEL1).

All models of a run share one written design: the label, the fold, the numeric values and every
categorical column's ordered target statistics for each fold model (``encoding``). Logistic models of all
folds and feature sets are fitted together, a scan an iteration (``logit``), boosted trees a scan a level
(``boost``: the trees of ``pyspark.ml``'s GBT on the same columns). Fitted models are small arrays;
scoring is one Arrow pass, and metrics come from histograms of scores, grouped by fold, when they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import TWO_POW_32, h
from foldwise.functions.scalar import PROBA_EPS, known
from foldwise.operators.boost import fit_boosted
from foldwise.operators.encoding import model_priors, ordered_statistics
from foldwise.operators.logit import Columns, array_column, fit_many, moments, plain_column, sigmoid, tasks_of
from foldwise.operators.rank import dist_rank
from foldwise.operators.scoring import METRICS, binary_metrics, packed_aucs, with_summary  # noqa: F401
from foldwise.session import materialize, ship_package


@dataclass
class ModelSpec:
    """``kind``: ``logistic`` (fast, for screens) or ``gbt`` (final model)."""

    kind: str = "logistic"
    max_iter: int = 50
    reg_param: float = 0.01
    tol: float = 1e-12
    trees: int = 20
    depth: int = 4
    step: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class BoostedModel:
    """The trees of a GBT over the design columns ``columns``."""

    columns: tuple[int, ...]
    trees: tuple

    def margin(self, x: np.ndarray) -> np.ndarray:
        from foldwise.operators.treeshap import predict_trees
        return 2.0 * predict_trees(self.trees, x[:, list(self.columns)])

    def proba(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


@dataclass
class Design:
    """``table``: id, label (double), fold (int, null outside of dev), num, enc_fit, enc_apply and the extra columns,
    written once."""

    table: DataFrame
    id_col: str
    columns: Columns
    priors: list[float]
    extra: tuple[str, ...] = ()

    @property
    def k(self) -> int:
        return self.columns.k

    @property
    def features(self) -> list[str]:
        return [*self.columns.numeric, *self.columns.categorical]

    @cached_property
    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        return moments(self.table, self.columns, tasks_of(self.table))

    def fit(self, sets: Sequence[tuple[int, Sequence[str]]], spec: ModelSpec) -> list:
        """The models of (fold left out or k, features)."""
        if spec.kind != "gbt":
            return fit_many(self.table, self.columns, sets, spec.reg_param, spec.tol, spec.max_iter, self.moments)[0]
        picked = [self.columns.of(f) for _, f in sets]
        trees = fit_boosted(self.table, self.id_col, self.columns, [(i, p) for (i, _), p in zip(sets, picked, strict=True)], spec.trees, spec.depth, spec.step, spec.seed)
        return [BoostedModel(tuple(p), t) for p, t in zip(picked, trees, strict=True)]

    def vector(self, model: int, picked: Sequence[int], encoding: str) -> Column:
        """The model's input as an array, its columns in the design's order."""
        n, c = len(self.columns.numeric), self.columns
        value = lambda j: F.get("num", F.lit(j))
        parts = []
        for j in picked:
            if j < n:
                parts.append(F.when(F.isnan(value(j)), F.lit(float(c.impute[model][j]))).otherwise(value(j)))
            elif j < 2 * n:
                parts.append(F.isnan(value(j - n)).cast("double"))
            else:
                parts.append(F.get(encoding, F.lit((j - 2 * n) * (self.k + 1) + model)))
        return F.array(*parts)

    def map(self, fn: Callable[[pa.RecordBatch, Callable[[int], np.ndarray]], Iterator[pa.RecordBatch]], schema: str, rows: DataFrame | None = None) -> DataFrame:
        """``fn(batch, matrix)`` over the table's batches; ``matrix(i, rows)`` are the rows (all by default) as model i scores them."""
        ship_package(self.table.sparkSession)
        matrix = self.matrix()

        def run(batches):
            for batch in batches:
                yield from fn(batch, matrix(batch))

        return (self.table if rows is None else rows).mapInArrow(run, schema)

    def matrix(self) -> Callable[[pa.RecordBatch], Callable[..., np.ndarray]]:
        columns = self.columns

        def of(batch):
            num, enc = array_column(batch, "num", len(columns.numeric)), array_column(batch, "enc_apply", len(columns.categorical) * (columns.k + 1))
            return lambda i, rows=slice(None): columns.matrix(num[rows], enc[rows], i)

        return of

    def aucs(self, fn: Callable[[pa.RecordBatch, Callable[[int], np.ndarray]], list], rows: DataFrame) -> DataFrame:
        """(set, fold, auc) of the pieces (set, fold, scores, labels) that ``fn`` gives for each batch of ``rows``."""
        matrix, used = self.matrix(), [c for c in self.table.columns if c != "enc_fit"]
        return packed_aucs(rows.select(*used), lambda batch: fn(batch, matrix(batch)), rows.select(*used), rows.count(), self.id_col).drop("several")

    def score(self, models: dict, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the probability of each of ``rows`` by the model of its fold, or by the only model."""
        fields = [f for f in self.table.schema.fields if f.name in keep]

        def fn(batch, matrix):
            fold = plain_column(batch, "fold")
            out = np.full(len(batch), np.nan)
            for i, model in models.items():
                mine = np.ones(len(batch), bool) if len(models) == 1 else fold == i
                if mine.any():
                    out[mine] = model.proba(matrix(i, mine))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in fields], pa.array(out)],
                                             names=[*[f.name for f in fields], "proba"])

        return self.map(fn, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "proba double"]), rows)


def build_design(df: DataFrame, id_col: str, label: str, numeric: Sequence[str], categorical: Sequence[str], k: int, fold_col: str = "fold",
                 extra: Sequence[str] = (), seed: int = 42) -> Design:
    """PRJ8 and the encodings: categorical values are text with ``__missing__`` for null and NaN, numeric ones doubles
    with a missing flag, imputed by each model's training mean."""
    numeric, categorical = list(numeric), list(categorical)
    dev = df.where(F.col(fold_col).isNotNull())
    priors = model_priors(df, label, k, fold_col)
    values = {c: known(df, c).cast("double") for c in numeric}
    sums = dev.groupBy(fold_col).agg(F.count(F.lit(1)), *[f(values[c]) for c in numeric for f in (F.avg, F.count)]).collect()  # k rows
    impute = np.zeros((k + 1, len(numeric)))
    for i in range(k + 1):
        for j in range(len(numeric)):
            own = [(r[2 + 2 * j], r[3 + 2 * j]) for r in sums if r[0] != i and r[3 + 2 * j]]
            impute[i, j] = sum(m * n for m, n in own) / max(sum(n for _, n in own), 1)
    nan = F.lit(float("nan"))
    base = [F.col(label).cast("double").alias("label"), F.col(fold_col).cast("int").alias("fold"), *[F.col(c) for c in extra],
            F.array(*[F.coalesce(values[c], nan) for c in numeric]).cast("array<double>").alias("num")]
    if categorical:
        table = ordered_statistics(df, id_col, label, categorical, k, fold_col, seed, priors, keep=base)
    else:
        table = df.select(F.col(id_col), *base, *[F.array().cast("array<double>").alias(c) for c in ("enc_fit", "enc_apply")])
    ship_package(df.sparkSession)
    return Design(materialize(table, "design"), id_col, Columns(tuple(numeric), tuple(categorical), k, impute), priors, tuple(extra))


@dataclass
class CVResult:
    """The fold models; scores and metrics are worked out when they are asked for."""

    design: Design
    models: dict  # fold -> model

    @cached_property
    def oof(self) -> DataFrame:
        """(id, fold, label, proba) of the validation rows, each by the model that did not see it."""
        d = self.design
        return d.score(self.models, d.table.where("fold IS NOT NULL"), [d.id_col, "fold", "label"])

    @cached_property
    def fold_metrics(self) -> DataFrame:
        """fold, auc, logloss, pr_auc, ks, brier (-1: mean, -2: population std)."""
        return with_summary(binary_metrics(self.oof, "proba", "label", by=["fold"]), "fold")

    @cached_property
    def train_metrics(self) -> DataFrame:
        """The same on the rows that each model was trained on."""
        d, models = self.design, self.models

        def fn(batch, matrix):
            fold, label = plain_column(batch, "fold"), plain_column(batch, "label")
            for i, model in models.items():
                seen = fold != i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(seen.sum(), i, np.int32)), pa.array(label[seen], from_pandas=True), pa.array(model.proba(matrix(i, seen)))],
                                                 names=["fold", "label", "proba"])

        scored = d.map(fn, "fold int, label double, proba double", d.table.where("fold IS NOT NULL"))
        return with_summary(binary_metrics(scored, "proba", "label", by=["fold"]), "fold")


def cross_validate(df: DataFrame | Design, id_col: str, label: str, numeric, categorical, k: int, fold_col: str = "fold",
                   spec: ModelSpec | None = None) -> CVResult:
    """ML1: k models (train = fold <> i) over one design."""
    design = df if isinstance(df, Design) else build_design(df.where(F.col(fold_col).isNotNull()), id_col, label, numeric, categorical, k, fold_col)
    features = [*numeric, *categorical]
    return CVResult(design, dict(enumerate(design.fit([(i, features) for i in range(k)], spec or ModelSpec()))))


def clipped(proba: np.ndarray) -> np.ndarray:
    return np.clip(proba, PROBA_EPS, 1 - PROBA_EPS)


def set_aucs(design: Design, sets: Sequence[Sequence[str]], spec: ModelSpec | None = None) -> list[float]:
    """SEL1: the mean fold AUC of each feature set; an empty set scores 0.5. All sets and folds are fitted in the same
    scans and scored in one."""
    spec, wanted = spec or ModelSpec(), [(n, s) for n, s in enumerate(sets) if s]
    if not wanted:
        return [0.5] * len(sets)
    tasks = [(n, i, s) for n, s in wanted for i in range(design.k)]
    models, k = [(n, i, m) for (n, i, _), m in zip(tasks, design.fit([(i, s) for _, i, s in tasks], spec), strict=True)], design.k

    def fn(batch, matrix):
        fold, y = plain_column(batch, "fold"), plain_column(batch, "label")
        pieces = []
        for i in range(k):
            mine = fold == i
            if mine.any():
                x = matrix(i, mine)
                pieces += [(n, i, clipped(m.proba(x)), y[mine]) for n, own, m in models if own == i]
        return pieces

    aucs = design.aucs(fn, design.table.where("fold IS NOT NULL")).groupBy("set").agg(F.avg("auc").alias("auc"))
    found = {r["set"]: r["auc"] for r in aucs.collect()}  # a number a set
    return [0.5 if found.get(n) is None else float(found[n]) for n in range(len(sets))]


def set_records(design: Design, sets: Sequence[Sequence[str]], split_col: str = "split", spec: ModelSpec | None = None) -> DataFrame:
    """ML5 of several feature sets: ``(set, auc_mean, auc_std, train_auc_mean, holdout_auc)``, the fold models' mean and
    population std on their validation rows, their mean on their training rows, and the full model on the holdout. All
    models are fitted in the same scans and scored in one."""
    k, tasks = design.k, [(n, i) for n in range(len(sets)) for i in range(design.k + 1)]
    models = list(zip(tasks, design.fit([(i, sets[n]) for n, i in tasks], spec or ModelSpec()), strict=True))

    def fn(batch, matrix):
        fold, y = plain_column(batch, "fold"), plain_column(batch, "label")
        held = np.array([v == "holdout" for v in batch.column(batch.schema.get_field_index(split_col)).to_pylist()], bool)
        pieces = []
        for i in range(k + 1):
            x = matrix(i)
            parts = [(0, fold == i), (1, ~np.isnan(fold) & (fold != i))] if i < k else [(2, held)]
            for part, mine in parts:
                if mine.any():
                    pieces += [(3 * n + part, i, clipped(m.proba(x[mine])), y[mine]) for (n, own), m in models if own == i]
        return pieces

    aucs = design.aucs(fn, design.table).withColumns({"part": F.col("set") % 3, "set": F.floor(F.col("set") / 3).cast("int")})
    of = lambda part: F.when(F.col("part") == part, F.col("auc"))
    return aucs.groupBy("set").agg(F.avg(of(0)).alias("auc_mean"), F.stddev_pop(of(0)).alias("auc_std"), F.avg(of(1)).alias("train_auc_mean"),
                                   F.max(of(2)).alias("holdout_auc"))


def fit(df: DataFrame, id_col: str, label: str, numeric, categorical, spec: ModelSpec | None = None, split_col: str = "split", k: int | None = None,
        fold_col: str = "fold") -> tuple[Design, object]:
    """ML2: the design of all rows, and one model of the rows that have a fold."""
    k = int(df.agg(F.max(fold_col)).first()[0] or 0) + 1 if k is None else k
    extra = [split_col] if split_col in df.columns else []
    design = build_design(df, id_col, label, numeric, categorical, k, fold_col, extra)
    return design, design.fit([(k, [*numeric, *categorical])], spec or ModelSpec())[0]


def predict(design: Design, model, rows: DataFrame | None = None) -> DataFrame:
    """(id, label, extra columns, proba) of the design's rows, or of ``rows`` of its table."""
    return design.score({design.k: model}, design.table if rows is None else rows, [design.id_col, "label", *design.extra])


def holdout_metrics(df: DataFrame, id_col: str, label: str, numeric, categorical, split_col: str = "split",
                    spec: ModelSpec | None = None) -> DataFrame:
    """ML3: fit on dev rows once, score the holdout rows once."""
    design, model = fit(df, id_col, label, numeric, categorical, spec, split_col)
    return binary_metrics(predict(design, model, design.table.where(F.col(split_col) == "holdout")), "proba", "label")


# ----------------------------------------------------------------------------- SHAP


def linear_shap(df: DataFrame, coefficients: dict, means: dict | None = None) -> DataFrame:
    """SHAP1, linear model: the exact contribution of feature j to a row is
    ``coef_j * (x_j - mean_j)``; the importance is its mean absolute value. Pure Columns."""
    if means is None:
        row = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
        means = {c: row[c] for c in coefficients}
    aggs = [F.avg(F.abs(F.lit(float(coefficients[c])) * (F.col(c) - F.lit(float(means[c]))))).alias(c)
            for c in coefficients]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_shap"))
                                          for c in coefficients])).alias("s")).select("s.*")


def validation_rows(cv: CVResult) -> DataFrame:
    """(id, fold, label, x): each validation row as its own fold's model scores it."""
    d, k = cv.design, cv.design.k
    doubles = lambda parts: F.array(*parts).cast("array<double>")
    impute = F.get(F.array(*[doubles([F.lit(float(v)) for v in d.columns.impute[i]]) for i in range(k)]), F.col("fold"))
    values = F.zip_with("num", impute, lambda v, mean: F.when(F.isnan(v), mean).otherwise(v))
    missing = F.transform("num", lambda v: F.isnan(v).cast("double"))
    statistics = doubles([F.get("enc_apply", F.lit(j * (k + 1)) + F.col("fold")) for j in range(len(d.columns.categorical))])
    return d.table.where("fold IS NOT NULL").select(F.col(d.id_col).alias("id"), "fold", "label", F.concat(values, missing, statistics).alias("x"))


def permutation_importance(cv: CVResult, columns: Sequence[str], n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """SHAP2: AUC drop when one column is shuffled among a fold's validation rows, each row scored by the model that
    did not see it. The shuffle pairs the row at rank r in one hash order with the row at rank r in another, inside
    the fold; all repeats are ranked and joined together. The rows travel as their values and their own model's statistics;
    one Arrow pass makes the model's input of them, scores every column of every pair and hands on packed scores, so
    the plan has the same few nodes for any number of columns."""
    d, k = cv.design, cv.design.k
    numeric, many_cats = len(d.columns.numeric), len(d.columns.categorical)
    own = F.array(*[F.get("enc_apply", F.lit(j * (k + 1)) + F.col("fold")) for j in range(many_cats)]) if many_cats else F.array().cast("array<double>")
    rows = materialize(d.table.where("fold IS NOT NULL").select(F.col(d.id_col).alias("id"), "fold", "label", F.concat("num", own).alias("x")), "validation")
    repeats = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    order = lambda side: h("id", F.concat(F.lit(f"{side}{seed}_"), F.col("rep")))
    rank = lambda side: dist_rank(repeats.withColumn("_h", order(side)), ["_h", "id"], by=["fold", "rep"], rank_col="_r", uniform_max=TWO_POW_32).drop("_h")
    donor = rank("b").select(F.col("fold").alias("_f"), F.col("rep").alias("_p"), F.col("_r").alias("_q"), F.col("x").alias("d"))
    pairs = rank("a").join(donor, (F.col("fold") == F.col("_f")) & (F.col("rep") == F.col("_p")) & (F.col("_r") == F.col("_q")))
    names, models, wanted, impute = d.columns.names, cv.models, list(columns), d.columns.impute
    slots = [[j for j, n in enumerate(names) if n == c] for c in wanted]
    width, many = numeric + many_cats, n_repeats

    def inputs(batch: pa.RecordBatch, name: str, rows: np.ndarray, i: int) -> np.ndarray:
        """``Columns.matrix`` of model i, from the compact rows."""
        v = array_column(batch, name, width)[rows]
        missing = np.isnan(v[:, :numeric])
        return np.hstack([np.where(missing, impute[i], v[:, :numeric]), missing, v[:, numeric:]])

    def score(batch: pa.RecordBatch) -> list:
        fold, rep, y = (plain_column(batch, c) for c in ("fold", "rep", "label"))
        pieces = []
        for i in np.unique(fold).astype(int).tolist():
            for r in np.unique(rep[fold == i]).astype(int).tolist():
                mine = (fold == i) & (rep == r)
                x, donor = inputs(batch, "x", mine, i), inputs(batch, "d", mine, i)
                for c, own in enumerate(slots):
                    swapped = x.copy()
                    swapped[:, own] = donor[:, own]
                    pieces.append((c * many + r, i, clipped(models[i].proba(swapped)), y[mine]))
        return pieces

    as_they_are = repeats.select("id", "fold", "rep", "label", "x", F.col("x").alias("d"))
    aucs = packed_aucs(pairs.select("fold", "rep", "label", "x", "d"), score, as_they_are, rows.count(), "id").drop("several")
    base = cv.fold_metrics.where("fold >= 0").select("fold", F.col("auc").alias("_base"))
    drop = aucs.join(base, "fold").select("fold", F.floor(F.col("set") / many).cast("int").alias("_c"), (F.col("_base") - F.col("auc")).alias("_drop"))
    per_fold = drop.groupBy("fold", "_c").agg(F.avg("_drop").alias("_m")).groupBy("_c").agg(F.avg("_m").alias("importance"))
    label = F.get(F.array(*[F.lit(c) for c in wanted]), F.col("_c"))
    return materialize(per_fold.select(label.alias("feature"), "importance"), "importance")


def training_record(cv: CVResult, holdout: DataFrame, n_rows: int | DataFrame, k: int, iteration: int = 0,
                    feature_set_id: str = "") -> DataFrame:
    """ML5: one-row training metrics record."""
    fm = cv.fold_metrics
    val = fm.where(F.col("fold") == -1).select(F.col("auc").alias("auc_mean"), F.col("logloss").alias("logloss_mean"))
    std = fm.where(F.col("fold") == -2).select(F.col("auc").alias("auc_std"))
    tr = cv.train_metrics.where(F.col("fold") == -1).select(F.col("auc").alias("train_auc_mean"))
    ho = holdout.select(F.col("auc").alias("holdout_auc"))
    rec = val.crossJoin(std).crossJoin(tr).crossJoin(ho)  # 1-row frames
    rows = n_rows if isinstance(n_rows, DataFrame) else None
    rec = rec.withColumn("iteration", F.lit(iteration)).withColumn("feature_set_id", F.lit(feature_set_id))
    if rows is not None:
        rec = rec.crossJoin(rows.agg(F.count(F.lit(1)).alias("train_rows")))
        rec = rec.withColumn("val_rows", (F.col("train_rows") / k).cast("bigint"))
    return rec


def tree_shap_importance(cv: CVResult) -> DataFrame:
    """SHAP1 for tree models: mean |SHAP| per input feature over the validation rows, each row explained by the fold
    model that did not see it (exact path-dependent tree SHAP)."""
    from foldwise.operators.treeshap import mean_abs_shap
    names = cv.design.columns.names
    picked = {i: m.columns for i, m in cv.models.items()}
    first = next(iter(picked.values()))
    rows = validation_rows(cv).select("fold", F.col("x") if list(first) == list(range(len(names))) else F.array(*[F.get("x", F.lit(j)) for j in first]).alias("x"))
    return mean_abs_shap(rows, {i: m.trees for i, m in cv.models.items()}, {i: [names[j] for j in c] for i, c in picked.items()}, "fold", "x")
