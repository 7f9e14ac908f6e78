"""Row-level Column helpers (FN1-FN10). All are built-in expressions, so they stay
inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that results depend on.
# Probability clip applied before every score metric.
PROBA_EPS = 1e-7
# Floor for bin proportions in the stability index; proportions are not renormalised.
PSI_EPSILON = 1e-4
# Stability classes: below 0.1 stable, below 0.25 watch, otherwise unstable.
PSI_STABLE = 0.1
PSI_UNSTABLE = 0.25
# Tolerances of the online/offline value comparison.
ISCLOSE_RTOL = 1e-9
ISCLOSE_ATOL = 1e-12
# Placeholder category for missing categorical values.
MISSING_CATEGORY = "__missing__"
# Single-feature AUC at or above this marks a feature as a possible leak.
LEAK_AUC_THRESHOLD = 0.90
# Characters outside this class are replaced by "_" in stored names.
UNSAFE_NAME_PATTERN = r"[^A-Za-z0-9_.-]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_proba(p: Column | str) -> Column:
    """Clip probabilities to [1e-7, 1 - 1e-7] (Q7)."""
    return F.least(F.greatest(col(p).cast("double"), F.lit(PROBA_EPS)), F.lit(1.0 - PROBA_EPS))


def nan_to_null(c: Column | str) -> Column:
    """NaN is a value in Spark; the library treats it as missing (T4)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def known(df: DataFrame, name: str) -> Column:
    """Column ``name`` with NaN as null, whatever its type; operators read their inputs through it, so
    that missing means the same everywhere."""
    return nan_to_null(name) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.col(name)


def same_value(df: DataFrame, a: str, b: str) -> Column:
    """FN3 on two columns of ``df``: numbers by ``isclose``, all else by equality; missing equals missing."""
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in (a, b))
    x, y = known(df, a), known(df, b)
    return isclose(x.cast("double"), y.cast("double")) if numeric else x.cast("string").eqNullSafe(y.cast("string"))


def isclose(a: Column | str, b: Column | str, rtol: float = ISCLOSE_RTOL,
            atol: float = ISCLOSE_ATOL) -> Column:
    """numpy-style ``isclose`` with null == null (FN3): equal, or |a-b| <= atol + rtol*|b| with both
    finite (so an infinity is close to itself alone)."""
    a, b = col(a), col(b)
    finite = (F.abs(a) < F.lit(float("inf"))) & (F.abs(b) < F.lit(float("inf")))
    close = finite & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return a.eqNullSafe(b) | F.coalesce(close, F.lit(False))


def safe_name(c: Column | str) -> Column:
    """Replace characters unsafe in paths by ``_`` (FN4, feature store names)."""
    return F.regexp_replace(col(c), UNSAFE_NAME_PATTERN, "_")


def missing_category(c: Column | str, df: DataFrame | None = None) -> Column:
    """Categorical preparation (PRJ8): text cast, null -> ``__missing__``; NaN too, if ``c`` names a column
    of ``df``."""
    c = known(df, c) if df is not None and isinstance(c, str) else col(c)
    return F.coalesce(c.cast("string"), F.lit(MISSING_CATEGORY))


def classify_psi(v: Column | str) -> Column:
    """stable / watch / unstable (STB6); null where there is no value."""
    v = col(v)
    return (F.when(v < F.lit(PSI_STABLE), F.lit("stable"))
            .when(v < F.lit(PSI_UNSTABLE), F.lit("watch"))
            .when(v.isNotNull(), F.lit("unstable")))


def psi_term(expected_pct: Column | str, actual_pct: Column | str) -> Column:
    """One bin's contribution (a - e) * ln(a / e) with both floored at 1e-4 (STB3)."""
    e = F.greatest(col(expected_pct).cast("double"), F.lit(PSI_EPSILON))
    a = F.greatest(col(actual_pct).cast("double"), F.lit(PSI_EPSILON))
    return (a - e) * F.ln(a / e)


def fmt_number(c: Column | str, digits: int = 4) -> Column:
    """Fixed decimals, ``n/a`` for null (FN5)."""
    c = col(c)
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", c))


def left_closed_bin(x: Column | str, inner_edges: Column) -> Column:
    """Bin index on edges with open outer ends, bins [a, b) (numpy histogram): the
    number of inner edges <= x."""
    x = col(x)
    return F.size(F.filter(inner_edges, lambda e: e <= x))


def right_closed_bin(x: Column | str, inner_edges: Column) -> Column:
    """Bin index with bins (a, b] (pandas cut): the number of inner edges < x."""
    x = col(x)
    return F.size(F.filter(inner_edges, lambda e: e < x))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact difference of two timestamps in days (FN10)."""
    return (F.unix_micros(col(later).cast("timestamp")) -
            F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(86400e6)
