from foldwise.functions.hashing import h, h_duckdb, uniform, TWO_POW_32
from foldwise.functions.scalar import (
    ISCLOSE_ATOL, ISCLOSE_RTOL, LEAK_AUC_THRESHOLD, MISSING_CATEGORY, PROBA_EPS, PSI_EPSILON,
    PSI_STABLE, PSI_UNSTABLE, classify_psi, clip_proba, days_between, fmt_number, isclose,
    left_closed_bin, missing_category, nan_to_null, psi_term, right_closed_bin, safe_name,
)

__all__ = [
    "h", "h_duckdb", "uniform", "TWO_POW_32", "ISCLOSE_ATOL", "ISCLOSE_RTOL",
    "LEAK_AUC_THRESHOLD", "MISSING_CATEGORY", "PROBA_EPS", "PSI_EPSILON", "PSI_STABLE",
    "PSI_UNSTABLE", "classify_psi", "clip_proba", "days_between", "fmt_number", "isclose",
    "left_closed_bin", "missing_category", "nan_to_null", "psi_term", "right_closed_bin",
    "safe_name",
]
