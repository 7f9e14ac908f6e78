"""Reusable DuckDB SQL fragments for the oracle statements."""

from __future__ import annotations

from foldwise.plans.inputs import BASE_SQL, EV_SQL


def with_base(*ctes: str) -> str:
    parts = [BASE_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)


def with_ev(*ctes: str) -> str:
    parts = [EV_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)


def with_both(*ctes: str) -> str:
    parts = [BASE_SQL.strip(), EV_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)


def auc_ctes(name: str, rel: str, score: str, y: str, by: list[str] | None = None) -> str:
    """CTEs ``{name}_h`` (histogram), ``{name}_c`` (running sums) and ``{name}`` with
    columns by..., P, N, nd, auc, pr_auc, ks (brute-force-equivalent tie handling)."""
    by = by or []
    b = ", ".join(by)
    bsel = (b + ", ") if by else ""
    part = f"PARTITION BY {b} " if by else ""
    grp = f"GROUP BY {b}" if by else ""
    return f"""
{name}_h AS (
  SELECT {bsel}CAST({score} AS DOUBLE) AS s, sum(CAST({y} AS BIGINT)) AS pos, sum(1 - CAST({y} AS BIGINT)) AS neg
  FROM {rel} WHERE {score} IS NOT NULL AND {y} IS NOT NULL
  GROUP BY {bsel}CAST({score} AS DOUBLE)
),
{name}_c AS (
  SELECT {bsel}s, pos, neg,
         sum(pos) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
         sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
         sum(pos) OVER ({part.strip()}) AS P, sum(neg) OVER ({part.strip()}) AS N
  FROM {name}_h
),
{name} AS (
  SELECT {bsel}max(P) AS P, max(N) AS N, count(*) AS nd,
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN
           sum(pos * ((cn - neg) + neg / 2.0)) / (max(P)::DOUBLE * max(N)) END AS auc,
         CASE WHEN max(P) > 0 THEN
           sum(CASE WHEN pos > 0 THEN (pos / P::DOUBLE) * ((P - (cp - pos)) / ((P - (cp - pos)) + (N - (cn - neg)))::DOUBLE) ELSE 0 END) END AS pr_auc,
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN max(abs(cp / P::DOUBLE - cn / N::DOUBLE)) ELSE 0.0 END AS ks
  FROM {name}_c {grp}
)"""


def probs_sql(bins: int) -> str:
    import numpy as np
    return "[" + ", ".join(f"{float(p)!r}::DOUBLE" for p in np.linspace(0.0, 1.0, bins + 1)) + "]"


def edges_cte(name: str, rel: str, value: str, bins: int = 10, by: list[str] | None = None) -> str:
    """CTE ``{name}`` with by..., edges (open ends), inner, n_bins from reference rows."""
    by = by or []
    bsel = "".join(f"{b}, " for b in by)
    grp = ("GROUP BY " + ", ".join(by)) if by else ""
    return f"""
{name}_u AS (
  SELECT {bsel}list_sort(list_distinct(quantile_cont({value}, {probs_sql(bins)}))) AS u0, min({value}) AS lo
  FROM {rel} WHERE {value} IS NOT NULL {grp}),
{name}_v AS (
  SELECT {bsel}CASE WHEN len(u0) < 2 THEN [lo - 1e-9, lo + 1e-9] ELSE u0 END AS u FROM {name}_u),
{name} AS (
  SELECT {bsel}list_slice(u, 2, len(u) - 1) AS inner_e, len(u) - 1 AS n_bins,
         list_concat(['-inf'::DOUBLE], list_slice(u, 2, len(u) - 1), ['inf'::DOUBLE]) AS edges
  FROM {name}_v)"""


def psi_sql(rel: str, keys: list[str]) -> str:
    """SELECT keys..., psi FROM rel(keys..., bin, ref_n, cur_n) over a complete grid."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    ksel = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""SELECT {ksel}sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))) AS psi
FROM (SELECT *, ref_n / greatest(sum(ref_n) OVER ({part}), 1)::DOUBLE AS e,
              cur_n / greatest(sum(cur_n) OVER ({part}), 1)::DOUBLE AS a FROM {rel}) {grp}"""


CLASSIFY = "CASE WHEN {v} < 0.1 THEN 'stable' WHEN {v} < 0.25 THEN 'watch' ELSE 'unstable' END"
