"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bit_whiten, decontaminate, html_mincut, license_scan, lm_score, near_dedup, periodic_runs, phrase_automata, prefix_bpe, token_rollup, toxicity, url_filter, va_search
from foldwise.llm.common import id_remainder, shared_path, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.floor(v.cast("double") * 1024)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), whole.alias("vec"))
    return va_search.top_k(rows, rows.where("id % 100 = 0"), k=10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

URL_RULES = (url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"),
             url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/"))
#: Words in a host that the filter blocks where no rule fits.
BLOCKED_HOST_WORDS = ("adult", "casino", "free-bets", "pills", "spam", "ads-track")
BLOCK_GLOBS = tuple(g for w in BLOCKED_HOST_WORDS for g in (f"*{w}*", f"*{w}*/**"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCK_GLOBS)


_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
OP4_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE """ + " ".join(
    f"WHEN {_FITS.format(h=r.text.split('/')[0], p=r.text[len(r.text.split('/')[0]):])} THEN '{r.text}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.text))) + r""" END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE """ + " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in URL_RULES) + (
    " WHEN " + " OR ".join(f"contains(host, '{w}')" for w in BLOCKED_HOST_WORDS) + " THEN 'block' ELSE 'allow' END AS verdict FROM r")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_text(table(spark, sf_dir, "pages"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a load, a re-count of documents labelled low in quality by white space
    squeezed, a deletion of toxic ones, and each batch sent twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    store = token_rollup.TokenRollup(spark, shared_path(spark, "rollup"))
    versions = token_rollup.native_tokenizers()
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    whole = token_rollup.count_tokens(docs, versions)
    squeezed = token_rollup.count_tokens(docs.withColumn("text", F.regexp_replace("text", r"[ \t\n\r]+", " ")), versions)
    # counts meet the labels, not texts
    sent = (("load", whole.withColumn("op", F.lit("insert"))),
            ("squeeze", squeezed.join(marked.where("quality = 0"), "doc_id").withColumn("op", F.lit("revise"))),
            ("toxic", whole.join(marked.where("toxic = 1"), "doc_id").withColumn("op", F.lit("delete"))))
    for _ in range(2):
        for batch_id, changes in sent:
            store.commit(batch_id, changes)
    return store.totals()


OP7_SQL = r"""
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang, CASE WHEN m.quality = 0 THEN regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g') ELSE coalesce(text, '') END AS t
  FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id WHERE coalesce(m.toxic, 0) <> 1
), c AS (
  SELECT source, lang, 'words/1' AS tokenizer, len(regexp_extract_all(t, '[^ \t\n\r]+')) AS n FROM d
  UNION ALL SELECT source, lang, 'bytes/1', strlen(t) FROM d
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM c GROUP BY source, lang, tokenizer
"""

BASE_PHRASES = (license_scan.Template.phrase("cc-by", "cc by"), license_scan.Template.phrase("gpl", "general public license"),
                license_scan.Template.phrase("reserved", "all rights reserved"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), BASE_PHRASES)
    base = F.filter("spans", lambda s: s["phrase"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id")) != 1)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bit_whiten.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return bit_whiten.whitened_rows(rows, components=4).withColumn("vec_id", F.col("vec_id").cast("long"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_automata.remove_recurring(table(spark, sf_dir, "documents"))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), replant=periodic_runs.planted_tail)
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"), F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_near_dedup": op1_near_dedup, "op2_bpe": op2_bpe, "op3_va_topk": op3_va_topk, "op4_url_filter": op4_url_filter, "op5_toxicity": op5_toxicity,
            "op6_main_text": op6_main_text, "op7_token_rollup": op7_token_rollup, "op8_license_scan": op8_license_scan,
            "op9_decontaminate": op9_decontaminate, "op10_lm_score": op10_lm_score,
            "op11_whiten": op11_whiten, "op12_phrases": op12_phrases, "op13_runs": op13_runs}


def oracles() -> dict[str, str]:
    return {"op3_va_topk": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_token_rollup": OP7_SQL}
