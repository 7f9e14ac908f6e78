"""Delta-maintained token counts.

A store holds one folder for each committed batch: its signed rows (doc_id, source, lang, tokenizer,
docs, tokens) and their sums by (source, lang, tokenizer). An insert adds a row, a delete adds the
negated row, a revision adds both; so totals are sums of the batches' sums, and a document's current
row is the sum of its signed rows. A batch is written under a hidden name and then renamed to
``batch=<id>``, which the store does at once or not at all; a batch id that is there already is left
as it is, so a batch may be sent again any number of times. Executors lost in between leave only a
hidden folder, which readers pass over.

Edge cases: null source or lang is a group of its own; null texts count as empty; several changes to
one (doc_id, tokenizer) in one batch: the last by ``seq`` counts, ties by the larger count; deletes of
absent documents and repeated rows change nothing; an empty batch commits nothing but its id; a row
whose doc_id or tokenizer is null is refused (``refused`` of the commit report counts them).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import hadoop_path

KEYS = ["source", "lang", "tokenizer"]
ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"

def native_tokenizers() -> dict[str, Column]:
    """Counts by built-in functions: white-space words, and UTF-8 bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"words/1": F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long"), "bytes/1": F.octet_length(text).cast("long")}


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, Column]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens), a row for each document and tokenizer version."""
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count.alias("tokens")) for name, count in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.inline(pairs))


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def batches(self) -> list[str]:
        fs, p = hadoop_path(self.spark, self.path)
        return sorted(s.getPath().getName()[len("batch="):] for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")) if fs.exists(p) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/batch={b}/{kind}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """(doc_id, source, lang, tokenizer, tokens) of the documents that are there now."""
        return (self._read("rows", ROWS).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs > 0").drop("docs"))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), from the batches' sums alone."""
        return self._read("sums", SUMS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")

    def commit(self, batch_id: str, changes: DataFrame) -> dict:
        """Apply ``changes`` (op: insert, revise or delete; doc_id, source, lang, tokenizer, tokens, and
        optionally seq). Insert and revise set the document's row, delete takes it away. Returns
        {"applied": False} if the batch is there already."""
        final = f"{self.path}/batch={batch_id}"
        if self._exists(final):
            return {"applied": False, "refused": 0}
        if "seq" not in changes.columns:
            changes = changes.withColumn("seq", F.lit(0))
        whole = changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
        last = whole.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.desc("seq"), F.desc("tokens"), F.desc("op"), F.desc("source"), F.desc("lang")))).where("n = 1")
        new = last.select("doc_id", *KEYS, F.when(F.col("op") == "delete", 0).otherwise(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        if self.batches():
            old = self.current().join(last.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            old = old.select("doc_id", *KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))
            signed = old.unionByName(new.where("docs = 1"))
        else:
            signed = new.where("docs = 1")
        hidden = f"{self.path}/_writing-{batch_id}-{self.spark.sparkContext.applicationId}"
        signed.write.mode("overwrite").parquet(f"{hidden}/rows")
        rows = self.spark.read.schema(ROWS).parquet(f"{hidden}/rows")
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{hidden}/sums")
        refused = changes.where("doc_id IS NULL OR tokenizer IS NULL OR op IS NULL OR op NOT IN ('insert', 'revise', 'delete')").count()
        fs, source = hadoop_path(self.spark, hidden)
        if self._exists(final) or not fs.rename(source, hadoop_path(self.spark, final)[1]):
            fs.delete(source, True)
            return {"applied": False, "refused": refused}
        return {"applied": True, "refused": refused}
