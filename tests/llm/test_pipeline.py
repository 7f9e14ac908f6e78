import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from foldwise.llm import decontaminate, prefix_bpe, toxicity

from .cases import documents, no_documents
from .test_near_dedup import groups

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """Groups by all pairs and ids by the library; the first and third stage by the operators' rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    classes = groups(list(left.items()))
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {i for i, c in classes.items() if i == c and i not in leaks}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == want and len(want) < len(texts)
    for i, r in got.items():
        assert r["ids"] == library.encode_ordinary(texts[i]) and r["round_trip"]
        assert r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_edge_cases(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = documents(spark)
    got = run(spark, docs, SF)
    ids = sorted(r["doc_id"] or 0 for r in got.collect())
    everything = [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    if name == "near_dedup":
        assert ids == [0, 0, 1, 3, 4, 5, 6, 7, 8]
    else:
        assert ids == everything
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns
    assert run(spark, no_documents(spark), SF).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
