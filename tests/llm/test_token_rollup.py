import random
from collections import defaultdict

from pyspark.sql import functions as F

from foldwise.llm.common import shared_path
from foldwise.llm.token_rollup import TokenRollup, count_tokens, native_tokenizers

from .cases import documents, no_documents

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, seq int"


def test_batches_equal_a_recount(spark):
    rng, now, store = random.Random(7), {}, TokenRollup(spark, shared_path(spark, "t"))
    for batch in range(4):
        rows = [(rng.choice(["insert", "revise", "delete"]), rng.randint(1, 12), rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.randint(0, 9), n) for n in range(20)]
        df = spark.createDataFrame(rows, CHANGES)
        assert store.commit(f"b{batch}", df)["applied"]
        assert not store.commit(f"b{batch}", df)["applied"]  # sent again
        for op, doc, source, lang, tok, n, _ in rows:
            now.pop((doc, tok), None)
            if op != "delete":
                now[doc, tok] = (source, lang, n)
        want = defaultdict(lambda: [0, 0])
        for (_, tok), (source, lang, n) in now.items():
            want[source, lang, tok][0] += 1
            want[source, lang, tok][1] += n
        assert {tuple(r)[:3]: list(r)[3:] for r in store.totals().collect()} == dict(want)
        assert {(r["doc_id"], r["tokenizer"]): (r["source"], r["lang"], r["tokens"]) for r in store.current().collect()} == now
    assert store.batches() == ["b0", "b1", "b2", "b3"]


def test_refused_and_empty(spark):
    store = TokenRollup(spark, shared_path(spark, "t"))
    assert store.totals().count() == 0
    df = spark.createDataFrame([("insert", None, "s", "en", "v1", 3, 0), ("erase", 1, "s", "en", "v1", 3, 0), ("delete", 2, "s", "en", "v1", 3, 0)], CHANGES)
    assert store.commit("a", df) == {"applied": True, "refused": 2}
    assert store.commit("b", df.limit(0)) == {"applied": True, "refused": 0}
    assert store.totals().count() == 0


def test_counts(spark):
    got = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in count_tokens(documents(spark), native_tokenizers()).collect()}
    assert (got[1, "words/1"], got[3, "words/1"], got[5, "words/1"], got[6, "words/1"], got[7, "bytes/1"]) == (7, 0, 0, 56000, 13)
    store = TokenRollup(spark, shared_path(spark, "t"))
    assert store.commit("load", count_tokens(documents(spark), native_tokenizers()).withColumn("op", F.lit("insert")))["refused"] == 4
    assert sum(r["docs"] for r in store.totals().collect()) == 16  # eight ids, two versions; the repeated row counts once
    assert count_tokens(no_documents(spark), native_tokenizers()).count() == 0
