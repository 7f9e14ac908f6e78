import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm.common import id_remainder
from foldwise.llm.toxicity import WORD, Restorer, count_trigrams, logistic, toxicity_scores

from .cases import documents, no_documents

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def restorer(spark):
    return Restorer(count_trigrams(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize(("hidden", "plain"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("l.o.s.e.r", "loser"), ("$tupid", "stupid"), ("c1own", "clown"),
                                               ("p@thet1c", "pathetic"), ("d!sgusting", "disgusting"), ("M0r0n", "moron")])
def test_hidden_words_are_restored(restorer, hidden, plain):
    assert restorer.restore(f"So {hidden} it is.") == f"so {plain} it is."


def test_plain_text_stays(restorer):
    for text in ("and the rest of it, or not.", "a a a a a a", "in 1984 and 2,000 more!", "", "été où ça", "que$$$ de%%%"):
        assert restorer.restore(text) == text


def test_words_are_those_of_the_restored_text(spark, restorer):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(1500).collect()]
    texts += ["a l_o_s_e_r", "m0$t id10t", "$tupid 1diot", "so i d ! o t", "mail me@x.org (now) a|b 5x", "aaargh 3rd x2y2z", "a.b.c.d"]
    for t in texts:
        assert restorer.words(t) == set(WORD.findall(restorer.restore(t))), t


def test_words_of_generated_spacings_and_signs():
    plain = Restorer(np.zeros((96, 96, 96)))
    for word in ("$hit", "b!tch", "loser", "1d!ot", "3rd+5", "aaa_!b", "cl0wn", "@ss", "x|y"):
        for apart in ("", " ", ".", "-", "_", "*"):
            for text in (apart.join(word), f"so {apart.join(word)}, he", f"{apart.join(word)}_", f"me {word}{apart}{word}"):
                assert plain.words(text) == set(WORD.findall(plain.restore(text))), text


def test_viterbi_finds_the_cheapest_path(restorer):
    import itertools

    def cost(outs, arcs):
        total, x, y = 0.0, 0, 0
        for out, options in zip(outs, arcs, strict=True):
            total += dict(options)[out]
            for c in out:
                from foldwise.llm.toxicity import NUMBER
                z = int(NUMBER[ord(c)]) if ord(c) < 0x250 else 0
                if z or y:
                    total += float(restorer.cost[x, y, z])
                    x, y = y, z
        return total

    for text in ("th1s", "l.o.s.e", "$h0t", "aaab", "1|!"):
        arcs = [*restorer.lattice(text), [(" ", 0.0)]]
        best = min(cost(outs, arcs) for outs in itertools.product(*[[o for o, _ in a] for a in arcs]))
        got = restorer.decode(text)
        assert any("".join(outs).strip() == got and math.isclose(cost(outs, arcs), best, rel_tol=1e-5) for outs in itertools.product(*[[o for o, _ in a] for a in arcs]))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where(id_remainder(F.col("doc_id")) == 0).select("score", "predicted", "toxic").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert np.mean([(b > np.array(good)).mean() + (b == np.array(good)).mean() / 2 for b in bad]) > 0.93
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(good)
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= 0.8 * len(bad)


def test_edge_cases(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (6, 0, 0), (8, 1, 0), (99, 1, 1)], LABELS)
    got = toxicity_scores(df, labels)
    assert got.count() == df.count() and got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> cast(score >= 0.5 AS int)").count() == 0
    assert {r["score"] for r in toxicity_scores(df, labels.limit(0)).collect()} == {0.5}
    assert toxicity_scores(no_documents(spark), labels).count() == 0
    assert toxicity_scores(df, labels.where("toxic = 1"))  .where("score > 0.5").count() == df.count()


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(id_remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in toxicity_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_logistic_separates():
    w, b = logistic([[0], [0, 1], [1], [], []] * 20, np.array([1.0, 1.0, 0.0, 0.0, 0.0] * 20), 2)
    assert w[0] + b > 0 > b and w[0] > abs(w[1])
