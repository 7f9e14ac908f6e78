import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm.bit_mix import GATES, MAP, RATE, SCALE, STEP, Cells, Code, Mixer, levels, odds, slots
from foldwise.llm.common import id_remainder
from foldwise.llm.lm_score import END, SlotCounts, before_each, blocks, lm_scores, spell, split, threes, word_contexts, words_of

from .cases import clash, documents, no_documents


def test_paths_are_a_prefix_code():
    code = Code([5, 1, 1, 9, 0, 2])
    assert abs(sum(2.0**-n for n in code.length) - 1) < 1e-12
    assert len({tuple(code.bit[s:s + n]) for s, n in zip(code.start, code.length, strict=True)}) == 6


def test_probabilities_sum_to_one_also_when_refined():
    rng = np.random.default_rng(1)
    code = Code([9, 5, 3, 2, 1, 1])
    counts = rng.integers(0, 9, (2, 1 << 10, 2))
    mixer = Mixer(code, counts, 10)
    start = rng.integers(0, 6, 700)  # more bits than one step, so that the weights have moved
    contexts = lambda s: [np.ones(len(s), np.uint32), np.concatenate([[0], s[:-1] + 1]).astype(np.uint32)]
    for refine in (False, True):
        before = mixer.log2(start, contexts(start), np.array([len(start)]), refine)[0]
        total = 0.0
        for x in range(6):
            s = np.append(start, x)
            total += 2 ** (mixer.log2(s, contexts(s), np.array([len(s)]), refine)[0] - before)
        assert abs(total - 1) < 1e-4


def test_slots_are_spread():
    at = np.repeat(np.arange(1000), 10)
    got = slots(np.arange(1000).astype(np.uint32), at, np.tile(np.arange(10, dtype=np.uint32), 1000), 20)
    assert len(set(got.tolist())) > 9900 and got.min() >= 0 and got.max() < 1 << 20


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    rows = [(1000 + i, " ".join(rng.choice(["the cat sat", "on a mat", "dogs bark", f"w{rng.randint(0, 50)}"]) for _ in range(40))) for i in range(150)]
    df = documents(spark).unionByName(clash(spark.createDataFrame(rows, "doc_id long, text string")), allowMissingColumns=True)
    return df.collect(), lm_scores(df, id_remainder(F.col("doc_id")) != 1).collect()


def test_base_by_brute_force(scored):
    rows, got = scored
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1 if i is not None else zlib.crc32(b"") % 5 != 1
    c = Counter()
    for r in rows:
        if train(r["doc_id"]):
            c.update([*words_of(r["text"] or ""), END])
    n, v = sum(c.values()), len(c)
    key = lambda i, b, k: (i is None, i, round(b, 6), k)
    want = sorted(key(r["doc_id"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), len(ws)) for r in rows for ws in [[*words_of(r["text"] or ""), END]])
    assert sorted(key(r["doc_id"], r["base_score"], r["n_tokens"]) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["train"] == train(r["doc_id"]) for r in got)


def test_model_beats_single_words(scored):
    _, got = scored
    held = [r for r in got if not r["train"] and r["doc_id"] and r["doc_id"] >= 1000]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_nothing_to_learn(spark):
    assert lm_scores(no_documents(spark), F.lit(True)).count() == 0
    got = lm_scores(documents(spark).where("doc_id = 8"), F.lit(False)).first()
    assert (got["train_tokens"], got["n_known"], got["base_score"]) == (0, 0, 0.0) and got["score"] < 0


def test_weights_are_fitted_on_all_counted_bits():
    rng = np.random.default_rng(2)
    code, bits = Code([40, 9, 5, 3, 2, 1, 1]), 12
    symbols = rng.choice(7, 30_000, p=[0.4, 0.2, 0.15, 0.1, 0.08, 0.05, 0.02])
    symbols[1::2] = symbols[::2]  # a symbol tells the next
    contexts = [np.ones(len(symbols), np.uint32), np.concatenate([[0], symbols[:-1] + 1]).astype(np.uint32)]
    at, node, bit, gate = code.expand(symbols)
    counts = np.zeros((2, 1 << bits, 2))
    for k, c in enumerate(contexts):
        np.add.at(counts[k], (slots(c, at, node, bits), bit.astype(int)), 1)
    table, means = levels(counts)
    cells = [Cells(code, table, bits) for _ in range(2)]  # two tasks, in blocks
    for i, part in enumerate(np.split(np.arange(len(symbols)), 6)):
        cells[i % 2].add(symbols[part], [c[part] for c in contexts])
    n = sum(c.n for c in cells)
    assert n.sum() == len(bit) and n[1::2].sum() == bit.sum()
    hit = np.flatnonzero(n)
    mixer = Mixer(code, counts, bits)
    mixer.fit(hit, n[hit], means)
    x = np.stack([odds(m[:, 1] - bit, m[:, 0] - (1 - bit)) for k, c in enumerate(contexts) for m in [counts[k][slots(c, at, node, bits)]]])
    want, here = np.full((GATES, 2), 0.5), np.maximum(np.bincount(gate, minlength=GATES), 1)
    for _ in range(60):
        error = bit - 1 / (1 + np.exp(-(x * want[gate].T).sum(0)))
        for k in range(2):
            want[:, k] += np.bincount(gate, error * x[k], GATES) / here / (np.bincount(gate, x[k] * x[k], GATES) / here + 0.1)
    loss = lambda w: np.logaddexp(0, (1 - 2 * bit) * (x * w[gate].T).sum(0)).mean()
    assert loss(mixer.weights) < 1.005 * loss(want) < 0.9 * loss(np.full((GATES, 2), 0.5) * [1, 0])


def test_fit_reads_every_training_row(spark, monkeypatch):
    rows = [(i, f"the cat sat on mat{i}") for i in range(1500)]  # more than the 200 texts once sampled
    seen, fit = [], Mixer.fit

    def spy(self, cells, n, means):
        seen.append(n.sum())
        fit(self, cells, n, means)

    monkeypatch.setattr(Mixer, "fit", spy)
    lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).count()
    words, spelling = seen
    assert words >= 1500 * 12  # six symbols of 2 bits at least each
    assert spelling >= (1500 + 5 - 1024) * 5  # words beyond the dictionary: five bytes and the end


def test_texts_are_split_twice(spark):
    """Counting, coding: later passes read written symbols."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame([(i, f"the cat sat on mat{i}") for i in range(60)], "doc_id long, text string").mapInPandas(seen, "doc_id long, text string")
    assert len(lm_scores(df, F.col("doc_id") % 2 == 0).collect()) == 60
    assert read.value == 2 * 60


def test_small_batches_go_together():
    rows = [b"w%d" % i for i in range(3000)]
    parts = lambda size: [x.column("token").to_pylist() for x in blocks(iter([pa.RecordBatch.from_pydict({"token": rows[i:i + 500]}) for i in range(0, 3000, 500)]), "token", size)]
    assert parts(1 << 20) == [rows]
    some = parts(2000)
    assert sum(some, []) == rows and all(1980 < sum(len(w) + 1 for w in x) <= 2000 for x in some[:-1])
    texts = ["", "a" * 50, "b", "c" * 70, "", "d"]  # longer ones alone
    got = [x.column("t").to_pylist() for x in blocks(iter([pa.RecordBatch.from_pydict({"t": texts}), pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]), "t", 10)]
    assert got == [[""], ["a" * 50], ["b"], ["c" * 70], ["", "d"]]


def test_split_as_bytes_do():
    texts = ["", " \n", "A bC  d\te\x0bf\x0cg\rh\x1ci\x1fj\x85k\u00a0l\u2003m", " Éa ÀB ", "x", "漢 😀\x00y", "\nz "]
    for own in (pa.array(texts), pa.array(["other words", *texts, "q"]).slice(1, len(texts)), pa.array(["a b", "c"]), pa.array([], pa.string())):
        words, n = split(own)
        want = [words_of(t) for t in own.to_pylist()]
        assert words.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]


def test_equal_threes_are_expanded_once():
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(-1, 6, k), 4).astype(np.int32) for k in (0, 1, 2, 300, 40)] * 6
    batches = lambda: iter([pa.RecordBatch.from_pydict({"numbers": pa.array([t.tobytes() for t in texts[i:i + 7]], pa.binary())}) for i in range(0, len(texts), 7)])
    code, bits = Code([50, 30, 20, 9, 3, 1]), 10
    flat, starts = np.concatenate(texts), np.cumsum([0, *(len(t) for t in texts)])[:-1]
    table, _ = levels(rng.integers(0, 9, (4, 1 << bits, 2)))
    for unused in ([], [2000]):  # keys of 32 and of 64 bits
        symbol = np.array([0, 1, 2, 3, 4, 5, *unused, 5])  # -1 and 5 are escapes
        symbols = symbol[flat]
        plain, once = [SlotCounts(code, 4, bits), Cells(code, table, bits)], [SlotCounts(code, 4, bits), Cells(code, table, bits)]
        total = expanded = 0
        for last, own, times in threes(batches(), symbol):
            total, expanded = total + times.sum(), expanded + len(last)
            for x in once:
                x.add(last, own, times)
        for x in plain:
            x.add(symbols, word_contexts(*before_each(symbols, starts)))
        want = Counter((a, b, c) for t in (symbol[t].tolist() for t in texts) for a, b, c in zip([-1, -1, *t], [-1, *t], t))  # noqa: B905
        assert total == len(flat) and expanded == len(want)
        assert (once[0].counts == plain[0].counts).all() and (once[1].n == plain[1].n).all()


def test_scores_by_plain_loops():
    rng = np.random.default_rng(6)
    code, bits = Code([40, 20, 9, 5, 3, 2, 1, 1]), 8
    mixer = Mixer(code, rng.integers(0, 30, (4, 1 << bits, 2)), bits)
    mixer.weights = rng.uniform(0, 0.6, mixer.weights.shape).astype(np.float32)
    mixer.map = (mixer.map + rng.uniform(-0.3, 0.3, mixer.map.shape)).astype(np.float32)
    lengths = [900, 1, 0, 300, 450]  # several steps, one step, none
    symbols, ends = rng.integers(0, 8, sum(lengths)), np.cumsum(lengths)
    contexts = word_contexts(*before_each(symbols, (ends - lengths)[np.array(lengths) > 0]))
    for refine in (False, True):
        want = []
        for end, n in zip(ends, lengths, strict=True):
            own, total, bit_no, moved, hits = mixer.weights.astype(float) / SCALE, 0.0, 0, np.zeros((GATES, 4)), np.zeros(GATES)
            for i in range(end - n, end):
                for j in range(code.start[symbols[i]], code.start[symbols[i]] + code.length[symbols[i]]):
                    if refine and bit_no and bit_no % STEP == 0:
                        own, moved, hits = own + moved * (RATE / SCALE**2 / (hits + 32))[:, None], np.zeros((GATES, 4)), np.zeros(GATES)
                    g, bit = code.gate[j], int(code.bit[j])
                    x = np.array([mixer.tables[k][slots(c[i:i + 1], np.array([0]), code.node[j:j + 1], bits)[0]] for k, c in enumerate(contexts)], float)
                    z = float(x @ own[g])
                    z = min(max(z, -30), 30) if refine else z
                    near = int(np.rint(min(max(z, -8), 8) * (MAP - 1) / 16)) + (MAP - 1) // 2
                    p = 1 / (1 + math.exp(-(z + mixer.map[g][near]) / 2))
                    total += math.log2(p if bit else 1 - p)
                    moved[g] += x * (bit - 1 / (1 + math.exp(-z)))
                    hits[g] += 1
                    bit_no += 1
            want.append(total)
        assert np.allclose(mixer.log2(symbols, contexts, ends, refine), want, rtol=2e-3, atol=1e-4)


def test_spelling_contexts_are_of_the_word_alone():
    words = [b"a", b"abc", b"abcd", b"x" * 300, b"abd"]
    data, contexts, ends = spell(words)
    assert data.tobytes() == np.frombuffer(b"".join(w + END for w in words), np.uint8).astype(np.int64).tobytes() and ends.tolist() == np.cumsum([len(w) + 1 for w in words]).tolist()
    for w, end in zip(words, ends, strict=True):
        _, own, _ = spell([w])
        assert all((c[end - len(w) - 1:end] == o).all() for c, o in zip(contexts, own, strict=True))
    prefix = contexts[3]
    assert prefix[2 + 3] == prefix[2 + 4 + 3] and len(set(prefix[2:6].tolist())) == 4  # of abc and abcd
    assert len(spell([])[0]) == 0
