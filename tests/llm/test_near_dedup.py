import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from foldwise.llm.components import connected_components
from foldwise.llm.near_dedup import Words, near_duplicates, shingles, similarity, sketch, word_hashes

from .cases import documents, no_documents


def plain_similarity(a, b):
    x, y = ({int(e): int(w) for e, w in zip(*s, strict=True)} for s in (a, b))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def groups(rows, least=0.8):
    """class of each (id, text) by all pairs."""
    known, bags, first, parent = Words(), {}, {}, {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, text in sorted(rows):
        words, parent[i] = word_hashes(text or "", known), i
        if len(words):
            j = first.setdefault(words.tobytes(), i)
            parent[i] = j
            if i == j:
                bags[i] = shingles(words)
    holders = defaultdict(list)
    for i, (e, _) in bags.items():
        for x in e.tolist():
            holders[x].append(i)
    for a, b in {p for ids in holders.values() for p in combinations(ids, 2)}:
        if root(a) != root(b) and similarity(bags[a], bags[b]) >= least - 1e-12:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def test_similarity_equals_its_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ((np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64)) for _ in range(2))
        x, y = (a, rng.integers(1, 5, len(a)).astype(float)), (b, rng.integers(1, 5, len(b)).astype(float))
        assert similarity(x, y) == pytest.approx(plain_similarity(x, y), abs=1e-9)


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(2)
    for _ in range(4):
        a, b = ((np.unique(rng.integers(0, 60, 40)).astype(np.uint64)) for _ in range(2))
        x, y = (a, rng.integers(1, 4, len(a)).astype(float)), (b, rng.integers(1, 4, len(b)).astype(float))
        doc = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
        got = sketch(doc, np.concatenate([a, b]), np.concatenate([x[1], y[1]]), 2, 4096)
        assert (got[0] == got[1]).mean() == pytest.approx(similarity(x, y), abs=0.05)


def test_sketch_does_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    bags = [(np.unique(rng.integers(0, 1 << 60, n)).astype(np.uint64)) for n in (1, 5, 300)]
    doc = np.repeat(np.arange(3), [len(b) for b in bags])
    together = sketch(doc, np.concatenate(bags), np.ones(len(doc)), 3)
    for i, b in enumerate(bags):
        assert (sketch(np.zeros(len(b), int), b, np.ones(len(b)), 1)[0] == together[i]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_groups_equal_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == groups([(r["doc_id"], r["text"]) for r in df.collect()])


def test_a_large_group_of_near_copies(spark):
    """Copies of one text with words changed, from slightly to beyond the limit, and copies of copies."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(130)]
    rows = []
    for i in range(400):
        words = list(rows[rng.randrange(len(rows))][1].split()) if rows and rng.random() < 0.3 else list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((i + 1, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_edge_cases(spark):
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["copies"]) for r in near_duplicates(documents(spark)).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1), (8, 8, 1)]
    assert near_duplicates(no_documents(spark)).count() == 0
