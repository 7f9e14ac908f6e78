import re
from collections import defaultdict

import pytest

from foldwise.llm.decontaminate import contaminated

from .cases import clash, documents, no_documents

ITEM = "Now, Tom has 12 apples and she gives 3 apples to Rob, then Tom buys 7 km of rope. How many apples has Tom left after that day?"
BENCHMARK = "item_id long, text string"


def doc(tom, rob, n, unit, before="We know that"):
    return f"{before} {tom} has {n} apples and she gives 3 apples to {rob}, then {tom} buys 7 {unit} of rope. How many apples has {tom} left after that day?"


@pytest.fixture(scope="module")
def benchmark(spark):
    return clash(spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "a b"), (10, "Once upon time it was"), (11, ""), (None, ITEM)], BENCHMARK))


def test_copies_and_other_values(spark, benchmark):
    rows = [(100, doc("Tom", "Rob", 12, "km")), (101, doc("Anna", "Bob", 99, "miles")), (102, "x " * 3000 + ITEM.upper().lower()), (103, "And once upon time it was so"),
            (104, "Once upon a time it was"), (105, ITEM + "\n" + doc("Zoe", "Max", 5, "cm")), (None, ITEM)]
    df = documents(spark).unionByName(clash(spark.createDataFrame(rows, "doc_id long, text string")), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(df, benchmark).collect()}
    assert got.pop((105, 7)) is not None
    assert got == {(100, 7): "copy", (102, 7): "copy", (101, 7): "re-parameterised", (103, 10): "copy"}


def test_contradicting_values(spark, benchmark):
    """They don't make a question of the template, but words equal to the item's count: a near copy with three names in place of one is held."""
    text = "We know that Carl has 12 apples and she gives 3 apples to Dora, then Ernst buys 7 km of rope. How many apples has Fred left after that day?"
    assert [r["item_id"] for r in contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), benchmark).collect()] == [7]
    other = "Tom saw 3 red cars near Tom before 3 old men met Tom with 3 dogs by Tom at 3 big farms"
    names, numbers = iter(["Ann", "Bea", "Cyd", "Dot"]), iter("4567")
    text = re.sub("Tom", lambda _: next(names), re.sub("3", lambda _: next(numbers), other))
    items = spark.createDataFrame([(1, other)], BENCHMARK)
    assert contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).count() == 0
    assert contaminated(spark.createDataFrame([(1, other.replace("Tom", "Ann").replace("3", "4"))], "doc_id long, text string"), items).count() == 1


def test_names_anywhere(spark):
    """At the beginning of a sentence, in capitals, with apostrophes and hyphens."""
    word = "Tom has 12 apples. Tom gives 3 apples to Rob and keeps what is left. Rob eats 2 of these. How many apples do both have?"
    space = "NASA sent 4 probes to Mars and O'Brien saw 2 of them land near Ann-Marie with the camera of NASA."
    rows = [(1, word.replace("Tom", "Zoe").replace("Rob", "Mary Ann").replace("12", "40").replace("3", "7").replace("2 of", "5 of")),
            (2, space.replace("NASA", "ESA").replace("O'Brien", "Smith").replace("Ann-Marie", "D\u2019Arc").replace("4", "9").replace("Mars", "Venus")),
            (3, space.upper()), (4, "Tom and Rob have many apples. NASA has none.")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, word), (2, space)], BENCHMARK)).collect()}
    assert got == {(1, 1): "re-parameterised", (2, 2): "re-parameterised", (3, 2): "copy"}


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    import foldwise.llm.decontaminate as D

    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, contaminated(docs, items).collect()))
    monkeypatch.setattr(D.matches, "__defaults__", (0,))
    assert sorted(map(tuple, contaminated(docs, items).collect())) == one


def test_equals_brute_force_on_plain_words(spark):
    """The tables hold no placeholders inside benchmark items, so runs of equal words decide."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect() for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"\w+", t.lower())
    index = defaultdict(set)
    length = {}
    for r in items:
        w = words(r["text"])
        length[r["item_id"]] = len(w)
        for i in range(len(w) - 7):
            index[tuple(w[i:i + 8])].add((r["item_id"], i))
    want = set()
    for r in docs:
        w, hit = words(r["text"] or ""), defaultdict(set)
        for i in range(len(w) - 7):
            for item, at in index.get(tuple(w[i:i + 8]), ()):
                hit[item].update(range(at, at + 8))
        want |= {(r["doc_id"], item) for item, at in hit.items() if len(at) >= 0.5 * length[item]}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))).collect()}
    assert got == want and want


def test_empty_tables(spark, benchmark):
    assert contaminated(no_documents(spark), benchmark).count() == 0
    assert contaminated(documents(spark), benchmark.limit(0)).count() == 0


PARIS = "She left Paris with 12 coins, went on to Rome with 30 coins, saw Paris again with 12 coins and then met Carl near Rome."
APPLES = "He said that Tom had 5 apples in his bag and gave 3 of them away, how many are left?"
CAPITAL = "What Is The Capital City Of The United Kingdom Of Great Britain"
SUMS = "If 3 + 4 = 7 and 5 + 6 = 11 then 8 + 9 = 17"
LAYOUT = "Then Lea has 12 marbles. With 7 of these Lea pays Otto."


def test_every_window_that_fits_counts(spark):
    """Item 1: one of two like values changed drops its windows alone. 2: two values may get one. 3 to 5: copies
    of items dense in values. 6: layout, case, longer numbers and names."""
    items = spark.createDataFrame(list(enumerate([PARIS, APPLES, CAPITAL, SUMS, "who is John Smith", LAYOUT], 1)), BENCHMARK)
    rows = [(1, PARIS.replace("saw Paris", "saw London")), (2, APPLES.replace("5", "4").replace("3", "4")), (3, f"so. {CAPITAL}"), (4, f"so. {SUMS}"), (5, "who is John Smith"),
            (61, "So. " + LAYOUT.replace("Then Lea", "Then\nLea").replace(" ", "  ")), (62, LAYOUT.lower()), (63, LAYOUT.replace("12", "1,250").replace("7", "2.5")), (64, LAYOUT.replace("Lea", "Mary Ann")),
            (7, "nothing of it here, or of anybody else"), (8, "who is Mary Jones")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    new = "re-parameterised"
    assert got == {(1, 1): "copy", (2, 2): new, (3, 3): "copy", (4, 4): "copy", (5, 5): "copy", (61, 6): "copy", (62, 6): "copy", (63, 6): new, (64, 6): new}
