import random
import re

from foldwise.llm.license_scan import NOTICES, RareTokenIndex, Template, scan_licenses, words_of
from foldwise.llm.queries import BASE_PHRASES

from .cases import clash, documents, no_documents


def test_words():
    assert words_of("All RIGHTS-reserved, 2É é_x") == [b"all", b"rights", b"reserved", b"2" + "É".encode(), "é".encode(), b"x"]


def test_every_place_of_a_phrase_whatever_the_frequencies():
    rng = random.Random(9)
    vocabulary = [w for t in BASE_PHRASES for w in words_of(t.text)] + [b"x"]
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        index = RareTokenIndex(BASE_PHRASES, {w: rng.randint(0, 9) for w in vocabulary}, 10)
        want = sorted((n, i, i + len(k)) for n, t in enumerate(BASE_PHRASES) for k in [words_of(t.text)] for i in range(len(words)) if words[i:i + len(k)] == k)
        assert sorted((n, s, e) for n, s, e, _ in index.scan(words)) == want


def test_documents(spark):
    rows = [(100, "Licensed under the Apache License, Version 2.0."), (101, "Released under the MIT License."), (102, "Licensed under CC BY-NC 4.0, cc by. All Rights Reserved"),
            (103, "the GNU General Public License, version 3"), (104, "mit and license apart"), (105, "general public\nlicense general public license")]
    df = documents(spark).unionByName(clash(spark.createDataFrame(rows, "doc_id long, text string")), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in scan_licenses(df, BASE_PHRASES).collect()}
    labels = lambda i: sorted({s["label"] for s in got[i]["spans"]})
    assert [labels(i) for i in range(100, 106)] == [["apache-2.0"], ["mit"], ["cc-by", "cc-by-nc", "reserved"], ["gpl", "gpl-3.0"], [], ["gpl"]]
    assert [s["start"] for s in got[105]["spans"]] == [0, 3] and got[105]["score"] == 1.0
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[3]["score"] == 0.0 and got[6]["n_words"] == 56000
    assert scan_licenses(no_documents(spark), BASE_PHRASES).count() == 0


def test_keys_stand_in_their_templates():
    for t in NOTICES:
        assert re.search(rf"\b{t.key}\b", t.text)
    assert RareTokenIndex([Template("a", "p q r", "q r", 0.1)], {}, 0).keys == [(1, (b"q", b"r"))]
