import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from foldwise.llm.prefix_bpe import Codec, PrefixTable, Vocabulary, encode_documents, load_ranks

from .cases import documents, no_documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(load_ranks(PATH))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_equals_the_library(vocabulary, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeiou 'stre\n\t0123éßñ漢😀!?.\u00a0\u2028") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 3000, "<|endoftext|>", "'s't"]
    codec = Codec(vocabulary, P.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == " ".join(map(str, library.encode_ordinary(text))), repr(text)
        assert codec.decode(ids) == text.encode()


def test_appends_and_edits_equal_a_new_encoding(vocabulary, library):
    rng = random.Random(2)
    some = lambda n: bytes(rng.choice(b"aeioutnsr   th") for _ in range(rng.randint(0, n)))
    for _ in range(60):
        table = PrefixTable(vocabulary, some(500))
        for _ in range(5):
            at = rng.randint(0, len(table.data))
            table.replace(at, min(len(table.data), at + rng.randint(0, 6)), some(6))
            table.append(some(4))
            assert table.last == PrefixTable(vocabulary, table.data).last
        assert table.ids() == library._core_bpe.encode_single_piece(table.data)
        cut = rng.randint(0, len(table.data))
        assert table.ids(cut) == (library._core_bpe.encode_single_piece(table.data[:cut]) if cut else [])


def test_edit_recomputes_little(vocabulary):
    table = PrefixTable(vocabulary, b"the thing and the other thing " * 200)
    assert table.replace(3000, 3001, b"x") < 600


def test_documents(spark, library):
    df = documents(spark)
    got = encode_documents(df, PATH, P.PATTERN).collect()
    assert len(got) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"]}
    for r in got:
        if r["doc_id"]:
            ids = library.encode_ordinary(texts[r["doc_id"]])
            assert (r["n_tokens"], r["ids"], r["round_trip"]) == (len(ids), ids, True)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert encode_documents(no_documents(spark), PATH, P.PATTERN).count() == 0
