"""License scans by a positional rare-token index.

Templates (notices and bare phrases) are indexed by position: a word's postings are the places it
takes in templates. Each template has a mandatory key phrase, and any match must hold that phrase
whole; so the key phrase's rarest word, by the document frequency of licence words in the scanned
files themselves, finds every match. For each place of such a word in a file the postings give the
relative position, hence where the template would start; the key phrase is verified there and the
rest of the template compared place by place.

Words: A-Z are lower-cased, a word is a run of digits, a-z and non-ASCII bytes. Document
frequencies cover all files; the table of them is bounded by the words of the templates.

Edge cases: null and empty texts have no words, no labels and score 0; texts are scanned whole;
repeated rows are scanned one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ship

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    """``key`` must stand whole in ``text``; ``least``: share of the template's words that must
    stand in their places."""

    label: str
    text: str
    key: str
    least: float = 1.0

    @staticmethod
    def phrase(label: str, words: str) -> Template:
        return Template(label, words, words)


#: Public licence notices and their names.
NOTICES = (
    Template("mit", "released under the mit license", "mit license", 0.4),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", 0.5),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license", 0.25),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3", 0.4),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2", 0.4),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license", 0.4),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license", 0.4),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", 0.4),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.4),
    Template("cc0", "licensed under cc0 1 0 universal", "cc0 1 0", 0.4),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", 0.15),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", 0.4),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", 0.5),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 0.3),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())  # bytes: A-Z alone


class RareTokenIndex:
    """Postings of the rarest key-phrase words of the templates. ``df``: files with each word."""

    def __init__(self, templates: Sequence[Template], df: dict[bytes, int], files: int):
        self.templates = [(t, tuple(words_of(t.text))) for t in templates]
        idf = {w: math.log((files + 1) / (df.get(w, 0) + 1)) for _, ws in self.templates for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys = []  # (place in the template, words) of each key phrase
        for n, (t, ws) in enumerate(self.templates):
            key = tuple(words_of(t.key))
            at = next(i for i in range(len(ws)) if ws[i:i + len(key)] == key)
            self.keys.append((at, key))
            rarest = max(range(len(key)), key=lambda i: (idf[key[i]], -i))
            self.postings[key[rarest]].append((n, at + rarest))

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, start and end of the key phrase, share of the template's words in place)."""
        for place in [i for i, w in enumerate(words) if w in self.postings]:
            for n, offset in self.postings[words[place]]:
                (at, key), ws = self.keys[n], self.templates[n][1]
                origin = place - offset
                start = origin + at
                if start < 0 or tuple(words[start:start + len(key)]) != key:
                    continue
                same = sum(0 <= origin + i < len(words) and words[origin + i] == w for i, w in enumerate(ws))
                if same >= self.templates[n][0].least * len(ws):
                    yield n, start, start + len(key), same / len(ws)


def licence_document_frequency(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """(files holding each licence word, files), over all files; counted by partition and summed."""
    vocabulary = {w for t in templates for w in words_of(t.text)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df: Counter[bytes] = Counter()
        for b in batches:
            df[b""] += len(b)
            for text in b["text"]:
                df.update(vocabulary.intersection(words_of(text)))
        if df:
            yield pd.DataFrame({"word": [w.decode() for w in df], "n": list(df.values())})

    rows = (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())  # at most one row for each licence word
    df = {r["word"].encode(): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan_licenses(docs: DataFrame, phrases: Sequence[Template], notices: Sequence[Template] = NOTICES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each file: n_words; every place of a template as ``spans`` (label, start, end, coverage;
    words from 0, end not included, whether the template is one of ``phrases``); ``score``, the
    best coverage. Two passes over the files, no shuffle of texts."""
    ship(docs.sparkSession)
    templates = [*phrases, *notices]
    df, files = licence_document_frequency(docs, templates, text_col)
    index = RareTokenIndex(templates, df, files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_words, spans, score = [], [], []
            for text in b["text"]:
                ws = words_of(text)
                found = list(index.scan(ws))
                n_words.append(len(ws))
                spans.append([{"label": templates[n].label, "start": s, "end": e, "coverage": c, "phrase": n < len(phrases)} for n, s, e, c in found])
                score.append(max((c for *_, c in found), default=0.0))
            yield pd.DataFrame({id_col: b[id_col], "n_words": n_words, "spans": spans, "score": score})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(
        run, f"`{id_col}` {kind}, n_words long, spans array<struct<label:string,start:long,end:long,coverage:double,phrase:boolean>>, score double")
