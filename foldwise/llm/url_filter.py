"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All rules are compiled into globs and packed side by side into 64-bit words. One step of
multiword Shift-And per byte moves every glob of every URL of a batch at once; wildcards are
states that keep their bit. Cost: bytes x words, whatever the number of rules that match.

Glob language, over ``host + path``: ``*`` any run without ``/``, ``**`` any run, ``?`` one
character other than ``/``; all else is literal and the whole text must match.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict (allow); ties between rules of one length go to block, then to the smaller
rule text; repeated rows are judged one by one; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ascii_lower, ship

PADDED_BYTES = 1 << 22  # bytes of one padded matrix of URLs


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains and a path prefix."""

    verdict: str
    text: str  # host/path


class GlobAutomaton:
    """Multiword Shift-And over UTF-8 bytes; the first glob of the list that matches wins."""

    def __init__(self, globs: Sequence[str]):
        cells: list[tuple[int | None, bool, bool, bool]] = []  # (byte or None for ?, start, *, **)
        self.final = []
        for g in globs:
            cells.append((None, True, False, False))
            b, i = g.encode(), 0
            while i < len(b):
                if b[i:i + 2] == b"**":
                    cells[-1] = (*cells[-1][:3], True)
                    i += 2
                elif b[i:i + 1] == b"*":
                    cells[-1] = (*cells[-1][:2], True, cells[-1][3])
                    i += 1
                else:
                    cells.append((None if b[i:i + 1] == b"?" else b[i], False, False, False))
                    i += 1
            self.final.append(len(cells) - 1)
        self.words = max(1, -(-len(cells) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        slash, tail = ord("/"), range(0x80, 0xC0)  # bytes after the first of a character
        for k, (byte, start, run, deep) in enumerate(cells):
            w, bit = k // 64, np.uint64(1 << (k % 64))
            if start:
                self.start[w] |= bit
            elif byte is None:
                for c in range(256):
                    if c != slash and c not in tail:
                        self.step[c, w] |= bit
                for c in tail:
                    self.stay[c, w] |= bit
            else:
                self.step[byte, w] |= bit
            if run or deep:
                for c in range(256):
                    if deep or c != slash:
                        self.stay[c, w] |= bit

    def _group(self, urls: list[bytes]) -> np.ndarray:
        """``urls``: longest first."""
        n, longest = len(urls), len(urls[0])
        lens = np.array([len(u) for u in urls])
        text = np.zeros((n, longest), np.uint8)
        for i, u in enumerate(urls):
            text[i, :len(u)] = np.frombuffer(u, np.uint8)
        active = np.searchsorted(-lens, -np.arange(longest), side="left")  # rows longer than t
        state = np.repeat(self.start[None, :], n, 0)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(longest):
            d, c = state[:active[t]], text[:active[t], t]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:active[t]] = (moved & self.step[c]) | (d & self.stay[c])
        hit = np.full(n, -1)
        for g in range(len(self.final) - 1, -1, -1):
            w, bit = divmod(self.final[g], 64)
            hit[(state[:, w] >> np.uint64(bit)) & one == one] = g
        return hit

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Index of the first matching glob of each URL, -1 if none matches."""
        out = np.full(len(urls), -1)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        i = 0
        while i < len(order):
            rows = max(1, PADDED_BYTES // max(1, len(urls[order[i]])))
            part = order[i:i + rows]
            out[part] = self._group([urls[j] for j in part])
            i += rows
        return out


def compile_rules(rules: Sequence[Rule], block_globs: Sequence[str], allow_globs: Sequence[str] = ()):
    """(globs, rule text or None of each, verdict of each), in order of precedence: the rules,
    longest first, then the block globs, then the allow globs."""
    out = []
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        out += [(r.text + "**", r.text, r.verdict), ("*." + r.text + "**", r.text, r.verdict)]
    out += [(g, None, "block") for g in block_globs] + [(g, None, "allow") for g in allow_globs]
    return tuple(zip(*out, strict=True)) if out else ((), (), ())


def judge_urls(pages: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str] = (),
               allow_globs: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each URL. One pass, no shuffle."""
    ship(pages.sparkSession)
    globs, texts, verdicts = compile_rules(rules, block_globs, allow_globs)
    automaton = GlobAutomaton(globs)
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col),
        F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in zip(b["host"], b["path"], strict=True)])
            yield b.assign(rule=pd.Series([texts[g] if g >= 0 else None for g in hit], dtype=object, index=b.index),
                           verdict=[verdicts[g] if g >= 0 else "allow" for g in hit])

    kind = dict(parts.dtypes)[id_col]
    return parts.mapInPandas(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
