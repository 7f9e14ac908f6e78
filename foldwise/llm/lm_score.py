"""Language-model scores by online logistic context mixing, learned from the corpus with Spark.

A text is its words (A-Z lower-cased, split at white space) and one end. The ``DICTIONARY`` most
frequent words and the end are symbols of their own, coded bit by bit by ``bit_mix`` from the hashed
contexts of the words before; the weights are refined within each text. Any other word is an escape
symbol (one of ``CLASSES``, by its last letter; eight of them gained 0.005 of log10 a word on held-out
texts for a quarter more time, so there is one), worth L * count / (counts of the class) + (1 - L) * spelling, with L by Good-Turing from
the class's words seen once, and the spelling coded byte by byte, given the class, by a second mixer
that learns from the distinct words. So the model is a probability over all texts, and knows every word of the training rows.

What it gathers: exact counts of all words (a table that grows with the corpus, never sent to the
driver), and hashed slot counts (tables of a fixed 2**18 slots, summed by Spark from every
training row). To executors go only the slots, the dictionary and the counts of the at most
``FREQUENT`` most frequent words, all bounded; the counts of other words reach the texts by a join
on the word. Weights and maps are fitted on every training row and every distinct training word, which tasks
add up in cells of like log odds (``bit_mix.Cells``, at most 2**21 a mixer). Texts are split twice: to count
their words, and to write their words' numbers once; what follows reads the numbers. A bit's contexts and cell hang on its
symbol and the two before alone, so tasks sort such threes and count equal ones as one.

Edge cases: null and empty texts are one end; with no training rows at all, every word is spelled by
an unfitted model and the base score is 0 (the formula without counts); texts are scored whole, very long
ones alone; repeated rows are scored one by one and each counts in training; other columns of the
input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.bit_mix import Cells, Code, Mixer, levels, slots_by_context, weighed
from foldwise.llm.common import ship, write_shared

END = b"\n"  # no word has white space
DICTIONARY, FREQUENT, CLASSES = 1024, 100_000, 1
WORD_BITS, SPELL_BITS, SPELL_CONTEXTS = 18, 18, 4
SPELLED = 200_000  # bytes of words spelled together
COUNTED, CODED = 6_000_000, 2_000_000  # bytes of text counted and coded together
BATCH = 100_000  # words scored together
THREES, EXPANDED = 2_000_000, 50_000  # words sorted together, distinct threes expanded together
TASK_WORDS = 30_000_000  # words counted by one task at most, about 200 MB
_P = np.uint32(0x01000193)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z and ASCII white space alone


def class_of(word: bytes) -> int:
    """By the last byte of the last letter (a-z or not ASCII)."""
    for b in reversed(word) if CLASSES > 1 else ():
        if 97 <= b <= 122 or b >= 128:
            return b % CLASSES
    return 0


def classes(words: Sequence[bytes]) -> np.ndarray:
    return np.zeros(len(words), np.int64) if CLASSES == 1 else np.array([class_of(w) for w in words], np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``size`` bytes of a string or binary column, whatever batches they come in; a longer row alone."""
    held, total = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy().astype(np.int64) + 1)  # no row is free
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + size - total, "right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(b.slice(at, to - at))
                total += int(ends[to - 1] - before)
                at = to
            if at < len(ends):  # the next one is too much
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(``words_of`` all texts, one after another; how many each has)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy()
    n, there = np.diff(ends), pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty one
    if there.all():
        return words, n
    kept = np.concatenate([[0], np.cumsum(there)])
    return words.filter(pa.array(there)), np.diff(kept[ends - ends[0]])


def count_words(rows: DataFrame) -> DataFrame:
    """(token, c): how often each token stands in the training rows; 0 for those only in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", COUNTED):
            words, n = split(b.column("text"))
            train, coded = b.column("train").to_numpy(zero_copy_only=False), words.dictionary_encode()
            counts = np.bincount(coded.indices.to_numpy()[np.repeat(train, n)], minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_pydict({"token": pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), "c": np.append(counts, train.sum()).astype(np.int64)})

    return rows.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def is_frequent(least: int | None) -> Column:
    """Words in the steps of counts from ``least`` on (eight steps to a doubling)."""
    return F.lit(False) if least is None else (F.col("c") > 0) & (F.floor(F.log2(F.greatest("c", F.lit(1))) * 8) >= least)


def most_frequent(vocabulary: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int | None]:
    """(token, c) of all words above a count, at most ``most``, and the step of that count; it is found
    from a histogram of at most some hundred steps."""
    steps = vocabulary.where("c > 0").groupBy(F.floor(F.log2("c") * 8).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for s, n in sorted(((r["s"], r["n"]) for r in steps), reverse=True):
        if total + n > most:
            break
        least, total = s, total + n
    rows = vocabulary.where(is_frequent(least)).collect()
    return sorted(((bytes(r["token"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0])), least


class Words:
    """The symbols of words: dictionary words 0 to n-1, the end n, escapes by class from n+1 on. Frequent
    words beyond the dictionary have numbers from n+1 on too, in ``listed`` alone."""

    def __init__(self, frequent: list[tuple[bytes, int]]):
        chosen = [w for w, _ in frequent if w != END][:DICTIONARY]
        self.n = len(chosen)
        self.words = list(dict.fromkeys([*chosen, END, *(w for w, _ in frequent)]))
        self.symbol = np.array([*(i if i <= self.n else self.n + 1 + class_of(w) for i, w in enumerate(self.words)), *range(self.n + CLASSES, self.n, -1)], np.int64)
        self.listed = pa.array(self.words, pa.binary())
        self.symbols = self.n + 1 + CLASSES

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word; if not a frequent one, -1 less its class, which ``symbol`` has at its end."""
        out = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy()
        if CLASSES == 1:
            return out
        rare = np.flatnonzero(out < 0)
        out = out.copy()
        out[rare] -= classes(words.take(pa.array(rare)).to_pylist()).astype(np.int32)
        return out

    def rarer(self, words: pa.Array) -> pa.Array:
        """The words beyond the dictionary."""
        return words.filter(pc.invert(pc.is_in(words, value_set=self.listed[:self.n + 1])))


def before_each(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each symbol and the second before, plus 1; 0 if there is none in the text."""
    before = np.concatenate([[0], symbols[:-1] + 1])
    before[starts] = 0
    second = np.concatenate([[0], before[:-1]])
    second[starts] = 0
    return before, second


def word_contexts(before: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Contexts of each symbol: none; the word before; the two before; the second before."""
    one, two = before.astype(np.uint32), second.astype(np.uint32)
    return [np.ones(len(one), np.uint32), one + np.uint32(1 << 20), (one * _P ^ two) * _P + np.uint32(2 << 20), two + np.uint32(3 << 20)]


def texts_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their words' numbers, where each text begins) of about ``size`` words of whole texts."""
    for b in blocks(batches, "numbers", 4 * size):
        own = b.column("numbers")
        n = pc.binary_length(own).to_numpy() // 4
        yield b, np.frombuffer(b"".join(own.to_pylist()), np.int32), np.cumsum(n, dtype=np.int64) - n


def threes(batches: Iterator[pa.RecordBatch], symbol: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(symbol, its contexts, how often) of the different (second before, before, symbol) of about
    ``THREES`` words; ``symbol``: of each number."""
    symbols = int(symbol.max()) + 1
    kind = np.uint32 if symbols * (symbols + 1) ** 2 <= 1 << 32 else np.int64
    held, size = [], 0

    def distinct() -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        key = np.concatenate(held)
        held.clear()
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times, key = np.diff(np.append(first, len(key))), key[first]
        for i in range(0, len(key), EXPANDED):
            rest, last = np.divmod(key[i:i + EXPANDED].astype(np.int64), symbols)
            second, before = np.divmod(rest, symbols + 1)
            yield last, word_contexts(before, second), times[i:i + EXPANDED]

    for _, numbers, starts in texts_of(batches, BATCH):
        own = symbol[numbers]
        before, second = before_each(own, starts)
        held.append(((second * (symbols + 1) + before) * symbols + own).astype(kind))
        size += len(own)
        if size >= THREES:
            yield from distinct()
            size = 0
    if held:
        yield from distinct()


def spell(words: Sequence[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(bytes of the words, each with an end; their contexts: two to four bytes before, all bytes
    before, each with the word's class; ends)."""
    data = np.frombuffer(b"".join([END.join(words), END] if len(words) else []), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    back = [np.where(place >= i, np.concatenate([np.zeros(i, np.int64), data[:-i]])[:len(data)] + 1, 0).astype(np.uint32) for i in (1, 2, 3, 4)]
    prefix = np.zeros(len(data), np.uint32)
    at, left, i = starts, lengths, 0
    while len(at := at[left > i + 1] + 1):
        left, i = left[left > i + 1], i + 1
        prefix[at] = (prefix[at - 1] ^ back[0][at]) * _P
    two = (back[0] * _P ^ back[1]) * _P
    own = np.repeat(classes(words).astype(np.uint32), lengths) << np.uint32(24)
    three = (two ^ back[2]) * _P
    return data, [two + np.uint32(2 << 20) ^ own, three + np.uint32(3 << 20) ^ own, (three ^ back[3]) * _P + np.uint32(4 << 20) ^ own,
                  prefix + np.uint32(5 << 20) ^ own], ends


class SlotCounts:
    """Counts of bits by context and slot, gathered in a task and emitted as (context, slot, zeros, ones)."""

    def __init__(self, code: Code, contexts: int, bits: int):
        self.code, self.bits = code, bits
        self.counts = np.zeros((contexts, 2 << bits), np.int64)

    def add(self, symbols: np.ndarray, contexts: list[np.ndarray], times: np.ndarray | None = None) -> None:
        """``times``: how often each symbol stands in its contexts, once if not given."""
        at, flat = self.code.places(symbols)
        bit = self.code.bit[flat]
        for own, slot in zip(self.counts, slots_by_context(self.code, contexts, at, flat, self.bits), strict=True):
            slot *= 2
            slot += bit
            own += weighed(slot, at, times, 2 << self.bits)

    def emit(self) -> Iterator[pa.RecordBatch]:
        for k, own in enumerate(self.counts):
            pairs = own.reshape(-1, 2)
            hit = np.flatnonzero(pairs.any(1))
            yield pa.RecordBatch.from_pydict({"k": np.full(len(hit), k, np.int32), "slot": hit.astype(np.int32), "zeros": pairs[hit, 0], "ones": pairs[hit, 1]})


SLOT_ROWS = "k int, slot int, zeros long, ones long"


def gathered(rows: DataFrame, contexts: int, bits: int) -> np.ndarray:
    """contexts x slots x 2, summed by Spark; at most contexts * 2**bits rows come to the driver."""
    total = np.zeros((contexts, 1 << bits, 2), np.int64)
    sums = rows.groupBy("k", "slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    for b in sums.select(F.col("k").cast("int"), "slot", "zeros", "ones").toArrow().to_batches():
        k, s, z, o = (b.column(i).to_numpy() for i in range(4))
        total[k, s, 0], total[k, s, 1] = z, o
    return total


def emit_cells(cells: Cells) -> Iterator[pa.RecordBatch]:
    hit = np.flatnonzero(cells.n)
    yield pa.RecordBatch.from_pydict({"cell": hit, "n": cells.n[hit]})


CELL_ROWS = "cell long, n long"


def fit_cells(mixer: Mixer, rows: DataFrame, means: np.ndarray) -> None:
    """Fit ``mixer`` on ``CELL_ROWS``, summed by Spark; at most a row a cell comes to the driver."""
    cell, n = (c.to_numpy() for c in rows.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow().columns)
    if len(cell):
        mixer.fit(cell, n, means)


class Counted:
    """What the word counts tell: bounded tables."""

    def __init__(self, vocabulary: DataFrame):
        some = vocabulary.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
        self.total, self.distinct = some["n"] or 0, some["v"]
        frequent, self.least = most_frequent(vocabulary, FREQUENT)
        self.words, counted = Words(frequent), dict(frequent)
        counted[END] = sum(r["c"] for r in vocabulary.where(F.col("token") == F.lit(END)).collect())  # one row
        self.counts = np.array([counted.get(w, 0) for w in self.words.words], np.int64)
        self.base, self.known = (np.concatenate([x, np.zeros(CLASSES)]) for x in (self.log_base(self.counts), self.counts > 0))  # by number

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def coded(self, texts: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        """Of each text: its words' numbers (four bytes each), n_tokens; n_known and base without words that are
        not frequent; those words and how often each stands there."""
        words, n = split(texts)
        doc, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n + 1, dtype=np.int64)
        numbers = np.full(len(words) + len(n), self.words.n, np.int32)  # the end's
        numbers[np.arange(len(words)) + doc] = own = self.words.numbers(words)
        beyond = np.flatnonzero(own < 0)
        rare = words.take(pa.array(beyond)).dictionary_encode()
        size = max(1, len(rare.dictionary))
        pairs, times = np.unique(doc[beyond] * size + rare.indices.to_numpy(), return_counts=True)
        at = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * size).astype(np.int32))
        places = pa.array(np.concatenate([[0], ends * 4]).astype(np.int32))
        sums = lambda x: np.add.reduceat(x[numbers], ends - n - 1)
        return {"numbers": pa.Array.from_buffers(pa.binary(), len(n), [None, places.buffers()[1], pa.py_buffer(numbers.tobytes())]), "n_tokens": (n + 1).astype(np.int64),
                "n_known": sums(self.known).astype(np.int64), "base": sums(self.base),
                "words": pa.ListArray.from_arrays(at, rare.dictionary.take(pa.array(pairs % size))), "times": pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))}


class Model:
    """All that executors need to score: bounded tables."""

    def __init__(self, counted: Counted, mixer: Mixer, speller: Mixer, seen: np.ndarray, rare: np.ndarray):
        """``seen``, ``rare``: by class, L and the counts of words beyond the dictionary."""
        self.symbol, self.mixer, self.speller, self.seen, self.rare = counted.words.symbol, mixer, speller, seen, rare
        words, self.extra = counted.words.words, np.zeros(len(counted.words.symbol))
        for i in range(counted.words.n + 1, len(words), 20_000):
            own = words[i:i + 20_000]
            self.extra[i:i + len(own)] = self.escaped(own, counted.counts[i:i + len(own)])

    def escaped(self, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each word after an escape."""
        data, contexts, ends = spell(words)
        spelled = np.maximum(self.speller.log2(data, contexts, ends, refine=False), -1000)
        own = classes(words)
        return np.log10(self.seen[own] * counts / np.maximum(1, self.rare[own]) + (1 - self.seen[own]) * np.exp2(spelled))

    def score(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text, without what follows the escapes of words that are not frequent."""
        symbols = self.symbol[numbers]
        contexts = word_contexts(*before_each(symbols, starts))
        return self.mixer.log2(symbols, contexts, np.append(starts[1:], len(symbols))) * np.log10(2) + np.add.reduceat(self.extra[numbers], starts)


def learn(counted: Counted, coded: DataFrame, vocabulary: DataFrame) -> Model:
    """The model, from the written numbers of the training rows and the word counts."""
    spark, words = vocabulary.sparkSession, counted.words
    shared_words = spark.sparkContext.broadcast(words)
    spelled_rows = vocabulary.where("c > 0").select("token", "c")

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of distinct words, and by class the counts of words beyond the dictionary and those seen once."""
        inside, total, by_class = shared_words.value.listed[:shared_words.value.n + 1], np.zeros(256, np.int64), np.zeros((2, CLASSES), np.int64)
        for b in blocks(batches, "token", SPELLED):
            tokens = b.column("token").to_pylist()
            total += np.bincount(np.frombuffer(b"".join(tokens), np.uint8), minlength=256)
            total[END[0]] += len(tokens)
            own = classes(tokens)
            c = b.column("c").to_numpy() * ~pc.is_in(b.column("token"), value_set=inside).to_numpy(zero_copy_only=False)
            by_class += np.stack([np.bincount(own, c, CLASSES), np.bincount(own, c == 1, CLASSES)]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"what": np.arange(256 + 2 * CLASSES, dtype=np.int32), "n": np.concatenate([total, *by_class])})

    tally = np.zeros(256 + 2 * CLASSES, np.int64)
    for r in spelled_rows.mapInArrow(count_bytes, "what int, n long").groupBy("what").agg(F.sum("n").alias("n")).collect():
        tally[r["what"]] = r["n"]
    rare, once = tally[256:256 + CLASSES], tally[256 + CLASSES:]

    def spelled(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Bytes and contexts of the words beyond the dictionary."""
        for b in blocks(batches, "token", SPELLED):
            yield spell(words.rarer(b.column("token")).to_pylist())[:2]

    tasks = max(2 * spark.sparkContext.defaultParallelism, counted.total // TASK_WORDS)  # a task sends each slot once
    code = Code([*counted.counts[:words.n + 1].tolist(), *np.maximum(1, rare).tolist()])
    mixer = learn_mixer(coded.coalesce(tasks), threes, words.symbol, code, 4, WORD_BITS)
    speller = learn_mixer(spelled_rows, spelled, words, Code(tally[:256].tolist()), SPELL_CONTEXTS, SPELL_BITS)
    seen = np.clip(1 - once / np.maximum(1, rare), 0.001, 0.999) * (rare > 0)
    return Model(counted, mixer, speller, seen, rare)


def learn_mixer(rows: DataFrame, read: Callable, what: object, code: Code, contexts: int, bits: int) -> Mixer:
    """The fitted mixer of what ``read(batches of rows, what)`` yields: (symbols, contexts) or (symbols, contexts, times)."""
    shared = rows.sparkSession.sparkContext.broadcast((what, code))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what, code = shared.value
        counts = SlotCounts(code, contexts, bits)
        for x in read(batches, what):
            counts.add(*x)
        yield from counts.emit()

    def gather_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        what, code = shared.value
        cells = Cells(code, shared_levels.value, bits)
        for x in read(batches, what):
            cells.add(*x)
        yield from emit_cells(cells)

    counts = gathered(rows.mapInArrow(count, SLOT_ROWS), contexts, bits)
    mixer = Mixer(code, counts, bits)
    table, means = levels(counts)
    shared_levels = rows.sparkSession.sparkContext.broadcast(table)
    fit_cells(mixer, rows.mapInArrow(gather_cells, CELL_ROWS), means)
    return mixer


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row; ``train``:
    the rows to learn from."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    ship(spark)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    vocabulary = write_shared(count_words(rows.select("text", "train")), "words")
    words = Counted(vocabulary)
    counted = spark.sparkContext.broadcast(words)

    def code_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", CODED):
            ids = os.urandom(16 * len(b))
            yield pa.RecordBatch.from_pydict({id_col: b.column(id_col), "train": b.column("train"), "row": pa.array([ids[i:i + 16] for i in range(0, len(ids), 16)], pa.binary()),
                                              "bytes": pc.binary_length(b.column("text")).cast(pa.int64()), **counted.value.coded(b.column("text"))})

    coded = write_shared(rows.mapInArrow(code_texts, f"`{id_col}` {kind}, train boolean, row binary, bytes long, numbers binary, n_tokens long, n_known long, base double, words array<binary>, times array<long>"), "coded")
    model = spark.sparkContext.broadcast(learn(words, coded.where("train").select("numbers"), vocabulary))
    kept = [id_col, "train", "row", "bytes", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, numbers, starts in texts_of(batches, BATCH):
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in kept}, "score": model.value.score(numbers, starts)})

    first = coded.select(*kept, "numbers").mapInArrow(run, f"`{id_col}` {kind}, train boolean, row binary, bytes long, n_tokens long, n_known long, base double, score double")
    beyond = coded.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnsRenamed({"words": "token", "times": "n"})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in blocks(batches, "token", SPELLED):
            counts = b.column("c").to_numpy().astype(np.float64)
            yield pa.RecordBatch.from_pydict({"token": b.column("token"), "known": (counts > 0).astype(np.int64), "b": counted.value.log_base(counts), "s": m.escaped(b.column("token").to_pylist(), counts)})

    worth = vocabulary.where(~is_frequent(words.least)).mapInArrow(weigh, "token binary, known long, b double, s double")
    # hashed by word on both sides and not sorted: a partition's distinct words fit in memory
    more = beyond.join(worth.hint("shuffle_hash"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("known")).alias("known"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.col("score") + zero("s")
    return first.join(more, "row", "left").select(
        id_col, "train", "n_tokens", (F.col("n_known") + zero("known")).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"))
