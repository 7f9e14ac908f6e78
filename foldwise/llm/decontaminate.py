"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Windows of eight tokens of the benchmark items are hash-joined with those of the documents, twice:
as literal words (lower-cased, values kept), which finds copies whatever their case, layout and
number of values; and as templates, in which numbers, names and units are typed placeholders. A
window of literal words always counts. A template match carries both sides' own values: on one
alignment of an item with a document every item value must stand for one document value; windows in
which it stands for another are not counted, those with the item's own values are.

A document holds an item if at least half of the item's words, or a run of 13 of them (all, if fewer),
stand in counted windows. White space counts as one space. Names: capitalised words of two letters and
more, wherever they stand (also in capitals, also ``O'Brien``), but for the function words of a fixed
list and units; names that only white space, an apostrophe or a hyphen parts are one. Numbers: digits,
with decimals and groups of three. Units: a fixed list, after a number. Template windows need at least
four literal tokens; items of fewer than eight tokens are matched whole (three words at least).

A token is hashed once; the hash of a window is put together from those of its halves. Its lowest bit
says whether it is a template window with a placeholder; template windows without one are literal.

The benchmark's windows are broadcast if there are at most ``MAX_BROADCAST`` of them (about 300
bytes each), by count; beyond that the same join is a shuffle join, whose skew AQE splits.

Edge cases: null and empty texts on either side match nothing; rows without an id are not reported;
a row that repeats another adds nothing; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import write_shared

WINDOW, LITERALS, SHORTEST = 8, 4, 3
RUN, COVERAGE = 13, 0.5
MAX_BROADCAST = 200_000
NAME, NUMBER, UNIT, JOIN, POINT = "\x01", "\x02", "\x03", "\x04", "\x05"
UNITS = ("km", "cm", "mm", "m", "kg", "mg", "g", "lb", "lbs", "oz", "ml", "l", "mph", "kmh", "miles", "mile", "feet", "foot", "inches", "inch",
         "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year",
         "dollars", "dollar", "euros", "euro", "cents", "cent", "percent", "degrees", "degree")
# fixed values: function words, which are no names even if capitalised
FUNCTION_WORDS = ("a", "about", "after", "all", "also", "although", "an", "and", "any", "are", "as", "at", "because", "been", "before", "but", "by", "can", "could", "did", "do",
                  "does", "during", "each", "every", "find", "for", "from", "given", "had", "has", "have", "he", "her", "here", "his", "how", "i", "if", "in", "into", "is", "it", "its",
                  "let", "may", "must", "my", "no", "not", "now", "of", "on", "once", "one", "or", "our", "she", "should", "since", "so", "some", "suppose", "that", "the", "their",
                  "then", "there", "these", "they", "this", "those", "though", "to", "was", "we", "were", "what", "when", "where", "whether", "which", "while", "who", "whom", "whose",
                  "why", "will", "with", "would", "you", "your")
INSIDE = rf"\p{{L}}\p{{N}}\p{{M}}{NAME}-{POINT}"  # of a token
# the patterns begin with what is rare, so that most places fail at once
GROUPS_RE = r",(?<=\p{N},)(?=\p{N}{3}(?!\p{N}))"
POINTS_RE = r"\.(?<=\p{N}\.)(?=\p{N})"
NAMES_RE = rf"(?=\p{{Lu}}(?:\p{{L}}|['\u2019]\p{{Lu}}\p{{L}}))(?<![{INSIDE}])(?!(?i:{'|'.join(FUNCTION_WORDS + UNITS)})(?![{INSIDE}]))"
RUNS_RE = rf"({NAME}[\p{{L}}\p{{M}}]+)(?:[\s\p{{Z}}]+|['\u2019-])(?={NAME})"
UNITS_RE = rf"(\p{{N}}[^{INSIDE}]*+)(?=(?i:{'|'.join(UNITS)})(?![{INSIDE}]))"
BREAKS_RE = rf"[^{INSIDE}]+"
SLOT_RE = rf"[{NAME}{UNIT}\p{{N}}]"


def closed(text: Column) -> Column:
    """The text with decimals joined and groups of digits closed up; the marks' own characters become spaces first."""
    text, marks = F.coalesce(text, F.lit("")), rf"[{NAME}-{POINT}]"
    text = F.when(text.rlike(marks), F.regexp_replace(text, marks, " ")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, GROUPS_RE, ""), POINTS_RE, POINT)


def marked(closed_text: Column) -> Column:
    """Lower case, with a mark before each name and each unit after a number, and the names of a run joined."""
    names = F.regexp_replace(F.regexp_replace(closed_text, NAMES_RE, NAME), RUNS_RE, f"$1{JOIN}")
    return F.lower(F.regexp_replace(names, UNITS_RE, f"$1{UNIT}"))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAKS_RE), "")


def is_slot(token: Column) -> Column:
    return token.rlike(SLOT_RE)


def placeholder(token: Column) -> Column:
    """The template's token for a marked token with a value."""
    return F.when(token.startswith(NAME), F.lit(NAME)).otherwise(
        F.regexp_replace(F.regexp_replace(token, f"{UNIT}.*", UNIT), rf"\p{{N}}+(?:{POINT}\p{{N}}+)*", NUMBER))


def form(own: Column) -> Column:
    """The template's tokens."""
    return F.transform(own, lambda t: F.when(is_slot(t), placeholder(t)).otherwise(t))


def n_words(own: Column) -> Column:
    """How many literal words some marked tokens have."""
    return F.aggregate(own, F.lit(0), lambda n, t: n + F.size(F.split(t, JOIN)))


def cut(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, plain): the marked tokens and the literal words; as many as ``own`` has, runs of names counted by name."""
    texts = rows.select(F.col(id_col).alias("id"), closed(F.col(text_col)).alias("closed")).where("id IS NOT NULL")
    return texts.select("id", tokens(marked(F.col("closed"))).alias("own"), tokens(F.lower("closed")).alias("plain"))


def window_hashes(tokens_: Column, hashed, joined, size: int) -> Column:
    """The hashes of all windows of ``size`` of at least as many tokens: of one token, of two, of four, and so on,
    each from the two that make it up; for other sizes the last two overlap."""
    def with_(value: Column, body) -> Column:  # a lambda's variable is computed once
        return F.transform(F.array(value), body)[0]

    def pairs(apart: int):
        return lambda w: F.zip_with(w, F.slice(w, F.lit(apart + 1), F.size(w)), joined)  # the last ones lack a half

    out, width = F.transform(tokens_, hashed), 1
    while width < size:
        apart = min(width, size - width)
        out = with_(out, pairs(apart))
        width += apart
    whole = with_(out, lambda w: F.slice(w, F.lit(1), F.size(w) - (size - 1)))
    return F.when(F.size(tokens_) >= size, whole).otherwise(F.array().cast("array<bigint>"))


def literal_hashes(size: int) -> Column:
    even = F.lit(-2).cast("long")
    return window_hashes(F.col("plain"), lambda t: F.xxhash64(t).bitwiseAND(even), lambda a, b: F.xxhash64(a, b).bitwiseAND(even), size)


def template_hashes(size: int) -> Column:
    even, one = F.lit(-2).cast("long"), F.lit(1).cast("long")
    return window_hashes(F.col("own"), lambda t: F.when(is_slot(t), F.xxhash64(placeholder(t)).bitwiseOR(one)).otherwise(F.xxhash64(t).bitwiseAND(even)),
                         lambda a, b: F.xxhash64(a, b).bitwiseAND(even).bitwiseOR(a.bitwiseOR(b).bitwiseAND(one)), size)


def with_windows(rows: DataFrame, size: int) -> DataFrame:
    """(id, own, plain, kind, place, hash): a row for each literal window (kind 0) and each template window with a
    placeholder (1)."""
    # hashes in a column of their own: an explode of an expression with functions copies the tokens into each row
    out = rows.select("id", "own", "plain", F.concat(literal_hashes(size), template_hashes(size)).alias("hashes"))
    out = out.select("id", "own", "plain", F.posexplode_outer("hashes").alias("pos", "hash"))  # outer: no filter that computes the hashes twice
    first = F.greatest(F.size("plain") - (size - 1), F.lit(0))
    kind = F.col("hash").bitwiseAND(F.lit(1).cast("long")).cast("int")
    return out.where((F.col("pos") < first) | (kind == 1)).select("id", "own", "plain", kind.alias("kind"), (F.col("pos") - F.when(kind == 1, first).otherwise(0)).alias("place"), "hash")


def window_at(size: int) -> Column:
    return F.when(F.col("kind") == 0, F.slice("plain", F.col("place") + 1, size)).otherwise(form(F.slice("own", F.col("place") + 1, size)))


def first_word() -> Column:
    """The literal place of a window's first word."""
    return F.when(F.col("kind") == 0, F.col("place")).otherwise(n_words(F.slice("own", F.lit(1), F.col("place"))))


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, length, kind, at, hash, window, values, slots, start, stop) of the items that are matched with
    windows of ``size``: all of ``WINDOW`` tokens and more, or of exactly ``size`` fewer."""
    rows = with_windows(cut(benchmark.select(id_col, text_col).distinct(), id_col, text_col), size).where(F.size("plain") >= SHORTEST)
    if size < WINDOW:
        rows = rows.where(F.when(F.col("kind") == 0, F.size("plain")).otherwise(F.size("own")) == size)
    rows = rows.select(F.col("id").alias("item_id"), F.size("plain").alias("length"), "kind", F.col("place").alias("at"), "hash", window_at(size).alias("window"),
                       F.when(F.col("kind") == 1, F.slice("own", F.col("place") + 1, size)).alias("values"), first_word().alias("start"))
    rows = rows.withColumn("stop", F.col("start") + F.when(F.col("kind") == 0, F.lit(size)).otherwise(n_words(F.col("values"))))
    rows = rows.withColumn("slots", F.when(F.col("kind") == 1, F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: is_slot(F.col("values")[i]))).otherwise(F.array().cast("array<int>")))
    return rows.where((F.col("kind") == 0) | (size - F.size("slots") >= F.least(F.lit(LITERALS), F.col("stop") - F.col("start") - 1)))


def matches(documents: DataFrame, items: DataFrame, size: int, id_col: str, text_col: str, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, length, size, kind, at, place, start, stop, slots, window, values, found): windows of equal hash
    with both sides' tokens, those of templates marked; ``judged`` compares them."""
    items = write_shared(items, "items")
    side = items.withColumnRenamed("hash", "item_hash").drop("kind")  # the hash holds it
    docs = with_windows(cut(documents, id_col, text_col), size)
    window = F.slice(F.when(F.col("kind") == 0, F.col("plain")).otherwise(F.col("own")), F.col("place") + 1, size)
    if items.count() <= max_broadcast:  # the tokens stay where they are: only windows that meet an item's are cut out
        side = F.broadcast(side)
    else:  # a row takes its window along, not the text
        docs, window = docs.select("id", "kind", "place", "hash", window.alias("found")), F.col("found")
    hit = docs.join(side, docs["hash"] == side["item_hash"])
    return hit.select(F.col("id").alias("doc_id"), "item_id", "length", F.lit(size).alias("size"), "kind", "at", "place", "start", "stop", "slots", "window", "values", window.alias("found"))


def judged(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_tokens, windows, covered, coverage, longest_run, kind) of the pairs in which
    the document holds the item."""
    found = write_shared(found.withColumn("shift", F.col("place") - F.col("at")).distinct(), "matches")
    found = found.where(F.when(F.col("kind") == 0, F.col("found")).otherwise(form(F.col("found"))) == F.col("window")).drop("window")
    align = ["doc_id", "item_id", "length", "size", "shift"]
    pairs = found.where("kind = 1").select(*align, "at", F.explode("slots").alias("i"), "values", "found").select(
        *align, "at", F.element_at("values", F.col("i") + 1).alias("v"), F.element_at("found", F.col("i") + 1).alias("w"))
    values = pairs.groupBy(*align, "v").agg(F.countDistinct("w").alias("nw"))
    checked = pairs.join(values, [*align, "v"]).groupBy(*align, "at").agg(
        F.min(((F.col("v") == F.col("w")) | (F.col("nw") == 1)).cast("int")).alias("fits"), F.max((F.col("v") != F.col("w")).cast("int")).alias("other"))
    templates = found.where("kind = 1").join(checked.where("fits = 1"), [*align, "at"])
    counted = found.where("kind = 0").withColumn("other", F.lit(0)).select(*align, "kind", "start", "stop", "other").unionByName(templates.select(*align, "kind", "start", "stop", "other"))
    pair = ["doc_id", "item_id", "length"]
    places = counted.select(*pair, "size", "kind", "shift", F.explode(F.sequence("start", F.col("stop") - 1)).alias("p")).distinct()
    run = Window.partitionBy(*pair, "size", "kind", "shift").orderBy("p")
    runs = places.withColumn("island", F.col("p") - F.row_number().over(run)).groupBy(*pair, "size", "kind", "shift", "island").agg(F.count("*").alias("run"))
    runs = runs.groupBy(*pair).agg(F.max("run").alias("longest_run"))
    windows = counted.groupBy(*pair).agg(F.countDistinct("start").alias("windows"), F.max("other").alias("other"))
    covered = places.groupBy(*pair).agg(F.countDistinct("p").alias("covered"))
    out = windows.join(covered, pair).join(runs, pair).where((F.col("covered") >= COVERAGE * F.col("length")) | (F.col("longest_run") >= F.least(F.lit(RUN), F.col("length"))))
    return out.select("doc_id", "item_id", F.col("length").cast("long").alias("item_tokens"), "windows", "covered", (F.col("covered") / F.col("length")).alias("coverage"),
                      "longest_run", F.when(F.col("other") == 1, "re-parameterised").otherwise("copy").alias("kind"))


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds."""
    lengths = cut(benchmark, item_col, item_text).where(F.size("plain") >= SHORTEST).select(F.explode(F.array(F.size("plain"), F.size("own"))).alias("n")).where(F.col("n") >= SHORTEST)
    sizes = sorted(r["n"] for r in lengths.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect())  # at most six numbers
    out = None
    for size in sizes or [WINDOW]:
        part = matches(documents, item_windows(benchmark, size, item_col, item_text), size, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return judged(out)
