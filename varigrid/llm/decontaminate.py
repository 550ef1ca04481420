"""Finding benchmark passages in documents, re-parameterised ones too.

Texts become template tokens: lower-case words, with numbers (in digits or words),
names (capitalised words) and units (after a number) as typed slots.  A capitalised word that begins a
sentence is a word where the benchmark has it in lower case, as a bitmap of its words says, else a name; the
benchmark is also read with all such words as words, for documents without capitals.
Every window of ``WINDOW`` template tokens is hashed, in benchmark and documents
alike, and they meet by a hash join.  A window of slots alone is hashed by its values instead.  Before the
join, a bitmap of bounded size over the benchmark's hashes drops nearly all windows of documents
inside their rows.  Windows of one document and item that lie as far apart in both
belong to one occurrence, and an occurrence counts only if its slots are
consistent: one value of the benchmark has one value in the document.  A
document contains an item if enough of the item's windows occur.

All of it is SQL functions.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import stored

WINDOW = 8
#: Share of an item's windows that an occurrence must have, and their least number where the item has so many.
COVERAGE, LEAST_WINDOWS = 0.3, 2
#: Benchmark windows are broadcast up to this number; more meet the documents' by shuffle.
MOST_BROADCAST = 300_000
#: Bits of the bitmap at least for each of the benchmark's hashes, and in all at most.
BITS_EACH, MOST_BITS = 16, 1 << 22
#: The same for each of its lower-case words: a word is taken for one of them in error at one in a thousand, up to 65,000 words.
WORD_BITS_EACH = 64

# Units that make a slot after a number.
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|feet|foot|yd|yards?|mi|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|centimet(?:er|re)s?"
    "|mg|g|kg|t|lb|lbs|oz|grams?|kilograms?|tons?|tonnes?|pounds?|ounces?|ml|cl|l|lit(?:er|re)s?|gallons?"
    "|ms|s|sec|secs|seconds?|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?"
    "|usd|eur|gbp|dollars?|euros?|cents?|percent|degrees?|mph|kmh|kw|w|v|hz|mb|gb|tb"
)
# Words of numbers, which make one number in a row.
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
    "|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
)


def _by_letter(words: str) -> str:
    """An alternation that looks at a word's first letter once."""
    rest: dict[str, list[str]] = {}
    for w in words.split("|"):
        rest.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(r)})" for c, r in rest.items())


def _with_numbers(t: Column) -> Column:
    """A text whose numbers in words are written as one word each, with a 0 at both ends."""
    one = f"(?:{_by_letter(NUMBER_WORDS)})"
    gap = r"(?:[\x20-]|\x20and\x20)"
    joined = F.regexp_replace(t, rf"(?i){gap}(?<=\b{one}{gap})(?={one}\b)", "_")
    return F.when(t.rlike(rf"(?i)\b{one}\b"), F.regexp_replace(joined, rf"(?i)(?<![\p{{L}}\p{{N}}_]){one}(?:_{one})*(?![\p{{L}}\p{{N}}_])", r"0$0\0")).otherwise(t)


def tokens(text: Column) -> Column:
    """Lower-case words; numbers begin with a digit (those in words with a 0 at both ends), names with ``#``, what may be name or word with ``##``, units with ``@``.  A sign right before digits belongs to the number."""
    text = F.coalesce(text, F.lit(""))
    t = F.when(text.contains("#") | text.contains("@"), F.regexp_replace(text, "[#@]", " ")).otherwise(text)
    # bound to a variable, so that it is worked out once
    return F.get(F.transform(F.array(_with_numbers(t)), _cut_words), F.lit(0))


def _cut_words(text: Column) -> Column:
    t = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll},;]\x20.)\p{Ll}+", "#$0")
    t = F.regexp_replace(t, r"\p{Lu}(?<![#\p{L}\p{N}_].)\p{Ll}+", "##$0")
    n = F.regexp_replace(t, r"[.,:/](?<=[0-9].)(?=[0-9])", "_")
    n = F.regexp_replace(n, r"[$€£](?=[0-9])", " ")
    n = F.regexp_replace(n, r"([0-9])[\x20-]?((?i:" + UNITS + r"))(?![\p{L}\p{N}_])", "$1 @$2")
    n = F.regexp_replace(n, r"([0-9])\x20?([%$€£°])", "$1 @$2 ")
    t = F.lower(F.when(text.rlike("[0-9]"), n).otherwise(t))
    t = F.when(F.octet_length(text) == F.length(text), t).otherwise(F.regexp_replace(t, r"[^\x00-\x7f\p{L}\p{M}\p{N}€£°]", " "))
    # what is left to part words is ASCII but for the signs above, digits, letters and #@_%$
    return F.array_remove(F.split(t, r"[\x00-\x22&-/:-?\[-^`{-\x7f]+"), "")


def template(word: Column) -> Column:
    """A token with the kind of its slot for its value."""
    return F.when((word >= "0") & (word < ":"), "<number>").when(word.startswith("#"), "<name>").when(word.startswith("@"), "<unit>").otherwise(word)


def settled(tokens: Column, vocabulary: tuple[int, Column] | None) -> Column:
    """The tokens with ``##`` ones as words where the vocabulary may have them, else as names; all as words without one."""
    word = lambda t: F.substr(t, F.lit(3))
    either = (lambda t: word(t)) if vocabulary is None else (lambda t: F.when(_may_be(F.xxhash64(word(t)), *vocabulary), word(t)).otherwise(F.substr(t, F.lit(2))))
    return F.transform(tokens, lambda t: F.when(t.startswith("##"), either(t)).otherwise(t))


def vocabulary(benchmark: DataFrame) -> tuple[int, Column]:
    """The words that the benchmark has in lower case, as a bitmap of bounded size."""
    each = benchmark.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).distinct()
    return bitmap(each.filter(template(F.col("w")) == F.col("w")).select(F.xxhash64("w").alias("hash")), WORD_BITS_EACH)


def _read(rows: DataFrame, *vocabularies: tuple[int, Column] | None) -> DataFrame:
    """Adds ``r0``, ``r1`` and so on, the tokens of ``text`` under each vocabulary, and per token of them its kind."""
    rows = rows.withColumn("tokens", tokens(F.col("text")))
    rows = rows.withColumns({f"r{i}": settled(F.col("tokens"), v) for i, v in enumerate(vocabularies)})
    return rows.withColumns({f"r{i}_kind": F.transform(f"r{i}", _kind) for i in range(len(vocabularies))})


def _kind(word: Column) -> Column:
    """A token's kind: 0 to 2 for slots, a hash for words."""
    return F.when((word >= "0") & (word < ":"), 0).when(word.startswith("#"), 1).when(word.startswith("@"), 2).otherwise(F.xxhash64(word))


def _hash(reading: str, at: Column, size: int) -> Column:
    """The hash of a reading's window of ``size`` tokens from a place on: of its templates, or of its values where all are slots."""
    kinds = [F.get(F.col(f"{reading}_kind"), at + i) for i in range(size)]
    every = (kinds[0] >= 0) & (kinds[0] <= 2)
    for x in kinds[1:]:
        every = every & (x >= 0) & (x <= 2)
    values = F.xxhash64(F.lit("value"), *[F.get(F.col(reading), at + i) for i in range(size)])
    return F.when(every, values).otherwise(F.xxhash64(*kinds))


def _cut(reading: str, size: int, places: Column, at: str, words: str) -> Column:
    """The windows at some places, with their hashes and tokens."""
    return F.transform(places, lambda i: F.struct(i.alias(at), F.lit(size).alias("size"), _hash(reading, i, size).alias("hash"), F.slice(reading, i + 1, F.lit(size)).alias(words)))


def _places(reading: str, size: int) -> Column:
    return F.sequence(F.lit(0), F.size(reading) - size)


def windows(benchmark: DataFrame, words: tuple[int, Column]) -> DataFrame:
    """(item_id, windows, at, size, hash, words): the items' windows under a vocabulary and with all as words, and how many places of windows an item has.

    An item shorter than a window is one, if it has a plain word; items without a token have none.
    """
    items = _read(benchmark.select("item_id", "text"), words, None)

    def found(reading: str) -> Column:
        out = F.when(F.size(reading) >= WINDOW, _cut(reading, WINDOW, _places(reading, WINDOW), "at", "words"))
        for size in range(1, WINDOW):
            worded = F.exists(f"{reading}_kind", lambda k: (k < 0) | (k > 2))
            out = out.when((F.size(reading) == size) & worded, _cut(reading, size, _places(reading, size), "at", "words"))
        return out.otherwise(F.array().cast("array<struct<at:int,size:int,hash:bigint,words:array<string>>>"))

    n = F.greatest(F.size("tokens") - WINDOW + 1, F.lit(1)).alias("windows")
    return items.select("item_id", n, F.explode(F.concat(found("r0"), found("r1"))).alias("x")).select("item_id", "windows", "x.*").distinct()


def bitmap(hashes: DataFrame, each: int = BITS_EACH) -> tuple[int, Column]:
    """A test of a hash column: the bitmap's number of bits, a power of two, and its array of 64-bit words."""
    n = hashes.count()
    bits = min(MOST_BITS, max(1 << 15, 1 << (each * n - 1).bit_length())) if n else 1 << 15
    spots = hashes.select(F.explode(F.array(*_spots(F.col("hash"), bits))).alias("spot"))
    rows = spots.select(F.floor(F.col("spot") / 32768).alias("bucket"), (F.col("spot") % 32768).cast("int").alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    words = np.zeros(bits // 64, "<i8")
    for r in rows:  # bits / 32768 rows of 4 KiB
        words[r["bucket"] * 512 : (r["bucket"] + 1) * 512] = np.frombuffer(bytes(r["map"]), "<i8")
    return bits, F.from_json(F.lit(json.dumps(words.tolist())), "array<bigint>")


def _spots(value: Column, bits: int) -> list[Column]:
    return [value.bitwiseAND(F.lit(bits - 1)), F.shiftright(value, 32).bitwiseAND(F.lit(bits - 1))]


def _may_be(value: Column, bits: int, words: Column) -> Column:
    """Whether the bitmap may hold a hash."""
    a, b = (F.call_function("shiftright", F.get(words, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1 for x in _spots(value, bits))
    return a & b


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id): documents, by id and text, and the items they contain."""
    items = benchmark.select("item_id", "text").distinct()
    known = vocabulary(items)
    bench = stored(windows(items, known))
    n, sizes = bench.count(), sorted(r["size"] for r in bench.select("size").distinct().collect())  # WINDOW sizes at most
    if not n:
        kind = benchmark.schema["item_id"].dataType
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(None).cast(kind).alias("item_id")).filter(F.lit(False))
    bits, words = bitmap(bench.select("hash").distinct())
    read = _read(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), known).drop("text")
    r, hits = "r0", {size: f"hits_{size}" for size in sizes}
    for size, name in hits.items():
        # all hashes first, each worked out once
        every = F.when(F.size(r) >= size, F.transform(_places(r, size), lambda i: _hash(r, i, size))).otherwise(F.array().cast("array<bigint>"))  # noqa: B023
        read = read.withColumn("_all", every)
        numbered = F.transform("_all", lambda h, i: F.when(_may_be(h, bits, words), i))
        read = read.withColumn(name, F.array_compact(numbered)).drop("_all")
    # the words of the windows that may match, and only theirs; a filter on the hits would work all columns out once more
    own = read.select("doc_id", "text_hash", F.explode(F.concat(*[_cut(r, size, F.col(name), "from", "own") for size, name in hits.items()])).alias("x")).select("doc_id", "text_hash", "x.*")
    met = own.join(F.broadcast(bench) if n <= MOST_BROADCAST else bench, ["hash", "size"])
    alike = F.array_join(F.transform("own", template), " ") == F.array_join(F.transform("words", template), " ")
    met = met.filter(alike & ((F.col("own") == F.col("words")) | F.exists("own", lambda w: template(w) == w)))
    # one occurrence: the same shift between the places in document and item
    slots = F.filter(F.arrays_zip(F.col("words").alias("b"), F.col("own").alias("d")), lambda x: template(x["b"]) != x["b"])
    met = met.select("doc_id", "text_hash", "item_id", "windows", "at", (F.col("from") - F.col("at")).alias("shift"), slots.alias("slots")).distinct()
    held = met.groupBy("doc_id", "text_hash", "item_id", "windows", "shift").agg(F.collect_set("at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    values = F.size(F.array_distinct(F.transform("slots", lambda x: x["b"])))
    held = held.filter(values == F.size("slots"))
    found = held.groupBy("doc_id", "text_hash", "item_id", "windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"))
    need = F.greatest(F.least(F.lit(LEAST_WINDOWS), F.col("windows")), F.ceil(F.col("windows") * COVERAGE))
    return found.filter(F.col("n") >= need).select("doc_id", "text_hash", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items) for every row of ``docs`` (doc_id, text): the items (item_id, text) it contains, ascending.

    Null and empty texts contain none, and items of fewer than ``WINDOW`` tokens without a plain word are contained
    nowhere.  Rows are told apart by id and text, so repeated rows and null ids
    get each their own answer.
    """
    docs = docs.select("doc_id", "text")
    found = matches(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.alias("r").join(found.alias("f"), (F.col("r.text_hash") == F.col("f.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    kind = found.schema["items"].dataType.simpleString()
    return joined.select(F.col("r.doc_id").alias("doc_id"), F.col("f.items").isNotNull().alias("contaminated"), F.coalesce("f.items", F.array().cast(kind)).alias("items"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with the columns they had."""
    found = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, (F.xxhash64(docs["text"]) == found["_hash"]) & docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")
