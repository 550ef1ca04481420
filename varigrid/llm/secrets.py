"""Secrets in texts: known patterns, and strings that look drawn at random.

Base patterns give spans of kind assign, access and hex.  Any other run of 16 or
more characters of ``[A-Za-z0-9+/_=-]`` that overlaps no base span goes through
a battery of tests under the encoding that its characters suggest, an alphabet
of 10 to 64 characters in a usual order:

* chi-squared: how evenly the alphabet's characters, and its kinds of them (lower, upper, digit), occur;
* runs: how often places change between the halves of the alphabet, about its median;
* serial correlation of neighbouring places.

A string that one of them rejects as random draws is never kept.  Those that pass
must also be unlike the corpus's own words.  Four p-values tell how likely a
string of such words would be to look so random: by coincidences of characters
(chi-squared's sum of squares), by runs of one kind of character, and by
neighbours (how much oftener the pairs occur together in words than apart), and by
the last two together, by their correlation in words.  Their
null is fitted to all words of 8 to 40 characters in the corpus, as a table of
28 x 28 pair counts over a prior.  The least p-value counts, times the number of tests, and a weighted
step-up procedure over all strings of the corpus keeps the share of false
discoveries under ``FDR``; longer strings get more of the allowance, as the tests
have more to say about them.

All of it is SQL functions on arrays inside a row, in time close to linear in the
text; what is exploded are the corpus's different words and one histogram of bounded size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import stored

# The base patterns and the least lengths of what they find.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Words that the null is fitted to.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,40}(?![A-Za-z0-9+/_=-])"
FDR = 0.01
#: Standard errors from randomness at which a test rejects: evenness of characters, of kinds, runs, serial correlation.
UNEVEN, UNEVEN_KINDS, UNEVEN_RUNS, UNEVEN_SERIAL = 3.5, 5.0, 4.0, 4.0
#: How much more words' scores spread than independent pairs would, in variances.
SPREAD = 2.0
#: Weight of the prior in pairs.
PRIOR = 2_000
#: Length classes (from, weight) and bins of a tenth of a decade.
CLASSES = ((16, 0.5), (24, 0.75), (32, 1.0), (48, 1.25), (64, 1.5))
BINS = 400

# Rounded shares of the letters a-z in English text, in percent; they only weigh as the prior.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
#: Symbols of the null: letters of either case, digits, signs.
SYMBOLS = 28

_SPAN = "array<struct<s:int,e:int>>"
_TOKENS = "array<struct<s:int,e:int,t:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where a lambda uses it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Numbers that are added up one by one; sums of so many come first, as appending to an array copies it.
BLOCK = 256


def sums_before(x: Column) -> Column:
    """For each number of an array the sum of those before it."""
    adding = lambda rows, of: F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, v: F.struct((acc["at"] + of(v)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
    inner = lambda x: F.transform(cut(x), lambda block: adding(block, lambda v: v))
    whole = lambda x: let(inner(x), lambda parts: let(adding(parts, lambda p: p["at"])["out"], lambda first: F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda v: v + F.get(first, i))))))
    return let(x, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, pattern: str, group: int = 0, least: int = 0, guard: Column | None = None, strings: bool = False) -> Column:
    """Start and end in code points of all leftmost non-overlapping matches whose ``group`` has ``least`` or more, with the match as ``t`` if ``strings``.

    The stretches between matches come from ``split`` and the matches from
    ``regexp_extract_all``; their lengths in turn add up to the places.  Texts
    that the ``guard`` rules out have none; without one the pattern itself is tried first.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")
    grouped = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")] if group else []
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches, *grouped)
    length = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def placed(parts: Column) -> Column:
        found = F.transform(F.arrays_zip(parts.alias("x"), sums_before(F.transform(parts, length)).alias("at")), lambda y: F.struct(
            (y["at"] + F.length(y["x"]["p"])).alias("s"), (y["at"] + length(y["x"])).alias("e"), y["x"]["m"].alias("t"), F.length(y["x"]["g" if group else "m"]).alias("n")))
        kept = F.filter(found, lambda y: y["t"].isNotNull() & (y["n"] >= least))
        return F.transform(kept, lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), *([y["t"].alias("t")] if strings else [])))

    return F.when(guard if guard is not None else text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(_TOKENS if strings else _SPAN))


def overlaps(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of some others that are in order and apart, by binary search."""
    before = F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(24))]), F.lit(0),
        lambda acc, w: F.when((acc + w <= F.size(others)) & (F.get(others, acc + w - 1)["s"] < span["e"]), acc + w).otherwise(acc),
    )
    return (F.size(others) > 0) & let(before, lambda k: F.coalesce(F.get(others, k - 1)["e"] > span["s"], F.lit(False)))


def alphabet(t: Column) -> Column:
    """Size of the smallest usual alphabet that a string's characters fit, padding aside."""
    return (
        F.when(t.rlike("^[0-9]*$"), 10)
        .when(t.rlike("^([0-9a-f]*|[0-9A-F]*)$"), 16)
        .when(t.rlike("^([a-z]*|[A-Z]*)$"), 26)
        .when(t.rlike("^[A-Z2-7]*$"), 32)
        .when(t.rlike("^([a-z0-9]*|[A-Z0-9]*)$"), 36)
        .when(t.rlike("^[A-Za-z]*$"), 52)
        .when(t.rlike("^[A-Za-z0-9]*$"), 62)
        .otherwise(64)
    )


def _kind(c: Column) -> Column:
    """0 lower, 1 upper, 2 digit, 3 sign, by code."""
    return F.when(c >= 97, 0).when((c >= 65) & (c <= 90), 1).when((c >= 48) & (c <= 57), 2).otherwise(3)


def _place(c: Column, a: Column) -> Column:
    """A character's place in an alphabet's usual order."""
    letter = F.when(c >= 97, c - 97).otherwise(c - 65)
    digits_first = F.when(c <= 57, c - 48).otherwise(letter + 10)
    both = F.when(c >= 97, c - 71).when(c >= 65, c - 65).when((c >= 48) & (c <= 57), c + 4).when(c.isin(43, 45), 62).otherwise(63)
    both = F.when(c == 95, 63).otherwise(both)
    return F.when(a.isin(10, 16, 36), digits_first).when(a == 26, letter).when(a == 32, F.when(c <= 57, c - 24).otherwise(c - 65)).otherwise(both).cast("double")


def symbol(c: Column) -> Column:
    """A character's symbol in the null's table: 0-25 letters of either case, 26 digits, 27 signs."""
    return F.when(c == 95, 27).when(c >= 97, c - 97).when((c >= 65) & (c <= 90), c - 65).when((c >= 48) & (c <= 57), 26).otherwise(27)


def _codes(t: Column) -> Column:
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c))


class Null:
    """What the corpus's words are like: scores of neighbours, and how characters coincide and kinds change."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        vowels = [i for i in range(26) if "abcdefghijklmnopqrstuvwxyz"[i] in "aeiouy"]
        share = [0.9 * x / sum(LETTERS) for x in LETTERS] + [0.07, 0.03]
        sort = [0 if i in vowels else 1 if i < 26 else i - 24 for i in range(SYMBOLS)]
        together = ((0.4, 1.4, 0.1, 0.5), (1.4, 0.7, 0.1, 0.5), (0.1, 0.1, 9.0, 0.5), (0.5, 0.5, 0.5, 1.0))
        prior = [[share[u] * share[v] * together[sort[u]][sort[v]] for v in range(SYMBOLS)] for u in range(SYMBOLS)]
        whole = sum(map(sum, prior))
        q = [[pairs.get((u, v), 0) + PRIOR * prior[u][v] / whole for v in range(SYMBOLS)] for u in range(SYMBOLS)]
        total = sum(map(sum, q))
        q = [[x / total for x in row] for row in q]
        left, right = [sum(row) for row in q], [sum(col) for col in zip(*q, strict=True)]
        self.score = [[math.log2(q[u][v] / (left[u] * right[v])) for v in range(SYMBOLS)] for u in range(SYMBOLS)]
        for u in (26, 27):
            self.score[u][u] = min(0.0, self.score[u][u])  # a number or a line says nothing against chance
        cells = [(q[u][v], self.score[u][v]) for u in range(SYMBOLS) for v in range(SYMBOLS)]
        self.mean = sum(p * x for p, x in cells)
        self.deviation = math.sqrt(SPREAD * max(1e-6, sum(p * x * x for p, x in cells) - self.mean**2))
        letters = [x / sum(left[:26]) for x in left[:26]]
        self.same = sum(x * x for x in letters)
        self.cubes = sum(x**3 for x in letters)
        sort = [0 if i < 26 else i - 25 for i in range(SYMBOLS)]
        self.changes = max(0.1, 2 * sum(q[u][v] for u in range(SYMBOLS) for v in range(SYMBOLS) if sort[u] != sort[v]))
        # correlation of a pair's score and a change in it: the sum of both tests spreads by it
        change = sum(q[u][v] for u in range(SYMBOLS) for v in range(SYMBOLS) if sort[u] != sort[v])
        shared = -sum(q[u][v] * (self.score[u][v] - self.mean) for u in range(SYMBOLS) for v in range(SYMBOLS) if sort[u] != sort[v])
        spread = math.sqrt(max(1e-12, self.deviation**2 / SPREAD * change * (1 - change)))
        self.joint = math.sqrt(2 + 2 * min(1.0, max(0.0, shared / spread)))


def fitted(docs: DataFrame) -> Null:
    """The null from all words of ``docs`` (text); each counts as often as it occurs."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    coded = words.select("n", F.transform(_codes(F.col("word")), symbol).alias("x"))
    pairs = coded.select("n", F.explode(F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))).alias("p"))
    return Null({(r["u"], r["v"]): r["n"] for r in pairs.groupBy("p.u", "p.v").agg(F.sum("n").alias("n")).collect()})  # SYMBOLS**2 rows at most


def battery(tokens: Column, null: Null) -> Column:
    """Per string (s, e, t): its place, length class and the decadic logarithm of 1 / p, in tenths; -1 if a test rejects it."""
    scores = F.from_json(F.lit(json.dumps([x for row in null.score for x in row])), "array<double>")
    zero = F.lit(0.0)

    def coded(x: Column) -> Column:
        bare = F.regexp_replace(x["t"], "=+$", "")
        seen = lambda a: F.transform(_codes(bare), lambda c: F.struct(c.alias("c"), _place(c, a).alias("x"), _kind(c).alias("k"), symbol(c).alias("y")))
        return let(alphabet(bare), lambda a: F.struct(x["s"].alias("s"), x["e"].alias("e"), a.alias("a"), seen(a).alias("codes")))

    def counted(x: Column) -> Column:
        codes, a = x["codes"], x["a"]
        equal = F.aggregate(F.sort_array(codes["c"]), F.struct(F.lit(-1).alias("c"), zero.alias("run"), zero.alias("sum")), lambda acc, c: F.struct(
            c.alias("c"), F.when(acc["c"] == c, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"), (acc["sum"] + F.when(acc["c"] == c, 2 * acc["run"] + 1).otherwise(F.lit(1.0))).alias("sum")))["sum"]
        numbers = ("t", "q", "l", "high", "turns", "changes", "score", "k0", "k1", "k2", "k3")
        start = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("y"), zero.alias("x"), zero.alias("first"), *[zero.alias(f"n_{k}") for k in numbers])

        def step(acc: Column, c: Column) -> Column:
            seen, one = acc["k"] >= 0, lambda condition: F.when(condition, 1.0).otherwise(0.0)
            high = lambda v: v["x"] * 2 >= a
            more = {
                "t": c["x"], "q": c["x"] * c["x"], "l": acc["x"] * c["x"], "high": one(high(c)), "turns": one(seen & (high(acc) != high(c))), "changes": one(seen & (acc["k"] != c["k"])),
                "score": F.when(seen, F.get(scores, acc["y"] * SYMBOLS + c["y"])).otherwise(zero), **{f"k{k}": one(c["k"] == k) for k in range(4)},
            }
            return F.struct(c["k"].alias("k"), c["y"].alias("y"), c["x"].alias("x"), F.when(seen, acc["first"]).otherwise(c["x"]).alias("first"), *[(acc[f"n_{k}"] + more[k]).alias(f"n_{k}") for k in numbers])

        f = F.aggregate(codes, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["x"].alias("x"), *[acc[f"n_{k}"].alias(k) for k in numbers]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), a.cast("double").alias("a"), F.size(codes).cast("double").alias("n"), equal.alias("equal"), f.alias("f"))

    def graded(x: Column) -> Column:
        n, a, f = x["n"], x["a"], x["f"]
        # under random draws
        chi = (x["equal"] * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        of = lambda k: F.when(a.isin(52, 62, 64), 26 if k < 2 else 10 if k == 2 else 2).when(a == 36, (13, 13, 10, 0)[k]).when(a == 32, (0, 26, 6, 0)[k]).when(a == 16, (3, 3, 10, 0)[k]).otherwise(0)
        one_case = a.isin(16, 36)  # letters of one case: both are counted together
        seen = [F.when(one_case, f["k0"] + f["k1"]).otherwise(f["k0"]), F.when(one_case, zero).otherwise(f["k1"]), f["k2"], f["k3"]]
        wanted = [F.when(one_case, of(0) + of(1)).otherwise(of(0)), F.when(one_case, F.lit(0)).otherwise(of(1)), F.when(a == 52, 0).otherwise(of(2)), F.when(a == 64, of(3)).otherwise(F.lit(0))]
        parts = [F.when(w > 0, F.pow(s - n * w / a, F.lit(2.0)) / (n * w / a)).otherwise(zero) for s, w in zip(seen, wanted, strict=True)]
        free = sum((F.when(w > 0, 1.0).otherwise(0.0) for w in wanted), F.lit(-1.0))
        kinds = F.when(free > 0, (sum(parts, zero) - free) / F.sqrt(2 * free)).otherwise(zero)
        both = 2 * f["high"] * (n - f["high"])
        runs = F.when(both > n, (f["turns"] - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
        mean = f["t"] / n
        around = f["q"] - n * mean * mean
        # sum of (x_i - mean)(x_i+1 - mean) over the neighbours
        beside = f["l"] - mean * (2 * f["t"] - f["first"] - f["x"]) + (n - 1) * mean * mean
        serial = F.when(around > 0, (beside / around + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        uneven = (a == 10) | (n < 16) | (chi > UNEVEN) | (kinds > UNEVEN_KINDS) | (F.abs(runs) > UNEVEN_RUNS) | (F.abs(serial) > UNEVEN_SERIAL)
        # under the corpus's words
        pairs = n * (n - 1)
        alike = (null.same * pairs - (x["equal"] - n)) / F.sqrt(2 * pairs * null.same * (1 - null.same) + 4 * pairs * (n - 2) * max(0.0, null.cubes - null.same**2))
        beside_words = (null.mean * (n - 1) - f["score"]) / (null.deviation * F.sqrt(n - 1))
        mixed = F.when(~a.isin(10, 26), (f["changes"] - (n - 1) * null.changes) / F.sqrt(SPREAD * (n - 1) * null.changes * (1 - min(0.9, null.changes)))).otherwise(zero)
        z = F.greatest(alike, beside_words, mixed, (beside_words + mixed) / null.joint)
        tail = F.when(z > 0, (math.log(2) + 0.717 * z + 0.416 * z * z) / math.log(10) - math.log10(4)).otherwise(zero)  # of the normal distribution, for the best of four
        size = F.lit(0)
        for i, (least, _) in enumerate(CLASSES[1:], 1):
            size = F.when(n >= least, F.lit(i)).otherwise(size)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), size.alias("size"), F.when(uneven, -1).otherwise(F.greatest(F.least(F.floor(10 * tail), F.lit(BINS)), F.lit(0))).cast("int").alias("grade"))

    return F.transform(F.transform(F.transform(tokens, coded), counted), graded)


def _scanned(docs: DataFrame, null: Null) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    low = F.lower(text)
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    rows = rows.select(
        "doc_id", spans(text, ASSIGN, 2, LEAST_ASSIGN, word).alias("assign"), spans(text, ACCESS, 0, LEAST_ACCESS, text.contains("AKIA")).alias("access"),
        spans(text, HEX, 0, LEAST_HEX).alias("hex"), spans(text, TOKEN, strings=True).alias("tokens"),
    )
    free = F.filter("tokens", lambda t: ~(overlaps(t, F.col("assign")) | overlaps(t, F.col("access")) | overlaps(t, F.col("hex"))))
    rows = rows.withColumn("tokens", F.when(F.size("tokens") > 0, free).otherwise(F.col("tokens")))
    return rows.withColumn("graded", F.when(F.size("tokens") > 0, battery(F.col("tokens"), null)).otherwise(F.array().cast("array<struct<s:int,e:int,size:int,grade:int>>"))).drop("tokens")


def thresholds(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> list[int]:
    """Per length class the least grade that is a discovery; past the last bin if none is.

    ``histogram`` has (class, grade, count).  Weights average to 1 over all
    strings, so that the weighted step-up procedure holds its rate.
    """
    total = sum(n for _, _, n in histogram)
    of = [sum(n for c, _, n in histogram if c == k) for k in range(len(CLASSES))]
    scale = total / max(1e-9, sum(m * w for m, (_, w) in zip(of, CLASSES, strict=True)))
    shift = [10 * math.log10(w * scale) for _, w in CLASSES] if total else [0.0] * len(CLASSES)
    for grade in range(1, BINS + 1):
        least = [max(1, math.ceil(grade - x)) for x in shift]
        found = sum(n for c, g, n in histogram if g >= least[c])
        if found and total * 10 ** (-grade / 10) <= fdr * found:  # the step-up condition
            return least
    return [BINS + 1] * len(CLASSES)


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of ``docs`` (doc_id, text).

    ``spans`` are kind:start:end by start and then kind, comma-joined, ends
    exclusive; ``base_sha256`` is the digest of the base ones alone so joined.
    A null text is empty and has none.
    """
    # the texts are read once: what the tests say of them is small
    found = stored(_scanned(docs, fitted(docs)))
    counts = found.select(F.explode("graded").alias("g")).groupBy("g.size", "g.grade").count().collect()  # at most len(CLASSES) * (BINS + 2) rows
    least = F.array(*[F.lit(x) for x in thresholds([(r["size"], r["grade"], r["count"]) for r in counts], fdr)])
    random = F.filter("graded", lambda g: g["grade"] >= F.get(least, g["size"]))
    rows = found.withColumn("random", F.when(F.size("graded") > 0, random).otherwise(F.col("graded")))
    order = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda *kinds: F.array_join(F.transform(F.sort_array(F.concat(*[order(k) for k in kinds])), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.encode(joined(*KINDS[:3]), "utf-8"), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
