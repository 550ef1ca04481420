"""Canonical exact digests of texts.

A text's canonical form is its NFKC normalisation, case-folded, normalised
again, with runs of white space turned into one space and none at the ends.
Its fingerprint is a 128-bit digest made of two 64-bit xxhash values of that
form.  Rows of one fingerprint form a bucket, and the canonical bytes are
compared inside buckets, so that texts which only share a digest part again.

All of it is SQL functions.  The JVM's own ICU library, which Spark ships with,
normalises and folds through the SQL function ``java_method``; texts of ASCII
alone need neither.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import only, stored

_NFKC = "com.ibm.icu.text.Normalizer", "compose"
_FOLD = "com.ibm.icu.lang.UCharacter", "foldCase"


def canonical(text: Column) -> Column:
    """The canonical form; that of null is empty."""
    text = F.coalesce(text, F.lit(""))
    static = lambda method, x: F.java_method(*map(F.lit, method), x, F.lit(True))
    folded = static(_NFKC, static(_FOLD, static(_NFKC, text)))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(plain, r"[\s\x{85}\p{Z}]+", " "))


def fingerprint(canon: Column) -> Column:
    """128 bits of a canonical form as 32 hexadecimal digits."""
    half = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("second"), canon, F.length(canon))))


#: Bits of the filter that says which texts may be in a bucket of several rows: a table of at most ``FILTER_BITS / 32768`` rows of 4 KiB.
FILTER_BITS = 1 << 25
#: Parts that a group of equal texts is counted and joined in.
SALTS = 64
#: Digests that different texts share are broadcast up to this number.
MOST_BROADCAST = 100_000


def colliding(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest): the digests that different canonical texts share.

    ``rows`` (digest, sha, edited_digest, edited_sha, raw) say of the rows of
    ``docs`` (text) what ``read`` does.  Digests are counted first.  Canonical
    texts move for digests that occur more than once, as far as a bitmap of
    bounded size over their raw texts' hashes can tell; each task sends a text
    of a bucket once, and a bucket's texts are compared byte by byte, as
    grouping keys.  Edited texts, which are no rows of the corpus, are told apart
    by SHA-256.
    """
    many = rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    raws = rows.select("digest", "raw").distinct().join(many, "digest", "left_semi").select("raw")
    bit = F.pmod(F.col("raw"), F.lit(FILTER_BITS))
    place = lambda df: df.withColumns({"_bucket": F.floor(bit / 32768), "_bit": (bit % 32768).cast("int")})
    bitmaps = place(raws).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("raw", F.xxhash64("text"))
    maybe = place(texts).join(F.broadcast(bitmaps), "_bucket").filter(byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0)
    canon = maybe.select(canonical(F.col("text")).alias("canon")).select("canon", fingerprint(F.col("canon")).alias("digest"))
    unlike = canon.distinct().groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    pairs = F.array(F.struct(F.col("digest").alias("d"), F.col("sha").alias("s")), F.struct(F.col("edited_digest").alias("d"), F.col("edited_sha").alias("s")))
    shas = rows.select(F.explode(pairs).alias("x")).select("x.d", "x.s").distinct().groupBy(F.col("d").alias("digest")).agg(F.count("*").alias("n"))
    return unlike.union(shas.filter("n > 1").select("digest")).distinct()


#: Ranges of rows that neighbours are looked for in, for each shuffle partition, and sampled rows for each range.
RANGES, SAMPLED = 4, 20


def with_next(rows: DataFrame, *ahead: str) -> DataFrame:
    """Each row of ``rows`` (doc_id, raw, text, ...) with the ``ahead`` columns of the next as ``next_...``.

    The order is by doc_id, nulls first, then ``raw``, a hash of the text, then
    text; the last row's next one is the first.  Rows are cut into ranges of
    (doc_id, raw) at quantiles of a sample, so no task orders them all and the
    rows of one id are cut too; where the cuts lie changes no result.  The first
    row of a range also goes to the range before it, where it only serves as the
    next one.
    """
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = f"struct<doc_id:{rows.schema['doc_id'].dataType.simpleString()},raw:bigint>"
    key = F.struct(F.col("doc_id"), F.col("raw"))
    sample = rows.select(key.alias("key")).orderBy(F.rand(7)).limit(SAMPLED * ranges)  # bounded by the limit
    some = [r[0] for r in sample.sort("key").select(F.to_json("key")).collect()]
    cuts = list(dict.fromkeys(some[SAMPLED::SAMPLED]))
    bounds = F.from_json(F.lit(f"[{','.join(cuts)}]"), f"array<{kind}>")
    # binary search: how many bounds are at most the key
    probe = lambda acc, width: F.when((acc + width <= len(cuts)) & (F.get(bounds, acc + width - 1) <= key), acc + width).otherwise(acc)
    place = F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))]), F.lit(0), probe)
    rows = rows.withColumn("_range", place)
    # one row a range: its first key
    firsts = sorted((r["_range"], r["first"]) for r in rows.groupBy("_range").agg(F.to_json(F.min(key)).alias("first")).collect())
    heads: list[dict | None] = [None] * (len(cuts) + 1)
    for i, (here, first) in enumerate(firsts):
        heads[here] = {"range": firsts[i - 1][0], "ghost": 1 if i else 2, "key": json.loads(first)}
    head = F.get(F.from_json(F.lit(json.dumps(heads)), f"array<struct<range:int,ghost:int,key:{kind}>>"), F.col("_range"))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("ghost"))
    spots = F.when(key == head["key"], F.array(own, F.struct(head["range"].alias("range"), head["ghost"].alias("ghost")))).otherwise(F.array(own))
    names = [c for c in rows.columns if c != "_range"]
    placed = rows.select(*names, F.explode(spots).alias("_at")).select(*names, F.col("_at.range").alias("_range"), F.col("_at.ghost").alias("_ghost"))
    order = "partition by _range order by _ghost, doc_id, raw, text"
    ordered = placed.select("*", *[F.expr(f"lead({c}) over ({order})").alias(f"next_{c}") for c in ahead])
    return ordered.filter("_ghost = 0").drop("_range", "_ghost")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half, rounded down, replaced by as many of the next one's first code points."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def read(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), without the text.

    (doc_id, n_chars, raw, digest, sha, edited_sha256, edited_digest, edited_sha,
    near_edited, near_next): ``raw`` is a hash of the text, ``sha`` SHA-256 of the
    canonical form.  A text is canonicalised once before the one shuffle of
    texts, its edited text once after it, and both again only where digests are
    equal and bytes are compared.
    """
    sha = lambda c: F.unhex(F.sha2(F.encode(c, "utf-8"), 256))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("raw"), canonical(F.col("text")).alias("canon"))
    rows = rows.select("doc_id", "text", "raw", fingerprint(F.col("canon")).alias("digest"), sha(F.col("canon")).alias("sha"))
    rows = with_next(rows, "text", "digest")
    rows = rows.select("*", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = rows.select("*", canonical(F.col("edited")).alias("edited_canon"))
    rows = rows.select("*", fingerprint(F.col("edited_canon")).alias("edited_digest"))
    same = lambda digest, canon: F.when((F.col("digest") == digest) & (canonical(F.col("text")) == canon), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "raw", "digest", "sha",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "edited_digest", sha(F.col("edited_canon")).alias("edited_sha"),
        same(F.col("edited_digest"), F.col("edited_canon")).alias("near_edited"),
        same(F.col("next_digest"), canonical(F.col("next_text"))).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, class_id, copies): likeness is 1 where the digests
    and then the canonical bytes are equal, else 0.  ``class_id`` is the
    smallest id with the row's fingerprint, and ``copies`` how many rows have it.  A
    fingerprint is the digest, with SHA-256 of the canonical text behind it where
    different texts share the digest, whether they are rows or edited texts.  A
    null text is empty.  A lone row is its own next one; repeated ids follow each
    other by a hash of the text, and rows that repeat both are each other's next.
    """
    docs = only(docs, "doc_id", "text")
    rows = stored(read(docs))
    shared = stored(colliding(rows, docs))
    n = shared.count()
    named = rows.withColumns({"fingerprint": F.col("digest"), "edited_fingerprint": F.col("edited_digest")})
    for name, sha in (("fingerprint", "sha"), ("edited_fingerprint", "edited_sha")) if n else ():
        hit = shared.select(F.col("digest").alias("_digest"))
        named = named.join(F.broadcast(hit) if n <= MOST_BROADCAST else hit, F.col(name) == F.col("_digest"), "left")
        named = named.withColumn(name, F.when(F.col("_digest").isNull(), F.col(name)).otherwise(F.concat_ws("-", name, F.lower(F.hex(sha))))).drop("_digest")
    # a group is counted and joined in parts, so that no task has all rows of a large one
    named = named.withColumn("_part", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    parts = named.groupBy("fingerprint", "_part").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    groups = parts.groupBy("fingerprint").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"))
    groups = parts.select("fingerprint", "_part").join(groups, "fingerprint")
    return named.join(groups, ["fingerprint", "_part"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "copies"
    )
