"""N-gram Jaccard join of documents.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
word shingles.  Documents with equal sets form a class, and only classes meet.

1. A counting sketch of fixed size (``2 ** sketch_bits`` counters) holds how
   often shingles occur in all documents.
2. Every class lists the shingles of its prefix: the ones that a partner must
   share one of, the rarest first under the sketch's counts, ties by hash.  Any
   order that is the same for all sets loses no link.
3. Classes meet on prefix shingles.  The length filter and the positional
   filter, with the sharing shingle's place in both, drop most meetings, and so
   does the suffix filter: the sets' parities by hash bucket differ in no more
   buckets than the sets differ in shingles.
4. Meetings are verified once per pair on the whole sets, fetched only for the
   classes that occur in a pair.
5. Components come from the links.  Within them, blocks of sets meet once more and the links of each document are
   counted, those between near copies whose meetings the first round below spared included.

A shingle shared by thousands of near copies would make all pairs of them meet.
So in a first round a class meets only its neighbours, by size, and the classes
at places 0, 1, 2, 4, 8 and so on under each of its prefix shingles: about
log n meetings of each of n.  The second round makes all meetings of classes that are not
yet in one component, which is what the components still depend on.

The rows of a shingle in more than ``BLOCK_ROWS`` prefixes are dealt to blocks (``_dealt``), so that no
task holds them all, in either round.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import binaries, counted, counter_rows, dropped, only, shared_dir, stored
from varigrid.llm.graph import components
from varigrid.llm.shingles import Shingler, digest, least_overlap, prefix_length

SKETCH_BITS = 20
#: Bits of the filter that says which classes' sets are fetched.
FETCH_BITS = 22
#: A set has about so many parity buckets for each shingle that it may differ from a partner in.
PARITIES = 8


def _sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shingler = np.zeros(1 << bits, np.int64), Shingler(width)
        for batch in batches:
            some: list[np.ndarray] = []
            held = 0
            for a in shingler.sets(batch.column(0)):
                some.append(a)
                held += len(a)
                if held > 1 << 20:
                    total += np.bincount((np.concatenate(some) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    some, held = [], 0
            if some:
                total += np.bincount((np.concatenate(some) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield from counter_rows(np.minimum(total, (1 << 31) - 1))

    return counted(only(docs, "text").mapInArrow(count, "block int, counts binary"), bits)


def rarest(shingles: np.ndarray, counts: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The prefix of a sorted set, rarest first."""
    n = len(shingles)
    if not n:
        return shingles
    p = prefix_length(n, percent)
    c = counts[(shingles >> np.uint64(64 - bits)).astype(np.int64)]
    if p < n:
        keep = c <= np.partition(c, p - 1)[p - 1]
        shingles, c = shingles[keep], c[keep]
    return shingles[np.lexsort((shingles, c))[:p]]


def parities(shingles: np.ndarray, percent: int) -> bytes:
    """Whether an odd number of shingles falls in each bucket; buckets by the hash's low bits."""
    n = len(shingles)
    b = 1 << max(6, (PARITIES * 2 * (n - least_overlap(n, n, percent)) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Buckets of different parity, the finer buckets joined until both have as many."""
    a, b, na, nb = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    while na > nb:
        na >>= 1
        a = a >> na ^ a & (1 << na) - 1
    while nb > na:
        nb >>= 1
        b = b >> nb ^ b & (1 << nb) - 1
    return (a ^ b).bit_count()


def _signatures(docs: DataFrame, width: int, percent: int, bits: int, counts) -> DataFrame:
    """(doc_id, text_hash, n, cls, prefix, odd): per document its set's size and class; a task gives a class's prefix and parities once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rare, seen = Shingler(width), counts.value, set()
        for batch in batches:
            sizes, classes, prefixes, odd = [], [], [], []
            for a in shingler.sets(batch.column(2)):
                d = digest(a)
                sizes.append(len(a))
                classes.append(d)
                if d and d not in seen:
                    seen.add(d)
                    prefixes.append(rarest(a, rare, bits, percent).view(np.int64))
                    odd.append(parities(a, percent))
                else:
                    prefixes.append(None)
                    odd.append(None)
                if len(seen) > 1_000_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), binaries(classes), pa.array(prefixes, pa.list_(pa.int64())), binaries(odd)],
                ["doc_id", "text_hash", "n", "cls", "prefix", "odd"],
            )

    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sign, f"doc_id {_type(docs, 'doc_id')}, text_hash long, n long, cls binary, prefix array<long>, odd binary")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


#: Rows of one shingle that meet in a task; more are dealt to blocks of about so many.
BLOCK_ROWS = 1000
#: Shingles with blocks that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def _crowded(counts: DataFrame, postings: DataFrame) -> DataFrame:
    """``postings`` with the columns of ``counts`` (token, ...), null for other tokens."""
    counts = stored(counts)
    few = counts.count() <= MOST_BROADCAST
    return postings.join(F.broadcast(counts) if few else counts, "token", "left")


def _dealt(postings: DataFrame, whole: bool) -> DataFrame:
    """``postings`` with part and side: rows of a token meet inside parts, those of a side with other sides only; null is no side.

    A token of up to ``BLOCK_ROWS`` rows is one part.  In the first round a larger one's rows are dealt to
    blocks twice, by two hashes, so that what no block links is linked by way of others.  In the
    second, the token's largest component and the rest go to blocks of their own: blocks of the
    former meet blocks of the latter, and those each other, each pair of rows in one part.
    """
    sizes = postings.groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > BLOCK_ROWS)
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("long")
    if not whole:
        rows = _crowded(sizes.select("token", blocks(F.col("rows")).alias("k")), postings)
        parts = [F.pmod(F.xxhash64("cls", "token", F.lit(i)), "k") + i * F.col("k") for i in range(2)]
        rows = rows.withColumn("part", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*parts))))
        return rows.withColumn("side", F.lit(None).cast("long")).drop("k")
    each = postings.join(sizes, "token", "left_semi").groupBy("token", "comp").agg(F.count("*").alias("rows"))
    each = each.groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.max("rows").alias("most"), F.sum("rows").alias("rows"))
    rows = _crowded(each.select("token", "main", blocks(F.col("most")).alias("k"), blocks(F.col("rows") - F.col("most")).alias("m")), postings)
    # a token of one component has no blocks of others, and nobody to meet
    rows = rows.filter("m is null or m > 0").withColumn("own", F.expr("pmod(xxhash64(cls, token), if(comp = main, k, m))"))
    at = lambda part, side: F.struct(part.alias("part"), side.cast("long").alias("side"))
    own, k, m, null = F.col("own"), F.col("k"), F.col("m"), F.lit(None)
    each_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    of_main = F.transform(each_of(m), lambda j: at(own * m + j, F.lit(1)))
    with_main = F.transform(each_of(k), lambda i: at(i * m + own, F.lit(0)))
    with_rest = F.transform(each_of(m), lambda j: at(k * m + F.least(own, j) * m + F.greatest(own, j), F.when(own != j, (own > j).cast("long"))))
    places = F.when(m.isNull(), F.array(at(F.lit(0).cast("long"), null))).when(F.col("comp") == F.col("main"), of_main).otherwise(F.concat(with_main, with_rest))
    return rows.withColumn("place", F.explode(places)).select("token", "n", "pos", "cls", "comp", "odd", "place.part", "place.side")


def _meetings(postings: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b): classes under one shingle that the length, positional and suffix filters let meet.

    ``postings`` (token, n, pos, cls, comp, odd) come grouped by token and part and sorted by n.
    A group's rows are held only as far as their sizes allow a link.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, hubs, recent = None, 0, [], []
        by_comp: dict[tuple, deque] = {}
        known: set[bytes] = set()
        left: list[bytes] = []
        right: list[bytes] = []

        def fits(x, y) -> bool:
            if x[3] == y[3] or 100 * min(x[0], y[0]) < percent * max(x[0], y[0]):
                return False
            need = least_overlap(x[0], y[0], percent)
            return min(x[0] - x[1], y[0] - y[1]) >= need and parity_distance(x[4], y[4]) <= x[0] + y[0] - 2 * need

        def pair(x, y) -> None:
            a, b = (x[2], y[2]) if x[2] < y[2] else (y[2], x[2])
            if a + b not in known:
                if len(known) > 500_000:
                    known.clear()
                known.add(a + b)
                left.append(a)
                right.append(b)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([binaries(left), binaries(right)], ["a", "b"])
            left.clear()
            right.clear()
            return out

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True)
            for token, part, side, *row in rows:
                if (token, part) != group:
                    group, seen, hubs, recent = (token, part), 0, [], []
                    by_comp.clear()
                if whole:
                    for (other, comp), members in by_comp.items():
                        if comp != row[3] and (side is None or other != side):
                            while members and 100 * members[0][0] < percent * row[0]:
                                members.popleft()
                            for x in members:
                                if fits(x, row):
                                    pair(x, row)
                    by_comp.setdefault((side, row[3]), deque()).append(row)
                else:
                    for x in {id(x): x for x in (*hubs, *recent)}.values():
                        if fits(x, row):
                            pair(x, row)
                    recent = [*recent[-1:], row]
                    if seen & (seen - 1) == 0:
                        hubs.append(row)
                    seen += 1
                if len(left) >= 20_000:
                    yield flush()
        if left:
            yield flush()

    rows = _dealt(postings, whole).select("token", "part", "side", "n", "pos", "cls", "comp", "odd")
    ordered = rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "cls")
    return ordered.mapInArrow(meet, "a binary, b binary").distinct()


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(cls, items): the sets of the classes in ``needed`` (cls), as bytes of sorted 64-bit hashes.

    A bitmap of fixed size keeps most other sets from moving, and a task sends a class once.
    """
    spark = docs.sparkSession

    def place(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8")[::2] >> np.uint64(64 - FETCH_BITS) if keys else np.empty(0, np.uint64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FETCH_BITS, np.uint32)
        for batch in batches:
            flags[place(batch.column(0).to_pylist()).astype(np.int64)] = 1
        yield from counter_rows(flags)

    flags = spark.sparkContext.broadcast(np.packbits(counted(needed.mapInArrow(mark, "block int, counts binary"), FETCH_BITS) > 0))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted, sent = Shingler(width), flags.value, set()
        for batch in batches:
            classes, sets, held = [], [], 0
            for a in shingler.sets(batch.column(0)):
                d = digest(a)
                if d and d not in sent:
                    at = int.from_bytes(d[:8], "little") >> (64 - FETCH_BITS)
                    if wanted[at >> 3] >> (7 - (at & 7)) & 1:
                        sent.add(d)
                        classes.append(d)
                        sets.append(a.tobytes())
                        held += len(sets[-1])
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([binaries(classes), binaries(sets)], ["cls", "items"])
                    classes, sets, held = [], [], 0
            if classes:
                yield pa.RecordBatch.from_arrays([binaries(classes), binaries(sets)], ["cls", "items"])

    sets = only(docs, "text").mapInArrow(fetch, "cls binary, items binary")
    return sets.join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("items").alias("items"))


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs of classes that link, by their whole sets."""
    spark = docs.sparkSession
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    path = shared_dir(spark)
    sets = stored(_sets(docs, needed, width), path)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if linked(x, y, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([binaries([a[i] for i in keep]), binaries([b[i] for i in keep])], ["a", "b"])

    with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("b_items")), "b")
    both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("a_items")), "a")
    found = stored(both.select("a", "b", "a_items", "b_items").mapInArrow(verify, "a binary, b binary"))
    dropped(spark, path)
    return found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    need = least_overlap(len(x), len(y), percent)
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


#: Shingles of the sets that one block of a component holds; two blocks meet in a task.
BLOCK_SHINGLES = 2_000_000
#: Numbers in the matrix of a tile of sets.
TILE = 8_000_000


def _tiles(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Runs of sets, ordered by size, whose matrix stays under ``TILE`` numbers."""
    out, i = [], 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or (total + len(sets[j])) * (j + 1 - i) <= TILE // 2):
            total += len(sets[j])
            j += 1
        out.append((i, j))
        i = j
    return out


def _matrix(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), np.float32)
    for k, x in enumerate(sets):
        out[k, np.searchsorted(known, x)] = 1
    return out


def count_links(left: list[np.ndarray], right: list[np.ndarray] | None, left_copies: np.ndarray, right_copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many copies each set of either side links to on the other; without a right side, of the left side's others.

    Sets come ordered by size.  Intersections of a tile of sets with another are one matrix product, and
    each pair is looked at once.
    """
    same = right is None
    other, weights = (left, left_copies) if same else (right, right_copies)
    a_links, b_links = np.zeros(len(left), np.int64), np.zeros(len(other), np.int64)
    for i, j in _tiles(left):
        for k, m in _tiles(other):
            if same and k < i or 100 * len(left[j - 1]) < percent * len(other[k]) or 100 * len(other[m - 1]) < percent * len(left[i]):
                continue
            known = np.unique(np.concatenate([*left[i:j], *other[k:m]]))
            both = _matrix(left[i:j], known) @ _matrix(other[k:m], known).T
            n, o = (np.array([len(x) for x in xs], np.float64) for xs in (left[i:j], other[k:m]))
            linked = 100 * both >= percent * (n[:, None] + o[None, :] - both)
            if same and i == k:
                np.fill_diagonal(linked, False)
            a_links[i:j] += linked @ weights[k:m]
            if not same or i != k:
                b_links[k:m] += left_copies[i:j] @ linked
    return (a_links + b_links, b_links[:0]) if same else (a_links, b_links)


def _link_counts(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(cls, links): the documents of other classes that each class of ``classes`` (cls, n, copies, root) links to.

    Links stay inside components.  A component's classes are dealt to blocks of about ``BLOCK_SHINGLES``
    shingles, and each pair of blocks is one task's: no task holds a component, and no pair is a row.
    """
    sizes = classes.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    inside = stored(classes.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("own", F.expr("int(pmod(xxhash64(cls), blocks))")))
    sets = _sets(docs, inside.select("cls"), width)
    met = inside.join(sets, "cls").select("root", "cls", "copies", "own", "n", "items", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = met.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "n", "cls", "copies", "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            _, i, j = key
            sides = [[r for r in held if r[0] == side] for side in ((i,) if i == j else (i, j))]
            sets = [[np.frombuffer(r[4], np.uint64) for r in rows] for rows in sides]
            copies = [np.array([r[3] for r in rows], np.int64) for rows in sides]
            links = count_links(sets[0], sets[1] if i != j else None, copies[0], copies[-1], percent)
            return pa.RecordBatch.from_arrays([binaries([r[2] for rows in sides for r in rows]), pa.array(np.concatenate(links))], ["cls", "links"])

        for batch in batches:
            for root, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, i, j) != key:
                    if held:
                        yield done()
                    key, held = (root, i, j), []
                held.append(row)
        if held:
            yield done()

    ordered = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "own", "n")
    return ordered.mapInArrow(count, "cls binary, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links), a row for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the row's own
    included; ``class_id`` the smallest doc_id with the same set; ``n_links`` the number of other rows it
    links to, those with its set included.  Rows with an
    empty set (null text, no words) stay alone: both are their own doc_id, without a link.  A
    null doc_id takes part and is never the smallest; it gets its component's
    id, or null where that has none.  Repeated rows come out as often as they
    go in.  An empty table gives an empty result.
    """
    found = stored(_grouped(docs, width, percent, sketch_bits))
    classes = stored(found.filter("n_shingles > 0").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.first("root").alias("root")))
    links = _link_counts(docs, classes, width, percent)
    by_class = classes.join(links, "cls", "left").select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = found.join(by_class, "cls", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return joined.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def _grouped(docs: DataFrame, width: int, percent: int, sketch_bits: int) -> DataFrame:
    """The columns of ``jaccard_components`` but for links, with cls, text_hash and root: the set's digest, what tells a row
    from others of its id, and a component from others of its smallest id; root is null for an empty set."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_sketch(docs, width, sketch_bits))
    signed = stored(_signatures(docs, width, percent, sketch_bits, counts))
    prefixes = signed.filter("prefix is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
    entries = prefixes.select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
    paired = entries.repartition("token").sortWithinPartitions("token", "n").mapInArrow(_with_company(percent), entries.schema)
    path = shared_dir(spark)
    postings = stored(paired.join(prefixes.select("cls", "odd"), "cls"), path)

    met = stored(_meetings(postings.withColumn("comp", F.col("cls")), percent, whole=False))
    first = components(_links(docs, met, width, percent)).withColumnRenamed("node", "cls")
    labelled = postings.join(first, "cls", "left").withColumn("comp", F.coalesce("root", "cls"))
    rest = stored(_meetings(labelled, percent, whole=True).join(met, ["a", "b"], "left_anti"))
    links = _links(docs, rest, width, percent)
    # of all links between two components of the first round, one is enough
    ends = links.join(first.select(F.col("cls").alias("a"), F.col("root").alias("x")), "a", "left").join(first.select(F.col("cls").alias("b"), F.col("root").alias("y")), "b", "left")
    joined = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b").distinct())
    dropped(spark, path)

    ids = signed.groupBy("cls").agg(F.min("doc_id").alias("class_id")).join(first, "cls", "left").withColumn("node", F.coalesce("root", "cls")).drop("root")
    # written, as are components: else each use below would repeat the plan, and the driver holds the plans of all stages at once
    ids = stored(ids.join(joined, "node", "left").select("cls", "class_id", F.coalesce("root", "node").alias("root")))
    least = ids.groupBy("root").agg(F.min("class_id").alias("component_id"))
    ids = ids.join(least, "root").select("cls", "class_id", "component_id", "root")
    alone = F.col("n") == 0
    return signed.select("doc_id", "text_hash", "n", "cls").join(ids, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "text_hash",
        F.when(~alone, F.col("root")).alias("root"),
        "cls",
    )


#: Groups up to this size are looked through pair by pair for rows that can meet.
SMALL = 64


def _with_company(percent: int):
    """Of rows (cls, n, pos, token) sorted by token and n, those that the length
    and positional filters let meet some other row; in a large group, those that
    the length filter lets meet a neighbour."""

    def near(n: np.ndarray, before: int | None) -> np.ndarray:
        close = 100 * n[:-1] >= percent * n[1:]
        return np.append(close, False) | np.append(before is not None and 100 * before >= percent * n[0], close)

    def usable(n: np.ndarray, pos: np.ndarray, before: int | None) -> np.ndarray:
        if before is not None or len(n) > SMALL:
            return near(n, before)
        a, b = n[:, None], n[None, :]
        good = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.minimum(a - pos[:, None], b - pos[None, :]) >= least_overlap(a, b, percent))
        np.fill_diagonal(good, False)
        return good.any(axis=1)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last token's rows not judged yet, and the size of the one before them
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token = whole.column(3).to_numpy()
            last = len(token) - int(np.argmax(token[::-1] != token[-1])) if token[0] != token[-1] else 0
            if last:
                yield select(whole.slice(0, last), before)
                before = None
            held = whole.slice(last)
            if held.num_rows > 2 * SMALL:
                # a large group: all but its last row, whose next neighbour may come yet
                n = held.column(1).to_numpy().astype(np.int64)
                yield held.slice(0, len(n) - 1).filter(pa.array(near(n, before)[:-1]))
                held, before = held.slice(len(n) - 1), int(n[-2])
        if held is not None:
            yield select(held, before)

    def select(rows: pa.RecordBatch, before: int | None) -> pa.RecordBatch:
        n, pos, token = (rows.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
        edges = np.flatnonzero(token[1:] != token[:-1]) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(token))
        some = (ends - starts > 1) | ((starts == 0) & (before is not None))
        keep = np.zeros(len(token), bool)
        for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
            keep[a:b] = usable(n[a:b], pos[a:b], before if a == 0 else None)
        return rows.filter(pa.array(keep))

    return filtered


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its smallest doc_id.

    Rows are told apart by id and text, so what happens to one says nothing of
    others with its id.  Of a component's rows with the smallest id, those of
    the text of the least hash stay: one, but for rows that repeat both id and
    text.  Rows with an empty set and rows with a null doc_id whose component
    has no id stay all.
    """
    found = stored(_grouped(docs, width, percent, SKETCH_BITS).filter("n_shingles > 0 and component_id is not null").select("doc_id", "text_hash", "component_id", "root").distinct())
    heads = found.filter("doc_id = component_id")
    first = heads.groupBy("root").agg(F.min("text_hash").alias("least"))
    others = heads.join(first, "root").filter("text_hash > least").select("doc_id", "text_hash")
    lost = found.filter("doc_id is null or doc_id > component_id").select("doc_id", "text_hash").union(others)
    lost = lost.select(F.col("doc_id").alias("_lost"), F.col("text_hash").alias("_hash"))
    return docs.join(lost, (F.xxhash64(docs["text"]) == lost["_hash"]) & docs["doc_id"].eqNullSafe(lost["_lost"]), "left_anti")
