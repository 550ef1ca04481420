"""Candidate alleles from aligned reads, and how they are made one."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from varigrid.operators import blocks
from varigrid.sources import shared

_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
#: Letters of reads that are walked at once.
LETTERS = 1 << 18
#: Beyond all places.
_FAR = 1 << 62
_LETTERS = pa.array(list("ACGTN"))
_COLLAPSED = {"chrom": "string", "pos": "long", "ref": "string", "alt": "string", "open_left": "boolean", "open_right": "boolean", "support": "long", "coverage": "long"}
_REALLOCATED = {"chrom": "string", "pos": "long", "ref": "string", "alt": "string", "support": "long", "callable": "boolean"}
_KIND = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_()]


def found(reads: DataFrame, min_q: int = 20, mnvs: bool = False, most_length: int = 3, most_gap: int = 1) -> DataFrame:
    """(chrom, pos, ref, alt, dir, open_left, open_right) of each read (chrom, pos, cigar, bases, quals, reference, dir).

    ``reference`` holds the reference's bases from the read's place on.  In
    aligned runs mismatching bases make substitutions, or one longer allele with
    ``mnvs`` while its length allows and matches in between are no longer than
    ``most_gap``.  Bases of poor quality end an allele and leave it open.
    Insertions and deletions keep the base before them; deletions need both
    neighbours' quality.
    """

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Runs of reads with at most ``LETTERS`` letters, or one longer read."""
        ends = np.cumsum(np.maximum(pc.utf8_length(batch.column(3)).to_numpy(zero_copy_only=False), 1))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LETTERS, "right")))
            yield batch.slice(i, j - i)
            i = j

    def alleles(batch: pa.RecordBatch) -> pa.RecordBatch:
        cigars, bases, quals, reference = (batch.column(i) for i in (2, 3, 4, 5))
        b, b_at = _codes(bases)
        r, r_at = _codes(reference)
        q_at = quals.offsets.to_numpy().astype(np.int64)
        q = quals.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(np.stack([b_at, r_at, q_at]), axis=1)
        read, base, ref, long, others, ops = [], [], [], [], [], {}
        for k, cigar in enumerate(_listed(cigars)):
            if cigar not in ops:
                ops[cigar] = _placed(cigar)
            for op, n, at, ref_at in ops[cigar]:
                if op in "M=X":
                    read.append(k), base.append(at), ref.append(ref_at), long.append(n)
                else:
                    others.append((k, op, n, at, ref_at))
        read, base, ref, long = (np.array(v, np.int64) for v in (read, base, ref, long))
        if np.any((base + long > sizes[0][read]) | (ref + long > sizes[1][read]) | (base + long > sizes[2][read])):
            raise IndexError("an alignment is longer than its read's bases, qualities or reference")
        # a letter of an aligned run each
        run = np.repeat(np.arange(len(read)), long)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(long) - long, long)
        b_i, r_i = (b_at[read] + base)[run] + inside, (r_at[read] + ref)[run] + inside
        poor = (q[(q_at[read] + base)[run] + inside] < min_q) | (b[b_i] == ord("N"))
        wrong = np.flatnonzero((b[b_i] != r[r_i]) & ~poor)
        # chains of mismatches that may be one allele, without poor bases between; an allele begins at a chain's head, and where it would be too long
        before = np.cumsum(poor)
        linked = (run[wrong[1:]] == run[wrong[:-1]]) & (np.diff(wrong) - 1 <= most_gap) & (before[wrong[1:]] == before[wrong[:-1]])
        chain = np.cumsum(np.concatenate([[True], ~linked if mnvs else np.ones(len(linked), bool)])[: len(wrong)])
        after = np.minimum(np.searchsorted(wrong, wrong + most_length), np.searchsorted(chain, chain, "right"))
        begins = np.zeros(len(wrong), bool)
        at = np.flatnonzero(np.concatenate([[True], np.diff(chain) > 0])[: len(wrong)])
        while len(at):
            begins[at] = True
            then = after[at]
            then_in = then < len(wrong)
            at = then[then_in][chain[then[then_in]] == chain[at[then_in]]]
        first = np.flatnonzero(begins)
        s, e = wrong[first], wrong[after[first] - 1] + 1
        edge = np.append(poor, False)
        left = (s > 0) & edge[s - 1] & (inside[s] > 0)
        right = edge[e] & (np.append(run, -1)[e] == run[s])
        n = e - s
        of = read[run[s]]
        pos = batch.column(1).to_numpy(zero_copy_only=False)[of] + ref[run[s]] + inside[s]
        columns = [batch.column(0).take(pa.array(of)), pa.array(pos, pa.int64()), _texts(r, r_i[s], n), _texts(b, b_i[s], n), batch.column(6).take(pa.array(of)), pa.array(left), pa.array(right)]
        rows = []
        reads = list(zip(*map(_listed, (batch.column(0), batch.column(1), bases, reference, batch.column(6))), strict=True)) if others else []
        q_at = q_at.tolist()
        for k, op, n, at, ref_at in others:
            chrom, pos, own, known, way = reads[k]
            if op == "I":
                if at and q[q_at[k] + at : min(q_at[k] + at + n, q_at[k + 1])].min() >= min_q and "N" not in own[at : at + n]:
                    anchor = known[ref_at - 1]
                    rows.append((chrom, pos + ref_at - 1, anchor, anchor + own[at : at + n], way, False, at + n == len(own)))
            elif at and at < len(own) and q[q_at[k] + at - 1 : q_at[k] + at + 1].min() >= min_q:
                rows.append((chrom, pos + ref_at - 1, known[ref_at - 1 : ref_at + n], known[ref_at - 1], way, False, False))
        more = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_KIND), _KIND, strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([c.cast(t), m]) for c, m, t in zip(columns, more, _KIND, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield alleles(part)

    names = ["chrom", "pos", "ref", "alt", "dir", "open_left", "open_right"]
    kind = "chrom string, pos long, ref string, alt string, dir int, open_left boolean, open_right boolean"
    return reads.select("chrom", "pos", "cigar", "bases", "quals", "reference", "dir").mapInArrow(each, kind)


def _placed(cigar: str) -> list[tuple[str, int, int, int]]:
    """(operation, length, bases before it, reference places before it) of matches, insertions and deletions."""
    out, at, ref_at = [], 0, 0
    for n, op in _OPS.findall(cigar):
        n = int(n)
        if op in "M=XID":
            out.append((op, n, at, ref_at))
        at += n if op in "M=XIS" else 0
        ref_at += n if op in "M=XDN" else 0
    return out


def _listed(column: pa.Array) -> list:
    """Values of a column; without nulls a list comes faster from numpy."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _numbers_of(column: pa.Array, none: int = 0) -> np.ndarray:
    """Numbers or flags, ``none`` for nulls."""
    return pc.fill_null(column.cast(pa.int64()), none).to_numpy(zero_copy_only=False)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text starts (texts + 1)."""
    column = column.cast(pa.string())
    sizes = _numbers_of(pc.utf8_length(column))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) and ends[-1] - ends[0] == starts[-1]:  # a byte a letter
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if starts[-1] else np.zeros(0, np.uint8), starts
    return np.frombuffer("".join(_listed(column)).encode("utf-32-le"), np.uint32), starts


def _texts(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """The texts of ``n`` code points from each ``start``."""
    ends = np.cumsum(n)
    picked = codes[np.repeat(start - (ends - n), n) + np.arange(n.sum())]
    if np.any(picked > 127):
        whole = picked.tobytes().decode("utf-32-le")
        return pa.array([whole[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.string())
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.astype(np.uint8).tobytes()))


def counted(candidates: DataFrame, *by: str) -> DataFrame:
    """(chrom, pos, ref, alt, by, support): equal candidates counted.  Columns of ``by`` are flags or numbers from 0 to 2.

    The place and the flags are one number and both alleles one text till they are counted, which halves the rows that are shuffled.
    """
    place = F.col("pos")
    for c in by:
        place = place * 4 + F.coalesce(F.col(c).cast("int"), F.lit(3))
    rows = candidates.select("chrom", place.alias("_place"), F.concat_ws(">", "ref", "alt").alias("_change"))
    rows = rows.groupBy("chrom", "_place", "_change").agg(F.count("*").alias("support"))
    flags = [F.shiftright("_place", 2 * i).bitwiseAND(F.lit(3)) for i in reversed(range(len(by)))]
    at = F.instr("_change", ">")
    kinds = candidates.schema
    return rows.select(
        "chrom", F.shiftright("_place", 2 * len(by)).alias("pos"), F.substring_index("_change", ">", 1).alias("ref"), F.when(at > 0, F.substring(F.col("_change"), at + 1, F.length("_change"))).alias("alt"),
        *[F.when(f < 3, f).cast("int").cast(kinds[c].dataType).alias(c) for c, f in zip(by, flags, strict=True)], "support",
    )


def spans(candidates: DataFrame, reach: int = 1) -> DataFrame:
    """Adds ``span``, its first place: runs of candidates (chrom, pos, ref) that touch or overlap, so that what may be made one shares a group."""
    rows = blocks.running(candidates, ["chrom"], "pos", ["pos", "ref", "alt"], F.col("pos") + F.length("ref") - 1, "_end")
    opened = F.when(F.col("_end").isNull() | (F.col("pos") > F.col("_end") + reach), F.col("pos"))
    return blocks.running(rows, ["chrom"], "pos", ["pos", "ref", "alt"], opened, "span", own=True).drop("_end")


def by_span(candidates: DataFrame, work: Callable[[list[dict]], list[tuple]], busy: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], reach: int = 1) -> DataFrame:
    """What ``work`` makes of the candidates (chrom, pos, ref) of each span, a dictionary a row, as rows of the same columns.

    ``busy`` names the rows of whole spans, in order and with a number a span, that ``work`` has to see; others
    stay as they are and never become Python objects.
    Rows are written once, shuffled once, to blocks of positions, and a task goes through a block
    in order and keeps one span at a time.  A block begins with a row that says how far
    the earlier ones reach and where the next one begins, so spans that lie in one
    block are known there; the few that cross borders are brought together after it.
    """
    candidates = shared.written(candidates)
    columns = candidates.columns
    keyed = candidates.withColumn("_block", F.floor(F.col("pos") / blocks.WIDTH))
    ends = keyed.groupBy("chrom", "_block").agg(F.max(F.col("pos") + F.length("ref") - 1).alias("_top"), F.min("pos").alias("_first"))
    # a row a block from here on
    order = Window.partitionBy("chrom").orderBy("_block")
    ends = ends.withColumns({"_before": F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("_first").over(order)})
    ends = shared.written(ends)
    kind = candidates.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def numbered(rows: pa.RecordBatch, last: bool, inner: bool) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch | None]:
        """A span's number a row, whether it is asked for, and the rows of the last span, which may go on, after their block's first row."""
        row = _numbers(rows, "_row").astype(bool)
        pos, at = _numbers(rows, "pos"), np.arange(len(row))
        stop = np.where(row, pos + _sizes(rows, "ref") - 1, _numbers(rows, "_before", -_FAR))
        top = _greatest(stop, np.cumsum(~row))
        opened = np.append(False, row[1:] & (pos[1:] > top[:-1] + reach))
        first = np.flatnonzero(opened | ~row)
        ends_block = np.append(~row[first[1:]], True)
        head = np.maximum.accumulate(np.where(row, 0, at))[first]
        done = ~ends_block | (_numbers(rows, "_next", _FAR)[head] > top[np.append(first[1:], len(row)) - 1] + reach)
        wanted = (opened[first] & done) == inner
        held = None
        if not last:
            wanted[-1] = False
            held = pa.concat_batches([rows.slice(head[-1], 1), rows.slice(max(first[-1], head[-1] + 1))])
        span = np.cumsum(opened | ~row) - 1
        return span, wanted[span] & row, held

    def sweep(batches: Iterator[pa.RecordBatch], inner: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows and spans' numbers of spans of one block, or with ``inner`` false what others have of the spans."""
        held, waiting = None, []
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting += [batch] if batch.num_rows else []
                # a long span is looked at again when it has doubled
                if not waiting or (held is not None and sum(b.num_rows for b in waiting) < held.num_rows):
                    continue
            some = [b for b in (held, *waiting) if b is not None]
            if some:
                rows = pa.concat_batches(some)
                span, wanted, held = numbered(rows, batch is None, inner)
                waiting = []
                yield rows.filter(pa.array(wanted)).select(columns), span[wanted]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, span in sweep(batches, True):
            some = busy(rows, span)
            yield rows.filter(pa.array(~some))
            seen, at = rows.filter(pa.array(some)), span[some]
            each = [dict(zip(columns, v, strict=True)) for v in zip(*map(_listed, seen.columns), strict=True)]
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(each)]
            yield made([x for i, j in zip(edges, edges[1:]) if i < j for x in work(each[i:j])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in sweep(batches, False):
            yield rows

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, span = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if span and (r["chrom"], r["span"]) != key:
                    out += work(span)
                    span = []
                key = r["chrom"], r["span"]
                span.append(r)
            yield made(out)
        if span:
            yield made(work(span))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), schema, strict=True)], columns)

    schema = to_arrow_schema(candidates.schema)

    def laid(rows: DataFrame, firsts: DataFrame) -> DataFrame:
        none = [F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in columns if c != "chrom"]
        heads = firsts.select("_block", F.lit(False).alias("_row"), "_before", "_next", "chrom", *none)
        rows = rows.select("_block", F.lit(True).alias("_row"), F.lit(None).cast("long").alias("_before"), F.lit(None).cast("long").alias("_next"), "chrom", *[c for c in columns if c != "chrom"])
        every = heads.unionByName(rows).select("_block", "_row", "_before", "_next", *columns)
        return every.repartition("chrom", "_block").sortWithinPartitions("chrom", "_block", "_row", "pos", "ref")

    crossing = ends.filter((F.col("_before") + reach >= F.col("_first")) | (F.greatest("_top", "_before") + reach >= F.col("_next")))
    some = keyed.join(F.broadcast(crossing.select(F.col("chrom").alias("_c"), F.col("_block").alias("_b"))), F.col("chrom").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left_semi")
    rest = spans(laid(some, crossing).mapInArrow(cut, kind), reach)
    across = rest.repartition("chrom", "span").sortWithinPartitions("chrom", "span").mapInArrow(joined, kind)
    return laid(keyed, ends).mapInArrow(whole, kind).unionByName(across)


def _numbers(rows: pa.RecordBatch, name: str, none: int = 0) -> np.ndarray:
    return _numbers_of(rows.column(name), none)


def _sizes(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return _numbers_of(pc.utf8_length(rows.column(name)))


def _greatest(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The greatest value so far of each group's rows, which follow one another; groups' numbers rise."""
    known, rank = np.unique(values, return_inverse=True)
    return known[np.maximum.accumulate(group * len(known) + rank) - group * len(known)]


def _shared(keys: list[np.ndarray], open_ones: np.ndarray) -> np.ndarray:
    """Rows that have a key with another row, an open one among them.  Keys are hashed, so a few rows more may be named."""
    mixed = np.zeros(len(open_ones), np.uint64)
    for k in keys:
        mixed = (mixed ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, of, n = np.unique(mixed, return_inverse=True, return_counts=True)
    return ((n > 1) & (np.bincount(of, weights=open_ones, minlength=len(n)) > 0))[of]


def collapsed(candidates: DataFrame, ratio: float = 0.5, least_frequency: float = 0.0) -> DataFrame:
    """Open-ended candidates (chrom, pos, ref, alt, open_left, open_right, support, coverage) given to longer ones that hold them.

    The longest open candidate goes first, of equal length those open at both
    ends.  Candidates of its kind (insertion, deletion, other) that are no shorter
    can take its support if they agree with it at its closed end: in place
    and bases, deletions in place alone.  Of those at least ``ratio`` as frequent, a closed one and
    then the best supported takes it, and stays open only where both are.
    """

    def kind(r: dict) -> int:
        return (len(r["alt"]) > len(r["ref"])) - (len(r["alt"]) < len(r["ref"]))

    def size(r: dict) -> int:
        return abs(len(r["alt"]) - len(r["ref"])) or len(r["alt"])

    def holds(t: dict, r: dict) -> bool:
        if kind(t) != kind(r) or size(t) < size(r):
            return False
        if not (r["open_left"] or r["open_right"]):
            return not (t["open_left"] or t["open_right"]) and all(t[k] == r[k] for k in ("pos", "ref", "alt"))
        k = kind(r)
        if k < 0:
            return t["pos"] == r["pos"] if r["open_right"] else t["pos"] + len(t["ref"]) == r["pos"] + len(r["ref"])
        if r["open_right"]:
            return t["pos"] == r["pos"] and t["alt"].startswith(r["alt"])
        if k > 0:
            return t["pos"] == r["pos"] and t["alt"].endswith(r["alt"][1:])
        return t["pos"] + len(t["alt"]) == r["pos"] + len(r["alt"]) and t["alt"].endswith(r["alt"])

    def one(rows: list[dict]) -> list[tuple]:
        turn = sorted((r for r in rows if r["open_left"] or r["open_right"]), key=lambda r: (-size(r), not (r["open_left"] and r["open_right"]), r["ref"], r["alt"], r["support"], r["open_right"], r["open_left"], r["pos"]))
        there = {id(r): r for r in rows}
        # what may hold an open candidate begins or ends where it does
        begin, stop = defaultdict(list), defaultdict(list)
        for r in rows:
            begin[r["pos"]].append(r)
            stop[r["pos"] + len(r["ref"])].append(r)
        for r in turn:
            frequent = max(least_frequency, ratio * r["support"] / max(1, r["coverage"]))
            near = begin[r["pos"]] if r["open_right"] or kind(r) > 0 else stop[r["pos"] + len(r["ref"])]
            fit = [t for t in near if id(t) in there and t is not r and holds(t, r) and t["support"] / max(1, t["coverage"]) >= frequent]
            if fit:
                t = min(fit, key=lambda t: (t["open_left"] or t["open_right"], -t["support"], -size(t), t["pos"], t["ref"], t["alt"], t["open_left"], t["open_right"]))
                t["support"] += r["support"]
                t["open_left"], t["open_right"] = t["open_left"] and r["open_left"], t["open_right"] and r["open_right"]
                del there[id(r)]
        kept = sorted(there.values(), key=lambda r: (r["pos"], r["ref"], r["alt"], r["open_left"], r["open_right"]))
        return [tuple(r[c] for c in ("chrom", "pos", "ref", "alt", "open_left", "open_right", "support", "coverage")) for r in kept]

    def busy(rows: pa.RecordBatch, span: np.ndarray) -> np.ndarray:
        # an open one may be held by what begins with its first letter where it does, or ends so; flags of an open one only go
        ref, alt = _sizes(rows, "ref"), _sizes(rows, "alt")
        kinds, plain = np.sign(alt - ref), alt == ref
        left, right = (_numbers(rows, c).astype(bool) for c in ("open_left", "open_right"))
        first, last = (_numbers_of(pc.index_in(pc.utf8_slice_codeunits(rows.column("alt"), *of), _LETTERS)) for of in ((0, 1), (-1,)))
        pos = _numbers(rows, "pos")
        begin = _shared([span, pos, kinds, np.where(plain, first, 0)], right | (left & (kinds > 0)))
        return begin | _shared([span, pos + ref, kinds, np.where(plain, last, 0)], left & (kinds <= 0))

    return by_span(candidates.select(*[F.col(c).cast(t) for c, t in _COLLAPSED.items()]), one, busy)


def reallocated(alleles: DataFrame) -> DataFrame:
    """Alleles (chrom, pos, ref, alt, support, callable): a longer allele that can't be called gives its support to parts of it.

    The longest callable allele inside it takes a part; what is left and right of
    that is dealt with in the same way, and single mismatches left over make
    substitutions of their own.
    """

    def one(rows: list[dict]) -> list[tuple]:
        held = {(r["pos"], r["ref"], r["alt"]): [r["support"], r["callable"]] for r in rows}
        failed = sorted((k for k, v in held.items() if len(k[1]) > 1 and len(k[1]) == len(k[2]) and not v[1]), key=lambda k: (k[0], -len(k[1]), -held[k][0], k[2]))
        begin = defaultdict(list)  # callable alleles, which stay, by place
        for x, v in held.items():
            if v[1] and len(x[1]) == len(x[2]):
                begin[x[0]].append(x)
        for k in failed:
            support = held.pop(k)[0]
            todo = [k]
            while todo:
                pos, ref, alt = todo.pop()
                parts = [x for p in range(pos, pos + len(ref)) for x in begin.get(p, ()) if x[0] + len(x[1]) <= pos + len(ref) and ref[x[0] - pos :].startswith(x[1]) and alt[x[0] - pos :].startswith(x[2])]
                if parts:
                    p = min(parts, key=lambda x: (-len(x[1]), -held[x][0], x[0], x[2]))
                    held[p][0] += support
                    i, j = p[0] - pos, p[0] - pos + len(p[1])
                    if i:
                        todo.append((pos, ref[:i], alt[:i]))
                    if j < len(ref):
                        todo.append((pos + j, ref[j:], alt[j:]))
                else:
                    for i, (r, a) in enumerate(zip(ref, alt, strict=True)):
                        if r != a:
                            held.setdefault((pos + i, r, a), [0, False])[0] += support
        return [(rows[0]["chrom"], *k, *v) for k, v in sorted(held.items())]

    def busy(rows: pa.RecordBatch, span: np.ndarray) -> np.ndarray:
        # what begins inside a failed allele, itself included
        ref, pos = _sizes(rows, "ref"), _numbers(rows, "pos")
        failed = (ref > 1) & (ref == _sizes(rows, "alt")) & ~_numbers(rows, "callable").astype(bool)
        top = _greatest(np.where(failed, pos + ref, -_FAR), span)
        # rows at one place have what the last of them has
        ends = np.append((np.diff(pos) != 0) | (np.diff(span) != 0), True)[: len(pos)]
        return top[ends][np.cumsum(ends) - ends] > pos

    return by_span(alleles.select(*[F.col(c).cast(t) for c, t in _REALLOCATED.items()]), one, busy)
