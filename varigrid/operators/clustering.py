"""Clusters of read signatures, the alleles they make, and what is left for the references.

A neighborhood is first cut between sites that no read spans: signatures on
either side can't agree, so a part is all that one task has to hold.  Inside a
part a signature is three bit masks over the part's sites (carries the
alternative, the reference, something else); agreement is a count of common bits.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions import stats
from varigrid.operators import blocks

#: Rounds of giving free signatures to clusters before one of them begins a new one.
ROUNDS = 10


def parts(signed: DataFrame) -> DataFrame:
    """Adds ``part`` to signatures (chrom, nbhd, signature, n): neighborhoods cut where no signature spans the gap between two sites."""
    ends = signed.select("chrom", "nbhd", "signature", "n", F.transform(F.split("signature", ","), lambda s: F.split(s, ":")[0].cast("long")).alias("_p"))
    ends = ends.select("chrom", "nbhd", "signature", "n", F.array_min("_p").alias("_lo"), F.array_max("_p").alias("_hi"))
    steps = ends.select("chrom", "nbhd", F.explode(F.array(F.struct(F.col("_lo").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("_hi").alias("pos"), F.lit(-1).alias("d")))).alias("x")).select("chrom", "nbhd", "x.*")
    steps = steps.groupBy("chrom", "nbhd", "pos").agg(F.sum("d").alias("d"))
    open_ = blocks.running(steps, ["chrom", "nbhd"], "pos", ["pos"], F.col("d"), "_open", "sum", own=True)
    # a place where nothing stays open ends a part; the part is known by that place
    cuts = open_.filter("_open = 0").select("chrom", "nbhd", F.col("pos").alias("_end"))
    marks = cuts.select("chrom", "nbhd", F.col("_end").alias("pos"), F.col("_end").alias("part"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("long").alias("n"))
    rows = ends.select("chrom", "nbhd", F.col("_lo").alias("pos"), F.lit(None).cast("long").alias("part"), "signature", "n").unionByName(marks)
    found = blocks.running(rows.withColumns({"_back": -F.col("pos"), "_mark": F.col("signature").isNotNull().cast("int")}), ["chrom", "nbhd"], "_back", ["_back", "_mark"], -F.col("part"), "_part", own=True)
    return found.filter("signature is not null").select("chrom", "nbhd", "signature", "n", (-F.col("_part")).alias("part"))


class _Part:
    """Signatures of one part: masks, numbers, and clusters of them in the order in which they began."""

    def __init__(self, rows: list[tuple[str, int]], least_agree: int, most_disagree: int):
        self.least, self.most = least_agree, most_disagree
        parsed = [([s.rsplit(":", 1) for s in sig.split(",")], n, sig) for sig, n in rows]
        parsed.sort(key=lambda r: (-len(r[0]), -r[1], r[2]))
        places = sorted({int(p) for states, _, _ in parsed for p, _ in states})
        at = {p: i for i, p in enumerate(places)}
        self.places, self.n, self.sig = places, [r[1] for r in parsed], [r[2] for r in parsed]
        self.sites: list[dict[int, str]] = [{at[int(p)]: s for p, s in states} for states, _, _ in parsed]
        mask = lambda states, kind: sum(1 << i for i, s in states.items() if kind is None or s == kind)
        self.known = [mask(s, None) for s in self.sites]
        self.alt, self.ref = [mask(s, "alt") for s in self.sites], [mask(s, "ref") for s in self.sites]
        self.clusters: dict[int, list[int]] = {}
        self.masks: dict[int, tuple[int, int, int]] = {}
        self.at_site: dict[int, set[int]] = defaultdict(set)
        self.begun = 0
        #: clusters by age; a merged one counts as new
        self.order: dict[int, int] = {}

    def agreement(self, a: int, b: int) -> tuple[int, int]:
        both = self.known[a] & self.known[b]
        differ = both & ((self.alt[a] ^ self.alt[b]) | (self.ref[a] ^ self.ref[b]))
        return both.bit_count() - differ.bit_count(), differ.bit_count()

    def put(self, cluster: int, v: int) -> None:
        self.clusters.setdefault(cluster, []).append(v)
        k, a, r = self.masks.get(cluster, (0, 0, 0))
        other = self.known[v] & ~self.alt[v] & ~self.ref[v]
        self.masks[cluster] = (k | other, a | self.alt[v], r | self.ref[v])
        for i in self.sites[v]:
            self.at_site[i].add(cluster)

    def rebuilt(self, cluster: int, members: list[int]) -> None:
        self.gone(cluster)
        for v in members:
            self.put(cluster, v)

    def gone(self, cluster: int) -> None:
        for v in self.clusters.pop(cluster, ()):
            for i in self.sites[v]:
                self.at_site[i].discard(cluster)
        self.masks.pop(cluster, None)

    def conflict(self, v: int, cluster: int) -> bool:
        """Whether a member disagrees with a signature at a site."""
        x, a, r = self.masks[cluster]
        k = self.known[v]
        return bool(k & ((a & ~self.alt[v]) | (r & ~self.ref[v]) | (x & (self.alt[v] | self.ref[v]))))

    def fits(self, v: int) -> list[tuple[int, int]]:
        """(score, cluster) of the clusters that a signature may join, by score and age."""
        near = set().union(*(self.at_site[i] for i in self.sites[v])) if self.sites[v] else set()
        out = []
        for c in sorted(near, key=lambda c: self.order[c]):
            if self.most == 0 and self.conflict(v, c):
                continue
            best, good = (0, 0), True
            for m in self.clusters[c]:
                if m == v:
                    continue
                same, differ = self.agreement(v, m)
                if differ > self.most:
                    good = False
                    break
                if same - differ > best[0] - best[1]:
                    best = (same, differ)
            if good and best[0] >= self.least:
                out.append((best[0] - best[1], c))
        return sorted(out, key=lambda x: (x[0], self.order[x[1]]))

    def _mergeable(self, a: int, b: int, v: int) -> bool:
        """By the pair of least score among all members: it may not disagree at more than ``most`` sites."""
        members = [*self.clusters[a], *self.clusters[b], v]
        if self.most == 0:
            xa, aa, ra = self.masks[a]
            xb, ab, rb = self.masks[b]
            x, al, re = xa | xb | (self.known[v] & ~self.alt[v] & ~self.ref[v]), aa | ab | self.alt[v], ra | rb | self.ref[v]
            if not (x & al | x & re | al & re):
                return True
        worst = None
        for i, p in enumerate(members):
            for q in members[i + 1 :]:
                same, differ = self.agreement(p, q)
                if worst is None or same - differ < worst[0]:
                    worst = (same - differ, differ)
        return worst is None or worst[1] <= self.most

    def begin(self, v: int) -> None:
        self.begun += 1
        self.order[self.begun] = self.begun
        self.put(self.begun, v)

    def worst(self, cluster: int) -> int:
        """The member that agrees least with all others, the first of equal ones."""
        counts: dict[int, Counter] = defaultdict(Counter)
        for v in self.clusters[cluster]:
            for i, s in self.sites[v].items():
                counts[i][s] += 1
        score = lambda v: sum(2 * (counts[i][s] - 1) - (counts[i].total() - 1) for i, s in self.sites[v].items())
        return min(self.clusters[cluster], key=score)

    def reassign(self) -> None:
        """Signatures that fit worst move to the first cluster that they fit, as long as it is another one."""
        if len(self.clusters) < 2:
            return
        for c in sorted(self.clusters, key=lambda c: sum(self.n[v] for v in self.clusters[c])):
            while self.clusters[c]:
                v = self.worst(c)
                found = self.fits(v)
                if not found or found[0][1] == c:
                    break
                members = [m for m in self.clusters[c] if m != v]
                self.gone(c)
                self.clusters[c] = []
                for m in members:
                    self.put(c, m)
                self.put(found[0][1], v)
        for c in [c for c, members in self.clusters.items() if not members]:
            self.gone(c)

    def allocate(self, free: list[int], merging: bool) -> list[int]:
        left = []
        for v in free:
            found = self.fits(v)
            if not found:
                left.append(v)
                continue
            best = [c for s, c in found if s == found[-1][0]]
            target = best[0]
            if merging:
                for i, a in enumerate(best):
                    for b in best[i + 1 :]:
                        if a not in self.clusters or b not in self.clusters:
                            continue
                        if self._mergeable(a, b, v):
                            members = [*self.clusters[a], *self.clusters[b]]
                            self.gone(b)
                            self.rebuilt(a, members)
                            self.order[a] = max(self.order.values()) + 1
                            target = a
                        elif sum(self.n[m] for m in self.clusters[b]) > sum(self.n[m] for m in self.clusters[a]):
                            target = b
            self.put(target, v)
        return left

    def run(self, merging: bool, moving: bool, per_site: int) -> None:
        free, most = list(range(len(self.n))), len(self.places) * per_site
        while free:
            self.begin(free.pop(0))
            if moving:
                self.reassign()
            for _ in range(ROUNDS):
                before = len(free)
                free = self.allocate(free, merging) if free else free
                if not free or len(free) == before:
                    break
            if len(self.clusters) > most:
                break

    def consensus(self, cluster: int) -> str:
        states: dict[int, str] = {}
        for v in self.clusters[cluster]:
            for i, s in self.sites[v].items():
                states.setdefault(i, s)
        return ",".join(f"{self.places[i]}:{states[i]}" for i in sorted(states))


def clusters(signed: DataFrame, most: int | None = None, least_agree: int = 1, most_disagree: int = 0, merging: bool = True, moving: bool = True, per_site: int = 100) -> DataFrame:
    """(chrom, nbhd, part, cluster, signature, n, consensus): signatures gathered into haplotypes.

    Those of most sites come first.  The first free one begins a cluster; then the
    worst fitting members move, and free ones join the cluster that they agree
    with best, at ``least_agree`` sites or more and with no member at more than
    ``most_disagree`` sites apart.  Clusters that tie for one are merged if they may.
    With ``most`` the lightest clusters of a neighborhood go till so many are
    left, unless more are equally light than may go.  Signatures left over when
    there are more clusters than ``per_site`` for each site belong to none.  The
    consensus stands in a cluster's first row alone, as a chain of reads may make it long.
    """

    names = ["chrom", "nbhd", "part", "cluster", "signature", "n", "consensus"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]

    def of(key: tuple, rows: list[tuple[str, int]]) -> Iterator[tuple]:
        held = _Part(rows, least_agree, most_disagree)
        held.run(merging, moving, per_site)
        for i, c in enumerate(sorted(held.clusters, key=lambda c: held.order[c]), 1):
            for j, v in enumerate(held.clusters[c]):
                yield *key, i, held.sig[v], held.n[v], None if j else held.consensus(c)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
        key, rows = None, []
        for batch in batches:
            out = []
            for *at, signature, n in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if at != key and rows:
                    out += of(tuple(key), rows)
                    rows = []
                key = at
                rows.append((signature, n))
            yield made(out)
        if rows:
            yield made(list(of(tuple(key), rows)))

    keys = ["chrom", "nbhd", "part"]
    # a part's rows lie together, and a task holds one part of them at a time
    dealt = parts(signed).select(*keys, "signature", "n").repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(walked, "chrom string, nbhd long, part long, cluster int, signature string, n long, consensus string")
    if most is None:
        return found
    keys = ["chrom", "nbhd", "part", "cluster"]
    light = found.groupBy(*keys).agg(F.sum("n").alias("_n"))
    here = Window.partitionBy("chrom", "nbhd")
    # all of equal weight go together: as many as stand up to them in order of weight
    light = light.withColumns({"_all": F.count("*").over(here), "_upto": F.count("*").over(here.orderBy("_n").rangeBetween(Window.unboundedPreceding, 0))})
    return found.join(light.filter(F.col("_upto") > F.col("_all") - most).select(*keys), keys)


# -- alleles ----------------------------------------------------------------------


def phased_alleles(clustered: DataFrame, sites: DataFrame, reference: DataFrame, noise_q: int = 20, most_q: int = 100) -> tuple[DataFrame, DataFrame]:
    """Alleles of clusters, and the reference places that they use up.

    ``sites`` (chrom, nbhd, pos, ref, alt) gives the alleles and ``reference`` (chrom, pos,
    base) the bases between.  The first frame is (chrom, nbhd, pos, ref, alt, kind,
    support, depth, vq): equal bases are trimmed from both ends, an insertion or
    deletion keeps the base before it, support and depth are whole averages over
    the sites that the cluster carries; equal alleles of a neighborhood add up
    their support.  The second is (chrom, nbhd, pos, used): how many reads at a
    reference place inside an allele went into it.
    """
    keys = ["chrom", "nbhd", "part", "cluster"]
    # what a cluster's reads have at a site and what it agrees on are rows of one pass, as clusters are costly to find
    place = lambda s: F.substring_index(s, ":", 1).cast("long")
    own = F.transform(F.split("signature", ","), lambda s: F.struct(place(s).alias("pos"), F.lit(False).alias("alt")))
    agreed = F.transform(F.filter(F.split("consensus", ","), lambda s: s.endswith(":alt")), lambda s: F.struct(place(s).alias("pos"), F.lit(True).alias("alt")))
    none = F.array().cast("array<struct<pos:bigint,alt:boolean>>")
    states = clustered.select(*keys, "n", F.explode(F.concat(own, F.coalesce(agreed, none))).alias("s")).select(*keys, "n", "s.*")
    counts = states.groupBy(*keys, "pos").agg(F.sum(F.when(~F.col("alt"), F.col("n"))).alias("_count"), F.max("alt").alias("_alt"))
    counts = counts.withColumn("_depth", F.sum("_count").over(Window.partitionBy("chrom", "nbhd", "pos"))).filter("_alt").drop("_alt")
    rows = counts.join(sites.select("chrom", "nbhd", "pos", "ref", "alt"), ["chrom", "nbhd", "pos"])
    rows = rows.filter("ref <> alt")
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", "_count", "_depth"))).alias("x"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sites of a cluster one after another: one that begins inside the one before is cut, places between them are rows without alleles."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last, held, places = None, [], []
                for s in row["x"]:
                    over = max(0, last - s["pos"] + 1) if last is not None else 0
                    if over and (over >= len(s["alt"]) or over >= len(s["ref"])):
                        continue
                    pos, ref, alt = s["pos"] + over, s["ref"][over:], s["alt"][over:]
                    if last is not None:
                        places += [(p, None, None) for p in range(last + 1, pos)]
                    places.append((pos, ref, alt))
                    held.append(s)
                    last = pos + len(ref) - 1
                support, depth = (math.floor(sum(s[n] for s in held) / len(held)) for n in ("_count", "_depth"))
                out += [(*(row[k] for k in keys), support, max(support, depth), *p) for p in places]
            yield rows_of(out, piece_names)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                r, a, h = row["_r"], row["_a"], 0
                while r and a and r[-1] == a[-1]:
                    r, a = r[:-1], a[:-1]
                while h < min(len(r), len(a)) and r[h] == a[h]:
                    h += 1
                if h < max(len(r), len(a)):
                    start, short = row["first"] + h, h in (len(r), len(a))
                    out.append((*(row[k] for k in keys), row["support"], row["depth"], row["inner"], start, start - short, r[h:], a[h:]))
            yield rows_of(out, trim_names)

    kinds = {"chrom": pa.string(), "cluster": pa.int32(), "ref": pa.string(), "alt": pa.string(), "_r": pa.string(), "_a": pa.string(), "inner": pa.list_(pa.int64())}
    piece_names, trim_names = [*keys, "support", "depth", "pos", "ref", "alt"], [*keys, "support", "depth", "inner", "start", "pos", "_r", "_a"]
    rows_of = lambda out, names: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names)
    head = "chrom string, nbhd long, part long, cluster int, support long, depth long"
    each = whole.mapInArrow(pieces, f"{head}, pos long, ref string, alt string")
    each = each.join(reference.select("chrom", "pos", "base"), ["chrom", "pos"], "left")
    filled = F.coalesce("base", F.lit("R"))
    built = each.groupBy(*keys, "support", "depth").agg(
        F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ref", filled).alias("r"), F.coalesce("alt", filled).alias("a")))).alias("y"),
        F.array_sort(F.collect_list(F.when(F.col("ref").isNull(), F.col("pos")))).alias("inner"),
    )
    text = lambda k: F.array_join(F.transform("y", lambda s: s[k]), "")
    built = built.select(*keys, "support", "depth", "first", "inner", text("r").alias("_r"), text("a").alias("_a"))
    built = built.mapInArrow(trimmed, f"{head}, inner array<bigint>, start long, pos long, _r string, _a string")
    short = (F.col("_r") == "") | (F.col("_a") == "")
    ahead = reference.select("chrom", "pos", F.col("base").alias("_ahead"))
    built = built.join(ahead, ["chrom", "pos"], "left").withColumn("_ahead", F.when(short, F.coalesce("_ahead", F.lit("R"))).otherwise(""))
    kind = F.when(F.col("_r") == "", "insertion").when(F.col("_a") == "", "deletion").when((F.length("_r") == 1) & (F.length("_a") == 1), "snv").otherwise("mnv")
    found = built.select(*keys, "support", "depth", "inner", "start", "pos", F.concat("_ahead", "_r").alias("ref"), F.concat("_ahead", "_a").alias("alt"), kind.alias("kind"))
    used = found.select("chrom", "nbhd", "support", "start", F.explode("inner").alias("pos")).filter("pos > start").groupBy("chrom", "nbhd", "pos").agg(F.sum("support").alias("used"))
    alleles = found.groupBy("chrom", "nbhd", "pos", "ref", "alt", "kind").agg(F.sum("support").alias("support"), F.max("depth").alias("depth"))
    alleles = alleles.withColumn("depth", F.greatest("depth", "support"))
    return alleles.withColumn("vq", stats.variant_q(F.col("support"), F.col("depth"), noise_q, most_q)), used


def recalled(alleles: DataFrame, least_q: int = 20, least_frequency: float = 0.01, filter_q: int = 30, filter_frequency: float = 0.01, filter_depth: int = 10) -> DataFrame:
    """Phased alleles that may be called, with their ``filters`` (q, vf, dp)."""
    vf = F.col("support") / F.col("depth")
    marks = F.array_compact(F.array(F.when(F.col("vq") < filter_q, f"q{filter_q}"), F.when(vf < filter_frequency, "LowVF"), F.when(F.col("depth") < filter_depth, "LowDP")))
    return alleles.filter((F.col("vq") >= least_q) & (vf >= least_frequency)).withColumn("filters", marks)


def references_left(originals: DataFrame, used: DataFrame, noise_q: int = 20, most_q: int = 100, least_q: int = 20) -> DataFrame:
    """(chrom, nbhd, pos, ref, support, depth, vq, genotype): each original place called anew as a reference.

    ``originals`` (chrom, nbhd, pos, ref, alt, ref_support, depth): what phased alleles have
    ``used`` up is taken off the reads of the reference; the first alternative of a place stands for it.
    """
    one = originals.groupBy("chrom", "nbhd", "pos").agg(F.min_by(F.struct(F.left("ref", F.lit(1)).alias("ref"), "ref_support", "depth"), F.struct("ref", "alt")).alias("x"))
    left = F.greatest(F.lit(0).cast("long"), F.col("x.ref_support") - F.coalesce("used", F.lit(0)))
    rows = one.join(used, ["chrom", "nbhd", "pos"], "left").select("chrom", "nbhd", "pos", "x.ref", left.alias("support"), F.greatest(F.col("x.depth"), left).alias("depth"))
    rows = rows.withColumn("vq", stats.variant_q(F.col("support"), F.col("depth"), noise_q, most_q))
    return rows.withColumn("genotype", F.when(F.col("vq") < least_q, "0/.").otherwise("0/0"))
