"""Named queries of loci, pairs and realignments, each with its SQL.

Reads are order lines as in ``catalogue_parts``; whole tables are used.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from varigrid.catalogue import ALLELES_SQL, SQL, _adaptive_sql, alleles, query
from varigrid.catalogue import neighborhood_ranges as all_ranges
from varigrid.catalogue_parts import ALIGNED_SQL, aligned
from varigrid.functions import sequence
from varigrid.operators import genotype, pairs, phasing, realign
from varigrid.plans import views

# -- pairs ------------------------------------------------------------------------

STATUS_SQL = f"""SELECT id, line, CASE WHEN (flag & 1) <> 0 AND ref <> mate THEN 'split_chromosomes' WHEN ((flag & 8) <> 0 AND ref = -1) OR ((flag & 4) <> 0 AND mate = -1) THEN 'mate_unmapped'
  WHEN (flag & 1024) <> 0 THEN 'duplicate' WHEN (flag & 1) <> 0 AND NOT (ref = mate AND abs(fragment) <= 1200) THEN 'long_fragment' ELSE 'unknown' END AS status
FROM (SELECT id, line, flag - 1 + CASE WHEN line % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN line % 3 = 0 THEN 8 ELSE 0 END AS flag, pos % 4 - 1 AS ref, pos % 4 - 1 + CASE WHEN mapq % 5 = 0 THEN 1 ELSE 0 END AS mate, pos % 3000 - 1500 AS fragment FROM ({ALIGNED_SQL}) a) r
WHERE (flag & 2304) = 0 AND (flag & 2) <> 0"""


@query(STATUS_SQL)
def pair_statuses(spark, sf_dir):
    c = F.col
    flag = c("flag") - 1 + F.when(c("line") % 4 != 0, 1).otherwise(0) + F.when(c("line") % 3 == 0, 8).otherwise(0)
    ref = c("pos") % 4 - 1
    rows = aligned(spark, sf_dir).select("id", "line", flag.alias("flag"), ref.alias("ref"), (ref + F.when(c("mapq") % 5 == 0, 1).otherwise(0)).alias("mate_ref"), (c("pos") % 3000 - 1500).alias("fragment"))
    return pairs.pair_source(rows, proper_only=True, considered_length=600).select("id", "line", "status")


@query(f"""SELECT id, line, NOT (overlap OR s1 BETWEEN p2 AND e2 OR t1 BETWEEN p2 AND e2 OR s2 BETWEEN p1 AND e1 OR t2 BETWEEN p1 AND e1) AS apart, NOT overlap AS aligned_apart
FROM (SELECT *, p1 <= e2 AND p2 <= e1 AS overlap, p1 - soft AS s1, e1 + ins AS t1, p2 - del AS s2, e2 + soft AS t2 FROM (
  SELECT *, pos AS p1, pos + m AS e1, pos + 2 * m - 20 AS p2, pos + 2 * m AS e2 FROM ({ALIGNED_SQL}) a) b) c""")
def pairs_apart(spark, sf_dir):
    c = F.col
    read = lambda pos, stop, left, right: F.struct(c("chrom"), pos.alias("pos"), stop.alias("stop"), c(left).alias("start_clip"), c(right).alias("end_clip"))
    r1, r2 = read(c("pos"), c("pos") + c("m"), "soft", "ins"), read(c("pos") + 2 * c("m") - 20, c("pos") + 2 * c("m"), "del", "soft")
    return aligned(spark, sf_dir).select("id", "line", pairs.apart(r1, r2).alias("apart"), pairs.apart(r1, r2, False).alias("aligned_apart"))


# -- neighborhoods ------------------------------------------------------------------

REGION_SQL = "SELECT p_partkey AS first, p_partkey + p_size AS last FROM part WHERE p_size = 3"
NEAR_SQL = f"""SELECT a.id, a.line, n.first, (a.soft > 0 AND a.pos BETWEEN n.first - 1 AND n.last + 1) AS clipped FROM ({ALIGNED_SQL}) a JOIN ({REGION_SQL}) n
ON a.pos + a.m + a.del + 24 >= n.first AND a.pos <= n.last + 2 WHERE a.mapq >= 10 AND (a.flag & 1024) = 0 AND (a.flag & 2) <> 0"""


@query(NEAR_SQL)
def neighborhood_reads(spark, sf_dir):
    c = F.col
    reads = aligned(spark, sf_dir).select("id", "line", F.lit("c").alias("chrom"), c("pos").alias("start"), (c("pos") + c("m") + c("del") + 24).alias("stop"), "flag", "mapq", c("soft").alias("start_clip"), F.lit(0).alias("end_clip"))
    regions = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size = 3").select(F.lit("c").alias("chrom"), c("p_partkey").alias("first"), (c("p_partkey") + c("p_size")).alias("last"))
    met = phasing.reads_near(reads, regions, min_mapq=10, proper_only=True, look_ahead=2)
    return met.select("a.id", "a.line", "b.first", phasing.clipped_within(c("a"), c("b.first") - 1, c("b.last") + 1).alias("clipped"))


@query(f"SELECT chrom, nbhd, first, last, sites FROM ({SQL['neighborhood_ranges']}) n ORDER BY chrom, first LIMIT 20")
def first_neighborhoods(spark, sf_dir):
    return phasing.first_neighborhoods(all_ranges(spark, sf_dir), 20)


MEMBER_SQL = "SELECT l_orderkey AS grp, l_partkey % 3 AS site, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS member, substr('ACGTNN', CAST(1 + l_partkey % 6 AS INT), 1) AS ref, substr('NACNGT', CAST(1 + l_suppkey % 6 AS INT), 1) AS alt FROM lineitem"


@query(f"""SELECT grp, site, coalesce(max_by(ref, member) FILTER (WHERE ref <> 'N'), 'N') AS ref, coalesce(max_by(alt, member) FILTER (WHERE alt <> 'N'), 'N') AS alt FROM ({MEMBER_SQL}) m GROUP BY grp, site""")
def sites_merged(spark, sf_dir):
    c = F.col
    letter = lambda letters, at: F.substring(F.lit(letters), (1 + at).cast("int"), F.lit(1))
    members = views.lines(spark, sf_dir).select(c("l_orderkey").alias("grp"), (c("l_partkey") % 3).alias("site"), ((c("l_partkey") * 100000 + c("l_suppkey")) * 10 + c("l_linenumber")).alias("member"), letter("ACGTNN", c("l_partkey") % 6).alias("ref"), letter("NACNGT", c("l_suppkey") % 6).alias("alt"))
    return phasing.merged_sites(members, ["grp", "site"])


@query("""SELECT grp, name, weight FROM (SELECT *, count(*) FILTER (WHERE weight = least) OVER (PARTITION BY grp) AS ties FROM (
  SELECT l_orderkey AS grp, l_linenumber AS name, l_suppkey % 4 AS weight, min(l_suppkey % 4) OVER (PARTITION BY l_orderkey) AS least FROM lineitem) a) b WHERE weight > least OR ties > 1""")
def worst_clusters_removed(spark, sf_dir):
    c = F.col
    rows = views.lines(spark, sf_dir).select(c("l_orderkey").alias("grp"), c("l_linenumber").alias("name"), (c("l_suppkey") % 4).alias("weight"))
    return phasing.without_worst(rows, 1, ["grp"])


# -- forced alleles ---------------------------------------------------------------

FORCED_SQL = f"""SELECT chrom, pos, ref, CASE WHEN pos % 3 = 0 THEN ref ELSE alt END AS alt, false AS forced, '0/1' AS genotype, ad::BIGINT AS gq, pos % 7 = 0 AS no_call FROM ({ALLELES_SQL}) a WHERE ad > 0
UNION ALL SELECT chrom, pos, ref, CASE WHEN pos % 4 = 0 THEN alt ELSE alt || 'T' END AS alt, true AS forced, './.' AS genotype, 99::BIGINT AS gq, false AS no_call FROM ({ALLELES_SQL}) a WHERE nc > 0"""


def _forced(spark, sf_dir):
    rows, pos, row = alleles(spark, sf_dir), F.col("pos"), ["chrom", "pos", "ref"]
    found = rows.filter("ad > 0").select(*row, F.when(pos % 3 == 0, F.col("ref")).otherwise(F.col("alt")).alias("alt"), F.lit(False).alias("forced"), F.lit("0/1").alias("genotype"), F.col("ad").cast("long").alias("gq"), (pos % 7 == 0).alias("no_call"))
    asked = rows.filter("nc > 0").select(*row, F.when(pos % 4 == 0, F.col("alt")).otherwise(F.concat("alt", F.lit("T"))).alias("alt"), F.lit(True).alias("forced"), F.lit("./.").alias("genotype"), F.lit(99).cast("long").alias("gq"), F.lit(False).alias("no_call"))
    return found.union(asked)


@query(f"""WITH f AS ({FORCED_SQL}) SELECT chrom, pos, ref, alt, forced FROM f WHERE NOT forced OR NOT EXISTS (SELECT 1 FROM f g WHERE g.chrom = f.chrom AND g.pos = f.pos AND g.ref = f.ref AND g.alt = f.alt AND NOT g.forced)
  OR NOT EXISTS (SELECT 1 FROM f g WHERE g.chrom = f.chrom AND g.pos = f.pos AND NOT g.forced AND g.ref <> g.alt)""")
def forced_reconciled(spark, sf_dir):
    return phasing.reconciled(_forced(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "forced")


@query(f"""WITH f AS ({FORCED_SQL}), l AS (SELECT chrom, pos, bool_or(forced) AS has, count(*) FILTER (WHERE NOT forced) AS own, bool_or(no_call) FILTER (WHERE NOT forced) AS none, bool_or(ref = alt) FILTER (WHERE NOT forced) AS isref, min(gq) FILTER (WHERE NOT forced) AS least FROM f GROUP BY chrom, pos)
SELECT f.chrom, f.pos, f.ref, f.alt, CASE WHEN NOT forced THEN genotype WHEN own = 0 OR none THEN './.' WHEN isref THEN '0/0' ELSE '*/*' END AS genotype, CASE WHEN has THEN coalesce(least, 0) ELSE gq END AS gq FROM f JOIN l ON f.chrom = l.chrom AND f.pos = l.pos""")
def forced_genotypes(spark, sf_dir):
    return genotype.forced_genotypes(_forced(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "genotype", "gq")


# -- genotypes ----------------------------------------------------------------------


def _two_sql() -> str:
    m, logs = genotype.SNV_MEANS, []
    for second, first in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)):
        rest = 1 - m[first] - m[second]
        if rest <= 0:
            rest = 1 - m[2]
        prior = 0.99 if first == second == 0 else 0.01 / 5
        logs.append(f"{math.log(prior)!r}::DOUBLE + a * {math.log(rest)!r}::DOUBLE + b * {math.log(m[first])!r}::DOUBLE + c * {math.log(m[second])!r}::DOUBLE")
    q = lambda p: f"(CASE WHEN {p} < 1e-300 THEN 100.0 ELSE least(100.0, -10 * log10({p})) END)"
    tops = ", ".join(f"x{i}" for i in range(6))
    shares, total, others = ", ".join(f"exp(x{i} - greatest({tops})) AS s{i}" for i in range(6)), " + ".join(f"s{i}" for i in range(6)), " + ".join(f"s{i}" for i in range(6) if i != 4)
    posts = ", ".join(f"CASE WHEN dp > 500 THEN {0 if i == 4 else 100}::DOUBLE WHEN dp = a + b + c THEN round({q(f's{i} / ({total})')}, 4)::DOUBLE END AS p{i}" for i in range(6))
    return f"""SELECT id, line, CASE WHEN dp > 500 THEN 100 WHEN dp = a + b + c THEN CAST(round_even({q(f'({others}) / ({total})')}, 0) AS BIGINT) END AS gq, {posts} FROM (SELECT *, {shares} FROM (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(logs))} FROM (
  SELECT l_orderkey AS id, l_linenumber AS line, l_quantity::BIGINT AS a, l_suppkey % 60 AS b, l_partkey % 45 AS c, l_quantity::BIGINT + l_suppkey % 60 + l_partkey % 45 + CASE l_linenumber WHEN 7 THEN 500 WHEN 6 THEN 1 ELSE 0 END AS dp FROM lineitem) r) l) s"""


@query(_two_sql())
def two_alternatives_quality(spark, sf_dir):
    c = F.col
    rows = views.lines(spark, sf_dir).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), F.array(c("l_quantity").cast("long"), c("l_suppkey") % 60, c("l_partkey") % 45).alias("n"))
    depth = F.get("n", F.lit(0)) + F.get("n", F.lit(1)) + F.get("n", F.lit(2)) + F.when(c("line") == 7, 500).when(c("line") == 6, 1).otherwise(0)
    rows = rows.select("id", "line", genotype.two_alternatives(c("n"), depth).alias("r"))
    return rows.select("id", "line", c("r.gq").cast("long").alias("gq"), *[F.round(F.get("r.posteriors", F.lit(i)), 4).alias(f"p{i}") for i in range(6)])


@query(f"SELECT chrom, pos, CASE WHEN pos % 2 = 0 THEN CAST(pos % 3 AS INT) ELSE state END AS state, CASE WHEN pos % 2 = 0 THEN 'fit' ELSE genotype END AS genotype FROM ({_adaptive_sql()}) a")
def fitted_genotypes(spark, sf_dir):
    own = genotype.adaptive(alleles(spark, sf_dir)).select("chrom", "pos", "state", "genotype")
    fitted = alleles(spark, sf_dir).filter("pos % 2 = 0").select("chrom", "pos", (F.col("pos") % 3).cast("int").alias("state"), F.lit("fit").alias("genotype"))
    return genotype.fitted_or(own, fitted, ["state", "genotype"])


# -- realignment ---------------------------------------------------------------------

BETTER_SQL = """SELECT id, line, CASE WHEN am = 1 AND ai = 0 AND bi > 1 THEN 1 WHEN bm = 1 AND bi = 0 AND ai > 1 THEN -1 WHEN am <> bm THEN sign(bm - am) WHEN ac <> bc THEN sign(bc - ac) ELSE sign(bi - ai) END::INT AS better,
  CASE WHEN bm = 0 THEN CASE WHEN bi = 1 AND am = 1 AND ai = 0 THEN false ELSE ai > 0 OR am - bm >= 1 END WHEN bl <= 3 THEN bm - sh <= 0 AND bm <= 1 AND am - bm >= 3
    ELSE bm - sh <= 1 AND bm <= 2 AND (am - bm >= 3 OR ((bl - ai >= 9 OR ac = 0) AND am - bm >= 2)) END AS replaced
FROM (SELECT *, least(am, bm) AS sh FROM (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey % 7 AS am, l_partkey % 3 AS ai, l_linenumber % 2 AS ac, l_partkey % 4 AS bm, l_suppkey % 3 AS bi, l_orderkey % 2 AS bc, l_partkey % 13 AS bl FROM lineitem) a) b"""


@query(BETTER_SQL)
def alignments_compared(spark, sf_dir):
    c = F.col
    rows = views.lines(spark, sf_dir).select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"),
        F.struct((c("l_suppkey") % 7).alias("mismatches"), (c("l_linenumber") % 2).alias("clipped"), (c("l_partkey") % 3).alias("indels"), (c("l_partkey") % 3).alias("indel_bases")).alias("a"),
        F.struct((c("l_partkey") % 4).alias("mismatches"), F.least(c("l_suppkey") % 7, c("l_partkey") % 4).alias("shared"), (c("l_orderkey") % 2).alias("clipped"), (c("l_suppkey") % 3).alias("indels"), (c("l_partkey") % 13).alias("indel_bases"), (c("l_linenumber") % 2 == 0).alias("frequent")).alias("b"),
    )
    return rows.select("id", "line", realign.compared(c("a"), c("b")).alias("better"), realign.improves(c("b"), c("a")).alias("replaced"))


MATES_SQL = f"""SELECT id, line, ins > 0 AS i1, del > 0 AS i2, ins AS l1, del AS l2, pos + m AS b1, pos + m + line % 2 AS b2, CASE WHEN line % 3 = 0 THEN 'I' ELSE 'D' END AS k1, CASE WHEN line % 4 = 0 THEN 'D' ELSE 'I' END AS k2,
  line % 5 = 0 AS t1, line % 7 = 0 AS t2, pos AS p1, pos + 2 * m AS e1, pos + mapq % 30 AS p2, pos + mapq % 30 + 40 AS e2, ins + line % 4 AS n1, del + mapq % 4 AS n2 FROM ({ALIGNED_SQL}) a"""


@query(f"""SELECT id, line, CASE WHEN i1 THEN 1 ELSE 0 END + CASE WHEN i2 THEN 1 ELSE 0 END AS indels, (n1 - CASE WHEN i1 THEN l1 ELSE 0 END <= 1 OR n2 - CASE WHEN i2 THEN l2 ELSE 0 END <= 1) AND ((i1 AND NOT same AND b1 >= p2 AND b1 + 1 <= e2) OR (i2 AND NOT same AND b2 >= p1 AND b2 + 1 <= e1)) AS disagree
FROM (SELECT *, i1 AND i2 AND b1 = b2 AND k1 = k2 AND (k1 = 'D' OR l1 = l2 OR (l2 < l1 AND t2) OR (l1 < l2 AND t1)) AS same FROM ({MATES_SQL}) m) s""")
def mates_disagreeing(spark, sf_dir):
    c = F.col
    indel = lambda n, before, kind, terminal: F.when(c(n) > 0, F.array(F.struct(before.alias("before"), (before + 1).alias("after"), kind.alias("kind"), c(n).alias("len"), terminal.alias("terminal")))).otherwise(
        F.array().cast("array<struct<before:bigint,after:bigint,kind:string,len:int,terminal:boolean>>"))
    first = indel("ins", c("pos") + c("m"), F.when(c("line") % 3 == 0, "I").otherwise("D"), c("line") % 5 == 0)
    second = indel("del", c("pos") + c("m") + c("line") % 2, F.when(c("line") % 4 == 0, "D").otherwise("I"), c("line") % 7 == 0)
    rows = aligned(spark, sf_dir).withColumn("del", c("del").cast("int")).withColumns({"first": first, "second": second})
    start = c("pos") + c("mapq") % 30
    r1 = F.struct(c("pos"), (c("pos") + 2 * c("m")).alias("stop"), (c("ins") + c("line") % 4).alias("nm"), F.lit(False).alias("backward"), c("first").alias("indels"))
    r2 = F.struct(start.alias("pos"), (start + 40).alias("stop"), (c("del") + c("mapq") % 4).alias("nm"), F.lit(True).alias("backward"), c("second").alias("indels"))
    return rows.select("id", "line", F.size(realign.pair_indels(c("first"), c("second"))).alias("indels"), realign.mates_disagree(r1, r2).alias("disagree"))


# -- sequences ------------------------------------------------------------------------

DIRS_SQL = f"SELECT id, line, bases, ins, del, soft, mapq % 32 AS spot, repeat('0', 8 + soft) || repeat('2', 2 * ins) || repeat('1', 24 - soft - 2 * ins) AS dirs FROM ({ALIGNED_SQL}) a"


def _dirs(spark, sf_dir):
    c = F.col
    text = F.concat(F.repeat(F.lit("0"), 8 + c("soft").cast("int")), F.repeat(F.lit("2"), 2 * c("ins")), F.repeat(F.lit("1"), (24 - c("soft") - 2 * c("ins")).cast("int")))
    return aligned(spark, sf_dir).withColumns({"at": c("mapq") % 32, "dirs": F.transform(F.split(text, ""), lambda d: d.cast("int"))})


@query(f"""SELECT id, line, CASE line % 3 WHEN 0 THEN substr(dirs, spot + 1, 1) WHEN 1 THEN CASE WHEN spot = 0 THEN left(dirs, 1) WHEN substr(dirs, spot, 1) = '2' THEN substr(dirs, spot + 1, 1) ELSE substr(dirs, spot, 1) END
  ELSE CASE WHEN contains(substr(dirs, spot + 1, 3), '2') THEN '2' WHEN left(substr(dirs, spot + 1, 3), 1) = right(substr(dirs, spot + 1, 3), 1) THEN left(substr(dirs, spot + 1, 3), 1) END END::INT AS direction,
  ins * 2 <= 3 OR NOT (substr(o, 2) = left(o, length(o) - 1) OR substr(o, 3) = left(o, length(o) - 2) OR substr(o, 4) = left(o, length(o) - 3)) AS anchored FROM (SELECT *, substr(bases, 9 + soft, 2 * ins) AS o FROM ({DIRS_SQL}) d) e""")
def support_directions(spark, sf_dir):
    c = F.col
    kind = F.when(c("line") % 3 == 0, "snv").when(c("line") % 3 == 1, "deletion").otherwise("mnv")
    return _dirs(spark, sf_dir).select("id", "line", sequence.support_direction(kind, c("at"), F.lit(3), c("dirs")).alias("direction"), sequence.bridge_anchored(c("bases"), c("dirs")).alias("anchored"))


CONTEXT_SQL = f"SELECT id, line, spot, left(bases, 1 + line % 3) AS unit, left(other, CAST(pos % 8 AS INT)) || repeat(left(bases, 1 + line % 3), 2 + ins) || left(other, CAST(del AS INT)) AS context, left(bases, 1 + line % 3) || CASE WHEN pos % 2 = 0 THEN 'A' ELSE '' END AS allele FROM (SELECT *, CAST(pos % 8 + mapq % 4 AS INT) AS spot FROM ({ALIGNED_SQL}) a) b"


def _contexts(spark, sf_dir):
    c = F.col
    unit = F.left("bases", (1 + c("line") % 3).cast("int"))
    context = F.concat(F.left("other", (c("pos") % 8).cast("int")), F.repeat(unit, 2 + c("ins")), F.left("other", c("del").cast("int")))
    return aligned(spark, sf_dir).select("id", "line", (c("pos") % 8 + c("mapq") % 4).cast("int").alias("at"), unit.alias("unit"), context.alias("context"), F.concat(unit, F.when(c("pos") % 2 == 0, "A").otherwise("")).alias("allele"))


_UNITS_SQL = ", ".join(f"CASE WHEN length(allele) >= {k} THEN {side}(allele, {k}) END" for side in ("left", "right") for k in (5, 4, 3, 2, 1))
_COUNT_SQL = "CASE WHEN u IS NULL OR spot > length(context) THEN 0 ELSE (length(regexp_extract(left(context, spot), '(?:' || u || ')*$')) + length(regexp_extract(substr(context, spot + 1), '^(?:' || u || ')*'))) // length(u) END"


@query(f"""SELECT id, line, CAST(list_max(counts) AS INT) AS n, CASE WHEN list_max(counts) > 0 THEN units[list_position(counts, list_max(counts))] ELSE '' END AS unit
FROM (SELECT *, list_transform(units, lambda u: {_COUNT_SQL}) AS counts FROM (SELECT *, [{_UNITS_SQL}] AS units FROM ({CONTEXT_SQL}) c) d) e""")
def repeats_with_units(spark, sf_dir):
    found = sequence.repeat_with_unit(F.col("context"), F.col("at") + 1, F.col("allele"))
    return _contexts(spark, sf_dir).withColumn("r", found).select("id", "line", "r.n", "r.unit")


@query(f"""SELECT id, line, spot >= k AND substr(context, spot + 2 - k, k) = unit AND substr(context, spot + 2, k) = unit AS flanked,
  (length(context) > spot + 1 AND regexp_full_match(substr(context, spot + 2), '(?:' || unit || ')*' || CASE k WHEN 1 THEN '' WHEN 2 THEN left(unit, 1) || '?' ELSE '(?:' || left(unit, 1) || '|' || left(unit, 2) || ')?' END))
  OR (len(steps) > 0 AND len(list_filter(steps, lambda i: substr(context, i, least(i, k)) <> right(unit, least(i, k)))) = 0) AS sketchy
FROM (SELECT *, list_filter(range(spot + 1, 0, -k), lambda i: i + k < length(context)) AS steps FROM (SELECT *, length(unit) AS k FROM ({CONTEXT_SQL}) c) d) e""")
def deletion_anchors(spark, sf_dir):
    c = F.col
    return _contexts(spark, sf_dir).select("id", "line", sequence.flanked_by_repeats(c("context"), c("unit"), c("at")).alias("flanked"), sequence.sketchy_anchor(c("context"), c("unit"), c("at")).alias("sketchy"))
