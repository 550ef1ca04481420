"""Clips put back: known cases, and a walk over letters."""

import random
import re

import pytest
from pyspark.sql import functions as F

#: Alignment, marks, former clip at the start, result.
KNOWN = [
    ("4M1I", "X====", 1, "1S3M1I"), ("4M1I", "XX===", 1, "1S3M1I"), ("4M1I", "=X===", 1, "4M1I"), ("4M1I", "=X===", 2, "2S2M1I"), ("4M1I", "XX===", 2, "2S2M1I"),
    ("10M1I", "XX=========U", 5, "5S5M1I"), ("3S7M1I", "XX=========U", 5, "5S5M1I"), ("5S5M1I", "XX=========U", 5, "5S5M1I"),
    ("15M1I", "===============U", 12, "15M1I"), ("15M1I", "==X============U", 11, "11S4M1I"), ("15M1I", "==X============U", 12, "3S12M1I"),
]


def walked(cigar, marks, prefix, suffix, mess=True):
    t = list("".join(op * int(n) for n, op in re.findall(r"(\d+)([A-Z])", cigar)))
    other = [i for i, c in enumerate(t) if c not in "MS"]
    if not prefix and not suffix:
        return cigar
    first, last = (min(other[0] + 1, prefix), min(len(t) - other[-1], suffix)) if other else (0, 0)
    before = list(t)
    messy, begun, shift = sum(marks[prefix - first + i] == "X" for i in range(first)) > prefix / 12, False, prefix - first
    for i in range(first - 1, -1, -1):
        if before[i] != "M":
            continue
        near = other and (other[0] - i == 1 or mess and other[0] - i == 2) and first > other[0]
        if not near and (messy or begun or marks[i + shift] == "X"):
            t[i], begun = "S", True
    messy, begun = sum(marks[len(marks) - last + i] == "X" for i in range(last)) > suffix / 12, False
    for i in range(last):
        at = len(t) - last + i
        if t[at] != "M":
            continue
        near = other and at - other[-1] == 1 and last == len(t) - other[-1]
        if not near and (messy or begun or marks[len(marks) - last + i] == "X"):
            t[at], begun = "S", True
    text = "".join(t)
    text = text if "M" in text else re.sub("^(S*)S", r"\1M", text, count=1)
    return "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", text))


def put_back(spark, rows, **options):
    from varigrid.operators.clips import reclipped

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, m string, p int, s int")
    return [r[0] for r in df.orderBy("i").select(reclipped(F.col("c"), F.col("m"), F.col("p"), F.col("s"), **options)).collect()]


def test_known_clips(spark):
    assert put_back(spark, [(c, m, p, 0) for c, m, p, _ in KNOWN]) == [k[3] for k in KNOWN]
    assert put_back(spark, [("6M2I", "XX====UU", 2, 0), ("8M", "XX====XX", 2, 2), ("", "", 1, 1), (None, "", 1, 1)]) == ["2S4M2I", "8M", "", None]
    assert put_back(spark, [("8M2I", "XX======UU", 2, 0)], only_n=True) == ["8M2I"]
    assert put_back(spark, [("8M2I", "XX======UU", 5, 0)], only_n=True, prefix_n=F.lit(2)) == ["2S6M2I"]
    assert put_back(spark, [("8M2I", "========UU", 3, 0)], clip_matches=True) == ["3S5M2I"]


@pytest.mark.parametrize("mess", [True, False])
def test_clips_equal_a_walk(spark, mess):
    rng, rows = random.Random(5 + mess), []
    for _ in range(600):
        ops = [(rng.randrange(1, 4), "S")] * (rng.random() < 0.2) + [(rng.randrange(1, 18), "M")]
        for _ in range(rng.randrange(3)):
            ops += [(rng.randrange(1, 4), rng.choice("ID")), (rng.randrange(1, 18), "M")]
        ops += [(rng.randrange(1, 4), "S")] * (rng.random() < 0.2)
        marks = "".join("".join("U" if op in "SI" else "X" if rng.random() < rng.choice([0.05, 0.4]) else "=" for _ in range(n)) for n, op in ops if op != "D")
        most = min(16, len(marks))
        rows.append(("".join(f"{n}{op}" for n, op in ops), marks, rng.randrange(most + 1), rng.randrange(most + 1)))
    got = put_back(spark, rows, mess=mess)
    assert got == [walked(*r, mess=mess) for r in rows]


def test_marks_of_bases(spark):
    from varigrid.operators.clips import base_marks

    df = spark.createDataFrame([(5, "2S3M1I2M1D2M", "AAACGTTGCA", "CCACGTGACATT", 3)], "pos long, cigar string, bases string, context string, context_start long")
    # places 5-7 are ACG, 8-9 TG, then 11-12 CA
    assert df.select(base_marks(F.struct("*"))).first()[0] == "UU===U===="
    wrong = df.withColumn("bases", F.lit("AATCGTTNCA"))
    assert wrong.select(base_marks(F.struct("*"))).first()[0] == "UUX==U=X=="
    assert df.withColumn("context", F.lit("CCAC")).select(base_marks(F.struct("*"))).first()[0] == "UU==XUXXXX"
