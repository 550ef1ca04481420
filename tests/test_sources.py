"""Files written and read again."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F


def block(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    size = len(body) + 25
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", size) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def alignment(name: str, pos: int, bases: str) -> bytes:
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in bases + ("=" if len(bases) % 2 else "")]
    body = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 60, 0, 1, 99, len(bases), 0, pos + 9, 0) + name.encode() + b"\0"
    body += struct.pack("<I", len(bases) << 4) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + bytes([30] * len(bases)) + b"NMC\x02XDZ5F\0"
    return struct.pack("<i", len(body)) + body


def test_alignments_across_block_borders(spark, tmp_path):
    from varigrid.sources.bam import AlignmentSource

    raw = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    raw += b"".join(alignment(f"r{i}", 10 + i, "ACGTN"[: 3 + i % 3]) for i in range(100))
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(block(raw[i : i + 777]) for i in range(0, len(raw), 777)) + block(b""))
    spark.dataSource.register(AlignmentSource)
    rows = spark.read.format("alignments").option("path", str(path)).load().orderBy("pos").collect()
    assert len(rows) == 100 and rows[5].name == "r5" and rows[5].pos == 15 and rows[5].bases == "ACGTN" and rows[5].cigar == "5M" and rows[5].tags == {"NM": "2", "XD": "5F"}


def test_calls_round_trip_in_contig_order(spark, tmp_path):
    from varigrid.sources import text

    header = ["##fileformat=VCFv4.1", "##contig=<ID=chr10,length=5>", "##contig=<ID=chr2,length=5>", "#CHROM\tPOS"]
    calls = spark.createDataFrame([("chr2", 5, "chr2\t5\t.\tA\tC\t30\tPASS\tDP=9\tGT\t0/1"), ("chr10", 7, "chr10\t7\t.\tA\tg\t30\tPASS\tDP=9\tGT\t0/1")], "chrom string, pos long, line string")
    text.write_calls(calls, header, str(tmp_path / "out"))
    assert text.read_header(spark, str(tmp_path / "out/header")) == header
    assert [r.chrom for r in spark.read.text(str(tmp_path / "out/records")).select(F.split("value", "\t")[0].alias("chrom")).collect()] == ["chr10", "chr2"]
    assert {(r.chrom, r.alt) for r in text.read_forced(spark, str(tmp_path / "out/records")).collect()} == {("chr2", "C"), ("chr10", "G")}


def test_reference_blocks_and_context(spark, tmp_path):
    from varigrid.sources import text

    (tmp_path / "g.fa").write_text(">c1 x\nacgtacgta\nCCGGTTNNA\n>c2\nTTTT\n")
    ref = text.read_fasta(spark, str(tmp_path / "g.fa"), block=5)
    assert sorted((r.contig, r.start, r.bases) for r in ref.collect()) == [("c1", 1, "ACGTA"), ("c1", 6, "CGTAC"), ("c1", 11, "CGGTT"), ("c1", 16, "NNA"), ("c2", 1, "TTTT")]
    assert sorted(tuple(r) for r in text.contig_sizes(ref).collect()) == [("c1", 18, 16), ("c2", 4, 4)]
    got = text.context(spark.createDataFrame([("c1", 6), ("c1", 1), ("c2", 4)], "chrom string, pos long"), ref, 3, 5)
    assert sorted((r.chrom, r.pos, r.context_start, r.context) for r in got.collect()) == [("c1", 1, 1, "ACGT"), ("c1", 6, 3, "GTACGTA"), ("c2", 4, 1, "TTTT")]


def test_intervals_and_counts(spark, tmp_path):
    from varigrid.sources import text

    (tmp_path / "i.picard").write_text("@HD\tx\nchr1\t5\t9\nchr1\t9\t5\n")
    assert [tuple(r) for r in text.read_intervals(spark, str(tmp_path / "i.picard")).collect()] == [("chr1", 5, 9)]
    counts = spark.createDataFrame([("A>C", 5.0), ("A>G", 1.0)], "category string, n double")
    text.write_counts(counts, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in text.read_counts(spark, str(tmp_path / "c")).collect()) == [("A>C", 5.0), ("A>G", 1.0)]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from varigrid.streaming import windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = windows.blocks(events, "ts", "1 hour", "365 days", "event_type")
    got = run(windows.blocks(stream, "ts", "1 hour", "365 days", "event_type"), "complete", "blocks")
    key = lambda df: sorted((r.event_type, r.block, r.n) for r in df.collect())
    assert key(got) == key(batch)
    drops = run(windows.drops(stream.select("user_id", "ts", "event_id", "value"), "user_id"), "append", "drops")
    assert drops.filter("value >= 0.5 * before").count() == 0 and drops.count() > 0


def test_not_a_blocked_file(tmp_path):
    from varigrid.sources.bam import AlignmentReader, Part

    (tmp_path / "x").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        list(AlignmentReader("").read(Part(str(tmp_path / "x"))))
