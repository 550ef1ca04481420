"""Binary alignment files as a Spark data source.

``spark.dataSource.register(AlignmentSource)`` makes ``spark.read.format("alignments")``
known.  A partition is a file, read block by block: a task holds one compressed
block and the records that begin in it, whatever the file's size.  Files per
chromosome or lane give as many partitions.
"""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, flag int, chrom string, pos int, mapq int, cigar string, bases string, quals array<int>, mate_chrom string, mate_pos int, tags map<string,string>"

# Codes of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_SIZES = {"c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}


def stream(file: BinaryIO) -> Iterator[bytes]:
    """The unpacked blocks of a blocked file, one after another."""
    while head := file.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a blocked file")
        n = struct.unpack_from("<H", head, 10)[0]
        extra, at, size = file.read(n), 0, None
        while at < n:
            if extra[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + struct.unpack_from("<H", extra, at + 2)[0]
        if size is None:
            raise ValueError("not a blocked file")
        body = file.read(size - 12 - n)
        yield zlib.decompress(body[:-8], -15)


def header(raw: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """Text, (name, length) of the contigs, and where records begin."""
    if raw[:4] != b"BAM\x01":
        raise ValueError("not an alignment file")
    n = struct.unpack_from("<i", raw, 4)[0]
    text = raw[8 : 8 + n].split(b"\0")[0].decode()
    at = 8 + n
    count = struct.unpack_from("<i", raw, at)[0]
    at += 4
    contigs = []
    for _ in range(count):
        k = struct.unpack_from("<i", raw, at)[0]
        contigs.append((raw[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", raw, at + 4 + k)[0]))
        at += 8 + k
    return text, contigs, at


def tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "A":
            out[name], at = chr(raw[at]), at + 1
        elif kind == "B":
            code, size = _SIZES[chr(raw[at])]
            n = struct.unpack_from("<i", raw, at + 1)[0]
            out[name] = ",".join(map(str, struct.unpack_from(f"<{n}{code}", raw, at + 5)))
            at += 5 + n * size
        else:
            code, size = _SIZES[kind]
            out[name] = str(struct.unpack_from("<" + code, raw, at)[0])
            at += size
    return out


def record(raw: bytes, contigs: list[tuple[str, int]]) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", raw, 0)
    at = 32
    name = raw[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at)) or "*"
    at += 4 * n_cigar
    packed = raw[at : at + (l_seq + 1) // 2]
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    quals = list(raw[at : at + l_seq])
    where = lambda i: contigs[i][0] if i >= 0 else None
    return name, flag, where(ref), pos + 1, mapq, cigar, bases, quals, where(mate_ref), mate_pos + 1, tags(raw[at + l_seq :])


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class AlignmentReader(DataSourceReader):
    """Reads files that the driver and executors see under one path."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, part: Part) -> Iterator[tuple]:
        contigs, held = None, b""
        with open(part.path, "rb") as file:
            for raw in stream(file):
                held += raw
                if contigs is None:
                    try:
                        _, contigs, begins = header(held)
                    except (struct.error, IndexError):
                        continue  # the header goes on in the next block
                    held = held[begins:]
                at = 0
                while at + 4 <= len(held):
                    n = struct.unpack_from("<i", held, at)[0]
                    if at + 4 + n > len(held):
                        break
                    yield record(held[at + 4 : at + 4 + n], contigs)
                    at += 4 + n
                held = held[at:]
        if held or contigs is None:
            raise ValueError(f"{part.path} ends within a record")


class AlignmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options["path"])
