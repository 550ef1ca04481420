"""A content-addressed store of token ids.

Writing: each text becomes ids (an end id closes it), a rolling hash over the
last eight ids cuts the ids into chunks, and a chunk's name is the 128-bit
digest of its bytes.  The store holds

* ``chunks``: every different chunk once, as (digest, data); data are ids as
  little-endian unsigned 16-bit integers, or 32-bit where the vocabulary is larger;
* ``recipes``: per document, in ascending doc_id, its chunks' names and
  lengths, its Merkle root, and where its ids start in its file;
* ``manifest``: per recipe file its number of documents, its number of ids and
  its root over the documents' ids, places and roots, and a root over those.

Cut points depend on the ids around them only, so a passage that documents
share gives them the same chunks.

Reading: the recipes must give the manifest's roots.  Every chunk's bytes are read once and named anew.  A document is
verified if all its chunks bear their names and lengths and their names give
the recipe's root.  The checksum of a document's ids comes from its chunks'
checksums, which need only be shifted by the bytes that follow and combined.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.llm.common import binaries, dropped, file_system, only, shared_dir, text_parts
from varigrid.llm.shingles import mix

#: A cut falls after an id with one chance in this many; chunks keep to these lengths.
MEAN, LEAST, MOST = 512, 64, 4096
WINDOW = 8

#: Plain texts are in ASCII and the letters up to U+017F.  The tokenizer's pieces of them, in lower case, are the
#: contractions 's 't 're 've 'm 'll 'd, runs of letters, single digits, and runs of what is neither these nor white space.
#: What isn't plain: other scripts, marks, U+0130, and the start of a special token.
_OTHER = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]|<\|")


#: Code points that are encoded at once; longer texts are parted at white space.
RUN = 1 << 18


class Encoder:
    """Ids of whole texts, as the tokenizer file gives them.

    The tokenizer drops white space and never joins across it or across the
    pre-tokenizer's pieces, so a text's ids are its pieces' ids in a row.  For a
    run of texts at once, pieces are cut and hashed (64 bits, length included)
    and looked up in a table of open addresses; the model encodes new ones.
    Words with characters whose treatment isn't plain to see go through the
    whole tokenizer, and so do pieces of more than ``LONGEST`` letters.
    """

    LONGEST = 64

    def __init__(self, path: str, most_pieces: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes = _byte_letters()
        self.most_pieces = most_pieces
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self._table(10)
        self.lengths, self.starts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.known = self.held = 0

    def _table(self, bits: int) -> None:
        self.bits, self.keys, self.places = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _room(self, more: int) -> None:
        """Make the table large enough for the pieces known and some more: at least two thirds stay free."""
        bits = max(10, (3 * (self.known + more)).bit_length())
        if bits > self.bits:
            keys, places = self.keys, self.places
            full = np.flatnonzero(keys)
            self._table(bits)
            self._put(keys[full], places[full])

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            base = int(mix(np.array([11], np.uint64))[0] | np.uint64(1))
            for name, r in (("up", base), ("down", pow(base, -1, 1 << 64))):
                p = np.full(max(n, RUN + 2), np.uint64(r))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of pieces, -1 for unknown ones."""
        at, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            key = self.keys[slot]
            hit = key == h
            at[left[hit]] = self.places[slot[hit]]
            on = ~hit & (key != 0)
            left, h, slot = left[on], h[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return at

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces not known before, with the different hashes ``h``."""
        found, sizes = [], []
        for piece in pieces:
            letters = piece if piece.isascii() and piece.isprintable() else "".join([self.bytes[b] for b in piece.encode()])
            tokens = self.model.tokenize(letters)
            sizes.append(len(tokens))
            found += [t.id for t in tokens]
        ids, n = np.array(found, np.uint32), np.array(sizes, np.int64)
        k = self.known
        while k + len(n) > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.starts, 2 * len(self.starts))
        while self.held + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.held : self.held + len(ids)] = ids
        self.lengths[k : k + len(n)] = n
        self.starts[k : k + len(n)] = self.held + np.cumsum(n) - n
        self.held += len(ids)
        self.known += len(n)
        self._put(h, np.arange(k, k + len(n)))

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        """Note the places of different pieces that the table doesn't have."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.places[slot[won]] = h[won], place[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, place, slot = h[rest], place[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _pieces(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of some code points in lower case."""
        kind = _KIND[low]
        start = kind != _SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        mark = np.flatnonzero(start & (low == 39))
        if len(mark):
            one, two, three = (np.append(x, [0, 0, 0])[mark + i] for i, x in enumerate([low] * 4) if i)
            end = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
            for x, y in ("re", "ve", "ll"):
                end = np.where((one == ord(x)) & (two == ord(y)), 3, end)
            mark, end = mark[end > 0], end[end > 0]
            start[mark + 1] = False
            after = (mark + end)[mark + end < len(low)]
            start[after[kind[after] == _LETTER]] = True
        edge = np.flatnonzero(start | (kind == _SPACE))
        begins = start[edge]
        return edge[begins], np.append(edge[1:], len(low))[begins]

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of plain characters, one after the other, and how many each has."""
        code = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        ids, ends, before, pos = [], [], 0, 0
        counts = np.zeros(len(texts) + 1, np.int64)
        while pos < len(code):
            stop = min(pos + RUN, len(code))
            if stop < len(code):
                space = np.flatnonzero(_KIND[_LOWER[code[pos:stop]]] == _SPACE)
                while not len(space):
                    more = min(stop + RUN, len(code))
                    space = np.flatnonzero(_KIND[_LOWER[code[stop:more]]] == _SPACE)[:1] + (stop - pos)
                    stop = more
                    if stop == len(code) and not len(space):
                        space = np.array([stop - pos - 1])
                stop = pos + int(space[-1]) + 1
            low = _LOWER[code[pos:stop]]
            s, e = self._pieces(low)
            got, n = self._run(low, s, e)
            ids.append(got)
            # ids before each text's end
            ends = np.searchsorted(s, bounds - pos)
            counts[1:] += np.append(0, np.cumsum(n))[ends]
            pos = stop
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.diff(counts)

    def _run(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids in a row and how many each piece has."""
        n = len(low)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_SALT[low] * self.up[:n], out=sums[1:])
        h = mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)) | np.uint64(1)
        long = np.flatnonzero(e - s > self.LONGEST)
        if len(long):
            h[long] = 1  # told apart by their places below, never kept
        at = self._find(h)
        at[long] = -2
        new = np.flatnonzero(at == -1)
        if len(new):
            text = low.astype("<u4").tobytes().decode("utf-32-le")
            u, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.known + len(u) > self.most_pieces and self.known:
                self._forget()
                return self._run(low, s, e)
            self._room(len(u))
            a, b = s[new[first]].tolist(), e[new[first]].tolist()
            k = self.known
            self._learn(u, [text[x:y] for x, y in zip(a, b, strict=True)])
            at[new] = k + back
        sizes = np.zeros(len(s), np.int64)
        fits = at >= 0
        sizes[fits] = self.lengths[at[fits]]
        if len(long):
            text = low.astype("<u4").tobytes().decode("utf-32-le")
            whole = [np.array(self.whole.encode(text[x:y], add_special_tokens=False).ids, np.uint32) for x, y in zip(s[long].tolist(), e[long].tolist(), strict=True)]
            sizes[long] = [len(x) for x in whole]
        ends = np.cumsum(sizes)
        where = np.repeat(np.where(fits, self.starts[at], 0) - (ends - sizes), sizes)
        where += np.arange(len(where))
        out = self.pool[where] if not len(long) else self.pool[np.minimum(where, len(self.pool) - 1)]
        for i, x in zip(long.tolist(), whole if len(long) else (), strict=True):
            out[ends[i] - len(x) : ends[i]] = x
        return out, sizes

    def _mixed(self, text: str) -> np.ndarray:
        """Words in plain letters by their pieces, runs of others by the whole tokenizer."""
        out = [np.empty(0, np.uint32)]
        plain: list[str] = []
        other: list[str] = []

        def flush() -> None:
            if plain:
                out.append(self._plain([" ".join(plain)])[0])
            if other:
                out.append(np.array(self.whole.encode(" ".join(other), add_special_tokens=False).ids, np.uint32))
            plain.clear()
            other.clear()

        for word in re.split(r"[ \t\n\r\f\v]+", text):
            odd = bool(_OTHER.search(word))
            if (plain if odd else other) or len(plain) + len(other) > 50_000:
                flush()
            (other if odd else plain).append(word)
        flush()
        return np.concatenate(out)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; a null is empty."""
        plain, odd = [], {}
        for i, t in enumerate(texts):
            t = t or ""
            if "<|" in t:
                odd[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            elif not t.isascii() and _OTHER.search(t):
                odd[i] = self._mixed(t)
            plain.append("" if i in odd else t)
        ids, n = self._plain(plain)
        if odd:
            ends, parts, last = np.cumsum(n), [], 0
            for i, x in odd.items():
                parts += [ids[last : ends[i]], x]
                last = int(ends[i])
                n[i] = len(x)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, n

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


# kinds and lower case of the code points that plain texts consist of
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_LOWER = np.array([ord(x) if len(x) == 1 else i for i in range(0x180) for x in [chr(i).lower()]], np.uint32)
_KIND = np.full(0x180, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x180)]] = _LETTER
_SALT = mix(np.arange(1, 0x181, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    return Encoder(path)


_GEAR = mix(np.arange(1, 1 << 17, dtype=np.uint64))


def cut_all(ids: np.ndarray, bounds: list[int]) -> tuple[list[int], list[int]]:
    """Ends of the chunks of some documents' ids in a row, which end at ``bounds``, and each document's number of them.

    The hash of a document's first ids also sees the last ones of the document
    before, but no cut falls that early.
    """
    gear = _GEAR[ids & np.uint32((1 << 17) - 2)]
    rolled = gear.copy()
    for i in range(1, WINDOW):
        rolled[i:] += gear[:-i] << np.uint64(i)
    marks = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    near = np.searchsorted(marks, bounds).tolist()
    marks = marks.tolist()
    ends, counts, last, at = [], [], 0, 0
    for b, k in zip(bounds, near, strict=True):
        had = len(ends)
        if b - last > LEAST:
            for m in [*marks[at:k], b]:
                while m - last > MOST:
                    last += MOST
                    ends.append(last)
                if m - last >= LEAST or m == b and m > last:
                    ends.append(m)
                    last = m
        elif b > last:
            ends.append(b)
        counts.append(len(ends) - had)
        last, at = b, k
    return ends, counts


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return cut_all(ids, [len(ids)])[0]


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; an odd one out moves up as it is."""
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [xxhash.xxh3_128_digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _wide(path: str) -> str:
    return "<u2" if encoder(path).whole.get_vocab_size() <= 1 << 16 else "<u4"


@cache
def _shift_rows() -> np.ndarray:
    """Row k: what each bit of a CRC-32 becomes when 2**k zero bytes follow."""

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]
    rows = [m]
    for _ in range(47):
        rows.append([times(rows[-1], x) for x in rows[-1]])
    return np.array(rows, np.uint64)


def crc_shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What checksums add to that of the whole when so many bytes follow."""
    crc, after = crc.astype(np.uint64), after.astype(np.int64)
    for k, row in enumerate(_shift_rows()):
        on = (after >> k & 1).astype(bool)
        if on.any():
            x, y = crc[on], np.zeros(int(on.sum()), np.uint64)
            for i in range(32):
                y ^= np.where(x >> np.uint64(i) & np.uint64(1), row[i], np.uint64(0))
            crc[on] = y
        if not (after >> k + 1).any():
            break
    return crc


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) to a new store at ``path``.

    Null texts are empty and give the end id alone.  Rows are kept apart, so
    repeated doc_ids give several documents, in the order of their place in the
    input; null doc_ids come first.  An empty table gives an empty store.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = ["doc_id", "row", "n", "root", "names", "lengths", "fresh", "data"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, wide = encoder(tokenizer), np.dtype(_wide(tokenizer))
        row, sent = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            for at, to, _, _ in text_parts(batch.column(1)):
                ids, n = enc.encode_all(batch.column(1).slice(at, to - at).to_pylist())
                ids = np.insert(ids, np.cumsum(n), end_id).astype(wide)
                n += 1
                ends, counts = cut_all(ids, np.cumsum(n).tolist())
                raw = memoryview(ids.tobytes())
                size = np.diff([0, *ends])
                pieces = [raw[(e - k) * wide.itemsize : e * wide.itemsize] for e, k in zip(ends, size.tolist(), strict=True)]
                names = [xxhash.xxh3_128_digest(p) for p in pieces]
                if len(sent) > 500_000:
                    sent.clear()
                new = [name not in sent and not sent.add(name) for name in names]
                by = np.append(0, np.cumsum(counts))
                of = by.tolist()
                roots = [merkle(names[a:b]) for a, b in zip(of[:-1], of[1:], strict=True)]
                fresh = np.flatnonzero(new)
                lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                of_fresh = np.searchsorted(fresh, by)
                place = fresh - np.repeat(by[:-1], np.diff(of_fresh))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at), pa.array(np.arange(row, row + len(n))), pa.array(n), binaries(roots), lists(by, binaries(names)), lists(by, pa.array(size, pa.int32())),
                        lists(of_fresh, pa.array(place, pa.int32())), lists(of_fresh, binaries([bytes(pieces[i]) for i in fresh.tolist()])),
                    ],
                    items,
                )
                row += len(n)

    schema = f"doc_id {kind}, row long, n long, root binary, names array<binary>, lengths array<int>, fresh array<int>, data array<binary>"
    draft = f"{path}/draft"
    only(docs, "doc_id", "text").mapInArrow(encode, schema).write.option("compression", "zstd").parquet(draft)
    drafted = spark.read.schema(schema).parquet(draft)

    new = drafted.select("names", F.explode(F.arrays_zip("fresh", "data")).alias("x"))
    new = new.select(F.element_at("names", F.col("x.fresh") + 1).alias("name"), F.col("x.data").alias("data"))
    new.groupBy("name").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), file, np.int32)), pa.array(ends - n)], [*batch.schema.names, "file", "at"])
            before = int(ends[-1]) if len(n) else before

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = drafted.select(*items[:6]).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    recipe = f"doc_id {kind}, row long, n long, root binary, names array<binary>, lengths array<int>, file int, at long"
    recipes.mapInArrow(place, recipe).write.option("compression", "zstd").parquet(f"{path}/recipes")
    dropped(spark, draft)

    written = spark.read.schema(recipe).parquet(f"{path}/recipes")
    files = file_roots(written)
    manifest = {
        "end_id": end_id,
        "ids": _wide(tokenizer),
        "files": files,
        "root": merkle([bytes.fromhex(f["root"]) for f in files]).hex(),
        "doc_id": kind,
    }
    fs, p = file_system(spark, f"{path}/manifest.json")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()


def file_roots(recipes: DataFrame) -> list[dict]:
    """Per recipe file its documents, ids and root: a digest over doc_id, row, place, length and root of its documents in order."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for file, at, row, n, root, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                had = seen.setdefault(file, [0, 0, xxhash.xxh3_128()])
                had[0] += 1
                had[1] += n
                had[2].update(f"{doc_id!r} {row} {at} {n} ".encode() + root)
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.int32()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1)), pa.array([x[2].hexdigest() for x in seen.values()], pa.string())], ["file", "documents", "ids", "root"])

    rows = recipes.select("file", "at", "row", "n", "root", "doc_id").repartition("file").sortWithinPartitions("file", "at", "row")
    return [r.asDict() for r in sorted(rows.mapInArrow(roots, "file int, documents long, ids long, root string").collect())]  # a row a file


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, p = file_system(spark, f"{path}/manifest.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _recipes(spark: SparkSession, path: str, manifest: dict) -> DataFrame:
    schema = f"doc_id {manifest['doc_id']}, row long, n long, root binary, names array<binary>, lengths array<int>, file int, at long"
    return spark.read.schema(schema).parquet(f"{path}/recipes")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) per document, from the store's files alone.

    Recipes that don't give the manifest's roots are an error: a document, its
    id, its place or its length was changed, added or lost.  Changed chunks show
    in ``verified``.
    """
    manifest = read_manifest(spark, path)
    wide = manifest["ids"]
    files = file_roots(_recipes(spark, path, manifest))
    if files != manifest["files"] or merkle([bytes.fromhex(f["root"]) for f in files]).hex() != manifest["root"]:
        raise ValueError(f"the recipes in {path} don't give the manifest's roots")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, good = [], [], []
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.as_py()
                ids = np.frombuffer(raw, wide)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                good.append(xxhash.xxh3_128_digest(raw) == name.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64()), pa.array(good, pa.bool_())], ["name", "size", "crc", "good"])

    chunks = spark.read.schema("name binary, data binary").parquet(f"{path}/chunks").mapInArrow(read, "name binary, size int, crc long, good boolean")
    recipes = _recipes(spark, path, manifest)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk of a document, with the bytes after it, and whether the names give the root."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out: list[list] = [[], [], [], [], []]
                for row, n, root, names, lengths in zip(*(batch.slice(at, 2000).column(i).to_pylist() for i in range(5)), strict=True):
                    after = (sum(lengths) - np.cumsum(lengths)) * 4
                    whole = merkle(names) == root and sum(lengths) == n
                    for c, x in zip(out, ([row] * len(names), names, lengths, after.tolist(), [whole] * len(names)), strict=True):
                        c.extend(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), binaries(out[1]), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.bool_())], ["row", "name", "length", "after", "whole"])

    # a name that many documents use is one key of the join; its large side is split by Spark's skew join
    uses = recipes.select("row", "n", "root", "names", "lengths").mapInArrow(spread, "row long, name binary, length int, after long, whole boolean")
    used = uses.join(chunks, "name", "left").select("row", "crc", "after", "size", (F.col("whole") & F.coalesce(F.col("good") & (F.col("size") == F.col("length")), F.lit(False))).alias("ok"))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = crc_shifted(batch.column(1).fill_null(0).to_numpy(), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc.astype(np.int64)), batch.column(3), batch.column(4)], ["row", "crc", "size", "ok"])

    sums = used.mapInArrow(shift, "row long, crc long, size int, ok boolean").groupBy("row").agg(
        F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("n_tokens"), F.every("ok").alias("verified")
    )
    before, starts = 0, []
    for f in manifest["files"]:
        starts.append((f["file"], before))
        before += f["ids"]
    at = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0), F.lit(0))
    placed = recipes.select("doc_id", "row", (F.element_at(at, F.col("file")).cast("long") + F.col("at")).alias("start"))
    return placed.join(sums, "row").select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids array<long>): the documents' ids put together again from their chunks."""
    manifest = read_manifest(spark, path)
    wide = manifest["ids"]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.concatenate([np.frombuffer(x["data"], wide) for x in sorted(xs, key=lambda x: x["pos"])]).astype(np.int64) for xs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "row", "ids"])

    uses = _recipes(spark, path, manifest).select("doc_id", "row", F.posexplode("names").alias("pos", "name"))
    chunks = spark.read.schema("name binary, data binary").parquet(f"{path}/chunks")
    whole = uses.join(chunks, "name").groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "data")).alias("parts"))
    return whole.mapInArrow(ids, f"doc_id {manifest['doc_id']}, row long, ids array<long>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and report on its documents as read back."""
    path = shared_dir(docs.sparkSession)
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path)
