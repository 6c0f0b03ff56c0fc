"""Token ids as a content-addressed store.

A rolling hash over the last ids of a document cuts its id stream into chunks, so equal passages mostly give equal
chunks. `write_store` writes below one path: chunks (digest, data: each unique chunk once), recipes (documents in
ascending id: start, n_tokens, chunk digests, Merkle root) and manifest (one row a shard of recipes: id range, sums,
Merkle root over its documents' rows, ids, places and roots; one row of a null shard: the same of the store, with the
Merkle root over the shards, and how ids are stored). `verify` reads the files back, recomputes every digest and root, and gives each document's checksum
from the stored chunks alone: a CRC over a document is the sum of its chunks' CRCs, each shifted by the bytes after
it, so chunk data need not travel. `read_ids` reconstructs the id streams.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from ._pretokens import Rules, rules
from ._spark import cut, drop, groups_for
from .bpe import WordIds

ROLLING, MASK, LEAST, MOST = 16, 0xFF, 64, 2048
#: Pre-tokens that the library gets in one text.
TOGETHER = 500


#: Pre-tokens that the library takes in a text of many, and gives back one by one: ASCII without capitals, and letters from ß to ÿ.
_PLAIN = re.compile(rb"[!-@\[-~]+|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


class LibraryIds(WordIds):
    """Ids of pre-tokens as the tokenizer library encodes them."""

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        own = self.own
        if not hasattr(own, "is_end"):
            own.is_end = np.zeros(max([*own.vocab.values(), *own.special.values()]) + 1, bool)
            own.is_end[[i for t, i in own.vocab.items() if t.endswith("</w>")]] = True
        plain = np.fromiter((_PLAIN(w) is not None for w in words), bool, len(words))
        ids = [np.zeros(0, np.int32)]
        asked = [w for w, ok in zip(words, plain.tolist(), strict=True) if ok]
        for lo in range(0, len(asked), TOGETHER):
            text = b" ".join(asked[lo : lo + TOGETHER]).decode()
            ids.append(np.array(own.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
        flat = np.concatenate(ids)
        ends = np.flatnonzero(own.is_end[flat]) + 1
        if len(ends) != len(asked):
            raise ValueError("the library split a pre-token")
        if len(asked) == len(words):
            return flat, np.concatenate([[0], ends])
        others = [np.array([t.id for t in own.library.model.tokenize("".join(own.char_of[b] for b in w))] if w else [], np.int32) for w, ok in zip(words, plain.tolist(), strict=True) if not ok]
        counts = np.zeros(len(words), np.int64)
        counts[plain], counts[~plain] = np.diff(ends, prepend=0), [len(x) for x in others]
        out, of_plain = np.empty(int(counts.sum()), np.int32), np.repeat(plain, counts)
        out[of_plain], out[~of_plain] = flat, np.concatenate(others)
        return out, np.concatenate([[0], np.cumsum(counts)])


def chunk_ends(ids: np.ndarray, begins: np.ndarray) -> list[list[int]]:
    """Where the chunks of each stream ids[begins[i]:begins[i + 1]] end, counted from the stream's begin.

    A chunk ends where the rolling hash of the last ROLLING ids has MASK's bits clear, has LEAST ids or more unless
    the stream ends, and MOST at most.
    """
    hit = np.flatnonzero((A.hash_windows(ids.astype(np.uint64) + A.U64(1), ROLLING) & A.U64(MASK)) == 0) + ROLLING
    out = []
    cuts = np.searchsorted(hit, begins, side="right")
    for lo, hi, a, b in zip(begins, begins[1:], cuts, cuts[1:], strict=False):
        ends, last, n = [], 0, int(hi - lo)
        for end in [int(x - lo) for x in hit[a:b] if x - lo >= ROLLING] + [n]:
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if (end - last >= LEAST and end < n) or (end == n and end > last):
                last = end
                ends.append(end)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """SHA-256 tree: leaves are tagged 0, inner nodes 1; an odd node goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


_SCHEMA = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("data", pa.binary()), ("id", pa.int64()), ("n", pa.int64()), ("digests", pa.binary()), ("sizes", pa.list_(pa.int32()))])
_DDL = "kind string, key binary, data binary, id long, n long, digests binary, sizes array<int>"


def id_kind(own: Rules) -> str:
    """How ids are stored: two bytes each if all ids of the file fit."""
    return "<u2" if max([*own.vocab.values(), *own.special.values()]) < 1 << 16 else "<u4"


def _chunker(path: str, end_id: int | None, kind: str):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LibraryIds(rules(path))
        for block in A.blocks(batches, max_bytes=3 * A.BLOCK_BYTES):
            ids, begins = own.block(block.column("text"))
            if end_id is not None:
                ids = np.insert(ids, begins[1:], end_id)
                begins = begins + np.arange(len(begins))
            chunks: dict[bytes, bytes] = {}
            data, width = ids.astype(kind).tobytes(), int(kind[-1])
            digests, sizes = [], []
            for lo, ends in zip(begins, chunk_ends(ids, begins), strict=False):
                own_digests, last = [], 0
                for end in ends:
                    part = data[(lo + last) * width : (lo + end) * width]
                    own_digests.append(digest := hashlib.sha256(part).digest())
                    chunks[digest] = part
                    last = end
                digests.append(b"".join(own_digests))
                sizes.append(np.diff(ends, prepend=0).tolist() if ends else [])
            n = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n), pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32()))], schema=_SCHEMA)
            m = block.num_rows
            keys = [hashlib.blake2b(d, digest_size=8).digest() for d in digests]
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * m), pa.array(keys, pa.binary()), pa.nulls(m, pa.binary()), block.column("id"), pa.array(np.diff(begins), pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], schema=_SCHEMA)

    return chunk


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with each chunk once; equal chunks are all in one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind == "doc" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield batch.filter(pa.array(keep))


def write_store(docs: DataFrame, path: str, out: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text of docs with the tokenizer file at `path` and writes the store below `out`.

    end_id is appended to each document's ids. Null texts are empty; null ids come first in the order; rows that
    repeat an id are stored one after the other. Copies of one document are dealt out by the hash of their content
    and id, so a large group of them is spread.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = groups_for(docs, 16 << 20, text_col)
    kind = id_kind(rules(path))
    rows = read.mapInArrow(_chunker(path, end_id, kind), _DDL)
    place = F.when(F.col("kind") == "doc", F.xxhash64("id", "key")).otherwise(F.xxhash64("key")).alias("place")
    dealt = rows.withColumn("place", place).repartition(parts, "place").drop("place")
    dealt.mapInArrow(_unique, _DDL).write.option("compression", "zstd").partitionBy("kind").parquet(f"{out}/parts")
    docs_part = spark.read.schema(_DDL).parquet(f"{out}/parts").filter("kind = 'doc'").select("id", "n", "digests", "sizes")
    ranged = cut(docs_part.repartitionByRange(max(1, parts // 2), "id").withColumn("shard", F.spark_partition_id()))
    totals = ranged.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs")).orderBy("shard").collect()  # one row a shard
    starts, at, row = {}, 0, 0
    for t in totals:
        starts[t.shard] = (at, row)
        at, row = at + t.ids, row + t.docs

    def recipes(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard, [("id", "ascending"), ("digests", "ascending")], null_placement="at_start"))
        at, row = starts[shard.column("shard")[0].as_py()]
        n = shard.column("n").to_numpy()
        roots = [merkle([d[i : i + 32] for i in range(0, len(d), 32)]) for d in shard.column("digests").to_pylist()]
        made = {"shard": shard.column("shard"), "row": pa.array(np.arange(row, row + len(n))), "doc_id": shard.column("id"), "start": pa.array(at + np.cumsum(n) - n), "n_tokens": shard.column("n")}
        return pa.table(made | {"digests": shard.column("digests"), "sizes": shard.column("sizes"), "root": pa.array(roots, pa.binary())})

    kinds = "shard int, row long, doc_id long, start long, n_tokens long, digests binary, sizes array<int>, root binary"
    ranged.groupBy("shard").applyInArrow(recipes, kinds).write.parquet(f"{out}/recipes")
    rows = [(*r, kind if r[0] is None else None) for r in _manifest(spark.read.parquet(f"{out}/recipes"))]
    spark.createDataFrame(rows, f"{_MANIFEST}, kind string").write.parquet(f"{out}/manifest")
    drop(ranged)


_MANIFEST = "shard int, docs long, first_row long, first_id long, last_id long, ids long, root binary"


def _stored_kind(spark: SparkSession, out: str) -> str:
    """How the store's ids are stored."""
    return spark.read.parquet(f"{out}/manifest").filter("shard IS NULL").first().kind


def _shard(group: pa.Table) -> pa.Table:
    """The manifest's row of one shard."""
    group = group.sort_by("row")
    columns = [group.column(n).to_pylist() for n in ("row", "doc_id", "start", "n_tokens", "root")]
    root = merkle([f"{row},{doc},{start},{n},".encode() + own for row, doc, start, n, own in zip(*columns, strict=True)])
    ids = [x for x in columns[1] if x is not None]
    out = {"shard": group.column("shard")[0].as_py(), "docs": group.num_rows, "first_row": columns[0][0], "first_id": min(ids, default=None), "last_id": max(ids, default=None), "ids": sum(columns[3]), "root": root}
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    return pa.table([pa.array([x], kind) for x, kind in zip(out.values(), kinds, strict=True)], names=list(out))


def _manifest(recipes: DataFrame) -> list[tuple]:
    """One row for each shard, in order, and at last one for the store, whose shard is null."""
    made = recipes.select("shard", "row", "doc_id", "start", "n_tokens", "root").groupBy("shard").applyInArrow(_shard, _MANIFEST)
    rows = sorted((_plain(r) for r in made.collect()), key=lambda r: r[0])  # one row a shard
    root = merkle([",".join(map(str, r[:-1])).encode() + b"," + r[-1] for r in rows])
    ids = [x for r in rows for x in r[3:5] if x is not None]
    return [*rows, (None, sum(r[1] for r in rows), min((r[2] for r in rows), default=None), min(ids, default=None), max(ids, default=None), sum(r[5] for r in rows), root)]


def _plain(row: tuple) -> tuple:
    return (*row[:-1], bytes(row[-1]))


def _crc_tables() -> np.ndarray:
    """tables[k]: what a CRC becomes when 2 ** k zero bytes follow, by its four bytes."""

    def shift(crc: int) -> int:
        for _ in range(8):
            crc = (crc >> 1) ^ (0xEDB88320 if crc & 1 else 0)
        return crc

    out = np.zeros((48, 4, 256), np.uint32)
    for byte in range(4):
        for value in range(256):
            out[0, byte, value] = shift(value << (8 * byte))
    for k in range(1, 48):
        out[k] = _shifted(out[k - 1].ravel(), out[k - 1]).reshape(4, 256)
    return out


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def crc_before(crc: np.ndarray, after: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The part that a chunk's CRC-32 has in the CRC-32 of a stream that goes on for `after` bytes."""
    crc = crc.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        odd = (after >> k) & 1 == 1
        crc[odd] = _shifted(crc[odd], tables[k])
    return crc


def verify(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files; fails if anything doesn't add up.

    ids_crc32 is over the ids as little-endian 32-bit integers.
    """
    parts = spark.read.schema(_DDL).parquet(f"{out}/parts").filter("kind = 'chunk'").select("key", "data")
    recipes, kind = spark.read.parquet(f"{out}/recipes"), _stored_kind(spark, out)
    if Counter(_manifest(recipes)) != Counter(_plain(r) for r in spark.read.parquet(f"{out}/manifest").drop("kind").collect()):
        raise ValueError(f"{out}: recipes and manifest differ")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != key:
                    raise ValueError(f"{out}: a chunk differs from its digest")
                ids = np.frombuffer(data, kind)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "crc", "size"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, sizes, after = [], [], [], []
            for row, digests, size, root in zip(batch.column("row").to_pylist(), batch.column("digests").to_pylist(), batch.column("sizes").to_pylist(), batch.column("root").to_pylist(), strict=True):
                own = [digests[i : i + 32] for i in range(0, len(digests), 32)]
                if merkle(own) != root or len(own) != len(size):
                    raise ValueError(f"{out}: a recipe differs from its root")
                total = np.cumsum(size, dtype=np.int64)
                rows += [row] * len(own)
                keys += own
                sizes += size
                after += (4 * (total[-1:] - total)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(after, pa.int64())], names=["row", "link", "asked", "after"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for batch in batches:
            crc = crc_before(batch.column("crc").to_numpy(), batch.column("after").to_numpy(), tables)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(crc.astype(np.int64)), batch.column("size")], names=["row", "crc", "size"])

    linked = recipes.select("row", "digests", "sizes", "root").mapInArrow(links, "row long, link binary, asked int, after long")
    stored = parts.mapInArrow(sums, "key binary, crc long, size int")
    joined = linked.join(stored, F.col("link") == F.col("key"), "left")
    joined = joined.select("row", "after", "crc", F.when(F.col("asked") == F.col("size"), F.col("size")).otherwise(F.raise_error(F.lit("a chunk is missing or of another size"))).alias("size"))
    whole = joined.mapInArrow(moved, "row long, crc long, size int").groupBy("row").agg(F.bit_xor("crc").alias("crc"), F.sum("size").alias("n")).withColumnRenamed("row", "r")
    result = recipes.select("row", "doc_id", "start", "n_tokens").join(whole, F.col("row") == F.col("r"), "left")
    same = F.coalesce(F.col("n"), F.lit(0)) == F.col("n_tokens")
    return result.select("doc_id", "start", F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not whole"))).alias("n_tokens"), F.coalesce("crc", F.lit(0).cast("long")).alias("ids_crc32"))


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, ids array<int> of each stored document, put together from its chunks."""
    recipes, kind = spark.read.parquet(f"{out}/recipes"), _stored_kind(spark, out)
    parts = spark.read.schema(_DDL).parquet(f"{out}/parts").filter("kind = 'chunk'").select("key", "data")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, i, d[i : i + 32]) for r, d in zip(batch.column("row").to_pylist(), batch.column("digests").to_pylist(), strict=True) for i in range(0, len(d), 32)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] // 32 for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["r", "k", "link"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["data"] for x in sorted(own or [], key=lambda x: x["k"])), kind).astype(np.int32) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    linked = recipes.select("row", "digests").mapInArrow(links, "r long, k long, link binary").join(parts, F.col("link") == F.col("key"))
    own = linked.groupBy("r").agg(F.collect_list(F.struct("k", "data")).alias("own"))
    return recipes.join(own, F.col("row") == F.col("r"), "left").select("doc_id", "start", "own").mapInArrow(join, "doc_id long, start long, ids array<int>")
