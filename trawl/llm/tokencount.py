"""Token counts: every distinct pre-token is merged once, and its number of pieces joined to the documents' frequencies.

A block of documents gives two things: the distinct pre-tokens it has, dealt out by their hash, and a sparse matrix
(document, pre-token, frequency). Where the pre-tokens meet, each distinct one is counted once, and the counts go
back to the blocks that asked. A block then multiplies and sums. Token ids are never made for a document.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._pack import pack, pack_steps, unpack, unpack_steps
from ._pretokens import pretokens, rules
from ._spark import cut, groups_for
from .bpe import WordIds

_ROWS = "pid int, block long, words binary, at binary, freq binary, doc binary"


def _split(path: str, groups: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rules(path)
        for part in A.blocks(batches, max_bytes=4 * A.BLOCK_BYTES):
            block = secrets.randbits(63)
            number, first, distinct = pretokens(part.column("text"), own)
            n = len(distinct)
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            cells, freq = np.unique(doc.astype(np.int64) * max(n, 1) + number, return_counts=True)
            special = np.array([isinstance(w, int) for w in distinct], bool)
            words = np.array([b"" if isinstance(w, int) else w for w in distinct], object)
            sizes = np.fromiter(map(len, words), np.int64, n)
            ends = np.cumsum(sizes)
            hashes = A.hash_spans(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
            pid = (hashes % A.U64(groups)).astype(np.int64)
            pid[special] = -1
            order = np.argsort(pid, kind="stable")
            order = order[pid[order] >= 0]
            cuts = np.flatnonzero(np.diff(pid[order], prepend=-1))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(order)][-len(cuts) :] if len(cuts) else (), strict=True):
                mine = order[lo:hi]
                rows.append({"pid": int(pid[mine[0]]), "block": block, "words": _joined(words[mine]), "at": pack_steps(mine), "freq": pack(sizes[mine], np.uint32), "doc": None})
            _, offsets = A.buffer_of(part.column("text"))
            ids = part.column("id").fill_null(0).to_numpy()
            table = np.stack([ids, part.column("id").is_valid().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)])
            rows.append({"pid": -1, "block": block, "words": pack_steps(np.flatnonzero(special)), "at": pack_steps(cells, np.int64), "freq": pack(freq, np.uint32), "doc": pack(table, np.int64)})
            rows[-1]["pid"] = -1 - n
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pid", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("at", pa.binary()), ("freq", pa.binary()), ("doc", pa.binary())]))

    return split


def _joined(words: np.ndarray) -> bytes:
    return pack(np.frombuffer(b"".join(words), np.uint8), np.uint8)


def _count(path: str):
    def count(group: pa.Table) -> pa.Table:
        own = WordIds(rules(path))
        asked, distinct = [], {}
        for row in group.to_pylist():
            data, ends = unpack(row["words"], np.uint8).tobytes(), np.cumsum(unpack(row["freq"], np.uint32))
            words = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            asked.append((row["block"], row["at"], np.array([distinct.setdefault(w, len(distinct)) for w in words], np.int64)))
        words, pieces = list(distinct), []
        for lo in range(0, len(words), 200_000):
            pieces.append(np.diff(own.encode(words[lo : lo + 200_000])[1]))
        pieces = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        rows = [{"pid": 0, "block": b, "words": None, "at": at, "freq": pack(pieces[i], np.uint32), "doc": None} for b, at, i in asked]
        return pa.Table.from_pylist(rows, group.schema)

    return count


def _sum(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    own = next(r for r in rows if r["pid"] < 0)
    n = -1 - own["pid"]
    pieces = np.zeros(max(n, 1), np.int64)
    pieces[unpack_steps(own["words"]).astype(np.int64)] = 1  # special tokens
    for r in rows:
        if r["pid"] >= 0:
            pieces[unpack_steps(r["at"]).astype(np.int64)] = unpack(r["freq"], np.uint32)
    ids, valid, sizes = unpack(own["doc"], np.int64).reshape(3, -1)
    cells = unpack_steps(own["at"], np.int64)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, cells // max(n, 1), pieces[cells % max(n, 1)] * unpack(own["freq"], np.uint32).astype(np.int64))
    return pa.table({"id": pa.array(ids, mask=valid == 0), "n_bytes": sizes, "n_tokens": total})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes and n_tokens of each row of docs, as the tokenizer file at `path` gives them.

    No begin, end or added special tokens; strings of special tokens in a text are one token each. A null or empty
    text has no bytes and no tokens. Rows are never merged, so repeated and null ids each keep their own count.
    """
    groups = groups_for(docs, 8 << 20, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = cut(read.mapInArrow(_split(path, groups), _ROWS))
    pieces = parts.filter("pid >= 0").groupBy("pid").applyInArrow(_count(path), _ROWS)
    both = parts.filter("pid < 0").union(pieces)
    return both.groupBy("block").applyInArrow(_sum, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
