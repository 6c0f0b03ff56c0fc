"""Substring dedup: every window of `window` consecutive words is hashed (Rabin-Karp) and looked up among all others.

A word goes if some window over it has a word sequence that also starts earlier: in a document of smaller id, or
earlier in the same document. Windows are judged on the input. The removed windows merge into maximal intervals.

How it scales. A task hashes its windows block by block and ships, per block, only the first occurrence of each
hash, so a passage that a third of all documents share arrives at most once a block; the occurrences after it
are known to be repeats on the spot. Windows are dealt out by ranges of their own hash, so no passage draws others into
its group, and the number of groups follows the input size, so a group stays small. A second hash of 32 bits,
independent of the first of 64, has to agree as well: two different windows of 10 ** 13 share both with a probability of
about 6e-4. Runs of repeats are written before the documents are read again, so the windows' shuffle is gone by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._pack import pack, pack_steps, unpack, unpack_steps
from ._spark import cut, groups_for

_SHIPPED = "pid int, repeats boolean, hashes binary, checks binary, at binary, ids binary, begins binary"
_RUNS = "id long, starts array<int>, counts array<int>"


def _shipper(window: int, groups: int):
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches, max_bytes=3 * A.BLOCK_BYTES):
            ids = block.column("id").to_numpy(zero_copy_only=False)
            if len(ids) > 1 and (np.diff(ids) < 0).any():
                order = np.argsort(ids, kind="stable")
                block, ids = block.take(pa.array(order)), ids[order]
            data, offsets = A.buffer_of(block.column("text"))
            starts, ends, first = A.spans(data, offsets, A.SPACE)
            words = A.hash_spans(data, starts, ends)
            at, _ = A.window_starts(first, window)
            if not len(at):
                continue
            begins = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - window + 1, 0))])
            hashes, checks = A.hash_windows(words, window)[at], (A.hash_windows(words, window, 2)[at] >> A.U64(32)).astype(np.uint32)
            order = np.argsort(hashes)
            sorted_, check = hashes[order], checks[order]
            edges = np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]) | (check[1:] != check[:-1])]))
            firsts = np.minimum.reduceat(order, edges)
            sent, check = sorted_[edges], check[edges]
            rows: dict[str, list] = {"pid": [], "repeats": [], "hashes": [], "checks": [], "at": [], "ids": [], "begins": []}

            def add(pid: int, repeats: bool, own: np.ndarray, check: np.ndarray, at: np.ndarray, ids=ids, begins=begins, rows=rows) -> None:
                doc = np.unique(np.searchsorted(begins, at, side="right") - 1)
                made = (pid, repeats, pack_steps(own, np.uint64), check.tobytes(), pack(at, np.uint32), pack_steps(ids[doc], np.int64), pack_steps(begins[doc]))
                for name, x in zip(rows, made, strict=True):
                    rows[name].append(x)

            pid = ((sent >> A.U64(32)) * A.U64(groups)) >> A.U64(32)
            cuts = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
            for lo, hi in zip(cuts, [*cuts[1:], len(pid)], strict=True):
                add(int(pid[lo]), False, sent[lo:hi], check[lo:hi], firsts[lo:hi])
            again = np.ones(len(hashes), bool)
            again[firsts] = False
            at = np.flatnonzero(again)
            if len(at):
                add(int(hashes[at[0]] % A.U64(groups)), True, hashes[:0], checks[:0], at)
            yield pa.RecordBatch.from_arrays([pa.array(rows["pid"], pa.int32()), pa.array(rows["repeats"], pa.bool_()), *(pa.array(rows[k], pa.binary()) for k in ("hashes", "checks", "at", "ids", "begins"))], names=list(rows))

    return ship


def _place(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each window that a shipped row has."""
    at = unpack(row["at"], np.uint32).astype(np.int64)
    ids, begins = unpack_steps(row["ids"], np.int64), unpack_steps(row["begins"]).astype(np.int64)
    doc = np.searchsorted(begins, at, side="right") - 1
    return ids[doc], (at - begins[doc]).astype(np.int32)


def _runs(ids: np.ndarray, starts: np.ndarray) -> pa.Table:
    """Windows as runs of consecutive starts, one row for each document."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(starts) > 1)
    run = np.flatnonzero(new)
    last = np.concatenate([run[1:], [len(ids)]])[: len(run)] - 1
    counts, starts, ids = starts[last] - starts[run] + 1, starts[run], ids[run]
    doc = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([doc, [len(ids)]]).astype(np.int32))
    return pa.table({"id": pa.array(ids[doc]), "starts": pa.ListArray.from_arrays(offsets, pa.array(starts, pa.int32())), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))})


def _find(group: pa.Table) -> pa.Table:
    """The windows of one group that are not the first of their kind."""
    hashes, checks, ids, starts, found = [], [], [], [], []
    for row in group.to_pylist():
        i, s = _place(row)
        if row["repeats"]:
            found.append((i, s))
        else:
            hashes.append(unpack_steps(row["hashes"], np.uint64))
            checks.append(np.frombuffer(row["checks"], np.uint32))
            ids.append(i)
            starts.append(s)
    if hashes:
        h, c, i, s = np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids), np.concatenate(starts)
        hashes.clear()
        order = np.argsort(h, kind="stable")  # each block's are in order already
        same = h[order][1:] == h[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        h, c, i, s = h[order], c[order], i[order], s[order]
        order = np.lexsort((s, i, c, h))
        h, c, i, s = h[order], c[order], i[order], s[order]
        if len(h):
            edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            head = np.repeat(edges, np.diff(np.append(edges, len(h))))
            later = (i != i[head]) | (s != s[head])
            found.append((i[later], s[later]))
    i = np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)])
    s = np.concatenate([x for _, x in found] or [np.zeros(0, np.int32)])
    return _runs(i, s)


def _remover(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches):
            data, offsets = A.buffer_of(block.column("text"))
            starts, ends, first = A.spans(data, offsets, A.SPACE)
            step = np.zeros(len(starts) + 1, np.int32)
            for row, (at, count) in enumerate(zip(block.column("starts"), block.column("counts"), strict=True)):
                if at.is_valid:
                    s = first[row] + at.values.flatten().to_numpy()
                    np.add.at(step, s, 1)
                    np.add.at(step, s + count.values.flatten().to_numpy() + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            keep = np.flatnonzero(~gone)
            lengths = ends[keep] - starts[keep]
            taken = A.ranges(starts[keep], lengths + 1)
            text = data[np.minimum(taken, len(data) - 1)] if len(data) else data
            stops = np.cumsum(lengths + 1)
            text[stops - 1] = 32
            kept = np.searchsorted(keep, first)  # of each text, the first word that stays
            at = np.concatenate([[0], stops])[kept]
            size = np.maximum(np.diff(at) - 1, 0)  # without the space after the last word
            text = text[A.ranges(at[:-1], size)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) if len(gone) else np.zeros(0))
            lead = first[:-1][np.diff(first) > 0]
            inner = lead[(lead > 0)]
            inner = inner[gone[inner] & gone[inner - 1]] if len(gone) else inner
            begin, end = np.sort(np.append(edge[::2], inner)), np.sort(np.append(edge[1::2], inner))
            doc = np.searchsorted(first, begin, side="right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(first))).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((begin - first[doc]).astype(np.int32)), pa.array((end - first[doc]).astype(np.int32))], ["start", "end"]),
            )
            n_words = np.diff(first)
            kept_text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([block.column("id"), kept_text, pa.array(n_words), pa.array(n_words - np.diff(kept)), spans], names=["id", "text", "n_words", "n_removed", "removed"])

    return remove


def repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The windows that also start earlier: id, starts array<int>, counts array<int> (runs of consecutive starts).

    A document may have several rows, and the same run never appears in two of them. Null texts and texts of fewer
    words than a window have none; rows of a null id are not looked at; rows that repeat an id count as one document.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    groups = groups_for(docs, 16 << 20, text_col)
    shipped = read.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_shipper(window, groups), _SHIPPED)
    return shipped.groupBy("pid").applyInArrow(_find, _RUNS)


def drop_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without its repeated passages.

    Returns one row for each row of docs: the id, text (the kept words, joined by one space), n_words, n_removed,
    removed array<struct<start, end>> (maximal intervals of removed words). Columns besides id and text are left
    out. A null or empty text gives an empty text and no words; a row of a null id stays whole.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    runs = cut(repeated_windows(docs, window, id_col, text_col)).groupBy(F.col("id").alias("rid")).agg(F.collect_list("starts").alias("starts"), F.collect_list("counts").alias("counts"))
    joined = read.join(runs, F.col("id") == F.col("rid"), "left").select("id", "text", "starts", "counts")
    return joined.mapInArrow(_remover(window), "id long, text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)
