"""MinHash near-dedup by a multi-key Hamming join.

A document is its set of distinct word shingles. Equal sets are one class. A class has a signature of 16-bit
MinHash values. Two sets of similarity t differ in each value with probability 1 - t, so a bound on the signature
distance holds but for a chance that `distance_plan` keeps under `miss`. The signature is split into m chunks; by
pigeonhole two signatures within m * (e + 1) - 1 differences have a chunk with at most e of them. All ways to leave
out e values of a chunk are enumerated, and equal rests are keys: every pair within the bound meets on one, and
every such pair is decided on the full sets (see _simjoin). Confirmed links are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._components import connected_components
from ._simjoin import KEYED, filtered, key_of, keyed_rows, permuted_minima, similar_components
from ._spark import cut, drop, groups_for

CHUNK, ERRORS = 5, 1


def distance_plan(percent: int, miss: float = 2e-5) -> tuple[int, int]:
    """(chunks, distance bound) so that a pair of exactly this similarity is over the bound with probability under miss."""
    p = 1 - percent / 100
    for chunks in range(2, 65):
        n, bound = CHUNK * chunks, chunks * (ERRORS + 1) - 1
        if 1 - sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bound + 1)) <= miss:
            return chunks, bound
    raise ValueError(f"no plan for a similarity of {percent} %")


def _keys(chunks: int):
    masks = list(combinations(range(CHUNK), CHUNK - ERRORS))

    def keys(sig: np.ndarray) -> np.ndarray:
        return np.stack([key_of(sig[:, [c * CHUNK + k for k in mask]], 1 + c * len(masks) + i) for c in range(chunks) for i, mask in enumerate(masks)], 1)

    return keys


def _first_tag(chunks: int):
    masks = list(combinations(range(CHUNK), CHUNK - ERRORS))
    without = np.array([next(i for i, m in enumerate(masks) if p not in m) for p in range(CHUNK)])

    def first(differ: np.ndarray) -> np.ndarray:
        parts = differ.reshape(-1, chunks, CHUNK)
        wrong = parts.sum(2)
        ok = wrong <= ERRORS
        c = ok.argmax(1)
        row = np.arange(len(c))
        mask = np.where(wrong[row, c] == 0, 0, without[parts[row, c].argmax(1)])
        return np.where(ok[row, c], c * len(masks) + mask, -1)

    return first


def shingles(block: pa.RecordBatch, size: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of each text, repeated ones too, and where each text's begin.

    A text of fewer words, but at least one, has one shingle: all of its words.
    """
    data, offsets = A.buffer_of(block.column(text))
    data = A.lower_ascii(data)
    starts, ends, first = A.spans(data, offsets, A.SPACE)
    words = A.hash_spans(data, starts, ends)
    counts = np.diff(first)
    at, _ = A.window_starts(first, size)
    hashes = A.hash_windows(words, size)[at] if len(at) else np.zeros(0, A.U64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    many = np.maximum(counts - size + 1, 0)
    many[short] = 1
    begin = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(begin[-1], A.U64)
    long = np.ones(begin[-1], bool)
    long[begin[short]] = False
    out[long] = hashes
    for row in short:
        n = int(counts[row])
        out[begin[row]] = A.hash_windows(words[first[row] : first[row + 1]], n)[0] ^ A.U64(n)
    return out, begin


def _class(own: np.ndarray) -> int:
    """A signed 64-bit id of a set of hashes."""
    return int(A.mix(own ^ A.mix(np.full(1, len(own), A.U64))).sum().view(np.int64))


def _signer(size: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches):
            hashes, begin = shingles(block, size)
            some = np.flatnonzero(np.diff(begin))
            sizes, classes = np.zeros(block.num_rows, np.int64), [None] * block.num_rows
            for row in some:
                own = np.unique(hashes[begin[row] : begin[row + 1]])
                sizes[row], classes[row] = len(own), _class(own)
            sigs = [None] * block.num_rows
            if len(some):
                for row, sig in zip(some, permuted_minima(hashes, np.append(begin[some], begin[-1]), width), strict=True):
                    sigs[row] = sig.tobytes()
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(sizes), pa.array(classes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "size", "class", "sig"])

    return sign


def _setter(size: int):
    """The class and set of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches):
            hashes, begin = shingles(block, size)
            sets = [np.unique(hashes[x:y]) for x, y in zip(begin, begin[1:], strict=False) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "size", "hashes"])

    return make


def _keyer(chunks: int, groups: int):
    keys = _keys(chunks)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield part.column("id").to_numpy(), keys(np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, chunks * CHUNK))

    return lambda batches: keyed_rows(parts(batches), groups)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id (the least id that links lead to), kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets (A-Z lower-cased, words
    are runs of bytes other than ASCII white space). A null or wordless text has no shingles and no link, and its row
    is its own component. Rows of a null id have a null component and are kept. Rows that repeat an id are one
    document: each of its texts leads to what any of them is linked with. An empty table gives no rows; columns
    besides id and text are left out, so none can clash.
    """
    chunks, bound = distance_plan(percent)
    width = chunks * CHUNK
    groups = groups_for(docs, 64 << 20, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(read.mapInArrow(_signer(shingle, width), "id long, size long, class long, sig binary"))
    some = signed.filter("size > 0 AND id IS NOT NULL")
    # Equal sets are one class, and classes are what is compared; the least id of a class finds its text again.
    classes = cut(some.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig")))
    items = classes.select(F.col("class").alias("id"), "sig")

    def sets(ids: DataFrame) -> DataFrame:
        ids = cut(ids)
        reps = cut(classes.join(ids, F.col("class") == F.col("id")).select(F.col("rep").alias("id")).distinct())
        made = filtered(read.filter("id IS NOT NULL"), reps, _setter(shingle), "id long, size long, hashes binary")
        return made.join(ids, "id", "left_semi").dropDuplicates(["id"])

    labels, held = similar_components(items.mapInArrow(_keyer(chunks, groups), KEYED), sets, (percent, 100), bound=(items, width, bound, _first_tag(chunks)))
    drop(held)
    # texts under one id link their classes
    shared = some.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select(F.col("id").alias("i"), "lo")
    shared = cut(some.select("id", "class").join(shared, F.col("id") == F.col("i")).filter("class <> lo").select(F.col("class").alias("a"), F.col("lo").alias("b")).distinct())
    if shared.limit(1).count():
        labels = connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(shared))
    reps = classes.select("class", "rep", "n")
    linked = reps.join(labels, F.col("class") == F.col("id"))
    least = linked.groupBy(F.col("label").alias("of")).agg(F.min("rep").alias("l"))
    placed = linked.join(least, F.col("label") == F.col("of")).select(F.col("class").alias("c"), "l")
    alone = reps.filter("n > 1").join(labels, F.col("class") == F.col("id"), "left_anti").select(F.col("class").alias("c"), F.col("rep").alias("l"))
    placed = cut(placed.union(alone))
    drop(classes, labels, shared)
    out = signed.select("id", "size", "class").join(placed, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("l", "id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
