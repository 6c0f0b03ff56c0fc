"""Line dedup: fuzzy copies of lines by MinHash over character shingles, one line kept of each component.

Lines are compared with A-Z lower-cased and white space collapsed. Equal lines are one; different ones are linked if
their sets of SHINGLE characters have a Jaccard similarity of 0.8 or more. Signatures are banded (BANDS bands of ROWS
values): a pair of exactly 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, under 2e-5. Every pair that
shares a band is decided on its exact sets (see _simjoin), and links are joined by a distributed union-find. Of a
component, the line that comes first (document id, then the hash of the row's text, then line number) stays. Lines
without a word always stay.

Lines travel as a 64-bit id; equality is that of 128 bits, the other half of which goes along. Rows are named by their
id and a hash of their text, so rows that repeat an id are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._simjoin import KEYED, bitmap, is_set, key_of, keyed_rows, similar_components
from ._spark import cut, drop, groups_for

SHINGLE, BANDS, ROWS, PERCENT = 8, 21, 4, 80
WIDTH = BANDS * ROWS
#: Ids of lines that a worker remembers to have signed, before it begins anew.
SIGNED = 1 << 18


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_ids(lines: list[bytes]) -> np.ndarray:
    """128 bits of each normal line as two signed 64-bit integers: shape (lines, 2). The first is its id."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)


def _lines(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The normal form of all lines with a word of the texts, the text of each, and its number there."""
    lines: list[bytes] = []
    texts: list[int] = []
    numbers: list[int] = []
    for k, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if not text:
            continue
        text = text.lower()
        # with none of these, and no space at its ends, a text has lines in their normal form
        uneven = b"  " in text or b" \n" in text or b"\n " in text or b"\t" in text or b"\r" in text or b"\v" in text or b"\f" in text or text[0] == 32 or text[-1] == 32
        for number, line in enumerate(text.split(b"\n")):
            if line and (not uneven or (line := b" ".join(line.split()))):
                lines.append(line)
                texts.append(k)
                numbers.append(number)
    return lines, np.array(texts, np.int64), np.array(numbers, np.int64)


def _shingles(chars: np.ndarray, kind: type, factors: tuple[int, int, int]) -> np.ndarray:
    """Hashes of all runs of SHINGLE = 8 characters, by doubling."""
    h = chars.astype(kind)
    for step, factor in zip((1, 2, 4), factors, strict=True):
        h = h[:-step] * kind(factor) + h[step:]
    return h


def _chars(line: bytes) -> str:
    """A line of fewer characters is one shingle."""
    return line.decode("utf-8", "replace").ljust(SHINGLE, "\0")


def signatures(lines: list[bytes]) -> np.ndarray:
    """MinHash values (16 bits) of the character shingles of each line, from 32-bit hashes: shape (lines, WIDTH)."""
    texts = [_chars(line) for line in lines]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    factors = (np.random.default_rng(11).integers(0, 1 << 31, WIDTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    out = np.empty((len(lines), WIDTH), np.uint16)
    at = 0
    while at < len(lines):  # in parts that fit in the cache
        lo = ends[at] - sizes[at]
        to = max(int(np.searchsorted(ends, lo + (1 << 15), side="right")), at + 1)
        h = _shingles(chars[lo : ends[to - 1]], np.uint32, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        begin = ends[at:to] - sizes[at:to] - lo
        edges = np.stack([begin, begin + sizes[at:to] - SHINGLE + 1], 1).ravel()[:-1]
        work = np.empty_like(h)
        for k in range(WIDTH):
            np.multiply(h, factors[k], out=work)
            least = np.minimum.reduceat(work, edges)[::2]
            out[at:to, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        at = to
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    return np.stack([key_of(sig[:, b * ROWS : (b + 1) * ROWS], 1 + b) for b in range(BANDS)], 1)


def sets_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each line's character shingles, one line after the other, and how many each has."""
    texts = [_chars(line) for line in lines]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = _shingles(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
    counts = sizes - SHINGLE + 1
    return A.mix(h[A.ranges(np.cumsum(sizes) - sizes, counts)]), counts


def _keyer(groups: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known: set[int] = set()
        for block in A.blocks(batches):
            lines = list(dict.fromkeys(_lines(block.column("text"))[0]))
            if not lines:
                continue
            ids = np.ascontiguousarray(line_ids(lines)[:, 0])
            if len(known) > SIGNED:
                known.clear()
            new = [i for i, x in enumerate(ids.tolist()) if x not in known]
            known.update(ids.tolist())
            if new:
                yield ids[new], bands(signatures([lines[i] for i in new]))

    return lambda batches: keyed_rows(parts(batches), groups)


_FOUND = "lo long, hi long, doc long, row long, line int, size long, text binary"


def _occurrences(held: Broadcast, bits: int):
    """lo, hi, doc, row, line of every line with a word; and lo, hi, size, text of the distinct ones of each block whose id has its slot set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in A.blocks(batches):
            lines, text, number = _lines(block.column("text"))
            ids, at = line_ids(lines), pa.array(text)
            wanted = np.flatnonzero(is_set(held.value, ids[:, 0] & (bits - 1)))
            once = {lines[i]: i for i in wanted.tolist()}
            own, n, m = np.fromiter(once.values(), np.int64, len(once)), len(lines), len(once)
            both = np.concatenate([np.arange(n), own])
            arrays = [pa.array(np.ascontiguousarray(ids[both, 0])), pa.array(np.ascontiguousarray(ids[both, 1]))]
            for column, kind in ((block.column("id").take(at), pa.int64()), (block.column("row").take(at), pa.int64()), (pa.array(number.astype(np.int32)), pa.int32())):
                arrays.append(pa.concat_arrays([column, pa.nulls(m, kind)]))
            arrays.append(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([len(x) for x in once], pa.int64())]))
            arrays.append(pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(list(once), pa.binary())]))
            yield pa.RecordBatch.from_arrays(arrays, names=["lo", "hi", "doc", "row", "line", "size", "text"])

    return run


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, lines (numbers counted from 0): a written table of the lines with a word that are not the first of their component.

    row is the xxhash64 of the row's text. Null texts have no lines; rows of a null id are not looked at; rows that
    repeat an id and a text are one row, so ties have one verdict.
    """
    groups = groups_for(docs, 64 << 20, text_col)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    tables: list[DataFrame] = []

    def texts(ids: DataFrame) -> DataFrame:
        """One pass for the texts of these lines and the places of all."""
        ids = cut(ids)
        held, bits = bitmap(ids, lambda bits: F.col("id").bitwiseAND(F.lit(bits - 1)))
        tables.extend([cut(read.mapInArrow(_occurrences(held, bits), _FOUND)), ids])
        own = tables[0].filter("size IS NOT NULL").select(F.col("lo").alias("id"), "hi", "size", F.col("text").alias("hashes"))
        return own.join(ids, "id", "left_semi").dropDuplicates(["id"])

    labels, held = similar_components(read.select("text").mapInArrow(_keyer(groups), KEYED), texts, (PERCENT, 100), sets_of)
    linked = labels.join(held.select(F.col("id").alias("lid"), F.col("hi").alias("lhi")), F.col("id") == F.col("lid")).select("lid", "lhi", "label")
    found = tables[0].filter("size IS NULL").select("lo", "hi", "doc", "row", "line")
    each = found.groupBy("lo", "hi").agg(F.min(F.struct("doc", "row", "line")).alias("first"), F.count("*").alias("n"))
    each = each.join(linked, (F.col("lo") == F.col("lid")) & (F.col("hi") == F.col("lhi")), "left").filter("n > 1 OR label IS NOT NULL")
    each = cut(each.select("lo", "hi", "first", "label"))
    # written, so that the join below has an exchange on both sides and adaptive execution may split a large component
    firsts = cut(each.filter("label IS NOT NULL").groupBy(F.col("label").alias("of")).agg(F.min("first").alias("least")))
    known = each.join(firsts, F.col("label") == F.col("of"), "left").select(F.col("lo").alias("l"), F.col("hi").alias("h"), F.coalesce("least", "first").alias("first"))
    known = cut(known)
    gone = found.join(known, (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))).filter(F.struct("doc", "row", "line") != F.col("first"))
    out = cut(gone.groupBy("doc", "row").agg(F.collect_set("line").alias("lines")))
    drop(labels, held, each, firsts, known, *tables)
    return out


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.blocks(batches):
        texts, total, gone = [], [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            own = text.split("\n") if text else []
            drop = set(lines or ())
            texts.append("\n".join(x for i, x in enumerate(own) if i not in drop) if drop else text)
            total.append(len(own))
            gone.append(len(drop))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["rest", "text", "n_lines", "n_removed"])


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """The id, text (without the lines of duplicate_lines), n_lines and n_removed of each row of docs.

    A null text stays null and has no lines. Other columns are left out, unless keep_columns; a column of docs that
    is named n_lines or n_removed then stays, in place of the count. An empty table gives no rows.
    """
    gone = duplicate_lines(docs, id_col, text_col).withColumnsRenamed({"doc": "_doc", "row": "_row"})
    others = [c for c in docs.columns if c not in (id_col, text_col)] if keep_columns else []
    read = docs.select(F.struct(id_col, *others).alias("rest"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    joined = read.join(gone, (F.col("rest")[id_col].cast("long") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left").select("rest", "text", "lines")
    out = joined.mapInArrow(_remover, f"rest {read.schema['rest'].dataType.simpleString()}, text string, n_lines long, n_removed long")
    named = [F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in (docs.columns if keep_columns else (id_col, text_col))]
    return out.select(*named, *(c for c in ("n_lines", "n_removed") if c not in others))
