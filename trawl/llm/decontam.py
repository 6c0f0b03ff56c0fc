"""Benchmark decontamination by a distributed positional inverted lists.

`build_postings` shards the training documents: a shard holds, for each of its terms, the ascending positions of all its
occurrences, and is a row of a table in the shared folder. Test items are a stated query set. Their terms' frequencies
are summed over all shards first, from the columns that have them; each phrase then has its terms from the rarest of
the collection on. A shard answers all phrases at once: those of which it lacks a term drop out, the lists of the others'
rarest terms, shifted by the term's offset, are the places to try, and each further term's list cuts them down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._pack import pack, pack_steps, unpack, unpack_steps
from ._spark import cut

NO_WORD = np.ones(256, bool)
NO_WORD[0x30:0x3A] = NO_WORD[0x61:0x7B] = NO_WORD[0x80:] = False
QUERY_BYTES = 16 << 20
_SHARD = "ids binary, counts binary, terms binary, sizes binary, df binary, positions binary"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (A-Z lower-cased; ASCII letters, digits and all non-ASCII) and the first word of each text."""
    data, offsets = A.buffer_of(texts)
    data = A.lower_ascii(data)
    starts, ends, first = A.spans(data, offsets, NO_WORD)
    keep = ~NO_WORD[data]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[keep])]), first


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in A.blocks(batches, max_bytes=4 * A.BLOCK_BYTES):
        words, first = words_of(block.column("text"))
        coded = words.dictionary_encode()
        number, terms = coded.indices.to_numpy().astype(np.uint64), coded.dictionary
        counts = np.diff(first)
        # a place is left free between documents, so that no phrase runs over an end
        places = np.arange(len(number)) + np.repeat(np.arange(len(counts)), counts)
        order = np.sort((number << A.U64(32)) | places.astype(np.uint64))
        df = np.bincount(number.astype(np.int64), minlength=len(terms))
        data, offsets = A.buffer_of(terms)
        ids = block.column("id")
        table = np.stack([ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
        yield pa.RecordBatch.from_pylist(
            [{"ids": pack(table, np.int64), "counts": pack(counts, np.int64), "terms": pack(data, np.uint8), "sizes": pack(np.diff(offsets), np.uint32), "df": pack(df, np.uint32), "positions": pack_steps(order & A.U64(0xFFFFFFFF))}],
            pa.schema([(n, pa.binary()) for n in ("ids", "counts", "terms", "sizes", "df", "positions")]),
        )


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of the texts of docs, as a written table of shards. Null texts have no words; every row is in them."""
    return cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_shards, _SHARD))


class Shard:
    """A row of the table of shards, unpacked."""

    def __init__(self, row: dict):
        self.ids, self.valid = unpack(row["ids"], np.int64).reshape(2, -1)
        self.counts = unpack(row["counts"], np.int64)
        self.begins = np.cumsum(self.counts + 1) - self.counts - 1  # the place of each document's first word
        sizes = np.concatenate([[0], np.cumsum(unpack(row["sizes"], np.uint32), dtype=np.int64)])
        self.terms = pa.Array.from_buffers(pa.large_binary(), len(sizes) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(unpack(row["terms"], np.uint8))])
        self.lists = np.concatenate([[0], np.cumsum(unpack(row["df"], np.uint32), dtype=np.int64)])
        self.positions = unpack_steps(row["positions"]).astype(np.int64)

    def places(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]]

    def df(self, terms: np.ndarray) -> np.ndarray:
        return self.lists[terms + 1] - self.lists[terms]

    def find(self, terms: pa.Array) -> np.ndarray:
        """Number of each term in this shard, -1 if it has none."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, side="right") - 1

    def phrases(self, own: Queries, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and place of every occurrence of a window: the lists of its terms, shifted and intersected from the rarest on."""
        keyed = (np.repeat(np.arange(len(self.lists) - 1), np.diff(self.lists)) << 32) | self.positions  # ascending
        whole = np.flatnonzero(np.logical_and.reduceat(known[own.flat] >= 0, own.begins)) if len(own.begins) else own.begins
        term = known[own.flat[own.begins[whole] + own.order[own.begins[whole]]]]
        counts = self.lists[term + 1] - self.lists[term]
        window = np.repeat(whole, counts)
        at = self.positions[A.ranges(self.lists[term], counts)] - np.repeat(own.order[own.begins[whole]], counts)
        step = 1
        while len(rest := np.flatnonzero(own.sizes[window] > step)):
            offset = own.order[own.begins[window[rest]] + step]
            place = at[rest] + offset
            wanted = (known[own.flat[own.begins[window[rest]] + offset]] << 32) | place
            to = np.searchsorted(keyed, wanted)
            to[to == len(keyed)] = 0
            stay = np.ones(len(window), bool)
            stay[rest] = (keyed[to] == wanted) & (place >= 0)
            window, at = window[stay], at[stay]
            step += 1
        return window, at

    def near(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the terms in this order in one document, with at most `slop` other words between them."""
        k = int(np.argmin(self.df(terms)))
        first = last = self.places(terms[k])
        for t in terms[k + 1 :]:
            other = np.append(self.places(t), np.iinfo(np.int64).max // 2)
            last = other[np.minimum(np.searchsorted(other, last, side="right"), len(other) - 1)]
        for t in terms[:k][::-1]:
            other = np.concatenate([[-(1 << 40)], self.places(t)])
            first = other[np.searchsorted(other, first, side="left") - 1]
        ok = (last - first < len(terms) + slop) & (first >= 0)
        first, last = first[ok], last[ok]
        ok = self.doc_of(first) == self.doc_of(last)
        return first[ok], last[ok]


class Queries:
    """A block of test items as windows of terms: window w has the terms flat[begins[w]:][:sizes[w]] and belongs to items[w]."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        words, first = words_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.terms, number = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        seen: dict[bytes, int] = {}
        windows: list[np.ndarray] = []
        self.items: list[list[int]] = []
        for item, lo, hi in zip(ids, first, first[1:], strict=False):
            for at in range(lo, max(hi - window, lo) + 1) if hi > lo else ():
                own = number[at : min(at + window, hi)]
                k = seen.setdefault(own.tobytes(), len(windows))
                if k == len(windows):
                    windows.append(own)
                    self.items.append([])
                if not self.items[k] or self.items[k][-1] != item:
                    self.items[k].append(item)
        self.sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.int64), *windows])
        self.rank(np.zeros(len(self.terms), np.int64))

    def rank(self, df: np.ndarray) -> None:
        """The order of each window's places: by the frequency of the term there."""
        window, place = np.repeat(np.arange(len(self.sizes)), self.sizes), A.ranges(np.zeros(len(self.sizes), np.int64), self.sizes)
        self.order = place[np.lexsort((place, df[self.flat], window))]

    def run(self, shard: Shard, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, first and last place of each occurrence in the shard."""
        known = shard.find(self.terms)
        if not slop:
            window, at = shard.phrases(self, known)
            return window, at, at + self.sizes[window] - 1
        found = [(np.zeros(0, np.int64),) * 3]
        for w, (begin, size) in enumerate(zip(self.begins, self.sizes, strict=True)):
            terms = known[self.flat[begin : begin + size]]
            if (terms >= 0).all():
                first, last = shard.near(terms, slop)
                found.append((np.full(len(first), w), first, last))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def items_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of occurrences: their numbers, once for each item of the window, and those items."""
        counts = np.fromiter((len(self.items[w]) for w in windows), np.int64, len(windows))
        return np.repeat(np.arange(len(windows)), counts), np.array([i for w in windows for i in self.items[w]], np.int64)


def _query_blocks(postings: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str) -> list:
    """The items in blocks of bounded size, with the order of their terms by the frequency in all shards, as broadcasts."""
    read = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = -(-size // QUERY_BYTES), []
    for k in range(blocks):
        rows = read.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        own = Queries([r.id for r in rows], [r.text for r in rows], window)
        terms = own.terms

        def frequencies(batches: Iterator[pa.RecordBatch], terms: pa.Array = terms) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sizes = np.concatenate([[0], np.cumsum(unpack(row["sizes"], np.uint32), dtype=np.int64)])
                    at = pc.index_in(terms, value_set=pa.Array.from_buffers(pa.large_binary(), len(sizes) - 1, [None, pa.py_buffer(sizes), pa.py_buffer(unpack(row["terms"], np.uint8))])).fill_null(-1).to_numpy()
                    some = np.flatnonzero(at >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(unpack(row["df"], np.uint32)[at[some]].astype(np.int64))], names=["term", "n"])

        df = np.zeros(len(terms), np.int64)
        for r in postings.select("terms", "sizes", "df").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # terms of the stated items
            df[r.term] = r.n
        own.rank(df)
        out.append(items.sparkSession.sparkContext.broadcast(own))
    return out


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Shard({n: batch.column(n)[k].as_py() for n in batch.schema.names})


def matches(postings: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (words of the document) of every window of an item that occurs in a document.

    A window is `window` consecutive words of an item, or all words of a shorter one. slop 0: exact phrases; else the
    words in order with at most `slop` others between them. Items of null id or text, or without a word, match nothing.
    """
    held = _query_blocks(postings, items, window, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shard_rows(batches):
            for queries in held:
                windows, first, last = queries.value.run(shard, slop)
                at, item = queries.value.items_of(windows)
                doc = shard.doc_of(first[at])
                arrays = [pa.array(shard.ids[doc], mask=shard.valid[doc] == 0), pa.array(item), pa.array(first[at] - shard.begins[doc]), pa.array(last[at] - shard.begins[doc] + 1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "start", "end"])

    return postings.mapInArrow(run, "doc_id long, item_id long, start long, end long").distinct()


def contamination(postings: DataFrame, items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each document of the postings: doc_id, n_words, n_hit (words in any matching window), n_items, items_sha256, contaminated.

    items_sha256: of the matching item ids, sorted as strings and joined by commas ('' if none).
    """
    held = _query_blocks(postings, items, window, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shard_rows(batches):
            size = int(shard.counts.sum()) + len(shard.counts)
            step = np.zeros(size + 1, np.int32)
            found: list[set[int]] = [set() for _ in shard.counts]
            for queries in held:
                windows, first, last = queries.value.run(shard, 0)
                np.add.at(step, first, 1)
                np.add.at(step, last + 1, -1)
                at, item = queries.value.items_of(windows)
                for doc, x in zip(shard.doc_of(first[at]).tolist(), item.tolist(), strict=True):
                    found[doc].add(x)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
            n_hit = hit[shard.begins + shard.counts] - hit[shard.begins]
            digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in found]
            arrays = [pa.array(shard.ids, mask=shard.valid == 0), pa.array(shard.counts), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array(digests), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return postings.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
