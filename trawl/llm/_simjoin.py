"""Similarity components: signatures collide on keys, candidates are confirmed on full sets, links are joined.

Used by line dedup (banded MinHash keys) and by near-dup detection (multi-key Hamming keys); they differ in the keys
of a signature and in where the sets come from. Two items that share a key (a bucket) are a candidate pair, and every
candidate pair is decided by its full sets, or by links that already join its two ends:

* Keys travel in blocks (key, id), without signatures. Of a key that a task sees on many items, only the first goes
  on to meet other tasks' keys (a combiner), so a bucket of any size is spread.
* Each bucket's least item is tried with all its others. Confirmed links are joined into components. A crowd of near
  copies is one component after that, from as many pairs as it has members.
* What is left is a bucket with members of different components besides its least item. Such a bucket is cut into
  blocks of bounded weight: the members of its largest component, which need not be tried with each other, and the
  rest. A tile is a pair of blocks, decided in one task, which gives back the links of a spanning forest at most.
  Where a signature has a distance bound, tiles first lose the members without a partner within it: one of another
  component that meets them on this key and on no earlier one.

No bucket, pair or partner is left out, and nothing here depends on how large a bucket is but the number of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import U64, mix, ranges, tidy
from ._components import connected_components
from ._pack import pack_steps, unpack_steps
from ._spark import cut, drop

#: The low bits of a key say which of a signature's keys it is.
TAGS = 7
#: Keys that a task packs at once, and of how many equal ones only the first goes on.
FLUSH, COMBINED = 1 << 20, 32
#: Weight of a block of members (set sizes, and OWN for each), which bounds a tile.
WEIGHT, OWN = 1 << 19, 256
#: The bitmap of ids has 32 bits or more for each, within these bounds (128 KB and 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Entries of a tile's table of members and shared items, above which its sets are compared one by one.
DENSE = 1 << 22
KEYED = "pid int, kind int, keys binary, ids binary"
PLAIN, WHOLE, FIRST = 0, 1, 2


def permuted_minima(hashes: np.ndarray, first: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """MinHash values (16 bits) of each non-empty segment hashes[first[i]:first[i + 1]]: shape (segments, count)."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    a, b = (a >> U64(31)).astype(np.uint32) | np.uint32(1), b.astype(np.uint32)
    out = np.empty((len(first) - 1, count), np.uint16)
    short = (hashes >> U64(32)).astype(np.uint32)
    at = 0
    while at < len(first) - 1:  # in parts that fit in the cache
        to = max(int(np.searchsorted(first, first[at] + (1 << 16), side="right")) - 1, at + 1)
        part = short[first[at] : first[to]]
        begins, work = first[at:to] - first[at], np.empty_like(part)
        for k in range(count):
            np.multiply(part, a[k], out=work)
            np.bitwise_xor(work, b[k], out=work)
            out[at:to, k] = mix(np.minimum.reduceat(work, begins).astype(np.uint64)) >> U64(48)
        at = to
    return out


def key_of(values: np.ndarray, tag: int) -> np.ndarray:
    """One 64-bit key of the columns of values."""
    h = np.full(len(values), tag, U64)
    for k in range(values.shape[1]):
        h = (h ^ values[:, k]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return mix(h)


def keyed_rows(parts: Iterator[tuple[np.ndarray, np.ndarray]], groups: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (ids, their keys: an array of up to 128 columns), dealt out to groups by ranges of keys."""
    held, size = [], 0
    for ids, made in parts:
        held.append((ids, made))
        size += made.size
        if size >= FLUSH:
            yield _packed(held, groups)
            held, size = [], 0
    if size:
        yield _packed(held, groups)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    made = np.concatenate([k for _, k in held])
    keys = (made >> U64(TAGS) << U64(TAGS) | np.arange(made.shape[1], dtype=np.uint64)).ravel()
    ids = np.repeat(np.concatenate([i for i, _ in held]), made.shape[1])
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(runs, len(keys)))
    many = sizes >= COMBINED
    rows: dict[str, list] = {"pid": [], "kind": [], "keys": [], "ids": []}

    def add(pid: int, kind: int, own: np.ndarray, of: np.ndarray) -> None:
        for name, x in zip(rows, (pid, kind, pack_steps(own, np.uint64), pack_steps(of, np.int64)), strict=True):
            rows[name].append(x)

    for lo, n in zip(runs[many], sizes[many], strict=True):
        # spread by its first item: the groups of a key that is frequent everywhere differ
        add(int(ids[lo]) % groups, WHOLE, keys[lo : lo + n], ids[lo : lo + n])
    plain = ~np.repeat(many, sizes)
    for kind, at in ((PLAIN, np.flatnonzero(plain)), (FIRST, runs[many])):
        own, of = keys[at], ids[at]
        pid = ((own >> U64(32)) * U64(groups)) >> U64(32)
        cuts = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]])) if len(pid) else at
        for lo, hi in zip(cuts, np.append(cuts, len(pid))[1:], strict=True):
            add(int(pid[lo]), kind, own[lo:hi], of[lo:hi])
    return pa.RecordBatch.from_arrays([pa.array(rows["pid"], pa.int32()), pa.array(rows["kind"], pa.int32()), pa.array(rows["keys"], pa.binary()), pa.array(rows["ids"], pa.binary())], names=list(rows))


def _collide(group: pa.Table) -> pa.Table:
    """(null, a, b): the first item of a bucket and each other one. (key, a, null): the others, where there are several;
    all items of a bucket of which a task has combined some, and those that it has combined.
    """
    keys, ids, first, pairs, members = [], [], [], [], []
    for kind, k, i in tidy(zip(group.column("kind").to_pylist(), group.column("keys").to_pylist(), group.column("ids").to_pylist(), strict=True)):
        k, i = unpack_steps(k, np.uint64), unpack_steps(i, np.int64)
        if kind == WHOLE:
            i = np.unique(i)
            pairs.append(np.stack([np.repeat(i[:1], len(i) - 1), i[1:]], 1))
            members.append(np.stack([np.repeat(k[:1].view(np.int64), len(i)), i], 1))
        else:
            keys.append(k)
            ids.append(i)
            first.append(np.full(len(k), kind == FIRST))
    if keys:
        k, i, f = np.concatenate(keys), np.concatenate(ids), np.concatenate(first)
        keys.clear()
        ids.clear()
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = order[np.lexsort((i[order], k[order]))]
        k, i, f = k[order], i[order], f[order]
        if len(k):
            runs = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            more = np.repeat(np.logical_or.reduceat(f, runs), np.diff(np.append(runs, len(k))))
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            k, i, more = k[fresh], i[fresh], more[fresh]
            runs = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(runs, len(k)))
            others = np.ones(len(k), bool)
            others[runs] = False
            pairs.append(np.stack([np.repeat(i[runs], sizes - 1), i[others]], 1))
            others = (others & np.repeat(sizes > 2, sizes)) | more
            members.append(np.stack([k[others].view(np.int64), i[others]], 1))
    none = np.zeros((0, 2), np.int64)
    two, more = np.concatenate([none, *pairs]), np.concatenate([none, *members])
    two = two[np.lexsort((two[:, 1], two[:, 0]))]
    two = two[np.concatenate([[True], (two[1:] != two[:-1]).any(1)])] if len(two) else two
    return pa.table(
        {
            "key": pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(np.ascontiguousarray(more[:, 0]))]),
            "a": pa.array(np.concatenate([two[:, 0], more[:, 1]])),
            "b": pa.concat_arrays([pa.array(np.ascontiguousarray(two[:, 1])), pa.nulls(len(more), pa.int64())]),
        }
    )


def as_sets(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of sets that are held as such, one set after the other, and how many each has."""
    return np.frombuffer(b"".join(held), U64), np.fromiter(map(len, held), np.int64, len(held)) // 8


Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def _kinds(held: list[bytes], to_sets: Sets) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes of sets as numbers from 0, one set after the other, how many each has, and how many numbers there are."""
    hashes, counts = to_sets(held)
    kinds = pa.array(hashes.view(np.int64)).dictionary_encode().indices.to_numpy()
    return kinds, counts, int(kinds.max(initial=-1)) + 1


def _distinct(kinds: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Each set without its repeats: of equal numbers the one that was marked last stays."""
    seen, places, out, at = np.empty(n, np.int64), np.arange(int(counts.max(initial=0))), [], 0
    for size in counts.tolist():
        own, place = kinds[at : at + size], places[:size]
        seen[own] = place
        out.append(own[seen[own] == place])
        at += size
    return out


def _confirm(ratio: tuple[int, int], to_sets: Sets):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            at, ends = 0, np.cumsum(batch.column("n").to_numpy())
            while at < batch.num_rows:  # parts of bounded weight, or one pair
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WEIGHT, side="right")), at + 1)
                part = batch.slice(at, to - at)
                at = to
                number: dict[bytes, int] = {}
                two = [[number.setdefault(x, len(number)) for x in part.column(c).to_pylist()] for c in ("sa", "sb")]
                kinds, counts, n = _kinds(list(number), to_sets)
                sets = _distinct(kinds, counts, n)
                marks, ok = np.full(n, -1), []
                for k, (i, j) in enumerate(zip(*two, strict=True)):
                    x, y = sets[i], sets[j]
                    marks[x] = k
                    shared = np.count_nonzero(marks[y] == k)
                    ok.append(ratio[1] * shared >= ratio[0] * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, from batches in the order of tiles."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in tidy(batches):
        tile = batch.column("tile").to_numpy()
        cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(tile)], strict=True):
            if hi == lo:
                continue
            if held and tile[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tile[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _prune(most: int, first: Callable[[np.ndarray], np.ndarray], ratio: tuple[int, int], width: int):
    """The rows that have a partner in their tile: of another label, within the distance bound and the ratio of sizes,
    and with this tile's key as the first in common.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            label, size = table.column("label").to_numpy(), table.column("size").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, width)
            tag = table.column("tag")[0].as_py()
            has = np.zeros(len(label), bool)
            for at in range(0, len(label), 64):
                x, y = size[at : at + 64, None], size[None, at:]
                ok = (label[at : at + 64, None] != label[None, at:]) & (np.minimum(x, y) * ratio[1] >= np.maximum(x, y) * ratio[0])
                rows, cols = np.nonzero(ok)
                for lo in range(0, len(rows), 1 << 16):
                    i, j = rows[lo : lo + (1 << 16)] + at, cols[lo : lo + (1 << 16)] + at
                    differ = sig[i] != sig[j]
                    near = np.flatnonzero(np.count_nonzero(differ, axis=1) <= most)
                    near = near[first(differ[near]) == tag]
                    has[i[near]] = has[j[near]] = True
            if has.any():
                yield table.select(["tile", "id", "label"]).filter(pa.array(has)).combine_chunks().to_batches()[0]

    return prune


def _settle(ratio: tuple[int, int], to_sets: Sets):
    """Links (a, b) between rows of a tile that have different labels and similar sets, but none between rows that others join."""

    def similar(held: list[bytes], label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with the later ones that are similar and have another label."""
        kinds, counts, n = _kinds(held, to_sets)
        if len(held) * n <= DENSE:
            table = np.zeros((len(held), n), np.float32)
            table[np.repeat(np.arange(len(held)), counts), kinds] = 1
            size = table.sum(1).astype(np.int64)
            table = table[:, table.sum(0) > 1]  # others are in no two sets
            shared = (table @ table.T).astype(np.int64)
            i, j = np.nonzero(np.triu((ratio[1] * shared >= ratio[0] * (size[:, None] + size[None] - shared)) & (label[:, None] != label[None]), 1))
            for x in np.unique(i):
                yield int(x), j[i == x]
            return
        sets = _distinct(kinds, counts, n)
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        begins, items, flags = np.cumsum(size) - size, np.concatenate(sets), np.zeros(n, np.int32)
        for i in range(len(sets) - 1):
            own, others = size[i], size[i + 1 :]
            at = np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(others, own) * ratio[1] >= np.maximum(others, own) * ratio[0])) + i + 1
            if len(at):
                flags[sets[i]] = 1
                shared = np.add.reduceat(flags[items[ranges(begins[at], size[at])]], np.cumsum(size[at]) - size[at])
                flags[sets[i]] = 0
                yield i, at[ratio[1] * shared >= ratio[0] * (own + size[at] - shared)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            ids, label = table.column("id").to_numpy(), np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
            if not label.any():
                continue
            left, right = [], []
            for i, found in similar(table.column("hashes").to_pylist(), label):
                for j in found:
                    if label[j] != label[i]:
                        left.append(ids[i])
                        right.append(ids[j])
                        label[label == label[j]] = label[i]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return settle


def bitmap(ids: DataFrame, slot: Callable[[int], Column]) -> tuple[Broadcast, int]:
    """A broadcast of packed bits with the slots of all ids (column id) set, and how many bits; MOST_BITS bounds it."""
    n = max(1, ids.count())
    bits = min(max(LEAST_BITS, 1 << (32 * n).bit_length()), MOST_BITS)
    page = 1 << 15
    slots = ids.select(slot(bits).alias("s")).select(F.expr(f"s div {page}").alias("page"), (F.col("s") % page).alias("s"))
    out = np.zeros(bits // 8, np.uint8)
    for number, data in slots.groupBy("page").agg(F.expr("bitmap_construct_agg(s)").alias("bits")).toLocalIterator():
        out[number * page // 8 : (number + 1) * page // 8] = np.frombuffer(data, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out), bits


def is_set(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def filtered(rows: DataFrame, ids: DataFrame, make: Callable, kind: str) -> DataFrame:
    """make (batches to batches of `kind`) over the rows whose id is among the ids, and perhaps a few more.

    Both steps run in one Python worker.
    """

    def slot(bits: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(bits))

    held, bits = bitmap(ids, slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return make(b.filter(pa.array(is_set(held.value, b.column("slot").to_numpy()))) for b in batches)

    return rows.withColumn("slot", slot(bits)).mapInArrow(run, kind)


def _tiled(placed: DataFrame, weight: int) -> tuple[DataFrame, DataFrame]:
    """tile, id, label, size, tag of the members (key, id, label, size) of buckets that have several labels; the table of those buckets."""
    each = F.col("size") + F.lit(OWN)
    by_label = placed.groupBy("key", "label").agg(F.sum(each).alias("w"))
    buckets = by_label.groupBy("key").agg(F.sum("w").alias("all"), F.max("w").alias("w"), F.max_by("label", "w").alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    own = F.when(F.col("all") > weight, F.col("w")).otherwise(0)
    buckets = cut(buckets.select(F.col("key").alias("of"), "top", F.greatest(F.lit(1), F.ceil((F.col("all") - own) / weight)).cast("int").alias("rest"), F.ceil(own / weight).cast("int").alias("tops")))
    found = placed.join(buckets, F.col("key") == F.col("of"))
    in_top = (F.col("tops") > 0) & (F.col("label") == F.col("top"))
    i = F.pmod(F.xxhash64("id"), F.when(in_top, F.col("tops")).otherwise(F.col("rest"))).cast("int")

    def across(n: str, tile: Callable[[Column], Column]) -> Column:
        return F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), tile)

    found = found.withColumn("i", i)
    tiles = F.when(in_top, across("rest", lambda j: F.xxhash64("key", F.lit(1), j, "i"))).otherwise(
        F.concat(across("rest", lambda j: F.xxhash64("key", F.lit(0), F.least("i", j), F.greatest("i", j))), across("tops", lambda j: F.xxhash64("key", F.lit(1), "i", j)))
    )
    return found.select(F.explode(tiles).alias("tile"), "id", "label", "size", F.col("key").bitwiseAND(F.lit((1 << TAGS) - 1)).cast("int").alias("tag")), buckets


def similar_components(
    keyed: DataFrame,
    sets: Callable[[DataFrame], DataFrame],
    ratio: tuple[int, int],
    to_sets: Sets = as_sets,
    bound: tuple[DataFrame, int, int, Callable[[np.ndarray], np.ndarray]] | None = None,
    weight: int = WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """Written tables: id, label (the least id of its component) of every item that has a confirmed link; and the sets.

    keyed: what keyed_rows makes of all items and their keys, k <= 128 each; rows that repeat an item are equal.
    sets: ids (column id) to one row each (id, size, hashes binary, and what else the caller wants). to_sets makes of a
    list of such hashes the 64-bit hashes of each set, one after the other and perhaps repeated, and how many each has,
    which is about size.
    ratio: (85, 100) links items with 100 * intersection >= 85 * union.
    bound: (id, sig), the values (16 bits) of a sig, the most that may differ, and a function of (pairs, values)
    differences to the first key that each pair has in common (-1 for none). Pairs over it are no candidates.
    """
    found = cut(keyed.groupBy("pid").applyInArrow(_collide, "key long, a long, b long"))
    pairs = cut(found.filter("key IS NULL").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    held = cut(sets(pairs.selectExpr("explode(array(a, b)) id").distinct()))
    one = pairs.join(held.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("hashes").alias("sa")), "a")
    two = one.join(held.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("hashes").alias("sb")), "b")
    links = cut(two.select("a", "b", (F.col("na") + F.col("nb")).cast("long").alias("n"), "sa", "sb").mapInArrow(_confirm(ratio, to_sets), "a long, b long"))
    labels = connected_components(links)
    members = found.filter("key IS NOT NULL").select("key", F.col("a").alias("id"))
    placed = members.join(labels, "id", "left").join(held.select("id", "size"), "id").select("key", "id", F.coalesce("label", "id").alias("label"), F.col("size").cast("long").alias("size"))
    placed = cut(placed)
    drop(found, pairs, links)
    rows, buckets = _tiled(placed, weight)
    if bound is not None:
        signed, width, most, first = bound
        rows = rows.join(signed, "id").repartition("tile").sortWithinPartitions("tile").mapInArrow(_prune(most, first, ratio, width), "tile long, id long, label long")
    rows = rows.select("tile", "id", "label").join(held.select("id", "hashes"), "id")
    more = cut(rows.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(_settle(ratio, to_sets), "a long, b long"))
    out = connected_components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(more))
    drop(placed, buckets, more, labels)
    return out, held
