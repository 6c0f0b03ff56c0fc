"""Substring counts and places, exact and with mismatches, and operators over labelled and sequenced rows."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: Hashes of a group of hash_overlap, about, and those that one step compares with four others or more.
GROUP, TILE = 1 << 18, 1 << 16


def count(text: Column, pattern: str) -> Column:
    """How often a pattern stands in a text, overlapping places counted; 0 for an empty pattern or a null."""
    if not pattern:
        return F.lit(0)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?={re.escape(pattern)})"))


def places(text: Column, pattern: str) -> Column:
    """All places (from 0, overlapping ones too) of a pattern in a text, ascending; none for an empty pattern or a null.

    Each is looked for from the one before on, so the text is read about once for each place and no substring is made.
    """
    none = F.array().cast("array<int>")
    n = count(text, pattern)
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(s: Column, _: Column) -> Column:
        at = F.call_function("locate", F.lit(pattern), text, s["at"] + 1)
        return F.struct(at.alias("at"), F.concat(s["found"], F.array(at - 1)).alias("found"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["found"])).otherwise(none)


def mismatches(a: Column, pattern: str) -> Column:
    out = F.lit(0)
    for i, c in enumerate(pattern):
        out = out + (F.substring(a, i + 1, 1) != c).cast("int")
    return out


def places_within(text: Column, pattern: str, k: int) -> Column:
    """Places at which the pattern stands with at most k characters replaced."""
    n = len(pattern)
    text = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.length(text) - n)
    found = F.filter(starts, lambda i: mismatches(F.substring(text, i + 1, F.lit(n)), pattern) <= k)
    return F.when((F.lit(n) > 0) & (F.length(text) >= n), found).otherwise(F.array().cast("array<int>"))


def label_vote(hits: DataFrame, label: str) -> DataFrame:
    """query_id, label, share: the most frequent label of each query's hits; ties go by label."""
    votes = hits.groupBy("query_id", label).agg(F.count("*").alias("n"))
    ranked = votes.withColumn("all", F.sum("n").over(Window.partitionBy("query_id"))).withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), label)))
    return ranked.filter("at = 1").select("query_id", F.col(label).alias("label"), F.round(F.col("n") / F.col("all"), 9).alias("share"))


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg of the first k ranks with gain 1 for relevant (query_id, doc_id)."""
    got = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n")).withColumn("ideal", F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 9).alias("ndcg"))


def shot_spans(scores: DataFrame, threshold: float, duration: Column, least: float = 0.25) -> DataFrame:
    """video, start, end of shots: a score over the threshold begins one, shots have a least length, a short tail joins the last.

    The rule looks back at the last cut, so a video's scores are read in order by one task; videos are spread.
    """

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        end = float(frame["duration"].iloc[0])
        cuts = [0.0]
        for t, s in zip(frame["t"], frame["score"], strict=True):
            if s > threshold and t > 0 and t - cuts[-1] >= least and t < end:
                cuts.append(float(t))
        if len(cuts) > 1 and end - cuts[-1] < least:
            cuts.pop()
        return pd.DataFrame({"video": frame["video"].iloc[0], "start": cuts, "end": [*cuts[1:], end]})

    return scores.withColumn("duration", duration).groupBy("video").applyInPandas(cut, "video long, start double, end double")


def hash_overlap(hashes: DataFrame, radius: int) -> DataFrame:
    """a, b, share of a's hashes (item, hash long) that are within `radius` bits of a hash of b, stronger direction first.

    The bits in which hashes differ at all are dealt to four blocks: within a radius under 8, two hashes differ by
    radius // 4 bits at most (none or one) in some block. A group is a block and the value of its first few bits; a hash
    goes to its own groups and, as what others may be near, to those that are one bit away. Groups get more as hashes do.
    """
    if not 0 <= radius < 8:
        raise ValueError("the radius is 0 to 7 bits")
    own = written(hashes.select("item", F.col("hash").cast("long").alias("hash")).filter("item IS NOT NULL AND hash IS NOT NULL").distinct())
    seen = own.agg(F.count("*").alias("n"), F.bit_or("hash").alias("some"), F.bit_and("hash").alias("all")).first()
    varying = [k for k in range(64) if seen.n and (seen.some & ~seen.all) >> k & 1]
    blocks, flips = [varying[i::4] for i in range(4)], radius // 4
    first = min(len(blocks[3]), max(3, (seen.n // GROUP).bit_length()))
    prefix = [reduce(Column.__add__, (F.shiftleft(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(1).cast("long")), i) for i, k in enumerate(bits[:first])), F.lit(0).cast("long")) for bits in blocks]
    changes = [0, *(1 << k for k in range(first))] if flips else [0]
    dealt = own.select("item", "hash", F.posexplode(F.array(*prefix)).alias("at", "prefix"))
    dealt = dealt.select("item", "hash", "at", "prefix", F.explode(F.array(*map(F.lit, changes))).alias("change"))
    dealt = dealt.select("item", "hash", "at", F.col("prefix").bitwiseXOR(F.col("change")).alias("prefix"), (F.col("change") == 0).alias("home"))
    kind = own.schema["item"].dataType.simpleString()

    def met(group: pa.Table) -> pa.Table:
        at = group.column("at")[0].as_py()
        values, home = group.column("hash").to_numpy().view(np.uint64), group.column("home").to_numpy()
        items = group.column("item").combine_chunks().dictionary_encode()
        items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
        number, names = items.indices.to_numpy().astype(np.int64), items.dictionary
        rest = np.zeros(len(values), np.int64)
        for i, k in enumerate(blocks[at][first:]):
            rest |= (values >> np.uint64(k) & np.uint64(1)).astype(np.int64) << i
        order = np.lexsort((rest, ~home))
        values, number, rest = values[order], number[order], rest[order]
        n = int(home.sum())
        keys, begins = np.unique(rest[:n], return_index=True)
        ends = np.append(begins[1:], n)
        place = {k: slice(b, e) for k, b, e in zip(keys.tolist(), begins.tolist(), ends.tolist(), strict=True)}
        sides = [(x, y) for x, y in zip(n + np.searchsorted(rest[n:], keys), n + np.searchsorted(rest[n:], keys, "right"), strict=True)]
        masks = [np.uint64(sum(1 << k for k in bits)) for bits in blocks[:at]]
        rows, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, side in zip(keys.tolist(), sides, strict=True):
            near = [place[key], slice(*side), *(place[x] for k in range(len(blocks[at]) - first if flips else 0) if (x := key ^ 1 << k) in place)]
            theirs, names_of = np.concatenate([values[x] for x in near]), np.concatenate([number[x] for x in near])
            begin, end = place[key].start, place[key].stop
            for c in range(0, len(theirs), TILE):
                t, o = theirs[c : c + TILE], names_of[c : c + TILE]
                step = max(1, TILE * 4 // len(t))
                for b in range(begin, end, step):
                    mine = values[b : min(end, b + step)]
                    row, col = np.divmod(np.flatnonzero(np.bitwise_count(mine[:, None] ^ t[None]) <= radius), len(t))
                    keep = number[b + row] != o[col]
                    row, col = row[keep], col[keep]
                    apart = mine[row] ^ t[col]
                    fresh = np.ones(len(row), bool)  # a pair that an earlier block has is met there
                    for mask in masks:
                        fresh &= np.bitwise_count(apart & mask) > flips
                    found = np.unique((b + row[fresh]) * len(names) + o[col[fresh]])
                    rows.append(found // len(names))
                    others.append(found % len(names))
        row, other = np.concatenate(rows), np.concatenate(others)
        columns = [names.take(pa.array(number[row])), pa.array(values[row].view(np.int64)), names.take(pa.array(other))]
        return pa.Table.from_arrays(columns, names=["item", "hash", "b"])

    near = dealt.groupBy("at", "prefix").applyInArrow(met, f"item {kind}, hash long, b {kind}")
    met_by = near.distinct().groupBy("item", "b").agg(F.count("*").alias("met"))
    sizes = own.groupBy("item").agg(F.count("*").alias("size"))
    return met_by.join(sizes, "item").select(F.col("item").alias("a"), "b", F.round(F.col("met") / F.col("size"), 9).alias("share")).orderBy(F.col("share").desc(), "a", "b")


def pair_table(hashes: DataFrame, radius: int) -> DataFrame:
    """a < b with the share in both directions (0 where nothing meets), the stronger one first."""
    one = hash_overlap(hashes, radius)
    pair = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.coalesce(F.max(F.when(F.col("a") < F.col("b"), F.col("share"))), F.lit(0.0)).alias("ab"), F.coalesce(F.max(F.when(F.col("a") > F.col("b"), F.col("share"))), F.lit(0.0)).alias("ba"))
    return pair.orderBy(F.greatest("ab", "ba").desc(), "a", "b")
