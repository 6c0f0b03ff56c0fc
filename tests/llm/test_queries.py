"""Every registered query of the training-data operators over the small tables: with DuckDB, the tokenizer library or brute force."""

import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from test_operators import brute_components, brute_lines, expected_ids, tokenizer  # noqa: E402

from trawl.llm import queries  # noqa: E402

DATA = os.environ.get("TRAWL_TEST_DATA_SMALL", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def run(spark, name):
    return queries.queries()[name](spark, DATA).collect()


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, con, name):
    made = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in made.description]
    want = sorted(made.fetchall(), key=repr)
    df = queries.queries()[name](spark, DATA)
    assert set(columns) <= set(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_op1(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op1_language_id")}
    assert set(got) == {i for i, _, _ in documents}
    right = total = 0
    for i, text, lang in documents:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and not math.isnan(r.score)
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and lang is not None:
            total += 1
            right += r.lang_pred == lang
    assert right >= 0.95 * total > 0


def test_op2(spark, documents):
    """All lines that brute force removes are removed, and no other: recall and precision are 1 on these tables."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    gone = collections.defaultdict(set)
    for i, _, k in brute_lines([(i, t, hashes[i]) for i, t, _ in documents]):
        gone[i].add(k)
    want = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t else "", len(gone[i])) for i, t, _ in documents}
    assert sum(n for _, n in want.values()) > 0
    got = {r.doc_id: (r.kept_sha256, r.n_removed) for r in run(spark, "op2_line_dedup")}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in want.items()}


def test_op5(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op5_token_counts")}
    assert got == {i: (len((t or "").encode()), n := len(expected_ids(t)), n > 2048) for i, t, _ in documents}


def test_op7(spark, documents):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op7_token_store")}
    at, want = 0, {}
    for i, t, _ in sorted(documents):
        ids = [*expected_ids(t), 1]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_op9(spark, documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op9_bpe_round_trip")}
    want = {}
    for i, t, _ in documents:
        ids = expected_ids(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer().decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_op10(spark, documents):
    want = brute_components([(i, t) for i, t, _ in documents], 3, 85)
    got = {r.doc_id: (r.component_id, r.kept) for r in run(spark, "op10_minhash_near_dedup")}
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert any(i != c for i, c in want.items())
