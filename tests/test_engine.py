"""Named behaviours of the analyzer, the query language, search, sources, collections, geometry and images."""

import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.functions import score, text
from trawl.operators import collection, fusion, geo, images, kernels, strings, vectors
from trawl.operators.lookup import Field, SearchTables, highlight, same_layout
from trawl.plans import query
from trawl.sources import rows
from trawl.streaming.changes import Collection

GROCERY = [
    ("Coca Cola", "Coca Cola Regular 1.5L", "Inumin"),
    ("Coca Cola", "Coca Cola Zero Sugar 500ml", "Inumin"),
    ("Pepsi", "Pepsi Regular 1.5L", "Inumin"),
    ("Bear Brand", "Bear Brand Powdered Milk 300g", "Gatas"),
    ("Bear Brand", "Bear Brand Powdered Milk 900g", "Gatas"),
    ("Colgate", "Colgate Total Charcoal Deep Clean 80g", "Toothpaste"),
    ("Nescafe", "Nescafe Classic Reseal 200g", "Kape"),
    ("Lucky Me", "Lucky Me Pancit Canton Chilimansi 60g", "Instant Noodles"),
]


@pytest.fixture(scope="module")
def shop(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(GROCERY)], "doc_id long, brand string, title string, category string")
    return SearchTables.build(df, [Field("brand", 3.0, 0.4), Field("title", 2.0, 0.4), Field("category", 1.0, 0.75)], "doc_id", text.grocery_aliases()).persist()


def top(spark, shop, q, k=5, **more):
    df = shop.search(spark.createDataFrame([(0, q)], "query_id long, text string"), k, **more)
    return [(r.doc_id, r.bucket) for r in df.orderBy("rank").collect()]


def test_analyzer_agrees_on_both_sides(spark):
    cases = ["Café Ñandú 1,5 L", "180 g pack", "30-23 MATH 30.23", "12s 6 pcs", "x2y 3.14.15", "⭐ top⭐shop", "", None, "été ÆØ ß", "5 5 g", "1.2345kg", "0.5ml", "no1 g"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [query.words(c) for c in cases]
    assert query.words("1.5L") == query.words("1500 ml") == ["1500ml"]
    assert query.words("Gatas kapeng 1 kg", text.grocery_aliases()) == ["milk", "coffee", "1000g"]


def test_query_language():
    q = query.parse('red "ice cream" -discontinued')
    assert (q.term, q.phrase, q.exclude) == (["red"], [["ice", "cream"]], ["discontinued"])
    assert query.parse('-"ice cream" x').exclude == ["ice", "cream"]
    assert query.parse("- ice").term == ["ice"]
    assert query.parse("e-mail").term == ["e", "mail"]
    assert query.parse('open "quote here').term == ["open", "quote", "here"]
    assert query.parse("-only").is_empty()
    assert query.typeahead("cru -santos") == (["cru"], True)
    assert query.typeahead('red "ice cream"') == (["red", "ice", "cream"], False)
    assert query.typeahead('"dela cr') == (["dela", "cr"], True)


def test_edit_distance():
    assert [score.osa(a, b) for a, b in (("teh", "the"), ("ca", "abc"), ("", "ab"), ("same", "same"))] == [1, 3, 2, 0]


def test_search(spark, shop):
    assert top(spark, shop, "colgaye")[0] == (5, 1)
    assert top(spark, shop, "bear brand 900g")[0] == (4, 0)
    assert {d for d, _ in top(spark, shop, "bearbrand")} >= {3, 4}
    assert top(spark, shop, '"powdered milk" -900g') == [(3, 0)]
    assert top(spark, shop, "nesc", typing=True)[0][0] == 6


def test_highlight():
    assert highlight("Bear Brand Milk 300g", {"bear", "300g"}) == [(0, 4), (16, 20)]


def test_plan_of_words(spark, shop):
    """Alias-made words have number forms, worth no more than the word; unknown short words are corrected by the rest."""
    df = spark.createDataFrame([(0, "inumin"), (1, "pancit cantons")], "query_id long, text string")
    rows = {(r.query_id, r.term, r.dist) for r in shop.planned_terms(df).collect()}
    assert (0, "drink", 0) in rows and (1, "canton", 1) in rows
    eggs = SearchTables.build(spark.createDataFrame([(0, "large eggs"), (1, "egg pie"), (2, "magic me"), (3, "mee goreng"), (4, "oat milk")], "doc_id long, t string"), [Field("t")], "doc_id", {"itlog": "egg"})
    found = {(r.term, r.dist): r.weight for r in eggs.planned_terms(spark.createDataFrame([(0, "itlog")], "query_id long, text string")).collect()}
    assert set(found) == {("egg", 0), ("eggs", 1)} and found["eggs", 1] <= found["egg", 0]
    assert [(d, b) for d, b in top(spark, eggs, "magic mee")][0] == (2, 1)
    assert {r.term for r in eggs.planned_terms(spark.createDataFrame([(0, "oat milk")], "query_id long, text string")).collect()} == {"oat", "milk"}
    assert {r.term for r in eggs.fetch_plan(spark.createDataFrame([(0, "magic mee")], "query_id long, text string")).collect()} == {"magic", "mee", "me"}


def test_segments_and_files(spark, tmp_path):
    first = SearchTables.build(spark.createDataFrame([(0, "red apple", "a"), (1, "green apple", "b")], "doc_id long, t string, sku string"), [Field("t")], "doc_id", key="sku")
    both = first.push(spark.createDataFrame([(2, "blue apple", "a"), (3, "apple", None)], "doc_id long, t string, sku string"), "doc_id")
    assert {d for d, _ in top(spark, both, "apple")} == {1, 2, 3}
    assert both.counts().first().asDict() == {"segments": 2, "docs": 4, "deleted": 1, "live": 3}
    less = both.delete_keys(spark.createDataFrame([("b",), ("nokey",)], "key string"))
    assert {d for d, _ in top(spark, less, "apple")} == {2, 3}
    assert {d for d, _ in top(spark, less.undelete(spark.createDataFrame([(1,)], "doc_id long")), "apple")} == {1, 2, 3}
    less.write(f"{tmp_path}/x")
    back = SearchTables.load(spark, f"{tmp_path}/x")
    assert top(spark, back, "apple") == top(spark, less, "apple") and same_layout(less, back)
    back.write_hits(back.search(spark.createDataFrame([(0, "apple")], "query_id long, text string"), 5), f"{tmp_path}/hits")
    assert spark.read.text(f"{tmp_path}/hits").count() == 2
    spark.createDataFrame([("x", 9)], "term string, df long").write.mode("append").parquet(f"{tmp_path}/x/terms")
    with pytest.raises(ValueError, match="not what was written"):
        SearchTables.load(spark, f"{tmp_path}/x")


def test_search_tables_are_made_for_what_is_asked(spark, tmp_path):
    """Of postings only those of the words are shuffled; no strings are made of long words; the same text is searched once."""
    data = [(0, "red apple", "a"), (1, "green apple pie", "b"), (2, "x" * 6000 + " apple", "b"), (3, "blue pie", "a"), (4, "apple pie " * 3, "b"), (5, "", None)]
    built = SearchTables.build(spark.createDataFrame(data, "doc_id long, t string, kind string"), [Field("t")], "doc_id")
    plan = built.postings.filter(F.col("term").isin("apple"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") < plan.index("Generate")
    assert not built.postings.storageLevel.useDisk and not built.docs.storageLevel.useDisk
    assert {d for d, _ in top(spark, built, "aplpe")} == {0, 1, 2, 4}
    assert built.near({"aple": 1}) == {"aple": [("apple", 1, 4)]} == built.near({"aple": 1, **{f"zq{i}zz": 1 for i in range(10)}})
    batch = spark.createDataFrame([(3, "pie"), (4, "apple"), (9, "pie"), (11, None)], "query_id long, text string")
    got = [(r.query_id, r.rank, r.doc_id) for r in built.search(batch, 2).orderBy("query_id", "rank").collect()]
    assert [x[1:] for x in got if x[0] == 3] == [x[1:] for x in got if x[0] == 9] and len(got) == 6
    built.write(f"{tmp_path}/t")
    loaded = SearchTables.load(spark, f"{tmp_path}/t")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(built.learned("kind")) == rows(loaded.learned("kind")) and rows(built.terms) == rows(loaded.terms)


def test_highlight_equals_spans():
    texts = ["Apple äpple APPLE", "ΣΑΣ apple", "İ apple", "a\u0301pple apple", "", "1,5 l apple", "pineapple", "5.apple 5apple apple5 apple.5", "3 apple-pie, apple" * 50]
    for t in texts:
        for terms in ({"apple"}, {"1500ml"}, {"l", "apple"}, {"apple", "pie"}, set()):
            assert highlight(t, terms) == [(a, b) for w, a, b in query.spans(t) if w in terms]
            assert query._whole(frozenset(terms)) is None or "l" not in terms
            assert "".join(x for c in t for x in ("" if "\u0300" <= c <= "\u036f" else query.fold(c))) == query.fold_with_origin(t)[0]
    long = "Ein Satz, that 1.5 l und apple pie. " * 30_000
    began = time.monotonic()
    assert len(highlight(long, {"that"})) == 30_000
    assert time.monotonic() - began < 2  # words were looked at one by one


def test_group_codes_of_many_ranges(spark):
    """Codes are right whatever partitions the ranges get, with coalescing on and off."""
    rows = spark.range(300_000, numPartitions=7).select((F.col("id") * 7919 % 300_000).alias("k"), F.col("id").alias("row_id"))
    for on in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", on)
        made = kernels.group_codes(rows, ["k"], "row_id")
        assert made.filter("code <> first_row").count() == 0 and made.count() == 300_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_filters_reach_the_scan(spark, tmp_path):
    kernels.range_clustered(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", f"{tmp_path}/v")
    made = spark.read.parquet(f"{tmp_path}/v").filter(kernels.condition("between", F.col("v"), 3.0, 5.0))
    assert made.count() == 3
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,3.0)" in plan and "LessThanOrEqual(v,5.0)" in plan


def test_fusion(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 1.0)], "doc_id long, score double")
    one = spark.createDataFrame([(2, 9.0)], "doc_id long, score double")
    assert [(r.doc_id, r.score) for r in fusion.convex(a, one, 0.5, 5).collect()] == [(1, 0.5), (2, 0.5)]


def test_row_sources(spark, tmp_path):
    data = [["A-1", 'Tooth "paste", big', "119.5"], ["A-2", "two\nlines", ""]]
    (tmp_path / "x.csv").write_text("sku,name,price\n" + 'A-1,"Tooth ""paste"", big",119.5\nA-2,"two\nlines",\n')
    assert [list(r) for r in rows.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [data[0], [*data[1][:2], None]]
    (tmp_path / "x.tsv").write_text('sku\tname\nA-1\t"raw\n')
    assert rows.read_tsv(spark, str(tmp_path / "x.tsv")).first().name == '"raw'
    (tmp_path / "x.jsonl").write_text('{"a": {"b": 1.50, "n": null}, "l": [1, {"x": 2}], "s": "t"}\n\n')
    assert rows.read_jsonl(spark, str(tmp_path / "x.jsonl")).first().row == {"a.b": "1.50", "l": '[1,{"x":2}]', "s": "t"}
    sql = "-- c\nCREATE TABLE x (a int);\nINSERT INTO public.\"item\" (sku, name) VALUES ('A-1', 'it''s'), ('A-2', NULL) ON CONFLICT DO NOTHING;\nCOPY item (sku, name) FROM stdin;\nB-1\ttab\\there\nB-2\t\\N\n\\.\nINSERT INTO other VALUES (1, now(), 2::numeric(3,1));\n"
    (tmp_path / "x.sql").write_text(sql)
    got = rows.read_sql_dump(spark, str(tmp_path / "x.sql"), ["ITEM"]).collect()
    assert [r.row for r in got] == [{"sku": "A-1", "name": "it's"}, {"sku": "A-2"}, {"sku": "B-1", "name": "tab\there"}, {"sku": "B-2"}]
    assert list(rows.dump_rows(sql))[-1] == ("other", {"c0": "1", "c1": "now()", "c2": "2"})
    assert rows.schema_of("sku:0:0.6,name:3") == [("sku", 0.0, 0.6), ("name", 3.0, 0.75)]


def test_change_stream_equals_rebuild(spark, tmp_path):
    kind = "key string, name string, op string, order long"
    live = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, name string")
    changes = [("a", "x2", "u", 1), ("c", "z", None, 2), ("c", None, "DELETE", 3), ("d", "w", "insert", 4), ("gone", None, "d", 5)]
    own = Collection(spark, str(tmp_path / "c"), "key")
    own.create(live)
    spark.createDataFrame(changes, kind).write.parquet(str(tmp_path / "in"))
    own.follow(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    want = collection.apply_changes(live, spark.createDataFrame(changes, kind), "key", "order")
    assert sorted(map(tuple, own.read().collect())) == sorted(map(tuple, want.collect())) == [("a", "x2"), ("b", "y"), ("d", "w")]
    own.apply(spark.createDataFrame(changes, kind), 0)  # a replay
    assert own.version() == 1
    for bad in ([("a", "x", "huh", 1)], [("a", " ", "u", 1)]):
        with pytest.raises(Exception):
            collection.apply_changes(live, spark.createDataFrame(bad, kind), "key", "order", ["name"]).collect()


def test_locate_equals_scan(spark):
    rings = [(1, 0, True, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]), (1, 1, False, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]), (2, 0, True, [(4.0, 4.0), (12.0, 4.0), (4.0, 12.0)]), (3, 0, True, [(1.0, float("nan")), (2.0, 2.0)])]
    df = spark.createDataFrame(rings, "poly_id int, ring int, outer boolean, points array<struct<x:double,y:double>>")
    points = [(i, (i % 25) * 0.5 + 0.1, (i // 25) * 0.5 + 0.1) for i in range(625)] + [(9000, None, 1.0), (9001, float("nan"), 1.0)]

    def inside(x, y, pts):
        hit = False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    def scan(x, y):
        if x is None or x != x:
            return None
        if inside(x, y, rings[0][3]) and not inside(x, y, rings[1][3]):
            return 1
        return 2 if inside(x, y, rings[2][3]) else None

    got = {r.point_id: r.poly_id for r in geo.locate(spark.createDataFrame(points, "point_id long, x double, y double"), df, 2.5).collect()}
    assert got == {i: scan(x, y) for i, x, y in points}


def test_curves():
    for order in (1, 2, 4):
        keys = {geo.hilbert(order, x, y): (x, y) for x in range(1 << order) for y in range(1 << order)}
        assert sorted(keys) == list(range(4**order))
        assert all(abs(keys[k][0] - keys[k + 1][0]) + abs(keys[k][1] - keys[k + 1][1]) == 1 for k in range(4**order - 1))
    for budget in (1, 4, 50):
        got = geo.cover(5, 3, 7, 20, 11, budget)
        assert len(got) <= budget
        assert all(any(a <= geo.hilbert(5, x, y) < b for a, b in got) for x in range(3, 21) for y in range(7, 12))


def test_dbscan(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16))
    data = [(i, (centres[i % 4] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(60)] + [(100, rng.normal(size=16).tolist()), (101, None)]
    got = {r.id: r.cluster for r in vectors.dbscan(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 0.05, 3).collect()}
    assert [got[i] for i in range(60)] == [i % 4 for i in range(60)]
    assert got[100] is None and got[101] is None


def test_dbscan_compares_few_with_all(spark, monkeypatch):
    """Several chunks and components that only meet outside the pivots; one cell of a grid would hold every pair of these."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(vectors, "PIVOTS", 100)
    own = rng.normal(size=(1500, 24))
    own[:150] = np.eye(24)[0] + rng.normal(scale=0.03, size=(150, 24))
    own[150:156] = np.eye(24)[3] + rng.normal(scale=0.02, size=(6, 24))
    data = [(i * 7 % 1500, row.tolist()) for i, row in enumerate(own)]
    unit = np.array([r for _, r in sorted(data)])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for distance in (0.4, 0.45):
        near = 1 - unit @ unit.T <= distance
        np.fill_diagonal(near, False)
        core, want, n = near.sum(1) >= 3, [None] * 1500, 0
        for i in np.flatnonzero(core):
            if want[i] is None:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if want[j] is None:
                        want[j] = n
                        todo += [k for k in np.flatnonzero(near[j] & core) if want[k] is None]
                n += 1
        want = [c if core[i] else min((want[j] for j in np.flatnonzero(near[i] & core)), default=None) for i, c in enumerate(want)]
        got = {r.id: r.cluster for r in vectors.dbscan(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5), distance, 3).collect()}
        assert [got[i] for i in range(1500)] == want


def test_dbscan_of_thousands_ends(spark):
    """Comparing every pair in expressions takes minutes for these."""
    own = np.random.default_rng(3).normal(size=(7000, 64))
    unit = own / np.linalg.norm(own, axis=1)[:, None]
    began = time.monotonic()
    got = {r.id: r.cluster for r in vectors.dbscan(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>"), 0.62, 3).collect()}
    assert time.monotonic() - began < 90
    near = 1 - unit @ unit.T <= 0.62
    core = near.sum(1) > 3
    assert [got[i] is not None for i in range(7000)] == (core | (near & core[None]).any(1)).tolist()


def test_strings(spark):
    df = spark.createDataFrame([("banana",), (None,), ("",), ("ban",)], "t string")
    assert [r[0] for r in df.select(strings.places(F.col("t"), "ana")).collect()] == [[1, 3], [], [], []]
    assert [r[0] for r in df.select(strings.places_within(F.col("t"), "bax", 1)).collect()] == [[0], [], [], [0]]
    shots = spark.createDataFrame([(1, t, s) for t, s in ((0.0, 9.0), (1.0, 9.0), (1.1, 9.0), (4.0, 1.0), (4.9, 9.0))], "video long, t double, score double")
    assert [(r.start, r.end) for r in strings.shot_spans(shots, 5.0, F.lit(5.0)).orderBy("start").collect()] == [(0.0, 1.0), (1.0, 5.0)]
    hashes = spark.createDataFrame([(1, 0b1111), (1, 1 << 40), (2, 0b0111)], "item long, hash long")
    assert [(r.a, r.b, r.share) for r in strings.hash_overlap(hashes, 3).collect()] == [(2, 1, 1.0), (1, 2, 0.5)]


def test_hashes_of_few_varying_bits(spark, monkeypatch):
    """Hashes whose upper half never varies meet few others, and equal brute force, in one group or many."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 30, 900)
    rows = [(f"i{k % 13}", int(base[k % 900]) ^ (1 << int(rng.integers(30))) ^ (1 << int(rng.integers(30)))) for k in range(2700)]
    values, names = np.array([h for _, h in rows]), np.array([n for n, _ in rows])
    frame = spark.createDataFrame(rows, "item string, hash long")
    for radius, group in ((7, 1 << 18), (7, 50), (3, 50), (0, 1 << 18)):
        monkeypatch.setattr(strings, "GROUP", group)
        near = np.bitwise_count(values[:, None] ^ values[None]) <= radius
        met = {(names[i], rows[i][1], names[j]) for i, j in zip(*np.nonzero(near), strict=True) if names[i] != names[j]}
        size, want = {n: len({h for m, h in rows if m == n}) for n in set(names)}, {}
        for a, _, b in met:
            want[a, b] = want.get((a, b), 0) + 1
        assert {(r.a, r.b): r.share for r in strings.hash_overlap(frame, radius).collect()} == {k: round(n / size[k[0]], 9) for k, n in want.items()}
    many = spark.range(30_000).select((F.col("id") % 20).alias("item"), (F.col("id") * 2654435761 % (1 << 40)).alias("hash"))
    began = time.monotonic()
    assert strings.hash_overlap(many, 7).count() <= 380
    assert time.monotonic() - began < 60  # a block that is 0 for all hashes made a billion rows


def test_images(spark):
    rng = random.Random(1)
    flat = np.full((40, 50, 3), 77, np.uint8)
    ramp = np.repeat(np.linspace(255, 0, 50)[None, :, None], 40, 0).repeat(3, 2).astype(np.uint8)
    assert images.ahash(flat) == images.dhash(flat) == images.phash(flat) == 0
    assert images.dhash(ramp) == -1  # every cell is lighter than the next
    assert bin(images.phash(ramp) ^ images.phash(np.clip(ramp.astype(int) + 3, 0, 255).astype(np.uint8))).count("1") <= 4
    colours = images.palette(np.concatenate([flat, ramp], 1))
    assert abs(sum(c[3] for c in colours) - 1) < 1e-9
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + bytes(9)
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<HHII", 0x0132, 2, 20, 40) + struct.pack("<I", 0) + b"\0\0" + b"2024:05:06 07:08:09\0"
    body = b"Exif\0\0" + tiff
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 30, 20, 1)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + sof + b"\xff\xda\0\2"
    junk = bytes(rng.randrange(256) for _ in range(40))
    df = spark.createDataFrame([("a.png", bytearray(png)), ("b.jpg", bytearray(jpeg)), ("c.bin", bytearray(junk)), ("d", None)], "path string, content binary")
    got = {r.path: r for r in images.probe(df).collect()}
    assert (got["a.png"].container, got["a.png"].width, got["a.png"].height) == ("png", 640, 480)
    assert (got["b.jpg"].container, got["b.jpg"].width, got["b.jpg"].orientation, got["b.jpg"].year, got["b.jpg"].day) == ("jpeg", 20, 6, 2024, 6)
    assert got["c.bin"].width is None
    grey = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0)], "r int, g int, b int")
    lab = images.oklab(F.col("r"), F.col("g"), F.col("b"))
    out = grey.select(F.round(lab[0], 3).alias("l"), images.colour_bucket(*lab).alias("k")).collect()
    assert [(r.l, r.k < 5) for r in out] == [(1.0, True), (0.0, True), (0.628, False)]


def test_dump_counts_and_binary_keys(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE a (x int);\nINSERT INTO a (x) VALUES (1), (2);\nINSERT INTO s.b VALUES (3);\nINSERT INTO a SELECT 1;\nCOPY a (x) FROM stdin;\n4\n\\.\nSET x = 1;\n")
    assert rows.dump_counts(spark, str(tmp_path / "d.sql"), ["a"]).first().asDict() == {"kept": 3, "excluded": 1, "skipped": 3}
    assert sorted((r.table, r.row["x"]) for r in rows.read_sql_dump(spark, str(tmp_path / "d.sql"), ["A"]).collect()) == [("a", "1"), ("a", "2"), ("a", "4")]
    (tmp_path / "k.bin").write_bytes(struct.pack("<Q3Q", 3, 5, 7, (1 << 64) - 1))
    assert [(r.position, int(r.key)) for r in rows.read_sosd(spark, str(tmp_path / "k.bin")).orderBy("position").collect()] == [(0, 5), (1, 7), (2, (1 << 64) - 1)]


def test_generated_tables(spark):
    from trawl.sources import generated as g

    for make in (g.uniform, g.lognormal, g.clustered):
        a, b = (make(spark, 500, 7).repartition(n).orderBy("id").collect() for n in (1, 5))
        assert a == b and a != make(spark, 500, 8).orderBy("id").collect() and all(r.key >= 0 for r in a)
    assert len({r.key // 1000 for r in g.clustered(spark, 500, 1, clusters=5).collect()}) <= 10
    assert all(len(r.text.split()) == 8 for r in g.texts(spark, 20, 1).collect()) and g.queries(spark, 3, 1).columns == ["query_id", "text"]


def test_picture_headers():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    heif = box(b"ftyp", b"heic0000") + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 640, 480)))))
    assert images.size_of(heif) == (640, 480) and images.size_of(heif[:-1]) is None
    table = bytes([0x01]) + bytes(range(64))
    jpeg = b"\xff\xd8\xff\xdb" + struct.pack(">H", 2 + len(table)) + table + b"\xff\xda\0\2"
    assert images.quantisation_tables(jpeg) == [(1, 0, list(range(64)))] and images.quantisation_tables(b"x") == []
    assert images.table_fingerprint([]) is None and images.table_fingerprint(images.quantisation_tables(jpeg)) != images.table_fingerprint([(0, 0, list(range(64)))])
    entry = lambda tag, kind, n, value: struct.pack("<HHI4s", tag, kind, n, value)
    first = struct.pack("<H", 1) + entry(0x0112, 3, 1, struct.pack("<HH", 6, 0)) + struct.pack("<I", 26)
    second = struct.pack("<H", 2) + entry(0x0201, 4, 1, struct.pack("<I", 56)) + entry(0x0202, 4, 1, struct.pack("<I", 3)) + struct.pack("<I", 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + first + second + b"abc"
    assert len(tiff) == 59 and images.exif(tiff) == {"orientation": 6, "thumbnail": b"abc"}
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(tiff), b"eXIf") + tiff + b"crc0"
    assert images.exif(png)["orientation"] == 6


def test_picture_words(spark):
    made = spark.createDataFrame([("a", "NIKON CORPORATION", "NIKON D750", None, 2019, 5, 7, 3.5), ("b", "Apple", "iPhone 15", "wide", None, None, None, float("nan"))], "path string, make string, model string, lens string, year int, month int, day int, lat double")
    words = {(r.path, r.field, r.value) for r in images.exif_terms(made).collect()}
    assert {("a", "exif.camera", "NIKON D750"), ("b", "exif.camera", "Apple iPhone 15"), ("a", "exif.date", "2019-05-07"), ("b", "exif.lens", "wide")} <= words
    full = made.selectExpr("*", "1d altitude", "1 orientation", "100 iso", "2d fnumber", "0.1d exposure", "50d focal", "2d lon")
    assert ("b", "exif.lat") not in {(r.path, r.field) for r in images.exif_numbers(full).collect()} and images.exif_numbers(full).filter("field = 'exif.year'").count() == 1


def test_cells_hold_what_a_scan_finds(spark):
    """Points by cells against every edge; inner cells answer alone."""
    star = [(0, 0, True, [(5.0, 5.0), (45.0, 8.0), (40.0, 44.0), (25.0, 20.0), (6.0, 40.0)]), (0, 1, False, [(12.0, 9.0), (20.0, 9.0), (20.0, 14.0)])]
    rings = spark.createDataFrame(star, "poly_id int, ring int, outer boolean, points array<struct<x:double,y:double>>")
    rng = random.Random(1)
    points = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(400)] + [(900, float("nan"), 1.0), (901, None, 2.0)]

    def inside(x, y):
        hit = [sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(c, c[1:] + c[:1], strict=True)) % 2 == 1 for *_, c in star]
        return hit[0] and not hit[1]

    df = spark.createDataFrame(points, "point_id long, x double, y double")
    got = {r.point_id: r.poly_id for r in geo.locate(df, rings, 3.0).collect()}
    assert got == {i: 0 if x is not None and x == x and inside(x, y) else None for i, x, y in points}
    assert geo.cells(rings, 3.0).filter("inner").count() > 20
    keys = spark.range(16).select(geo.hilbert_key(F.col("id") % 4, F.floor(F.col("id") / 4), 2).alias("k"), "id").collect()
    assert all(r.k == geo.hilbert(2, r.id % 4, r.id // 4) for r in keys)
    ranges = geo.cover(2, 1, 1, 2, 2, 8)
    found = spark.range(16).select(geo.hilbert_key(F.col("id") % 4, F.floor(F.col("id") / 4), 2).alias("k"), "id").filter(geo.in_cover(F.col("k"), ranges))
    assert {(r.id % 4, r.id // 4) for r in found.collect()} >= {(1, 1), (1, 2), (2, 1), (2, 2)}
