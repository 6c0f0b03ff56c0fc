"""Each training-data operator against a brute-force version, with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from trawl.llm import bpe, castore, decontam, langid, linededup, neardup, quality, queries, substring, tokencount, urlfilter  # noqa: E402
from trawl.llm import _simjoin  # noqa: E402
from trawl.llm._components import connected_components  # noqa: E402
from trawl.llm._pretokens import rules  # noqa: E402
from trawl.llm._spark import new_table_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, id long"
PATH = queries.tokenizer_path()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(texts):
    """Documents with columns that clash with what operators make."""
    return [(i, t, None, None, None, 7, None, 3) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "of", "Théa", "ation", "wh", "it's", "42", "a<|endoftext|>b", "日本", "İx", "—"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    out += [(100 + i, out[5][1]) for i in range(6)]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "the " * 4000), (205, "x" * 5000), (206, "It's 42 of Théa—<|endoftext|> İx\t日本 " * 24_000), (None, "no id"), (7, out[7][1])]
    out += [(300 + i, "line one is here and long enough\n" + out[i][1]) for i in range(5)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, texts, empty):
    for size in (4, 20):
        first = {}
        own = sorted((i, (t or "").encode().split()) for i, t in texts if i is not None)
        for i, w in own:
            for s in range(len(w) - size + 1):
                first.setdefault(tuple(w[s : s + size]), (i, s))
        want = []
        for i, t in texts:
            w = (t or "").encode().split()
            gone = set()
            if i is not None:
                for s in range(len(w) - size + 1):
                    if first[tuple(w[s : s + size])] != (i, s):
                        gone |= set(range(s, s + size))
            want.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
        got = substring.drop_repeats(docs, size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(want)
        assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in got)
    assert substring.drop_repeats(empty).count() == 0


def brute_components(texts, size, percent):
    sets = collections.defaultdict(list)
    for i, t in texts:
        w = (t or "").translate(LOWER).encode().split()
        s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        if i is not None:
            sets[i].append(s)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_every_pair_of_a_bucket_is_tried(monkeypatch):
    """Through a first item or a bucket's members, also where tasks combine frequent keys."""
    monkeypatch.setattr(_simjoin, "COMBINED", 4)
    rng = np.random.default_rng(2)
    keys = rng.zipf(1.6, (400, 3)).astype(np.uint64) % 50 << np.uint64(50)
    ids = np.arange(400) * 7
    parts = [[(ids[k::3], keys[k::3])] for k in range(3)]  # three tasks
    batches = [b for part in parts for b in _simjoin.keyed_rows(iter(part), 5)]
    groups = collections.defaultdict(list)
    for b in batches:
        for row in b.to_pylist():
            groups[row["pid"]].append(row)
    pairs, members = set(), collections.defaultdict(set)
    for own in groups.values():
        for r in _simjoin._collide(pa.Table.from_pylist(own, batches[0].schema)).to_pylist():
            if r["key"] is None:
                pairs.add((min(r["a"], r["b"]), max(r["a"], r["b"])))
            else:
                members[r["key"]].add(r["a"])
    pairs |= {(a, b) for m in members.values() for a in m for b in m if a < b}
    want = {(min(x, y), max(x, y)) for c in range(3) for k in np.unique(keys[:, c]) for m in [ids[keys[:, c] == k]] for x in m for y in m if x < y}
    assert pairs == {(int(a), int(b)) for a, b in want}
    assert not list(_simjoin.keyed_rows(iter([]), 5))


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_tiles_settle_all_links(dense, monkeypatch):
    monkeypatch.setattr(_simjoin, "DENSE", dense)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = []
    for _ in range(70):
        own = base.copy()
        own[rng.choice(120, rng.integers(0, 30), replace=False)] = rng.integers(0, 1 << 62, 1).astype(np.uint64)
        sets.append(np.unique(own))
    label = rng.integers(0, 40, 70)
    rows = [{"tile": 1, "id": i, "label": int(label[i]), "hashes": s.tobytes()} for i, s in enumerate(sets)]
    batch = pa.RecordBatch.from_pylist([*rows, {"tile": 2, "id": 99, "label": 5, "hashes": sets[0].tobytes()}])
    links = [(r["a"], r["b"]) for b in _simjoin._settle((85, 100), _simjoin.as_sets)(iter([batch.slice(0, 30), batch.slice(30)])) for r in b.to_pylist()]

    def components(pairs):
        parent = list(range(70))
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for x in range(70):
            while parent[x] != x:
                x = parent[x]
            out.append(x)
        return out

    same = [(int(np.flatnonzero(label == label[i])[0]), i) for i in range(70)]
    want = [(i, j) for i in range(70) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert components([*same, *links]) == components([*same, *want])
    assert len(links) < 70


@pytest.mark.parametrize("weight", [_simjoin.WEIGHT, 3000])
def test_near_duplicates(spark, docs, texts, empty, weight, monkeypatch):
    """Also with blocks of a few members, so that buckets have many tiles."""
    tiled = _simjoin._tiled
    monkeypatch.setattr(_simjoin, "_tiled", lambda placed, _: tiled(placed, weight))
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randint(0, 99)) for _ in range(200)]
    crowd = list(texts)
    for i in range(40):  # near copies of one text, some closer to each other than to it
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(200)] = f"z{rng.randint(0, 30)}"
        crowd.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows(crowd), SCHEMA).repartition(4)
    for size, percent in ((3, 85), (5, 80)):
        want = brute_components(crowd, size, percent)
        got = neardup.near_duplicates(df, size, percent).collect()
        assert len(got) == len(crowd)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    one, two = " ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))
    near = [x.replace("100", "z") for x in (one, two)]
    # 1 has both texts; 5 and 6 are exact copies of them, 7 and 8 near ones, each also without 5 and 6
    for more in ([(5, one), (6, two)], []):
        texts = [(1, one), (1, two), (1, None), (7, near[0]), (8, near[1]), (9, "something else"), *more]
        got = neardup.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()
        assert len(got) == len(texts)
        assert {r.doc_id: r.component_id for r in got} == brute_components(texts, 5, 80) == {i: 9 if i == 9 else 1 for i, _ in texts}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5000, 5001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    made = spark.createDataFrame(edges + [(9, None)], "a long, b long").repartition(5)
    for each in (1 << 19, 20):  # one partition, and several that meet in rounds
        got = {r.id: r.label for r in connected_components(made, each).collect()}
        assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(texts):
    """(id, text, line) of all lines to be removed. texts: (id, text, hash of the row's text)."""
    places = collections.defaultdict(set)
    for i, t, h in texts:
        for k, x in enumerate((t or "").encode().split(b"\n")):
            if i is not None and linededup.normal(x):
                places[linededup.normal(x)].add((i, h, k))
    own = list(places)
    chars = [x.decode().ljust(linededup.SHINGLE, "\0") for x in own]
    sets = [{x[k : k + linededup.SHINGLE] for k in range(len(x) - linededup.SHINGLE + 1)} for x in chars]
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in by[x] if j < i).items():
            if 100 * n >= linededup.PERCENT * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = collections.defaultdict(set)
    for i, x in enumerate(own):
        members[root(i)] |= places[x]
    return {p for v in members.values() for p in v if p != min(v)}


@pytest.mark.parametrize("weight", [_simjoin.WEIGHT, 1500])
def test_line_dedup(spark, empty, weight, monkeypatch):
    tiled = _simjoin._tiled
    monkeypatch.setattr(_simjoin, "_tiled", lambda placed, _: tiled(placed, weight))
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = [x[:50] + "Q" + x[51:] for x in lines]
    crowd = []
    for _ in range(60):  # variants of one line, some closer to each other than to it
        x = list("the quick brown fox jumps over the lazy dog and then it runs away from the big bad wolf in the wood")
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("QXZ")
        crowd.append("".join(x))
    texts = [(i, "\n".join(rng.choice(lines + near + crowd + ["", "ok", "  OK "]) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    texts += [(500, None), (501, ""), (None, lines[0]), (502, "x" * 5000 + "\n\n" + lines[3])]
    # rows that repeat an id: with other texts, of which only the shared line goes, and with the same text
    texts += [(600, f"{lines[5]}\nonly here, in the first row of this id"), (600, f"nothing but this row has it\n{lines[5]}"), (601, "twice the same\nin two rows"), (601, "twice the same\nin two rows")]
    df = spark.createDataFrame(rows(texts), SCHEMA).withColumn("n_lines", F.lit(-5)).repartition(3)
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    gone = brute_lines([(i, t, hashes[i, t]) for i, t in texts])
    assert {(r.doc, r.row, x) for r in linededup.duplicate_lines(df).collect() for x in r.lines} == gone
    want = []
    for i, t in texts:
        kept = [x for k, x in enumerate(t.split("\n")) if (i, hashes[i, t], k) not in gone] if t else []
        want.append((str(i), "\n".join(kept) if t else t, len(t.split("\n")) - len(kept) if t else 0))
    got = linededup.drop_duplicate_lines(df).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_removed) for r in got), key=str) == sorted(want, key=str)
    kept = linededup.drop_duplicate_lines(df, keep_columns=True)
    assert kept.columns == [*df.columns, "n_removed"]
    assert sorted(((str(r.doc_id), r.text, r.n_removed) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert {(r.n_lines, r.id, r.n_words) for r in kept.collect()} == {(-5, 3, 7)}
    assert "only here, in the first row of this id" in " ".join(r.text or "" for r in got)
    assert linededup.drop_duplicate_lines(empty).count() == 0


def test_line_pairs_at_the_threshold_are_candidates():
    rng = random.Random(4)
    lines, near = [], []
    for _ in range(5000):  # 64 of 80 shingles in common
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(79))
        k = rng.randrange(7, 72)
        lines.append(line.encode())
        near.append((line[:k] + "#" + line[k + 1 :]).encode())
    a, b = linededup.signatures(lines), linededup.signatures(near)
    # 0.08 of them are expected to be missed
    assert (~(linededup.bands(a) == linededup.bands(b)).any(1)).sum() <= 2


def expected_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def tokenizer(made=[]):  # noqa: B006
    if not made:
        made.append(Tokenizer.from_file(PATH))
    return made[0]


def test_token_counts(docs, texts, empty):
    want = sorted((str(i), len((t or "").encode()), len(expected_ids(t))) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, PATH).collect()) == want
    assert tokencount.count_tokens(empty, PATH).count() == 0


def test_bpe_round_trip(docs, texts, empty):
    want = []
    for i, t in texts:
        ids = expected_ids(t)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer().decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.round_trip_digests(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    encoded = bpe.encode(docs, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), expected_ids(t)) for i, t in texts)
    assert sorted(r.text for r in bpe.decode(encoded, PATH).collect()) == sorted(tokenizer().decode(expected_ids(t), skip_special_tokens=False) for _, t in texts)
    assert bpe.round_trip_digests(empty, PATH).count() == 0


def test_transducer_is_stable_and_bounded():
    table = bpe.merges(PATH)
    rng = random.Random(2)
    words, wanted = [], []
    for _ in range(200):
        word = "".join(rng.choice(rng.choice(["abcdefgh", "theinraton", "aeiou", "s"])) for _ in range(rng.randint(1, 900))).encode()
        encoder, out, at = bpe.Encoder(table), [], 0
        while at < len(word):
            to = at + rng.randint(1, 40)
            out += encoder.feed(word[at:to])
            assert len(encoder.held) <= 2 * table.window
            at = to
        out += encoder.finish()
        assert out == table.whole([*(int(table.inner[c]) for c in word[:-1]), int(table.last[word[-1]])])
        assert out == bpe.merge_all([word], np.ones(1, bool), table)[0].tolist()
        words.append(word)
        wanted.append(out)
    for step in (None, 7, 10_000):  # the same, for all words in step, whatever they are fed
        ids, begins = bpe.Encoders(table, step).run([*words, b""])
        assert [ids[x:y].tolist() for x, y in zip(begins, begins[1:], strict=False)] == [*wanted, []]
    pieces = list(bpe.text_pieces(b"one two three four five six", 6))
    assert pieces == [b"one two", b" three", b" four five", b" six"] and b"".join(pieces) == b"one two three four five six"
    machine, ids = bpe.Decoder(rules(PATH)), np.array(expected_ids("The thing is, 42 of them."))
    assert b"".join(machine.feed(ids[k : k + 1]) for k in range(len(ids))).decode() == tokenizer().decode(ids.tolist(), skip_special_tokens=False)


def test_store(spark, docs, texts, empty):
    out = new_table_path(spark, "store")
    castore.write_store(docs, PATH, out, end_id=1)
    want = collections.defaultdict(list)
    for i, t in texts:
        want[i].append([*expected_ids(t), 1])
    got = collections.defaultdict(list)
    for r in castore.verify(spark, out).collect():
        got[r.doc_id].append(r)
    at = 0
    for i in sorted(want, key=lambda x: (x is not None, x)):
        assert sorted((r.n_tokens, r.ids_crc32) for r in got[i]) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[i])
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
    back = castore.read_ids(spark, out).collect()
    assert sorted((str(r.doc_id), r.ids) for r in back) == sorted((str(i), x) for i, own in want.items() for x in own)
    keys = spark.read.parquet(f"{out}/parts").filter("kind = 'chunk'").select("key")
    assert keys.count() == keys.distinct().count()
    other = new_table_path(spark, "store")
    castore.write_store(empty, PATH, other)
    assert castore.verify(spark, other).count() == 0


def test_store_changed(spark, docs):
    out = new_table_path(spark, "store")
    castore.write_store(docs, PATH, out)
    assert castore.verify(spark, out).count() == docs.count()
    recipes = spark.read.parquet(f"{out}/recipes")
    one = recipes.filter("doc_id IS NOT NULL").first()
    own = F.col("row") == one.row
    changes = {
        "shard lost": recipes.filter(F.col("shard") != one.shard),
        "document lost": recipes.filter(~own),
        "id": recipes.withColumn("doc_id", F.when(own, F.lit(-9)).otherwise(F.col("doc_id"))),
        "start": recipes.withColumn("start", F.when(own, F.col("start") + 1).otherwise(F.col("start"))),
    }
    for name, changed in changes.items():
        other = new_table_path(spark, "store")
        shutil.copytree(out.removeprefix("file:"), other.removeprefix("file:"), ignore=shutil.ignore_patterns("recipes"))
        changed.write.parquet(f"{other}/recipes")
        with pytest.raises(ValueError, match="recipes and manifest differ"):
            castore.verify(spark, other)
            print(name, "passed")
    shards = spark.read.parquet(f"{out}/manifest")
    assert shards.filter("shard IS NULL").count() == 1
    other = new_table_path(spark, "store")  # a shard gone from recipes and manifest alike
    shutil.copytree(out.removeprefix("file:"), other.removeprefix("file:"), ignore=shutil.ignore_patterns("recipes", "manifest"))
    changes["shard lost"].write.parquet(f"{other}/recipes")
    shards.filter(F.col("shard").isNull() | (F.col("shard") != one.shard)).write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError, match="recipes and manifest differ"):
        castore.verify(spark, other)


def test_store_damaged(spark, docs):
    """A chunk whose bytes changed, a chunk that is gone, and ids of four bytes."""
    out = new_table_path(spark, "store")
    castore.write_store(docs, PATH, out, end_id=1)
    chunks = spark.read.parquet(f"{out}/parts").filter("kind = 'chunk'")
    one = F.col("key") == chunks.select(F.min("key")).first()[0]
    for changed in (chunks.withColumn("data", F.when(one, F.concat(F.lit(b"xx"), F.col("data"))).otherwise(F.col("data"))), chunks.filter(~one)):
        other = new_table_path(spark, "store")
        shutil.copytree(out.removeprefix("file:"), other.removeprefix("file:"), ignore=shutil.ignore_patterns("kind=chunk"))
        changed.write.partitionBy("kind").mode("append").parquet(f"{other}/parts")
        with pytest.raises(Exception, match="chunk"):
            castore.verify(spark, other).collect()
    wide = new_table_path(spark, "store")
    castore.id_kind, kind = lambda own: "<u4", castore.id_kind
    try:
        castore.write_store(docs.filter("doc_id < 5"), PATH, wide, end_id=1)
    finally:
        castore.id_kind = kind
    assert castore._stored_kind(spark, out) == "<u2" and castore._stored_kind(spark, wide) == "<u4"
    narrow = new_table_path(spark, "store")
    castore.write_store(docs.filter("doc_id < 5"), PATH, narrow, end_id=1)
    for read in (castore.verify, castore.read_ids):
        assert sorted(map(str, read(spark, wide).collect())) == sorted(map(str, read(spark, narrow).collect()))


def test_decontamination(spark, docs, texts, empty):
    items = [(1, " ".join(texts[0][1].split()[3:20]) if texts[0][1] else "the of"), (2, "one"), (3, None), (4, ""), (5, "--"), (5, "the of the"), (None, "the"), (6, "the " * 30)]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER).encode())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 10, 0) + 1) if w and i is not None else ():
            windows[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    postings = decontam.build_postings(docs)
    got = decontam.contamination(postings, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    small = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta y gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    probe = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    shards = decontam.build_postings(small)
    assert [(r.doc_id, r.start, r.end) for r in decontam.matches(shards, probe).collect()] == [(1, 0, 3)]
    assert sorted((r.doc_id, r.start, r.end) for r in decontam.matches(shards, probe, slop=2).collect()) == [(1, 0, 3), (2, 0, 5)]
    assert decontam.contamination(decontam.build_postings(empty), bench).count() == 0
    assert decontam.contamination(postings, bench.filter("false")).filter("contaminated").count() == 0


def test_quality(docs, texts, empty):
    got = {(str(r.doc_id), r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars, r.n_symbols) for r in quality.judge(docs).collect()}
    want = set()
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((str(i), len(w), len(rep), len(lines) - len(set(lines)), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or ""))))
    assert got == want
    assert quality.judge(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_verdicts(spark):
    clean = "The river of the valley is wide and the people in it are known for their bread. " * 1
    clean = " ".join(f"{clean} {k}" for k in range(6))
    cases = {1: clean.replace("  ", " "), 2: "too short", 3: " ".join(f"w{k}###" for k in range(90)), 4: "buy now cheap " * 60, 5: "\n".join(["the same line of the text"] * 9 + [f"the other line {k} of the text" for k in range(9)])}
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), base=(quality.BASE[0],)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_urls(spark):
    pages = [(1, "https://A.Example.com/en/7x?q#f"), (2, "http://example.com/en/8"), (3, "ftp://x.net/de/1"), (4, "http://b.example.net/de/8"), (5, "http://notcom/en/"), (6, None), (7, "no scheme"), (8, "http://h.org?x"), (8, "http://bad.host.io/a")]
    pages += [(100 + k, "http://bad.host.io/x") for k in range(60)] + [(300 + k, f"http://good{k}.io/x") for k in range(60)]
    outcomes = [(100 + k, 1) for k in range(60)] + [(300 + k, 0) for k in range(60)] + [(100, None)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert {(1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "example.com", "/en/8", "com/en/", "block"), (3, "x.net", "/de/1", "net/de/", "allow"), (4, "b.example.net", "/de/8", "example.net/de/8", "block")} <= got
    assert {(5, "notcom", "/en/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "h.org", "", None, "allow"), (8, "bad.host.io", "/a", None, "block")} <= got
    assert sum(v == "block" for *_, v in got) == 63
    assert urlfilter.judge(df.filter("false"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert urlfilter.judge(df, spark.createDataFrame([], "page_id long, bad int")).count() == len(pages)


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    kinds = {"aa": ["ba", "ra", "lan", "tor", "mi"], "bb": ["schu", "kei", "üb", "ver", "zt"], "cc": ["ció", "que", "ñar", "dos", "el"]}
    word = lambda own: "".join(rng.choice(own) for _ in range(rng.randint(1, 3)))
    data = [(i, " ".join(word(kinds[lang]) for _ in range(rng.randint(5, 60))), lang) for i in range(600) for lang in [rng.choice(list(kinds))]]
    df = spark.createDataFrame(data + [(9001, None, "aa"), (9002, "12 + 3", None), (9003, "", "bb")], "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(df, ~held)
    got = langid.predict(df, model).join(df.select("doc_id", "lang", held.alias("held")), "doc_id").collect()
    test = [r for r in got if r.held and r.doc_id < 9000]
    assert sum(r.lang_pred == r.lang for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id > 9000} == {("und", 0.0)}
    # long texts in pieces give the n-grams of the whole
    text = data[0][1] * 3
    whole = np.sort(langid.features([text])[0])
    assert (np.sort(np.concatenate([langid.features([p])[0] for p in langid.pieces(text, 11)])) == whole).all()
    # prediction by hand: the mean of the rows' logits
    rows = langid.features([data[1][1]])[0]
    score = model.scores((model.logits[rows].mean(0) + model.bias)[None])[0]
    mine = next(r for r in got if r.doc_id == data[1][0])
    assert mine.lang_pred == model.langs[int(score.argmax())] and abs(mine.score - score.max()) < 1e-9
    assert langid.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_language_id_full_block(spark):
    """Blocks whose last text fills the characters that are held at once, so that nothing is left for a last call."""
    own = {"aa": "ba ra lan ", "bb": "schu kei üb "}
    samples = [(lang, rows, counts.astype(float)) for lang, text in own.items() for k in range(10) for rows, counts in [np.unique(langid.features([text * (k + 1)])[0], return_counts=True)]]
    model = langid.train(samples)
    fill = lambda lang, n: (own[lang] * (n // 10 + 1))[:n]
    size = langid.PIECE
    for texts in ([fill("aa", size)], [fill("bb", 7), None, fill("aa", size - 7)], [fill("aa", size // 2), fill("bb", 9), fill("bb", size // 2 + 5)], ["1 " * (size // 2)], [fill("aa", size - 1)]):
        raw, count = model.raw(texts)
        for k, text in enumerate(texts):
            rows = langid.features([text])[0]
            assert count[k] == len(rows)
            assert np.allclose(raw[k], model.logits[rows].mean(0) + model.bias if len(rows) else 0)
    assert langid.features([])[0].size == 0 and langid.features([])[1].tolist() == [0]
    df = spark.createDataFrame([(1, fill("aa", 20)), (2, fill("bb", size - 20))], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()} == {(1, "aa"), (2, "bb")}
