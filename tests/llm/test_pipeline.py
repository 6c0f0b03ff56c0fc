"""The pipeline on a small corpus with planted cases, each stage judged on its own input."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from trawl.llm import linededup  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    syllables = ["tion", "ba", "rel", "mon", "ti", "sul", "gra", "phe", "lo", "dun", "ki", "ves"]
    stop = ["the", "of", "and", "in", "is"]

    def prose(n):
        words = [rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n)]
        return "\n".join(" ".join(words[k : k + 25]) for k in range(0, n, 25))

    clean = {i: prose(150) for i in range(30)}
    item = prose(40).replace("\n", " ")
    docs = dict(clean)
    docs[100] = "$$$ ### " * 100
    docs[101] = clean[3]  # an exact copy
    words = clean[4].split(" ")
    words[40:44] = ["changed"]
    docs[102] = " ".join(words)  # a near copy
    docs[103] = prose(80) + "\n" + item + "\n" + prose(80)
    docs[104] = "short"
    docs[105] = None
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, clean


def test_run(spark, corpus):
    folder, docs, clean = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    # the near copy loses all lines but the one that was changed; what is left of it is no copy any more
    assert set(got) - {102} == set(clean)
    assert all(len(r.ids) == r.n_tokens > 0 for r in got.values())


def test_stages(spark, corpus):
    folder, docs, clean = corpus
    start = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "encode"]
    ids = lambda df: {r.doc_id for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    for name in names[:-1]:
        assert stages[name](spark, start, folder).columns == start.columns
    assert ids(stages["quality_rules"](spark, start, folder)) == set(docs) - {100, 104, 105}
    after = {r.doc_id: r.text for r in stages["line_dedup"](spark, start, folder).collect()}
    assert 101 not in after
    assert all(after[i] == t for i, t in clean.items())
    assert {(r.doc, x) for r in linededup.duplicate_lines(start).collect() for x in r.lines} >= {(101, k) for k in range(6)}
    assert ids(stages["near_dedup"](spark, start, folder)) == set(docs) - {101, 102}
    assert ids(stages["decontaminate"](spark, start, folder)) == set(docs) - {103}
    assert ids(stages["encode"](spark, start, folder)) == set(docs)


def test_odd_rows(spark, tmp_path):
    """A long text, null and repeated ids, null, empty and repeated texts; and empty tables."""
    rng = random.Random(5)
    words = ["the", "of", "and", *("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000))]
    prose = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(words[:3]) for _ in range(n))
    long, item, one, two = prose(20_000), prose(30), prose(200), prose(200)
    rows = [(1, long), (2, one), (2, two), (2, two), (None, prose(150) + " " + item), (None, prose(150)), (3, None), (4, ""), (5, long), (6, prose(90) + "\n" + one)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, len(t) if t else None) for i, t in own], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert [n for n, _ in got.dtypes] == ["doc_id", "n_tokens", "ids"]
        ids = sorted(str(r.doc_id) for r in got.collect())
        # 5 repeats 1; 6 loses its last line; of the rows of no id the one with the item goes; 3 and 4 fail the quality rules
        assert ids == (["1", "2", "2", "2", "6", "None"] if own else [])


def test_quality_filter_stays_above_its_lambdas(spark):
    """No filter on the verdict below the projections, where it would be computed anew for each element of an array."""
    from trawl.llm import quality

    words = " ".join(f"the of {k}" for k in range(6000))
    df = spark.createDataFrame([(1, words), (2, "x")], "doc_id long, text string")
    kept = quality.keep(df)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Filter (isnotnull(kept") < plan.find("Generate") and plan.count("Filter (") == 1
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(df).filter("kept").collect()} == {1}
