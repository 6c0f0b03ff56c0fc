"""One query for each training-data operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, castore, decontam, langid, linededup, neardup, quality, substring, tokencount, urlfilter
from ._spark import new_table_path

LIMIT_TOKENS, END_ID = 2048, 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_duplicate_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = decontam.build_postings(_documents(spark, sf_dir))
    return decontam.contamination(postings, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(_documents(spark, sf_dir), tokenizer_path())
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_table_path(spark, "token-store")
    castore.write_store(_documents(spark, sf_dir), tokenizer_path(), out, end_id=END_ID)
    return castore.verify(spark, out)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir), tokenizer_path())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_line_dedup, op3_benchmark_decontamination, op4_substring_dedup, op5_token_counts, op6_url_filters, op7_token_store, op8_quality_rules, op9_bpe_round_trip, op10_minhash_near_dedup)
    return {f.__name__: f for f in own}


_WORD_SPLIT = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = urlfilter.UPPER, urlfilter.LOWER


def _rules_sql(rules) -> str:
    def one(r) -> str:
        left, right = f"{r.left} * {r.share}", f"{'1' if r.right == 'one' else r.right} * {r.limit}"
        return f"{left} {'>' if r.over else '<'} {right}"

    return " OR ".join(f"({one(r)})" for r in rules)


_OP3 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
tw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, item_id, m, i FROM tw JOIN iw USING (m, g)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN n_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_OP4 = rf"""
WITH dw AS (SELECT doc_id, {_WORD_SPLIT.format(t="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, doc_id * 100000000 + i AS k, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, k, min(k) OVER (PARTITION BY g) AS f FROM win) WHERE k > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM dw),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256 FROM dw d LEFT JOIN kept k USING (doc_id)
"""

_OP6_RULES = sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _fits(own: str, start: str) -> str:
    return f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{start}')"


def _strength_sql(units: str) -> str:
    return f"""SELECT round(least(greatest(CASE WHEN k > 1 AND tn > nn / tn AND spread > 0 THEN noise / spread - 1 ELSE {urlfilter.MOST_STRENGTH} END, {urlfilter.LEAST_STRENGTH}), {urlfilter.MOST_STRENGTH}), 3) AS s, p FROM (
  SELECT *, p * (1 - p) AS noise, (round(q - tb * p, 6) - (k - 1) * (p * (1 - p))) / (tn - nn / tn) AS spread FROM (
  SELECT *, CASE WHEN tn > 0 THEN tb / tn ELSE 0.5 END AS p FROM (
  SELECT count(*) AS k, coalesce(sum(n), 0)::DOUBLE AS tn, coalesce(sum(b), 0)::DOUBLE AS tb, coalesce(sum(b::DOUBLE * b / n), 0.0) AS q, coalesce(sum(n * n), 0)::DOUBLE AS nn FROM {units} WHERE n > 0)))"""


_TWO = r"regexp_extract(host, '([^.]*\.)?[^.]*$')"
_LONG = f"{_TWO} IN ({', '.join(repr(x) for x in urlfilter.LONG_SUFFIXES)})"
_OP6 = rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcomes AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS b FROM labels GROUP BY doc_id),
hosts AS (SELECT host, CASE WHEN {_LONG} THEN {_TWO} ELSE regexp_extract(host, '[^.]*$') END AS suffix,
  CASE WHEN {_LONG} THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*$') ELSE {_TWO} END AS domain, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(b), 0)::BIGINT AS b
  FROM seen LEFT JOIN outcomes ON page_id = doc_id GROUP BY host),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM hosts GROUP BY suffix),
domains AS (SELECT domain, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM hosts GROUP BY domain),
f1 AS ({_strength_sql('suffixes')}), f2 AS ({_strength_sql('domains')}), f3 AS ({_strength_sql('hosts')}),
m1 AS (SELECT h.*, d.n AS dn, d.b AS db, (x.b + f1.s * f1.p) / (x.n + f1.s) AS m FROM hosts h JOIN suffixes x USING (suffix) JOIN domains d USING (domain), f1),
m2 AS (SELECT host, b + f3.s * ((db + f2.s * m) / (dn + f2.s)) AS a, n - b + f3.s * (1 - (db + f2.s * m) / (dn + f2.s)) AS z FROM m1, f2, f3),
known AS (SELECT host, a / (a + z) - {urlfilter.Z} * sqrt(a * z / ((a + z) * (a + z) * (a + z + 1))) AS lower_bound FROM m2)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _OP6_RULES)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _OP6_RULES)} WHEN lower_bound > {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM seen JOIN known USING (host)
"""

_STOP = ", ".join(repr(w) for w in sorted({w for line in quality.STOP_WORDS for w in line.split()}))
_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, {_WORD_SPLIT.format(t='t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  list_filter(string_split_regex(lower(t), '[\x20\x09-\x0D.,;:!?()"]+'), lambda x: x IN ({_STOP})) AS stops FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(stops) AS BIGINT) AS n_stop_words FROM a LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_rules_sql(quality.BASE)}) AS base_failed, NOT ({_rules_sql((*quality.BASE, *quality.RULES))}) AS kept FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": _OP3, "op4_substring_dedup": _OP4, "op6_url_filters": _OP6, "op8_quality_rules": _OP8}
