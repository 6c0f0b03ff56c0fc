"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule compares two integer counts of a text: it fails where share * `left` is over (or under) `limit` * `right`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in a is that it for was on with as be at by this are or an",
    "la le les de des du et un une en que pour dans est pas",
    "der die das und ist zu ein eine nicht mit von auf den im",
    "el los las y es por con para una del se no",
)


@dataclass(frozen=True)
class Rule:
    name: str
    left: str
    over: bool
    limit: int
    right: str
    share: int = 100


#: The base rules come first; a document that fails any rule is rejected.
BASE = (Rule("few_words", "n_words", False, 50, "one", 1), Rule("repeats", "n_repeat_words", True, 50, "n_words"))
RULES = (
    Rule("short_words", "word_chars", False, 2, "n_words", 1),
    Rule("long_words", "word_chars", True, 12, "n_words", 1),
    Rule("symbols", "n_symbols", True, 10, "n_words"),
    Rule("no_stop_words", "n_stop_words", False, 2, "n_words"),
    Rule("repeated_lines", "n_dup_lines", True, 30, "n_lines"),
)


def counts(text: Column) -> dict[str, Column]:
    """The arrays that the counts are taken from; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {
        "_text": text,
        "_words": F.filter(F.split(text, SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_plain": F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?()\"]+"), lambda w: w.isin(sorted({w for line in STOP_WORDS for w in line.split()}))),
    }


def measures() -> dict[str, Column]:
    words = F.col("_words")
    n = F.size(words)
    # starts of the three-word windows, in the order of their words
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, 3)).alias("w"), i.alias("i"))))).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace("_text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size("_plain").cast("long"),
        "_windows": windows,
    }


def repeat_words() -> Column:
    """Words in three-word windows that the text has twice or more."""
    w = F.col("_windows")
    m = F.size(w)
    twice = F.filter(w, lambda x, k: ((k > 0) & (F.get(w, k - 1)["w"] == x["w"])) | ((k + 1 < m) & (F.get(w, k + 1)["w"] == x["w"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def rules_column(rules: tuple[Rule, ...]) -> Column:
    """Whether any of the rules fails."""
    out = F.lit(False)
    for r in rules:
        left, right = F.col(r.left) * F.lit(r.share), (F.lit(1) if r.right == "one" else F.col(r.right)) * F.lit(r.limit)
        out = out | ((left > right) if r.over else (left < right))
    return out


def _measured(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], base: tuple[Rule, ...]) -> DataFrame:
    """docs as one struct _row, with all counts and verdicts.

    A filter on them would be pushed below the projections, and the arrays they make would then be made anew for each
    element of the lambdas above them. So the last step is a generator of one row, over which no filter moves.
    """
    made = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), *(c.alias(k) for k, c in counts(F.col(text_col)).items()))
    made = made.select("_row", *(c.alias(k) for k, c in measures().items())).withColumn("_starts", repeat_words())
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    made = made.withColumn("n_repeat_words", covered.cast("long"))
    made = made.withColumn("base_failed", rules_column(base)).withColumn("kept", ~rules_column((*base, *rules)))
    names = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept"]
    return made.select(F.inline(F.array(F.struct(*names))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, all counts, base_failed and kept of each row of docs.

    Null and empty texts have counts of 0 and fail the base rules. Other columns are left out, so none can clash.
    """
    made = _measured(docs.select(id_col, text_col), text_col, rules, base)
    return made.select(F.col("_row")[id_col].alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects. Null and empty texts fail; an empty table gives no rows."""
    return _measured(docs, text_col, rules, base).filter("kept").select("_row.*")
