"""The analyzer as column expressions: fold, tokens, exact quantities, aliases, word forms.

Everything here stays in the JVM. `tokens` gives the same array for documents and for queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters that fold to a base letter.
FOLDS = {
    "a": "àáâãäåÀÁÂÃÄÅæÆ",
    "e": "èéêëÈÉÊË",
    "i": "ìíîïÌÍÎÏ",
    "o": "òóôõöÒÓÔÕÖøØ",
    "u": "ùúûüÙÚÛÜ",
    "y": "ýÿÝ",
    "n": "ñÑ",
    "c": "çÇ",
    "s": "šŠ",
    "z": "žŽ",
}
#: Units of quantities, as base unit and thousandths of it.
UNITS = {
    "g": {"g gram grams gr": 1_000, "kg kilo kilos kilogram kilograms": 1_000_000, "mg": 1},
    "ml": {"ml milliliter millilitre mls": 1_000, "l li lit liter liters litre litres": 1_000_000, "cl": 10_000},
    "pc": {"pc pcs piece pieces s pack packs ct count": 1_000},
}
#: Words that a query may carry and a row may leave out.
CONNECTIVES = ("and", "at", "for", "of", "the", "with", "sa", "ng")
#: Abbreviations, and Filipino words for grocery categories.
ABBREVIATIONS = {
    "pwdr": "powder", "pwd": "powder", "evap": "evaporated", "condensada": "condensed", "choco": "chocolate", "choc": "chocolate", "btl": "bottle", "pck": "pack",
    "pk": "pack", "sach": "sachet", "reg": "regular", "orig": "original", "asstd": "assorted", "w": "with", "wmkt": "wet market", "ref": "refill",
}
CATEGORIES = {
    "bigas": "rice", "gatas": "milk", "kape": "coffee", "asukal": "sugar", "asin": "salt", "mantika": "oil", "sabon": "soap", "panligo": "bath", "panlaba": "laundry",
    "gamot": "medicine", "ubo": "cough", "sardinas": "sardines", "delata": "canned", "itlog": "egg", "tinapay": "bread", "manok": "chicken", "baboy": "pork",
    "isda": "fish", "inumin": "drink", "chichirya": "snack", "paaralan": "school",
}
EMOJI = r"\x{200D}\x{2600}-\x{27BF}\x{2B50}-\x{2B55}\x{FE0F}\x{1F1E6}-\x{1FAFF}"
ALNUM = r"\p{IsAlphabetic}\p{N}"
FROM, TO = "".join(FOLDS.values()), "".join(base * len(chars) for base, chars in FOLDS.items())
_UNIT = {name: (base, times) for base, kinds in UNITS.items() for names, times in kinds.items() for name in names.split()}


def fold(text: Column) -> Column:
    """Lower case without the diacritics of the table and without combining marks; null stays null."""
    plain = F.octet_length(text) == F.length(text)  # ASCII has neither
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(F.regexp_replace(text, r"[\x{0300}-\x{036F}]", ""), FROM, TO)))


def quantity(token: Column) -> Column:
    """The canonical token of a quantity (1.5l and 1500ml are 1500ml), null if it isn't one.

    The number has at most twelve digits before the point; of those after it, three count.
    """
    pattern = rf"^([0-9]{{1,12}})(?:[.,]([0-9]*))?({'|'.join(sorted(_UNIT, key=len, reverse=True))})$"
    whole, part, unit = (F.regexp_extract(token, pattern, k) for k in (1, 2, 3))
    by_times: dict[tuple[str, int], list[str]] = {}
    for name, key in _UNIT.items():
        by_times.setdefault(key, []).append(name)
    times, base = F.lit(None).cast("long"), F.lit(None).cast("string")
    for (b, t), names in by_times.items():
        times, base = F.when(unit.isin(names), F.lit(t).cast("long")).otherwise(times), F.when(unit.isin(names), b).otherwise(base)
    thousandths = whole.cast("long") * 1000 + F.rpad(F.substring(part, 1, 3), 3, "0").cast("long")
    per = F.lit(1000).cast("long")
    milli = F.call_function("div", thousandths * times, per)
    number = F.call_function("div", milli, per).cast("string")
    text = F.when(milli % 1000 == 0, F.concat(number, base)).otherwise(F.concat(number, F.lit("."), F.lpad((milli % 1000).cast("string"), 3, "0"), base))
    return F.when(token.rlike(pattern), text)


def tokens(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Tokens of a text in order: folded, numbers with a point, quantities merged and canonical, aliases applied.

    Null and empty texts give an empty array.
    """
    joined = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"(?<=[0-9])[,-](?=[0-9])", ".")
    units = "|".join(sorted(_UNIT, key=len, reverse=True))
    joined = F.regexp_replace(joined, rf"(?<![{ALNUM}])(?<![0-9]\.)([0-9]+(?:\.[0-9]+)?)[^{ALNUM}{EMOJI}]+({units})(?![{ALNUM}])", "$1$2")
    found = F.regexp_extract_all(joined, F.lit(rf"[{ALNUM}]++(?:(?<=[0-9])\.(?=[0-9])[{ALNUM}]++)*+|[{EMOJI}]"), F.lit(0))
    return F.transform(found, lambda t: _canonical(t, aliases))


def _canonical(token: Column, aliases: dict[str, str] | None) -> Column:
    sized = F.when(token.rlike("^[0-9]"), F.coalesce(quantity(token), token)).otherwise(token)
    return F.when(is_numeric(token), sized).otherwise(alias(token, aliases)) if aliases else sized


def is_numeric(token: Column) -> Column:
    """Tokens with an ASCII digit are never matched fuzzily and never aliased."""
    return token.rlike("[0-9]")


def alias(token: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))
    return F.coalesce(F.element_at(table, token), token)


def ligature(word: Column) -> Column:
    """The ligated form of a Tagalog word; null after a consonant other than n."""
    return F.when(word.rlike("[aeiou]$"), F.concat(word, F.lit("ng"))).when(word.endswith("n"), F.concat(word, F.lit("g")))


def ligated(word: str) -> str | None:
    return word + "ng" if word[-1:] in "aeiou" and word else word + "g" if word.endswith("n") else None


def grocery_aliases() -> dict[str, str]:
    """Abbreviations, category words, and the ligated forms of the latter."""
    return ABBREVIATIONS | CATEGORIES | {form: to for word, to in CATEGORIES.items() if (form := ligated(word))}


def is_connective(token: Column) -> Column:
    return token.isin(*CONNECTIVES)


def number_forms(word: Column) -> Column:
    """Plural forms of what looks singular, singular forms of what looks plural; [] for other than 3 or more of a-z."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    plural = F.concat(word, F.lit("s"))
    forms = (
        F.when(word.endswith("ies"), F.array(F.concat(cut(3), F.lit("y"))))
        .when(word.endswith("es"), F.array(cut(2), cut(1)))
        .when(word.endswith("s") & ~word.endswith("ss"), F.array(cut(1)))
        .when(word.rlike("[^aeiou]y$"), F.array(F.concat(cut(1), F.lit("ies")), plural))
        .when(word.rlike("(ch|sh|[xzso])$"), F.array(F.concat(word, F.lit("es")), plural))
        .otherwise(F.array(plural))
    )
    return F.when(word.rlike("^[a-z]{3,}$"), F.filter(forms, lambda f: F.length(f) >= 2)).otherwise(F.array().cast("array<string>"))


def number_forms_of(word: str) -> list[str]:
    """number_forms of one string."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return []
    if word.endswith("ies"):
        forms = [word[:-3] + "y"]
    elif word.endswith("es"):
        forms = [word[:-2], word[:-1]]
    elif word.endswith("s") and not word.endswith("ss"):
        forms = [word[:-1]]
    elif word[-1] == "y" and word[-2] not in "aeiou":
        forms = [word[:-1] + "ies", word + "s"]
    elif word.endswith(("ch", "sh", "x", "z", "s", "o")):
        forms = [word + "es", word + "s"]
    else:
        forms = [word + "s"]
    return [f for f in forms if len(f) >= 2]


def edit_budget(token: Column) -> Column:
    """Typos allowed by the length of the query word: none up to 3 characters, one up to 7, else two."""
    return F.when(is_numeric(token) | (F.length(token) <= 3), 0).when(F.length(token) <= 7, 1).otherwise(2)
