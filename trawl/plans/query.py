"""The query language: terms, quoted phrases and exclusions, parsed on the driver or for a table of queries.

White space ends a clause, quotes hold a phrase, and a `-` at the start of a clause excludes. Every string parses: an
unclosed quote is read as terms. `words` is the analyzer for one string, equal to functions.text.tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from trawl.functions.text import CONNECTIVES, FROM, TO, UNITS

_FOLD = str.maketrans(FROM, TO)
_TIMES = {name: (base, times) for base, kinds in UNITS.items() for names, times in kinds.items() for name in names.split()}
_EMOJI = "‍☀-➿⭐-⭕️\U0001f1e6-\U0001faff"
_TOKEN = regex.compile(rf"(?:[\p{{Alphabetic}}\p{{N}}]|(?<=[0-9])\.(?=[0-9]))+|[{_EMOJI}]")
_MOVES = regex.compile("[\u0300-\u036fİΣ]")  # marks that go, what lower case makes longer, and what depends on its neighbours
_SIZED = regex.compile(r"([0-9]{1,12})(?:[.,]([0-9]*))?([a-z]+)")


def fold(text: str) -> str:
    return regex.sub("[̀-ͯ]", "", text).translate(_FOLD).lower()


def quantity(token: str) -> str | None:
    """The canonical token of a quantity, None if it isn't one."""
    found = _SIZED.fullmatch(token)
    if not found or found[3] not in _TIMES:
        return None
    base, times = _TIMES[found[3]]
    milli = (int(found[1]) * 1000 + int((found[2] or "")[:3].ljust(3, "0"))) * times // 1000
    return f"{milli // 1000}{base}" if milli % 1000 == 0 else f"{milli // 1000}.{milli % 1000:03}{base}"


def words(text: str | None, aliases: dict[str, str] | None = None) -> list[str]:
    return [w for w, _ in words_and_aliased(text, aliases)]


def words_and_aliased(text: str | None, aliases: dict[str, str] | None = None) -> list[tuple[str, bool]]:
    """The words of a text, and whether the alias table put each in the place of another."""
    joined = regex.sub(r"(?<=[0-9])[,-](?=[0-9])", ".", fold(text or ""))
    out: list[str] = []
    for token in _TOKEN.findall(joined):
        if out and token.isascii() and token.isalpha() and regex.fullmatch(r"[0-9.]+", out[-1]) and (sized := quantity(out[-1] + token)):
            out[-1] = sized
        else:
            out.append(quantity(token) or token)
    made = [t if any(c in "0123456789" for c in t) else (aliases or {}).get(t, t) for t in out]
    return [(w, w != t) for w, t in zip(made, out, strict=True)]


def fold_with_origin(text: str) -> tuple[str, Sequence[int]]:
    """The folded text, and for each of its characters the place of the one it comes from."""
    if not _MOVES.search(text):
        return text.translate(_FOLD).lower(), range(len(text))
    out: list[str] = []
    origin: list[int] = []
    for i, c in enumerate(text):
        for x in "" if "\u0300" <= c <= "\u036f" else c.translate(_FOLD).lower():
            out.append(x)
            origin.append(i)
    return "".join(out), origin


def spans(text: str | None, aliases: dict[str, str] | None = None) -> list[tuple[str, int, int]]:
    """The words of a text with the characters they stand for (start, end); a merged quantity has both halves."""
    folded, origin = fold_with_origin(text or "")
    joined = regex.sub(r"(?<=[0-9])[,-](?=[0-9])", ".", folded)
    out: list[tuple[str, int, int]] = []
    for found in _TOKEN.finditer(joined):
        token, start, end = found[0], origin[found.start()], origin[found.end() - 1] + 1
        if out and token in _TIMES and regex.fullmatch(r"[0-9.]+", out[-1][0]) and (sized := quantity(out[-1][0] + token)):
            out[-1] = (sized, out[-1][1], end)
        else:
            out.append((token[0].isdigit() and quantity(token) or token, start, end))
    return [(t if any(c in "0123456789" for c in t) else (aliases or {}).get(t, t), a, b) for t, a, b in out]


@lru_cache(maxsize=1000)
def _whole(terms: frozenset[str]) -> regex.Pattern | None:
    """Where one of the terms is a whole word of a folded text; None for terms that may be made of other characters."""
    if not terms or any(t in _TIMES or not regex.fullmatch(r"\p{Alphabetic}+", t) for t in terms):
        return None
    return regex.compile(rf"(?<![\p{{Alphabetic}}\p{{N}}])(?:{'|'.join(sorted(terms))})(?![\p{{Alphabetic}}\p{{N}}])")


def spans_of(text: str, terms: frozenset[str], aliases: dict[str, str] | None = None) -> Iterator[tuple[int, int]]:
    """The ranges of those `spans` whose word is one of the terms."""
    pattern = None if aliases else _whole(terms)
    if pattern is None:
        return ((a, b) for w, a, b in spans(text, aliases) if w in terms)
    folded, origin = fold_with_origin(text)
    if not any(t in folded for t in terms):
        return iter(())
    return ((origin[m.start()], origin[m.end() - 1] + 1) for m in pattern.finditer(folded))


@dataclass
class Query:
    term: list[str] = field(default_factory=list)
    phrase: list[list[str]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        """No positive clause: such a query finds nothing."""
        return not self.term and not self.phrase

    def scoring(self) -> list[str]:
        """The words that rank: terms, then phrase words."""
        return [*self.term, *(w for p in self.phrase for w in p)]


def clauses(query: str, aliases: dict[str, str] | None = None) -> list[tuple[str, list[str]]]:
    """(kind, words) of each clause that has words, in the order typed; kind is term, phrase or exclude."""
    pieces = query.split('"')
    closed = len(pieces) % 2 == 1  # an even number of quotes
    out: list[tuple[str, list[str]]] = []
    negated = False
    for k, piece in enumerate(pieces):
        if k % 2 == 1:
            own = words(piece, aliases)
            if own:
                kind = "phrase" if closed or k < len(pieces) - 1 else "term"
                out.append(("exclude" if negated else kind, own))
                negated = False
            continue
        for run in regex.findall(r"\s+|\S+", piece):
            if run.isspace():
                negated = False
                continue
            if run[0] == "-" and not negated:
                negated, run = True, run[1:]
            if own := words(run, aliases):
                out.append(("exclude" if negated else "term", own))
                negated = False
    return out


def parse(query: str, aliases: dict[str, str] | None = None) -> Query:
    out = Query()
    for kind, own in clauses(query, aliases):
        if kind == "phrase":
            out.phrase.append(own)
        else:
            getattr(out, kind).extend(own)
    return out


def typeahead(query: str, aliases: dict[str, str] | None = None) -> tuple[list[str], bool]:
    """Positive words in the order typed, and whether the last one is still being typed (an unquoted term)."""
    own = [(kind, w) for kind, w in clauses(query, aliases) if kind != "exclude"]
    return [x for _, w in own for x in w], bool(own) and own[-1][0] == "term"


def optional(tokens: list[str], typing: bool) -> list[bool]:
    """Which words are connectives that may be missing: only beside a content word, and never the one being typed."""
    content = any(t not in CONNECTIVES for t in tokens)
    return [content and t in CONNECTIVES and not (typing and i == len(tokens) - 1) for i, t in enumerate(tokens)]
