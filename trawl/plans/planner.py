"""Plans a batch of queries: from words to weighted dictionary terms, in groups of which each asks for one word.

A batch is a stated set of queries, so it is planned on the driver. What planning needs from the tables it asks for in
a few small joins for the whole batch (`Lookup`): which words are terms, which terms are near words that aren't, and
which groups meet in documents. Its result is a bounded table, at most `cap` terms for each word and source of terms.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log
from typing import Protocol

from trawl.functions import score as S
from trawl.functions.text import number_forms_of
from trawl.plans import query as Q


class Lookup(Protocol):
    n_docs: int

    def exact(self, words: set[str]) -> dict[str, int]:
        """Document frequency of each word that is a term."""

    def near(self, words: dict[str, int]) -> dict[str, list[tuple[str, int, int]]]:
        """(term, distance, document frequency) of the terms within the edits asked for of each word."""

    def ahead(self, words: dict[str, int], cap: int) -> dict[str, list[tuple[str, int, int]]]:
        """The same for words that are being typed: the best `cap` terms of which a prefix is within the edits."""

    def meetings(self, groups: list[tuple[int, int, str]], typed: list[tuple[int, int, str, int]]) -> dict[int, set[int]]:
        """Of (query, group, term), and groups of words that are being typed, with their edits: the sets of groups, as bits, that live documents have of each query."""

    def meeting_terms(self, groups: list[tuple[int, int, str]], typed: list[tuple[int, int, str, int]], asked: dict[tuple[int, int], tuple[int, list[str]]]) -> dict[tuple[int, int], set[str]]:
        """Of each (query, group) with its other groups as bits and some terms: the terms that a live document has together with all those groups."""

    def learned(self, keys: set[str]) -> dict[str, list[tuple[str, int]]]:
        """(term, document frequency) learned for each key."""


@dataclass
class Emit:
    """Terms from one source, of which the nearest `cap` count."""

    matches: list[tuple[str, int, int]]  # term, distance, document frequency
    ceiling: float | None = None


@dataclass
class Group:
    kind: str  # word, size or connective
    word: str
    at: int | None  # place of the word; None for half a compound
    emits: list[Emit]

    def terms(self) -> set[str]:
        return {t for t, _, _ in self.emits[0].matches}


@dataclass
class Planned:
    query_id: int
    typing: bool
    words: list[tuple[str, bool]]  # and whether the alias table made it
    groups: list[Group] = field(default_factory=list)

    def being_typed(self, at: int | None) -> bool:
        return self.typing and at is not None and at == len(self.words) - 1


def idf(n: int, df: int) -> float:
    return log(1 + max(n - df + 0.5, 0.5) / (df + 0.5))


def budget(word: str) -> int:
    """Typos allowed by the length of a query word: none up to 3 characters, one up to 7, else two; none with a digit."""
    return 0 if numeric(word) or len(word) <= 3 else 1 if len(word) <= 7 else 2


def numeric(word: str) -> bool:
    return any(c in "0123456789" for c in word)


def scoring_words(text: str, aliases: dict[str, str], typing: bool, parsed: bool) -> tuple[list[tuple[str, bool]], bool]:
    """The words that rank, each with whether an alias made it, and whether the last one is still being typed.

    A query without phrases and exclusions is taken as it is.
    """
    query = Q.parse(text, aliases) if parsed else Q.Query()
    if query.phrase or query.exclude:
        if typing:
            own, typing = Q.typeahead(text)
        else:
            own, typing = Q.parse(text).scoring(), False
        text = " ".join(own)
    return Q.words_and_aliased(text, aliases), typing


def plan(queries: Iterable[tuple[int, str | None]], lookup: Lookup, aliases: dict[str, str], typing: bool = False, cap: int = S.EXPANSIONS, parsed: bool = True, correct: bool = True) -> list[Planned]:
    """The groups of each query. A connective beside a content word may be missing; a word that nothing matches may be two."""
    out = []
    for qid, text in queries:
        words, open_ = scoring_words(text or "", aliases, typing, parsed)
        out.append(Planned(qid, open_, words))
    typed = {p.words[-1][0] for p in out if p.typing and p.words}
    whole = {w for p in out for i, (w, _) in enumerate(p.words) if not p.being_typed(i)}
    forms = {f for p in out for i, (w, made) in enumerate(p.words) if made and not numeric(w) and not p.being_typed(i) for f in number_forms_of(w)}
    known = lookup.exact(whole | forms)
    lost = {w for w in whole if w not in known}
    near = lookup.near({w: budget(w) for w in lost if budget(w)}) if any(map(budget, lost)) else {}
    ahead = lookup.ahead({w: budget(w) for w in typed}, max(1, cap)) if typed else {}
    split = {w: [(w[:k], w[k:]) for k in range(2, len(w) - 1)] for w in lost | typed if len(w) >= 4 and not near.get(w) and not ahead.get(w)}
    halves = lookup.exact({x for cuts in split.values() for cut in cuts for x in cut}) if split else {}
    for p in out:
        spare = Q.optional([w for w, _ in p.words], p.typing)
        for i, (w, _) in enumerate(p.words):
            if p.being_typed(i):
                matches = ahead.get(w, [])
            else:
                matches = [(w, 0, known[w])] if w in known else near.get(w, [])
            cuts = [(halves[a] + halves[b], k, a, b) for k, (a, b) in enumerate(split.get(w, [])) if a in halves and b in halves] if not matches else []
            if cuts:
                for half in min(cuts)[2:]:
                    p.groups.append(Group("size" if Q.quantity(half) else "word", half, None, [Emit([(half, 0, halves[half])])]))
            else:
                p.groups.append(Group("connective" if spare[i] else "size" if numeric(w) and Q.quantity(w) else "word", w, i, [Emit(matches)]))
    if correct:
        _correct(out, lookup)
    for p in out:
        _number_forms(p, known, lookup.n_docs)
    _learned(out, lookup)
    return out


def _correct(out: list[Planned], lookup: Lookup) -> None:
    """Words that exist but never stand with the rest of their query may be read as neighbours (one edit) that do."""
    required = {p.query_id: [g for g, own in enumerate(p.groups) if own.kind != "connective"] for p in out}
    some = [p for p in out if len(p.groups) >= 2 and any(_correctable(p, g) for g in required[p.query_id])]
    if not some:
        return
    open_ = [(p.query_id, g, p.groups[g].word, budget(p.groups[g].word)) for p in some for g in required[p.query_id] if p.being_typed(p.groups[g].at) and p.groups[g].terms()]
    rows = [(p.query_id, g, t) for p in some for g in required[p.query_id] if not p.being_typed(p.groups[g].at) for t in p.groups[g].terms()]
    met = lookup.meetings(rows, open_)
    asked: dict[tuple[int, int], tuple[int, str]] = {}
    for p in some:
        bits = met.get(p.query_id, set())
        has = [g for g in required[p.query_id] if p.groups[g].terms()]
        together = lambda groups, bits=bits: any(all(x >> g & 1 for g in groups) for x in bits)
        if len(has) >= 2 and len(has) == len(required[p.query_id]) and together(has):
            continue
        for g in required[p.query_id]:
            other = [h for h in has if h != g]
            if _correctable(p, g) and other and together(other) and not (g in has and together([*other, g])):
                asked[p.query_id, g] = (sum(1 << h for h in other), p.groups[g].word)
    if not asked:
        return
    near = lookup.near({w: 1 for _, w in asked.values()})
    of = {p.query_id: p for p in some}
    tried = {at: (other, [t for t, d, _ in near.get(w, []) if d == 1 and t not in of[at[0]].groups[at[1]].terms()]) for at, (other, w) in asked.items()}
    meeting = lookup.meeting_terms(rows, open_, {at: x for at, x in tried.items() if x[1]})
    for (qid, g), terms in meeting.items():
        of[qid].groups[g].emits[0].matches += [(t, 1, n) for t, d, n in near[asked[qid, g][1]] if t in terms]


def _correctable(p: Planned, g: int) -> bool:
    own = p.groups[g]
    return own.kind == "word" and own.at is not None and not numeric(own.word) and not p.being_typed(own.at) and len(own.word) >= 3 and all(d == 0 for _, d, _ in own.emits[0].matches)


def _number_forms(p: Planned, known: dict[str, int], n_docs: int) -> None:
    """Words of the alias table also match their number forms, one edit away and worth no more than the word itself."""
    for own in p.groups:
        if own.at is None or not p.words[own.at][1] or numeric(own.word) or p.being_typed(own.at):
            continue
        forms = [(f, 1, known[f]) for f in number_forms_of(own.word) if f in known and f not in own.terms()]
        if forms:
            own.emits.append(Emit(forms, idf(n_docs, known[own.word]) if own.word in known else None))


def _learned(out: list[Planned], lookup: Lookup) -> None:
    """A query that is a learned value as a whole has the value's terms in every group, one edit away."""
    keys = {p.query_id: " ".join(w for w, _ in p.words) for p in out if p.words}
    found = lookup.learned(set(keys.values())) if keys else {}
    for p in out:
        terms = [(t, 1, n) for t, n in found.get(keys.get(p.query_id, ""), [])]
        for own in p.groups if terms else ():
            own.emits.append(Emit(list(terms)))


def weighed(plans: list[Planned], n_docs: int, cap: int = S.EXPANSIONS) -> list[tuple[int, int, str, int, float]]:
    """(query_id, group, term, distance, weight): of each source the nearest terms, among those the rarest, `cap` at most."""
    out = []
    for p in plans:
        for g, own in enumerate(p.groups):
            for emit in own.emits:
                for term, distance, df in sorted(emit.matches, key=lambda m: (m[1], m[2], m[0]))[: max(1, cap)]:
                    worth = idf(n_docs, df) if emit.ceiling is None else min(idf(n_docs, df), emit.ceiling)
                    out.append((p.query_id, g, term, distance, worth * S.TYPO_PENALTY**distance))
    return out


def missing(kind: str) -> int:
    return {"size": S.MISSING_SIZE, "connective": S.MISSING_CONNECTIVE}.get(kind, S.MISSING_WORD)
