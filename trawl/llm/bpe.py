"""BPE encoding and decoding as a streaming transducer of bounded lookahead.

The merge list alone says how far to the right the text can matter. A token x that has formed over some bytes can
only come apart by a merge (s, y) across its right edge, where s ends x and is still waiting for its own merge with
the part before it; whether y is there depends on what follows y, under merges of lower rank still. `Merges.reach`
is the largest sum of such y's. Once that many bytes after a token are known, nothing later changes it, so it is
emitted and forgotten: `Encoder` holds no more than a window, however long the text. `Decoder` is the state machine
back from tokens to text.

`Encoders` is the same transducer for many streams in step: each is fed a window of bytes at a time, all windows are
merged at once in numpy, and each stream emits what has become stable, or all that it holds once its pre-token has
ended. Every pre-token goes through it, a distinct one once for as long as a worker remembers it. Texts come in pieces
(`text_pieces`) that end before a space, so a long text is neither encoded nor decoded as a whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._pretokens import Rules, pretokens, rules

END = "</w>"
NEVER = np.iinfo(np.int32).max
#: Distinct pre-tokens that a worker keeps the ids of, before it begins anew.
KEPT_WORDS = 400_000


class Merges:
    """The merge list in arrays, by token ids, with its sufficient lookahead."""

    def __init__(self, own: Rules):
        vocab = own.vocab
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (x, y) in enumerate(own.merges):
            self.ranks.setdefault((vocab[x], vocab[y]), (rank, vocab[x + y]))
        self.inner = np.array([vocab[own.char_of[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[own.char_of[b] + END] for b in range(256)], np.int32)
        size = max(vocab.values()) + 1
        self.text = [""] * size
        for t, i in vocab.items():
            self.text[i] = t
        self.bytes = np.array([len(t.removesuffix(END)) for t in self.text], np.int32)
        self._table()

    def _table(self) -> None:
        """A hash table of pairs for whole arrays: two places for each key."""
        self.bits = 19
        slots = 1 << self.bits
        self.keys, self.rank, self.made = np.full(slots, -1, np.int64), np.full(slots, NEVER, np.int32), np.zeros(slots, np.int32)
        for (x, y), (rank, made) in self.ranks.items():
            item = ((x << 24) | y, rank, made)
            at = self._slots(np.array([item[0]]))[0][0]
            for _ in range(200):
                old = (int(self.keys[at]), int(self.rank[at]), int(self.made[at]))
                self.keys[at], self.rank[at], self.made[at] = item
                if old[0] < 0:
                    break
                item = old
                a, b = (int(p[0]) for p in self._slots(np.array([item[0]])))
                at = b if at == a else a
            else:
                raise ValueError("the pair table is too small")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        shift = np.uint64(64 - self.bits)
        return ((k * A.U64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), ((k * A.U64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)

    def look(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it doesn't merge) and where the table has it."""
        keys = (x.astype(np.int64) << 24) | y
        one, two = self._slots(keys)
        at = np.where(self.keys[one] == keys, one, two)
        return np.where(self.keys[at] == keys, self.rank[at], NEVER), at

    def whole(self, symbols: list[int]) -> list[int]:
        """Merges one sequence of symbols: the pair of least rank first, from the left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.ranks.get(p, (NEVER, 0))[0]) for p in zip(symbols, symbols[1:], strict=False)), default=NEVER)
            if best == NEVER:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (hit := self.ranks.get((symbols[i], symbols[i + 1]))) and hit[0] == best:
                    out.append(hit[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    @property
    def reach(self) -> dict[int, int]:
        """For each token, how many bytes after it must be known before nothing later can change it."""
        if not hasattr(self, "_reach"):
            self._compute_reach()
        return self._reach

    def _compute_reach(self) -> None:
        parent: dict[int, tuple[int, int, int]] = {}  # how a token forms: its first merge
        for (x, y), (rank, made) in self.ranks.items():
            if made not in parent or rank < parent[made][0]:
                parent[made] = (rank, x, y)
        by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks, and the largest need up to each

        def need(token: int, before: int) -> int:
            """Bytes after token that say whether it is still there when merges of rank under `before` are done."""
            most, top = 0, before
            while True:
                ranks, needs = by_left.get(token, ((), ()))
                if (n := bisect_left(ranks, top)) > 0:
                    most = max(most, needs[n - 1])
                if token not in parent:
                    return most
                top, _, token = parent[token]

        for (x, y), (rank, _) in sorted(self.ranks.items(), key=lambda item: item[1]):
            here = int(self.bytes[y]) + need(y, rank)
            ranks, needs = by_left.setdefault(x, ([], []))
            ranks.append(rank)
            needs.append(max(here, needs[-1] if needs else 0))
        self._reach = {i: need(i, NEVER) for i in range(len(self.text)) if self.text[i]}
        self.lookahead = max(self._reach.values())
        self.window = self.lookahead + int(self.bytes.max()) + 1


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(rules(path))


def merge_all(words: list[bytes], ended: np.ndarray, own: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each run of bytes, one after the other, and where each begins: all runs merge at once.

    ended: whether a run's last byte is the last of its pre-token.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = own.inner[data]
    ends = np.cumsum(sizes)
    final = ends[(sizes > 0) & ended] - 1
    symbols[final] = own.last[data[final]]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [], []
    while len(symbols):
        right = np.append(symbols[1:], 0)
        rank, at = own.look(symbols, right)
        same = np.append(word[1:] == word[:-1], False)
        rank[~same] = NEVER
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, first)
        counts = np.diff(np.append(first, len(symbols)))
        merged = np.repeat(least == NEVER, counts)
        if merged.any():
            done_symbols.append(symbols[merged])
            done_words.append(word[merged])
        hit = (rank == np.repeat(least, counts)) & ~merged
        run = np.flatnonzero(hit)
        if len(run):  # of touching pairs, which share a symbol, every other one from the left
            new = np.concatenate([[True], np.diff(run) != 1])
            if not new.all():
                begin = np.flatnonzero(new)
                odd = (np.arange(len(run)) - np.repeat(begin, np.diff(np.append(begin, len(run))))) % 2 == 1
                hit[run[odd]] = False
                run = run[~odd]
        symbols = symbols.copy()
        symbols[run] = own.made[at[run]]
        stay = ~merged
        stay[run + 1] = False
        symbols, word = symbols[stay], word[stay]
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    word = np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    ids = np.concatenate(done_symbols)[order]
    return ids, np.searchsorted(word[order], np.arange(len(words) + 1))


class Encoders:
    """Token ids of many pre-tokens, each a stream that is fed `step` bytes at a time and holds a window besides them."""

    def __init__(self, own: Merges, step: int | None = None):
        self.own, self.reach = own, np.zeros(len(own.text), np.int64)
        self.reach[list(own.reach)] = list(own.reach.values())
        self.step = step or own.window

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after the other, and where each begins."""
        fed, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # bytes given, and bytes not yet emitted
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        open_ = np.flatnonzero(sizes)
        out, of = [], []
        while len(open_):
            fed[open_] = np.minimum(fed[open_] + self.step, sizes[open_])
            ended = fed[open_] == sizes[open_]
            ids, begins = merge_all([words[i][h:f] for i, h, f in zip(open_.tolist(), held[open_].tolist(), fed[open_].tolist(), strict=True)], ended, self.own)
            stream = np.repeat(np.arange(len(open_)), np.diff(begins))
            total = np.cumsum(self.own.bytes[ids])
            end = total - np.concatenate([[0], total])[begins[stream]]  # of each token, in what its stream holds
            firm = ended[stream] | (end + self.reach[ids] < (fed - held)[open_][stream])
            # a stream emits up to its first token that isn't firm
            loose = np.cumsum(~firm)
            firm = loose == np.concatenate([[0], loose])[begins[stream]]
            out.append(ids[firm])
            of.append(open_[stream[firm]])
            held[open_] += np.bincount(stream[firm], self.own.bytes[ids[firm]], minlength=len(open_)).astype(np.int64)
            open_ = open_[~ended]
        if not out:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ids, word = np.concatenate(out), np.concatenate(of)
        if len(out) > 1:
            order = np.argsort(word, kind="stable")
            ids, word = ids[order], word[order]
        return ids, np.searchsorted(word, np.arange(len(words) + 1))


class Encoder:
    """Token ids of one pre-token that arrives in pieces; holds at most a window of bytes."""

    def __init__(self, own: Merges):
        self.own, self.held = own, b""
        own.reach  # noqa: B018  sets window

    def feed(self, piece: bytes) -> list[int]:
        """The tokens that have become stable."""
        out: list[int] = []
        for at in range(0, len(piece), self.own.window):
            self.held += piece[at : at + self.own.window]
            out += self._stable()
        return out

    def _stable(self) -> list[int]:
        out, at = [], 0
        tokens = self.own.whole([int(self.own.inner[b]) for b in self.held])
        for token in tokens:
            size = int(self.own.bytes[token])
            if at + size + self.own.reach[token] >= len(self.held):
                break
            out.append(token)
            at += size
        self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        """The rest: the pre-token has ended."""
        if not self.held:
            return []
        out = self.own.whole([*(int(self.own.inner[b]) for b in self.held[:-1]), int(self.own.last[self.held[-1]])])
        self.held = b""
        return out


class WordIds:
    """Ids of pre-tokens, kept between blocks; begins anew beyond `limit` words, so memory is bounded."""

    def __init__(self, own: Rules, limit: int = KEPT_WORDS):
        self.own, self.table, self.limit = own, merges(own.path), limit
        self.at: dict[bytes | int, int] = {}
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return Encoders(self.table).run(words)

    def find(self, distinct: list[bytes | int]) -> np.ndarray:
        """Where each distinct pre-token is; begins[i]:begins[i + 1] are its ids."""
        if len(self.at) + len(distinct) > self.limit and self.at:
            self.__init__(self.own, self.limit)
        out = np.fromiter((self.at.get(w, -1) for w in distinct), np.int64, len(distinct))
        new = [w for w, i in zip(distinct, out, strict=True) if i < 0]
        if new:
            words = [b"" if isinstance(w, int) else w for w in new]
            ids, begins = self.encode(words)
            special = [i for i, w in enumerate(new) if isinstance(w, int)]
            if special:
                parts = [np.array([new[i]], np.int32) if isinstance(new[i], int) else ids[begins[i] : begins[i + 1]] for i in range(len(new))]
                ids, begins = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            base = len(self.begins) - 1
            self.begins = np.concatenate([self.begins, begins[1:] + self.begins[-1]])
            self.ids = np.concatenate([self.ids, ids])
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
            out[out < 0] = np.arange(base, base + len(new))
        return out

    def block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and where each text's begin."""
        number, first, distinct = pretokens(column, self.own)
        at = self.find(distinct)[number]
        counts = self.begins[at + 1] - self.begins[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[A.ranges(self.begins[at], counts)], total[first]


class Decoder:
    """Text of token ids that arrive in pieces. The file names no decoder: token strings are joined by one space."""

    def __init__(self, own: Rules):
        pieces = [b""] * (max([*own.vocab.values(), *own.special.values()]) + 1)
        for text, i in (own.vocab | own.special).items():
            pieces[i] = text.encode()
        self.sizes = np.fromiter((len(x) + 1 for x in pieces), np.int64, len(pieces))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(b" " + x for x in pieces), np.uint8)
        self.started = False

    def feed(self, ids: np.ndarray) -> bytes:
        """The text of these ids, as UTF-8; from the second token on, a space comes first."""
        if not len(ids):
            return b""
        out = self.data[A.ranges(self.begins[ids], self.sizes[ids])].tobytes()
        started, self.started = self.started, True
        return out if started else out[1:]


#: Bytes of a piece of a long text.
PIECE = 1 << 20
#: Where a text may be cut: before a space that a word of ASCII follows, over which no rule of the tokenizer looks.
_CUT = re.compile(rb" (?=[A-Za-z0-9])")


def text_pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes, each but the first beginning with a space; longer where it can't be cut."""
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def in_pieces(block: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, bool]]:
    """The block with whether its (only) text goes on in the next; one that holds a long text comes in pieces of it."""
    if block.num_rows != 1 or len(value := block.column(text).cast(pa.binary())[0].as_py() or b"") <= PIECE:
        yield block, False
        return
    at = block.schema.get_field_index(text)
    made = list(text_pieces(value))
    for k, piece in enumerate(made):
        yield block.set_column(at, text, pa.array([piece.decode()], pa.string())), k < len(made) - 1


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordIds(rules(path))
        for block in A.blocks(batches):
            found = [own.block(part.column("text")) for part, _ in in_pieces(block)]
            ids, begins = found[0] if len(found) == 1 else (np.concatenate([i for i, _ in found]), np.array([0, sum(len(i) for i, _ in found)]))
            arrays = {n: block.column(n) for n in block.schema.names if n != "text"}
            arrays["ids"] = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
            arrays["n_tokens"] = pa.array(np.diff(begins), pa.int64())
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return encode


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ids array<int> and n_tokens of each row of docs. A null or empty text has no tokens; other columns are left out."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(_encoder(path), f"id {kind}, ids array<int>, n_tokens long").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and text of each row of ids. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(), path).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    read = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


@lru_cache(maxsize=4)
def _tables(path: str) -> Decoder:
    return Decoder(rules(path))


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The text of all ids of a document, as UTF-8."""
    machine = _tables(path)
    machine.started = False
    return machine.feed(ids)


#: Ids that the decoder is fed at a time.
FED = 1 << 16


class _Digest:
    """Digests of one text's ids and of what they decode to, from ids that arrive in pieces."""

    def __init__(self, machine: Decoder):
        self.ids, self.text, self.count, self.machine = hashlib.sha256(), hashlib.sha256(), 0, machine
        machine.started = False

    def feed(self, ids: np.ndarray) -> None:
        self.count += len(ids)
        for at in range(0, len(ids), FED):
            part = ids[at : at + FED]
            self.ids.update(part.astype("<u4").tobytes())
            self.text.update(self.machine.feed(part))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, machine = WordIds(rules(path)), Decoder(rules(path))
        for block in A.blocks(batches):
            done: list[_Digest] = []
            goes_on = False
            for part, more in in_pieces(block):
                ids, begins = own.block(part.column("text"))
                for x, y in zip(begins, begins[1:], strict=False):
                    if not goes_on:
                        done.append(_Digest(machine))
                    done[-1].feed(ids[x:y])
                goes_on = more
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array([d.count for d in done], pa.int64()), pa.array([d.ids.hexdigest() for d in done]), pa.array([d.text.hexdigest() for d in done])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded, in one pass."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(_digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
