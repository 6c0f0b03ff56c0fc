"""Pre-tokens of a block of texts, for tokenizer files of the lower-casing word-BPE kind.

The file's rules are: NFC, white space collapsed, lower case, then matches of a split pattern (contractions, letter
runs, single digits, runs of other signs). For texts of ASCII and the letters À-ÿ all of it is a matter of byte
classes and is done for a whole block at once. Every other text goes through the tokenizer library's own normaliser
and pre-tokenizer. Strings of special tokens inside a text become the special token, as the library does by default.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from ._arrays import buffer_of

OTHER, LETTER, DIGIT = 3, 1, 2
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
CLASS[48:58] = DIGIT
CLASS[97:123] = CLASS[128:] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Rules:
    """What a tokenizer file says, checked to be of the kind this module handles."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": PATTERN} or level["type"] != "ByteLevel" or spec["model"]["end_of_word_suffix"] != "</w>" or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: not a lower-casing word-BPE file")
        self.path, self.library = path, Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.special_bytes = [x.encode() for x in self.special]
        self.byte_of = byte_alphabet()
        self.char_of = {b: c for c, b in self.byte_of.items()}

    def slow(self, text: str) -> list[bytes | int]:
        """Pre-tokens of one text by the library's own steps; an int is a special token."""
        out: list[bytes | int] = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(self.byte_of[c] for c in piece))
        return out


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def rules(path: str) -> Rules:
    return Rules(path)


def _simple(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have only ASCII and the letters À-ÿ, that is, UTF-8 lead bytes 0xC3 but for the signs × and ÷."""
    odd = (data >= 0xC0) & (data != 0xC3)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    odd[after[(data[after] == 0x97) | (data[after] == 0xB7)]] = True
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = False
    return out


def _fast(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of simple texts: the bytes of all pre-tokens, where each begins in them, and the first pre-token of each text."""
    joined = b"\n".join(texts) + b"\n"
    data = LOWER[np.frombuffer(joined, np.uint8)]
    after = np.flatnonzero(data == 0xC3) + 1
    upper = after[data[after] <= 0x9E]
    data[upper] += 32
    kind = CLASS[data]
    before = np.concatenate([[0], kind[:-1]])
    start = (kind != 0) & ((kind != before) | (kind == DIGIT))
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[kind[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        x, y = padded[quote + 1], padded[quote + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))
        for at, size in ((quote[one], 2), (quote[two], 3)):
            start[at + 1] = False
            more = at + size
            start[more[kind[more] == LETTER]] = True
    keep = kind != 0
    place = np.cumsum(keep)  # bytes kept up to and with each
    begins = place[start] - 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    edges = np.concatenate([[0], place[ends - 1]])
    return data[keep], begins, np.searchsorted(begins, edges)


def pretokens(column: pa.Array, own: Rules) -> tuple[np.ndarray, np.ndarray, list[bytes | int]]:
    """Of each text the pre-tokens, as places in a list of distinct ones, and where each text's begin."""
    data, offsets = buffer_of(column)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    plain = _simple(data, offsets)
    if any(s in raw for s in own.special_bytes):
        plain &= np.array([not any(s in x for s in own.special_bytes) for x in texts], bool)
    packed, begins, first = _fast([x if ok else b"" for x, ok in zip(texts, plain, strict=True)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(packed)).astype(np.int64)), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    distinct: list[bytes | int] = coded.dictionary.to_pylist()
    number = coded.indices.to_numpy()
    if plain.all():
        return number, first, distinct
    known: dict[bytes | int, int] = {w: i for i, w in enumerate(distinct)}
    parts = []
    for row, ok in enumerate(plain):
        if ok:
            parts.append(number[first[row] : first[row + 1]])
        else:
            parts.append(np.array([known.setdefault(w, len(known)) for w in own.slow(texts[row].decode())], number.dtype))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), list(known)
