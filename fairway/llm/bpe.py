"""Exact BPE encoding by dynamic programming over prefixes, and the cached piece tables that encode batches of texts.

Every prefix of a word has one valid encoding, so it is enough to store that encoding's last token. A token t that ends
at position i extends the prefix before it exactly if the pair (last token of that prefix, t) is compatible: if BPE, on
the two tokens' text, gives just these two. The automaton lists all tokens that end at each position; back-pointers
from the end of the word give the ids.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from functools import cached_property

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

from fairway.llm.textstream import mix

VOCABULARY = "word_bpe_49k.json"
#: Pieces and words that a worker keeps, some 45 bytes each; beyond them a table starts anew.
PIECES, WORDS = 400_000, 600_000
#: Pairs of tokens whose compatibility a worker keeps, some 80 bytes each.
PAIRS = 250_000

#: Bits of an id in the key of a pair.
TOKEN_BITS = 24

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_SPECIAL = b"<|"
_KEY = np.dtype("<u8")
#: Punctuation that, at the end of a piece of letters, is a word of its own.
_STOPS = b".,;:!?"


def memo(f: Callable) -> dict:
    """A dictionary that fills itself by f."""

    class Memo(dict):
        def __missing__(self, key):
            self[key] = value = f(key)
            return value

    return Memo()


def vocabulary_path(name: str) -> str:
    """An absolute path as it is; else the public vocabulary file of that name."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_texts(path: str) -> dict[int, str]:
    """The texts of all tokens of a vocabulary file by id, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


class PrefixBpe:
    """Encoder of a byte-level BPE vocabulary with word ends, as the tokenizers library encodes with it.

    Within, a word is a string of symbols: chr(b) for a byte, chr(256 + b) for the last byte of the word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.bytes_of = byte_alphabet()
        end = spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            body, last = (token[: -len(end)], 256) if token.endswith(end) else (token, 0)
            b = [self.bytes_of[c] for c in body]
            return "".join(map(chr, b[:-1])) + chr(b[-1] + last)

        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.id_of = {symbols(t): i for t, i in vocab.items()}
        self.symbols_of = {i: s for s, i in self.id_of.items()}
        if max(vocab.values()) >= 1 << TOKEN_BITS:
            raise ValueError(f"vocabularies of more than {1 << TOKEN_BITS} ids are not supported")
        self.compatible: dict[int, bool] = {}
        self.splits = memo(self._split_of)
        self.lefts = memo(lambda t: self._spine(t, 0))
        self.rights = memo(lambda t: self._spine(t, 1))
        self._split = self._special_pattern()

    def _special_pattern(self):
        return regex.compile(b"(" + b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None

    @cached_property
    def rank(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and result of the merges, by their parts."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All tokens, to be found at every place of a word."""
        found = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            found.add_word(s, (len(s), i))
        found.make_automaton()
        return found

    @cached_property
    def library(self):
        """The library's own tokenizer, for texts whose characters normalisation changes; most workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _split_of(self, token: int) -> tuple[int, int, int]:
        """Left part, right part and rank of the merge that makes a token last; (-1, -1, -1) for a symbol, (-2, ...) if BPE never gives it."""
        ids, last = [self.id_of[c] for c in self.symbols_of[token]], (-1, -1, -1)
        while len(ids) > 1:
            best = min((self.rank[p] + (i,) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                return (-2, -2, -2)
            r, made, i = best
            last = (ids[i], ids[i + 1], r)
            ids[i : i + 2] = [made]
        return last if ids == [token] else (-2, -2, -2)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts at one edge of a token (side 0: left), outermost first, each with the rank of the merge that consumes it."""
        parts, rank = [], 1 << 60
        while token >= 0:
            parts.append((token, rank))
            split = self.splits[token]
            token, rank = split[side], split[2]
        return parts

    def _test(self, key: int, last: int, token: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that make them; last < 0: whether BPE gives the token at all."""
        ok = self.splits[token][0] != -2
        if ok and last >= 0:
            rank = self.rank
            for x, until in self.rights[last]:
                for y, before in self.lefts[token]:
                    # of equal merges the leftmost comes first
                    if (m := rank.get((x, y))) is not None and m[0] < until and m[0] <= before:
                        ok = False
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def word(self, word: bytes) -> bytes:
        """Ids of one word, as unsigned 32-bit numbers."""
        w = word[:-1].decode("latin-1") + chr(256 + word[-1])
        if (whole := self.id_of.get(w)) is not None and (self.compatible.get(whole) or self._test(whole, -1, whole)):
            return array("I", (whole,)).tobytes()
        last = [-1] * (len(w) + 1)
        size = [0] * (len(w) + 1)
        known = self.compatible
        for at, (n, token) in self.automaton.iter(w):
            at += 1
            if size[at]:
                continue
            before = last[at - n]
            key = (before + 1) << TOKEN_BITS | token
            ok = known.get(key)
            if ok is None:
                ok = self._test(key, before, token)
            if ok:
                last[at], size[at] = token, n
        at, ids = len(w), []
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def words(self, piece: bytes) -> list[bytes]:
        """The words of a piece of text without ASCII white space and special strings, normalised."""
        low = piece.lower()
        if low.isalpha():  # ASCII letters
            return [low]
        if low[-1] in _STOPS and low[:-1].isalpha():
            return [low[:-1], low[-1:]]
        text = piece.decode()
        if max(text) < "ɐ":  # no characters that normalisation changes, and letters that no Unicode version moves
            return [p.encode() for p in _PARTS.findall(text.lower())]
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in shown if p]

    def parts(self, piece: bytes) -> list[bytes]:
        """The words, and special strings as they are, of a piece of text without ASCII white space."""
        if not piece:
            return []
        if _SPECIAL in piece and self._split and len(parts := self._split.split(piece)) > 1:
            return [w for p in parts if p for w in ([p] if p in self.special else self.words(p))]
        return self.words(piece)

    def part(self, part: bytes) -> bytes:
        """Ids of one of those."""
        return array("I", (self.special[part],)).tobytes() if part in self.special else self.word(part)


class LibraryBpe(PrefixBpe):
    """The same ids, those of a word from the library's own model: for operators that only need the ids. The file is parsed by the library alone."""

    def __init__(self, path: str):
        self.path, self.bytes_of = path, byte_alphabet()
        self.special = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self._split = self._special_pattern()
        self.model, self.shown = self.library.model, {b: c for c, b in self.bytes_of.items()}

    def word(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.shown))]).tobytes()


def split_pieces(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pieces of texts cut at ASCII white space; the pieces of all texts in order, as numbers; each text's bounds.

    Such cuts are safe: the normaliser joins nothing across white space and the pre-tokenizer drops it. Null is empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), bounds


class Strings:
    """Byte strings in one array."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)


def same(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Whether string i of `a` is string j of `b`, byte for byte."""
    out = a.size[i] == b.size[j]
    k = np.flatnonzero(out)
    n = a.size[i[k]]
    ends = np.cumsum(n)
    at = np.arange(int(n.sum())) - np.repeat(ends - n, n)
    wrong = np.r_[0, np.cumsum(a.flat[np.repeat(a.start[i[k]], n) + at] != b.flat[np.repeat(b.start[j[k]], n) + at])]
    out[k] = wrong[ends] == wrong[ends - n]
    return out


class IdTable:
    """Ids of byte strings in arrays, a few dozen bytes for each string: found by a 64-bit key, then compared byte for byte.

    A string whose key belongs to another one goes on to the key's successor, so that no two share their ids.
    """

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.keys = np.empty(0, _KEY)  # sorted
        self.slot = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int32)  # of the strings
        self.flat = np.empty(0, np.uint8)
        self.used = self.bytes = 0

    @property
    def n(self) -> int:
        return len(self.keys)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        there = at < self.n
        there[there] = self.keys[at[there]] == keys[there]
        out = np.full(len(keys), -1, np.int64)
        out[there] = self.slot[at[there]]
        return out

    def find(self, strings: Strings, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the strings, -1 for those not there; then the places of these, their distinct keys, the first place of each, and each one's number."""
        while True:
            slots = self._at(keys)
            wrong = np.zeros(len(keys), bool)
            there, new = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
            wrong[there] = ~same(strings, there, self, slots[there])
            kinds, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            wrong[new] = ~same(strings, new, strings, new[first[back]])
            if not wrong.any():
                return slots, new, kinds, new[first], back
            keys = np.where(wrong, mix(keys + np.uint64(1)), keys)

    def add(self, strings: Strings, which: np.ndarray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts the strings at `which` under new keys with their ids, one after another; their slots."""
        slots = np.arange(self.n, self.n + len(keys))
        n = strings.size[which]
        ends = np.cumsum(n)
        at = np.repeat(strings.start[which] - (ends - n), n)
        self.flat, self.bytes = _appended(self.flat, self.bytes, strings.flat[at + np.arange(len(at))])
        self.start = np.concatenate([self.start, (self.bytes - len(at) + ends - n).astype(np.int32)])
        self.size = np.concatenate([self.size, n.astype(np.int32)])
        self.ids, self.used = _appended(self.ids, self.used, ids)
        self.first = np.concatenate([self.first, (self.used - len(ids) + np.cumsum(sizes)).astype(np.int32)])
        new = np.argsort(keys)
        both = np.concatenate([self.keys, keys[new]])
        order = np.argsort(both, kind="stable")  # merges two sorted runs
        self.keys, self.slot = both[order], np.concatenate([self.slot, slots[new].astype(np.int32)])[order]
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slots in order, and the number of each."""
        start = self.first[slots]
        n = self.first[slots + 1] - start
        ends = np.cumsum(n)
        where = np.repeat(start - (ends - n), n)
        where += np.arange(len(where))
        return self.ids[where], n

    def make_room(self, entries: int) -> None:
        """Starts anew beyond so many entries, or ten ids or twenty bytes for each of them."""
        if self.n > entries or self.used > 10 * entries or self.bytes > 20 * entries:
            self.reset()


def _appended(array: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """The array with `more` after its first `used` places, and how many are used now; it grows by halves."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.empty(max(len(more), used // 2, 1 << 16), array.dtype)])
    array[used : used + len(more)] = more
    return array, used + len(more)


def _keys(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), _KEY, len(strings))


class PieceTable:
    """Ids of the pieces and words seen so far by this worker."""

    def __init__(self, encoder: PrefixBpe):
        self.encoder = encoder
        self.pieces, self.words = IdTable(), IdTable()

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of distinct pieces in the table of pieces."""
        self.pieces.make_room(PIECES)
        strings = Strings(pieces)
        slots, _, kinds, new, _ = self.pieces.find(strings, _keys(pieces))
        if len(new):
            split = [self.encoder.parts(pieces[i]) for i in new.tolist()]
            count = np.array([len(x) for x in split])
            ids, n = self._words([w for x in split for w in x])
            total = np.r_[0, np.cumsum(n)]
            ends = np.cumsum(count)
            slots[new] = self.pieces.add(strings, new, kinds, ids, total[ends] - total[ends - count])
        return slots

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.words.make_room(WORDS)
        strings = Strings(words)
        slots, new, kinds, first, back = self.words.find(strings, _keys(words))
        if len(new):
            made = [self.encoder.part(words[i]) for i in first.tolist()]
            sizes = np.array([len(x) for x in made]) // 4
            slots[new] = self.words.add(strings, first, kinds, np.frombuffer(b"".join(made), np.uint32), sizes)[back]
        return self.words.gather(slots)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's bounds."""
        pieces, order, bounds = split_pieces(texts)
        ids, n = self.pieces.gather(self.numbers(pieces)[order] if len(order) else np.empty(0, np.int64))
        return ids, np.r_[0, np.cumsum(n)][bounds]


_TABLES: dict[tuple[str, type], PieceTable] = {}


def piece_table(vocabulary: str, kind: type[PrefixBpe] = PrefixBpe) -> PieceTable:
    """This worker's table for a vocabulary file; it lives as long as the worker."""
    if (vocabulary, kind) not in _TABLES:
        _TABLES[vocabulary, kind] = PieceTable(kind(vocabulary_path(vocabulary)))
    return _TABLES[vocabulary, kind]
