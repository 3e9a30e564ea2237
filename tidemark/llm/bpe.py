"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

The last token of the encoding of each prefix of a word is unique. So for every prefix, from short to
long, the tokens that end it are taken from an automaton over the vocabulary, and the one is stored
that may stand after the last token of what remains: two tokens may stand side by side if merging them
from their symbols would not join across the border. Following the stored tokens back gives the ids,
in time linear in the word whatever the order of merges. No merge list is replayed on the text.

A worker encodes the distinct words of a stretch of text at once: all advance through the automaton byte
by byte as arrays. Words over ``LONG`` bytes go one at a time by the same steps. The coder's tables are
flat arrays, and what a worker remembers of earlier words is bounded in bytes and dropped with the task.

Words come from the tokenizer's own rules: NFC, white space to blanks, lower case, split at letters,
single digits and other runs; a word's last symbol is a symbol of its own (with the end-of-word mark).
Special tokens in the text are taken as such. Ids, token counts and the decoded text equal those of the
tokenizers library for a vocabulary file of this kind (BPE with end-of-word suffix, no decoder).

Defined results: null and empty text encode to no ids and decode to the empty string; texts of any
length are encoded whole, in stretches of about ``STRETCH`` characters cut at blanks; a byte without a symbol
in the vocabulary raises an error when the file is read; an empty table gives an empty result; repeated rows
and extra columns, whatever their names, pass through.
"""

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import give_back

#: Characters of text that are encoded at once; words of more bytes than this go one at a time.
STRETCH, LONG = 1 << 17, 48
#: Words, and stretches without white space, that a task remembers; none of them is longer than ``SHORT``.
REMEMBERED, SHORT = 50_000, 40
#: So few new words go one at a time.
FEW = 64
#: Places of the table of pair tests, as a power of two; a later pair takes an earlier one's place.
PAIRS = 18
# What counts as white space for the tokenizer's normaliser.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Separators that str.split() takes for white space but the tokenizer does not.
_NOT_BLANK = re.compile(r"[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _places(keys: np.ndarray) -> np.ndarray:
    """Where pairs of tokens stand in the table of pair tests; the highest bits of a product, on which both tokens tell."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIRS)).view(np.int64)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether it is there) of each wanted key in sorted keys."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class PrefixCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.text: list[str | None] = [None] * size
        for token, i in chain(ids.items(), self.special.items()):
            self.text[i] = token
        self.decimal = list(map(str, range(size)))
        symbols = byte_symbols()
        plain, final = [ids[s] for s in symbols], [ids[s + suffix] for s in symbols]
        spelled = {i: bytes([b]) for b, i in enumerate(plain)} | {i: bytes([b]) for b, i in enumerate(final)}
        closing = set(final)
        self.rank, self.left, self.right = (np.full(size, -1, np.int32) for _ in range(3))
        joined = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            joined.append((left << 32 | right, rank))
            self.left[whole], self.right[whole], self.rank[whole] = left, right, rank
            spelled[whole] = spelled[left] + spelled[right]
            if right in closing:
                closing.add(whole)
        joined = dict(joined)  # of a pair that is listed twice, the later line counts
        order = sorted(joined)
        self.pairs, self.pair_rank, self.last_rank = np.array(order, np.int64), np.array([joined[k] for k in order], np.int32), len(model["merges"])
        self.length = np.zeros(size, np.int32)
        for i, s in spelled.items():
            self.length[i] = len(s)
        self._automaton(spelled, closing)
        self.tested, self.outcome = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)
        letters, numbers = _ranges("L"), _ranges("N")
        self.split = re.compile(rf"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{letters}{numbers}]+").findall
        self.blanks = re.compile(f"[{_SPACE}]+").split
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self, remembered: int | None = None) -> None:
        """Drop what was remembered of words met so far, and remember so many from now on, ``REMEMBERED`` by default."""
        self.known, self.remembered = _Known({}), remembered or REMEMBERED

    def _automaton(self, spelled: dict[int, bytes], closing: set[int]) -> None:
        """States are prefixes of tokens; each links to its longest suffix that is a state too.

        ``edge`` has the keys state * 256 + byte in order and ``after`` the states they lead to. For both kinds
        of tokens (those within a word, and those that carry the end-of-word mark), ``first`` is the nearest
        state on a state's chain of links whose whole text is a token, ``token`` that token and ``rest`` the next
        such state; state 0, the empty text, ends a chain.
        """
        edges: dict[int, int] = {}
        texts = [b""]
        own = ({}, {})
        for i, s in spelled.items():
            at = 0
            for k, byte in enumerate(s):
                nxt = edges.setdefault(at << 8 | byte, len(texts))
                if nxt == len(texts):
                    texts.append(s[: k + 1])
                at = nxt
            own[i in closing][at] = i
        n = len(texts)
        by_text = {t: k for k, t in enumerate(texts)}
        link, depth = array("i", bytes(4 * n)), array("i", map(len, texts))
        self.token, self.first, self.rest = ([array("i", bytes(4 * n)) for _ in range(2)] for _ in range(3))
        for state in sorted(range(1, n), key=depth.__getitem__):
            t = texts[state]
            link[state] = next(by_text[t[k:]] for k in range(1, len(t) + 1) if t[k:] in by_text)
            for kind in (0, 1):
                token = own[kind].get(state)
                self.rest[kind][state] = self.first[kind][link[state]]
                self.first[kind][state] = self.rest[kind][state] if token is None else state
                self.token[kind][state] = -1 if token is None else token
        keys = sorted(edges)
        self.edge, self.after = array("q", keys), array("i", [edges[k] for k in keys])
        self.link, self.depth = link, depth

    def _step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one byte each."""
        edge, after, link = np.frombuffer(self.edge, np.int64), np.frombuffer(self.after, np.int32), np.frombuffer(self.link, np.int32)
        out, open_, at = np.zeros(len(states), np.int32), np.arange(len(states)), states.astype(np.int64)
        while len(open_):
            place, there = _at(edge, at[open_] << 8 | codes[open_])
            out[open_[there]] = after[place[there]]
            going = open_[~there & (at[open_] > 0)]
            at[going] = link[at[going]]
            open_ = going
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether they stay apart when their symbols are merged as one text.

        Merges are undone from the latest one: whichever of the two tokens was made later is split,
        and its part at the border takes its place. The pair at the border must not merge before the
        step that was undone last; of equal ranks, the place further left comes first.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        limit, right_next, out, open_ = np.full(len(a), self.last_rank), np.ones(len(a), bool), np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            place, there = _at(self.pairs, x << 32 | y)
            rank = np.where(there, self.pair_rank[place], self.last_rank + 1)
            joins = (rank < limit[open_]) | (rank == limit[open_]) & right_next[open_]
            out[open_[joins]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            going = ~joins & ((made_x >= 0) | (made_y >= 0))
            split_left = made_x > made_y
            a[open_] = np.where(split_left, self.right[x], x)
            b[open_] = np.where(split_left, y, self.left[y])
            limit[open_], right_next[open_] = np.maximum(made_x, made_y), ~split_left
            open_ = open_[going]
        return out

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Pair tests, remembered; -1 before is the word's start, which fits all."""
        out = before < 0
        at = np.flatnonzero(~out)
        if not len(at):
            return out
        key = before[at].astype(np.int64) << 32 | token[at]
        place = _places(key)
        met = self.tested[place] == key
        out[at[met]] = self.outcome[place[met]]
        if not met.all():
            new, back = np.unique(key[~met], return_inverse=True)
            found = self.compatible(new >> 32, new & 0xFFFFFFFF)
            out[at[~met]] = found[back]
            place = _places(new)
            self.tested[place], self.outcome[place] = new, found
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers; all words advance together, byte by byte."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out = [b""] * len(data)
        alone = size > (LONG if len(data) > FEW else 0)
        for k in np.flatnonzero(alone).tolist():
            out[k] = array("i", self._encode_long(data[k])).tobytes()
        for part in np.array_split(short := np.flatnonzero(~alone), max(1, len(short) // 8192)):
            part = part[np.argsort(-size[part], kind="stable")]
            for k, ids in zip(part.tolist(), self._encode_short([data[k] for k in part.tolist()], size[part]), strict=True):
                out[k] = ids
        return out

    def _encode_short(self, data: list[bytes], size: np.ndarray) -> Iterator[bytes]:
        """Ids of words that come longest first, so that those still running are always the first rows."""
        if not data:
            return
        rows, width = len(data), int(size[0])
        codes = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(rows, width)
        last = np.full((rows, width + 1), -1, np.int32)
        tables = [tuple(np.frombuffer(t[kind], np.int32) for t in (self.first, self.token, self.rest)) for kind in (0, 1)]
        depth, state = np.frombuffer(self.depth, np.int32), np.zeros(rows, np.int32)
        for end in range(1, width + 1):
            live = int(np.searchsorted(-size, -end, "right"))
            state = self._step(state[:live], codes[:live, end - 1].astype(np.int64))
            ending = int(np.searchsorted(-size, -end, "left"))
            for kind, row in ((0, np.arange(ending)), (1, np.arange(ending, live))):
                first, token, rest = tables[kind]
                at = first[state[row]]
                while len(row):
                    if not at.all():
                        raise ValueError(f"no token ends at byte {end} of {data[row[np.argmin(at)]]!r}")
                    made = token[at]
                    fit = self._fits(last[row, end - depth[at]], made)
                    last[row[fit], end] = made[fit]
                    row, at = row[~fit], rest[at[~fit]]
        ends, ids, turn = size.copy(), [], np.arange(rows)
        while len(turn):
            made = last[turn, ends[turn]]
            ids.append((turn, made))
            ends[turn] -= self.length[made]
            turn = turn[ends[turn] > 0]
        row = np.concatenate([r for r, _ in ids])
        order = np.argsort(row[::-1], kind="stable")
        flat = np.concatenate([m for _, m in ids])[::-1][order].astype(np.int32).tobytes()
        ends = np.cumsum(4 * np.bincount(row, minlength=rows)).tolist()
        yield from map(flat.__getitem__, map(slice, [0, *ends], ends))

    def _encode_long(self, data: bytes) -> list[int]:
        """Ids of one long word, by the same steps."""
        last, state, size, depth = array("i", [-1]), 0, len(data), self.depth
        edge, link, known = self.edge, self.link, {}
        for end, byte in enumerate(data, 1):
            while True:
                place = bisect_left(edge, state << 8 | byte)
                if place < len(edge) and edge[place] == state << 8 | byte:
                    state = self.after[place]
                    break
                if not state:
                    break
                state = link[state]
            kind = end == size
            at = self.first[kind][state]
            while at:
                token, before = self.token[kind][at], last[end - depth[at]]
                if (fit := known.get((before, token))) is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    fit = known[before, token] = bool(self._fits(np.array([before]), np.array([token]))[0])
                if fit:
                    break
                at = self.rest[kind][at]
            if not at:
                raise ValueError(f"no token ends at byte {end} of {data[:80]!r}")
            last.append(token)
        ids, end = [], size
        while end:
            ids.append(last[end])
            end -= int(self.length[last[end]])
        return ids[::-1]

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space, normalised; white space parts words, so words never cross them."""
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return [c for c in self.blanks(text) if c] if _NOT_BLANK.search(text) else text.split()

    def _words(self, chunk: str) -> list[str]:
        """The words of a stretch without white space that is not one word; it may hold only part marks."""
        return [chunk[:-1], chunk[-1]] if chunk[-1] in ".," and chunk[:-1].isalpha() else self.split(chunk)

    def _meet(self, chunks: set[str]) -> list[str]:
        """Encode the stretches without white space that aren't remembered, together; returns those too long to be kept."""
        if len(self.known) >= self.remembered:
            self.known.before = {}
            self.known = _Known(self.known)
        known, before = self.known, self.known.before
        new = [c for c in chunks if c not in known and c not in before]
        several = {c: self._words(c) for c in new if not c.isalpha()}
        words = list({*(c for c in new if c not in several), *chain.from_iterable(several.values())})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        self.known.update((c, b"".join(map(ids.__getitem__, several[c])) if c in several else ids[c]) for c in new)
        return [c for c in new if len(c) > SHORT]

    def _pieces(self, texts: Iterable[str]) -> Iterator[tuple[int, int, str, int]]:
        """(number of the text, special id or -1, stretch, its characters); a text without any has one empty stretch."""
        for k, text in enumerate(texts):
            for part_no, part in enumerate([text] if self.specials is None or "<|" not in text else self.specials.split(text)):
                if part_no % 2:
                    yield k, self.special[part], "", 1
                    continue
                at = 0
                while at < len(part) or not at:
                    end = part.find(" ", at + STRETCH)
                    end = len(part) if end < 0 else end
                    yield k, -1, part[at:end], end - at
                    at = max(end, 1)

    def encode_texts(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids as 32-bit numbers) of stretches in order; every text has one at least, and none is over ``STRETCH`` by more than a word."""

        def done() -> Iterator[tuple[int, bytes]]:
            long = self._meet(set(chain.from_iterable(own for _, _, own in held)))
            ids = self.known
            for k, special, own in held:
                yield k, array("i", [special]).tobytes() if special >= 0 else b"".join(map(ids.__getitem__, own))
            for c in long:
                del ids[c]

        held, chars = [], 0
        for k, special, stretch, size in self._pieces(texts):
            held.append((k, special, self.chunks(stretch)))
            chars += size
            if chars >= STRETCH:
                yield from done()
                held, chars = [], 0
        yield from done()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(ids for _, ids in self.encode_texts([text])), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, as the library does for a file without a decoder; unknown ids are left out."""
        top = len(self.text)
        return " ".join([t for i in ids if 0 <= i < top and (t := self.text[i]) is not None])

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text that decoding the ids gives) of each text."""
        now, count, of_ids, of_text = 0, 0, hashlib.sha256(), hashlib.sha256()
        for k, ids in self.encode_texts(texts):
            if k != now:
                yield count, of_ids.hexdigest(), of_text.hexdigest()
                now, count, of_ids, of_text = k, 0, hashlib.sha256(), hashlib.sha256()
            if ids:
                between, own = b" " if count else b"", np.frombuffer(ids, np.int32).tolist()
                of_ids.update(between + " ".join(map(self.decimal.__getitem__, own)).encode())
                of_text.update(between + " ".join(map(self.text.__getitem__, own)).encode())
                count += len(own)
        yield count, of_ids.hexdigest(), of_text.hexdigest()


class _Known(dict):
    """Ids of stretches met lately; those of the time ``before`` come over when they are met again."""

    def __init__(self, before: dict):
        super().__init__()
        self.before = before

    def __missing__(self, chunk: str) -> bytes:
        got = self[chunk] = self.before[chunk]
        return got


def _ranges(kind: str) -> str:
    """The code points of a general category's first letter, as the inside of a character class."""
    points = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == kind]
    starts = [p for p, q in zip(points, [-2, *points], strict=False) if p != q + 1]
    ends = [p for p, q in zip(points, [*points[1:], -2], strict=True) if q != p + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@cache
def coder(path: str) -> PrefixCoder:
    """The coder of a vocabulary file that each machine holds, one for each worker process."""
    with open(path, encoding="utf-8") as f:
        made = PrefixCoder(f.read())
    give_back()
    return made


def _list_array(parts: list[list[bytes]]) -> pa.Array:
    ends = np.cumsum([0, *(sum(map(len, own)) // 4 for own in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(chain.from_iterable(parts)), np.int32)))


def encoded_batches(batches: Iterable[pa.Array], path: str) -> Iterator[pa.Array]:
    """The ids of each text of a task's batches; what the task remembered goes back to the system when it ends."""
    c = coder(path)
    try:
        for texts in batches:
            parts: list[list[bytes]] = [[] for _ in range(len(texts))]
            for k, ids in c.encode_texts(t.as_py() for t in texts):
                parts[k].append(ids)
            yield _list_array(parts)
    finally:
        parts = texts = None
        c.forget()
        give_back()


def encoded_column(text: Column, path: str) -> Column:
    """The ids of each text as array<int>; null encodes to an empty array."""

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded_batches(batches, path)

    return encoded(F.coalesce(text, F.lit("")))


def decoded_column(ids: Column, path: str) -> Column:
    """The decoded text of each array of ids; null stays null."""

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([None if (x := r.as_py()) is None else c.decode(x) for r in rows], pa.string())

    return decoded(ids)


def digest_column(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of each text: its ids, and the text decoded from them again."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(path)
        c.forget(2 * REMEMBERED)
        try:
            for texts in batches:
                found = list(c.digests(t.as_py() for t in texts)) if len(texts) else []
                columns = [pa.array([d[i] for d in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            c.forget()
            give_back()

    return digests(F.coalesce(text, F.lit("")))
