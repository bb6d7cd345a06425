"""Byte-level BPE by backtracking over longest matches, applied in columns.

A text is cut into pre-tokens with array operations on its code points, equal
pre-tokens of a batch are encoded once, and the ids are put together by index.
Each distinct pre-token is encoded exactly by :class:`BacktrackingEncoder`:
an Aho-Corasick automaton gives the vocabulary entries that match at every
byte, and the longest that can stand next to its predecessor is kept, which the
table of merges decides. The work is linear in the number of matches.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import unicodedata

import ahocorasick
import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k"

# The contractions that the splitting rule keeps together.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Ranges of the White_Space property.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

LETTER, NUMBER, OTHER, SPACE, END = 0, 1, 2, 3, 4
#: Stands behind each text; no sign has this number.
TEXT_END = 0x110000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the installed rank file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class BacktrackingEncoder:
    """Exact BPE of one byte string at a time.

    A vocabulary entry is made by one merge of two earlier entries, so merges
    run in the order of their ranks, and a piece of a text lives from the rank
    of its own merge to the rank of the merge that takes it up. Of an entry
    only the pieces at its two ends matter to what stands beside it:
    ``tails(t)`` and ``heads(t)`` list them in the order of their lives, from
    the single byte to the entry itself, each with the rank that ends it.
    """

    NEVER = 1 << 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.length = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.merge_of: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.heads = functools.cache(lambda t: self._lives(t, 0))
        self.tails = functools.cache(lambda t: self._lives(t, 1))
        self.fits = functools.lru_cache(1 << 20)(self._fits)
        known = ranks.get
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            # An entry's halves are the earlier entries that spell it and fit; if there are none, no merge makes it.
            for k in range(1, len(b)):
                left = known(b[:k], i)
                if left < i and (right := known(b[k:], i)) < i and self._fits(left, right):
                    self.halves[i] = left, right
                    self.merge_of[left, right] = i
                    break

    def _lives(self, token: int, side: int) -> list[tuple[int, int]]:
        pieces = [(token, self.NEVER)]
        while (halves := self.halves.get(token)) is not None:
            pieces.append((halves[side], token))
            token = halves[side]
        return pieces[::-1]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE of the two entries' joint bytes gives just these two.

        It does unless some merge crosses the seam. Until one does, the sides
        develop as each would alone, so it is enough to follow in time the two
        pieces that meet at the seam and to ask of each meeting whether they
        would merge while both are still there. Of equal ranks the leftmost
        merge comes first: it takes the left piece away before the seam is
        reached, but not the right one.
        """
        ends, begins, merge, never = self.tails(left), self.heads(right), self.merge_of.get, self.NEVER
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], begins[j]
            across = merge((x, y))
            if across is not None and across < x_until and across <= y_until:
                return False
            if x_until == y_until == never:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode(self, b: bytes) -> list[int]:
        """Ids of a byte string.

        Entries that start at a position are tried from the longest on, and one
        that doesn't fit its predecessor is passed over; where none is left, the
        step before is taken back. A row of entries in which all neighbours fit
        is the BPE of its bytes, so each position is reached by one row at most:
        a step taken back never comes again, and the tries are no more than the
        matches of the automaton.
        """
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        n, length, fits = len(b), self.length, self.fits
        untried: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(b.decode("latin-1")):
            untried[end + 1 - length[token]].append(token)  # ends only grow: the longest comes last
        out: list[int] = [untried[0].pop()]
        at = length[out[0]]
        while at < n:
            options = untried[at]
            while options:
                token = options.pop()
                if not out or fits(out[-1], token):
                    out.append(token)
                    at += length[token]
                    break
            else:
                at -= length[out.pop()]
        return out


def offset_table(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """All entries' bytes, joined by id, and where each begins (one more than entries)."""
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for b, i in ranks.items():
        by_id[i] = b
    return b"".join(by_id), np.cumsum([0] + [len(b) for b in by_id])


def decode(ids, table: tuple[bytes, np.ndarray]) -> bytes:
    """Bytes of a list of ids, by the offset table."""
    data, at = table
    return b"".join(data[at[i] : at[i + 1]] for i in ids)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
    for a, b in WHITE_SPACE:
        out[a : b + 1] = SPACE
    return out


def cut(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ``points``, whose classes are ``kinds``.

    Every text ends with one point of class END. The rule: a contraction, or a
    run of letters, of numbers or of other signs, each with one blank before
    it; of a run of white space before a text's next sign, all but the last.
    """
    n = len(points)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, kinds[:-1]
    starts = kinds != before
    starts |= kinds == END
    space = kinds == SPACE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = END, kinds[1:]
    # The last of a run of white space, when a sign follows, parts from its run.
    last = space & (after != SPACE) & (after != END)
    starts[last] = True
    # If it is a blank, the following sign joins it.
    blank = np.flatnonzero(last & (points == 32))
    starts[blank + 1] = False
    quote = np.flatnonzero((points == 39) & (kinds == OTHER))
    if len(quote):
        prev_kind = before[quote]
        prev_blank = np.zeros(len(quote), bool)
        inner = quote > 0
        prev_blank[inner] = points[quote[inner] - 1] == 32
        # A blank that ends another text's run can't be there: END lies between.
        quote = quote[(prev_kind != OTHER) & ~prev_blank]
        a = points[np.minimum(quote + 1, n - 1)]
        b = points[np.minimum(quote + 2, n - 1)]
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            if len(c) == 1:
                hit = a == ord(c)
            else:
                hit = (a == ord(c[0])) & (b == ord(c[1]))
            size[hit & (size == 0)] = len(c)
        quote, size = quote[size > 0], size[size > 0]
        starts[quote + 1] = False
        rest = quote + 1 + size
        starts[rest] = True  # letters may go on; anything else began there anyway
        # A contraction that stops before a blank keeps the blank's own rule.
    return np.flatnonzero(starts)


class ColumnEncoder:
    """Encodes whole columns of texts; keeps what it has seen, within a bound."""

    SLOTS = 1 << 21

    def __init__(self, path: str, most_cached: int = 400_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoder = BacktrackingEncoder(ranks)
        self.kinds = char_classes()
        # Keys only spread pre-tokens over slots; what they find is compared sign by sign, so any odd factors do.
        self.factors = np.frombuffer(os.urandom(24), np.uint64) | np.uint64(1)
        self.most = most_cached
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.first = np.zeros(self.SLOTS, np.int64)
        self.count = np.zeros(self.SLOTS, np.int32)
        self.begin = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)
        self.signs = np.zeros(1 << 18, np.uint32)
        self.used = self.written = self.cached = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        mask = np.uint64(self.SLOTS - 1)
        slot = ((keys >> np.uint64(20)) & mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            there = self.key[s]
            hit = there == keys[todo]
            out[todo[hit]] = s[hit]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)
        return out

    def _insert(self, keys: np.ndarray, signs: np.ndarray, sizes: np.ndarray, ids: list[list[int]]) -> None:
        """Keep distinct pre-tokens: their signs, all in a row, and their ids."""
        slots = []
        for s in ((keys >> np.uint64(20)) & np.uint64(self.SLOTS - 1)).tolist():
            while self.size[s]:
                s = (s + 1) & (self.SLOTS - 1)
            self.size[s] = 1
            slots.append(s)
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        while self.written + len(signs) > len(self.signs):
            self.signs = np.concatenate([self.signs, np.zeros(len(self.signs), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.signs[self.written : self.written + len(signs)] = signs
        self.key[slots], self.count[slots], self.size[slots] = keys, count, sizes
        self.first[slots] = self.used + np.cumsum(count) - count
        self.begin[slots] = self.written + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.written += len(signs)
        self.cached += len(keys)

    def _other(self, slot: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which pre-tokens are not the ones their slots hold."""
        out = self.size[slot] != sizes
        whole = np.cumsum(sizes, dtype=np.int32)
        before = whole - sizes
        place = np.arange(whole[-1], dtype=np.int32)
        kept = np.repeat(self.begin[slot] - before, sizes)
        kept += place
        if whole[-1] != len(points):
            points = points[np.repeat(starts - before, sizes) + place]
        differs = np.flatnonzero(self.signs.take(kept, mode="clip") != points)
        out[np.searchsorted(whole, differs, side="right")] = True
        return out

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every pre-token and how many pre-tokens come before each text's end."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        kinds = self.kinds[points]
        kinds[ends], points[ends] = END, TEXT_END
        starts = cut(points, kinds).astype(np.int32)
        sizes = np.diff(np.append(starts, np.int32(len(points))))
        one, two, three = self.factors
        place = np.arange(len(points), dtype=np.int32)
        place -= np.repeat(starts, sizes)
        mixed = place.astype(np.uint64)
        mixed <<= np.uint64(21)
        mixed |= points
        mixed *= one
        mixed ^= mixed >> np.uint64(31)
        mixed *= two
        mixed ^= mixed >> np.uint64(29)
        keys = np.add.reduceat(mixed, starts)
        slot = np.empty(len(starts), np.int64)
        todo = np.arange(len(starts))
        while len(todo):
            own = keys[todo] | np.uint64(1)  # 0 is an empty slot
            at = self._find(own)
            missing = np.flatnonzero(at < 0)
            if len(missing):
                distinct, where = np.unique(own[missing], return_index=True)
                new = todo[missing[where]]
                a, b = starts[new], starts[new] + sizes[new]
                signs = points[np.repeat(a - np.cumsum(sizes[new]) + sizes[new], sizes[new]) + np.arange(int(sizes[new].sum()))]
                ids = [[] if end else self.encoder.encode(joined[i:j].encode()) for i, j, end in zip(a.tolist(), b.tolist(), (points[a] == TEXT_END).tolist())]
                self._insert(distinct, signs, sizes[new], ids)
                at[missing] = self._find(own[missing])
            slot[todo] = at
            todo = todo[self._other(at, points, starts[todo], sizes[todo])]
            keys[todo] = (keys[todo] ^ (keys[todo] >> np.uint64(32))) * three + np.uint64(2)
        return slot, np.searchsorted(starts, ends) + 1

    def encode(self, texts: list[str], most_points: int = 2_000_000):
        """Flat ids and each text's end in them; texts are taken in groups of bounded size."""
        flat, sizes = [], []
        for group in self._groups(texts, most_points):
            slot, before = self._slots(group)
            count = self.count[slot].astype(np.int64)
            ends = np.cumsum(count)
            at = np.repeat(self.first[slot] - (ends - count), count) + np.arange(ends[-1])
            flat.append(self.ids[at])
            sizes.append(np.diff(ends[before - 1], prepend=0))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.cumsum(np.concatenate(sizes))

    def count_tokens(self, texts: list[str], most_points: int = 2_000_000) -> np.ndarray:
        sizes = []
        for group in self._groups(texts, most_points):
            slot, before = self._slots(group)
            sizes.append(np.diff(np.cumsum(self.count[slot].astype(np.int64))[before - 1], prepend=0))
        return np.concatenate(sizes) if sizes else np.zeros(0, np.int64)

    def _groups(self, texts: list[str], most: int):
        group: list[str] = []
        size = 0
        for t in texts:
            if group and size + len(t) > most:
                yield group
                group, size = [], 0
                if self.cached > self.most:
                    self._clear()
            group.append(t)
            size += len(t) + 1
        if group:
            yield group
            if self.cached > self.most:
                self._clear()


@functools.cache
def column_encoder(path: str) -> ColumnEncoder:
    """One encoder for each Python worker."""
    return ColumnEncoder(path)
