"""Unknown swaps of one-byte encodings as substitution ciphers, learned per source against a bigram model."""

from __future__ import annotations

import encodings.aliases
import functools
import math
from collections import Counter, defaultdict

import numpy as np

START, STOP = 256, 257


@functools.cache
def pages() -> tuple[str, ...]:
    """Names of the encodings of one byte a sign that Python has and that keep ASCII; of equal ones the first."""
    found: dict[str, str] = {}
    low = bytes(range(128))
    for name in sorted(set(encodings.aliases.aliases.values())):
        try:
            signs = bytes(range(256)).decode(name, "replace")
            single = all(len(bytes([b]).decode(name, "replace")) == 1 for b in range(256))
        except (LookupError, UnicodeError, ValueError, AssertionError):
            continue
        if single and len(signs) == 256 and signs[:128] == low.decode("ascii") and signs.count("�") < 64:
            found.setdefault(signs, name)
    return tuple(found.values())


@functools.cache
def page_signs(page: str) -> str:
    """The 256 signs of a page; bytes it leaves open stand for control signs."""
    return "".join(chr(i) if c == "�" else c for i, c in enumerate(bytes(range(256)).decode(page, "replace")))


@functools.cache
def _read_pages() -> tuple[dict[str, int], tuple[dict[int, int], ...]]:
    """For each sign outside ASCII a bit for every page that has it, and each page's table to Latin-1."""
    masks: dict[str, int] = defaultdict(int)
    tables = []
    for n, page in enumerate(pages()):
        signs = page_signs(page)
        for c in signs[128:]:
            masks[c] |= 1 << n
        tables.append({ord(c): i for i, c in enumerate(signs) if i >= 128})
    return dict(masks), tuple(tables)


def raw_forms(s: str) -> dict[bytes, int]:
    """The bytes a stretch can have been read from, each with the first page that reads them so."""
    masks, tables = _read_pages()
    common = -1
    for c in set(s):
        if c > "\x7f":
            common &= masks.get(c, 0)
            if not common:
                return {}
    out: dict[bytes, int] = {}
    n = 0
    while common >> n:
        if common >> n & 1:
            out.setdefault(s.translate(tables[n]).encode("latin-1"), n)
        n += 1
    return out


def _symbol(c: str) -> str:
    if c.isascii():
        return c.lower() if c.isalpha() else "0" if c.isdigit() else " "
    return c


class PageScores:
    """Bigram scores of bytes under every page at once."""

    #: Log probability of a sign that no text has.
    BAD = -14.0

    def __init__(self, bigrams):
        self.pages = pages()
        symbols = {"\x02": 0, "\x03": 1}
        numbers = np.zeros((len(self.pages), 258), np.int32)
        bad = []
        for p, page in enumerate(self.pages):
            for i, c in enumerate(page_signs(page)):
                numbers[p, i] = symbols.setdefault(_symbol(c), len(symbols))
                if "\x80" <= c < "\xa0" or "\ue000" <= c < "\uf900":
                    bad.append(numbers[p, i])
        numbers[:, START], numbers[:, STOP] = 0, 1
        names = list(symbols)
        base = np.array([bigrams.base.get(c, bigrams.unseen) for c in names])
        left = np.array([bigrams.left.get(c, 0.0) for c in names])
        seen = np.zeros((len(names), len(names)))
        for pair, n in bigrams.pair.items():
            a, b = symbols.get(pair[0]), symbols.get(pair[1])
            if a is not None and b is not None:
                seen[a, b] = n
        table = np.log((seen + base[None, :]) / (left[:, None] + 1.0))
        table[:, sorted(set(bad))] = self.BAD
        self.symbols, self.numbers, self.table = symbols, numbers, table.astype(np.float32)

    def of(self, raw: bytes) -> np.ndarray:
        """Log probability of the bytes under each page."""
        codes = np.empty(len(raw) + 2, np.int64)
        codes[0], codes[-1] = START, STOP
        codes[1:-1] = np.frombuffer(raw, np.uint8)
        z = self.numbers[:, codes]
        return self.table[z[:, :-1], z[:, 1:]].sum(axis=1)


#: Mean log probability of a pair of signs below which a stretch looks like a cipher.
POOR = -3.0
#: Log odds from which a stretch speaks for a cipher, what one that doesn't speaks against it at most, and what a source's stretches have to give together.
CLEAR, AGAINST, ENOUGH = 1.5, 3.0, 12.0
#: Log odds within which pairs of pages count as equally good.
TIED = 0.5
#: Log odds by which a byte's own letter on the page it starts from is preferred.
KEEP = 6.0


def odds_of(s: str, own: float, scores: PageScores) -> dict[tuple[int, int], float]:
    """Log odds of the pairs (page written, page read) by which a stretch becomes likeliest; pages that agree on it all count."""
    forms = raw_forms(s)
    if not forms:
        return {}
    gains = np.stack([scores.of(raw) for raw in forms]) - own
    reads = list(forms.values())
    gains[np.arange(len(reads)), reads] = -np.inf
    least = max(CLEAR, float(gains.max()) - TIED)
    return {(int(w), reads[k]): float(gains[k, w]) for k, w in zip(*np.nonzero(gains >= least))}


class Cipher:
    """A substitution of signs: it starts as the swap of two pages, and single signs may have moved since."""

    def __init__(self, written: int, read: int, moves: dict[str, str] | None = None):
        self.written, self.read, self.moves = written, read, dict(moves or {})

    @property
    def name(self) -> str:
        p = pages()
        return f"{p[self.written]}<{p[self.read]}"

    @functools.cached_property
    def table(self) -> dict[int, str]:
        back = page_signs(pages()[self.written])
        out = {ord(c): back[i] for i, c in enumerate(page_signs(pages()[self.read])) if i >= 128}
        return out | {ord(k): v for k, v in self.moves.items()}

    def read_back(self, s: str) -> str:
        return s.translate(self.table)


def best_starts(evidence: dict[tuple[str, int, int], float]) -> dict[str, list[Cipher]]:
    """Per source the pairs of pages that its stretches bear out together."""
    out: dict[str, list[Cipher]] = defaultdict(list)
    for (source, written, read), gain in sorted(evidence.items(), key=lambda x: (-x[1], x[0])):
        if gain >= ENOUGH:
            out[source].append(Cipher(written, read))
    return dict(out)


def expected_contexts(s: str, n: float, own: float, ciphers: list[Cipher], bigrams, into: Counter, key: str) -> None:
    """Add a stretch's expected counts of (source, cipher, sign, letter before, letter after), by the ciphers' shares in it."""
    readings = [c.read_back(s) for c in ciphers]
    gains = [bigrams.score(r) - own for r in readings]
    top = max([0.0, *gains])
    weights = [math.exp(max(g - top, -60.0)) for g in gains]
    total = sum(weights) + math.exp(max(-top, -60.0))
    for k, (w, r) in enumerate(zip(weights, readings)):
        share = w / total
        if share < 0.01 or len(r) != len(s):
            continue
        z = "\x02" + "".join(map(_symbol, r)) + "\x03"
        for i, c in enumerate(s):
            if c > "\x7f":
                into[key, k, c, z[i], z[i + 2]] += share * n


def moved(ciphers: list[Cipher], counts: dict[tuple[int, str, str, str], float], scores: PageScores) -> list[Cipher]:
    """The ciphers with their signs at the letters that their contexts make likeliest, the pages' own preferred.

    No two signs of a cipher stand for one letter: a sign moves to a letter that
    is free, and two signs change places, while that gains more than ``KEEP``.
    """
    names = list(scores.symbols)
    letters = np.array([len(c) == 1 and c > "\x7f" and c.isalpha() for c in names])
    table = scores.table.astype(np.float64)
    contexts: dict[int, dict[str, list[tuple[int, int, float]]]] = defaultdict(lambda: defaultdict(list))
    for (k, sign, before, after), n in counts.items():
        a, b = scores.symbols.get(before), scores.symbols.get(after)
        if a is not None and b is not None:
            contexts[k][sign].append((a, b, n))
    out = []
    for k, cipher in enumerate(ciphers):
        start = Cipher(cipher.written, cipher.read)
        home = {sign: scores.symbols.get(start.table.get(ord(sign), sign)) for sign in contexts[k]}
        signs = sorted(sign for sign, at in home.items() if at is not None)
        if not signs:
            out.append(cipher)
            continue
        gain = np.empty((len(signs), len(names)))
        for i, sign in enumerate(signs):
            a, b, n = (np.array(v) for v in zip(*contexts[k][sign]))
            gain[i] = n @ table[a] + table[:, b] @ n
            gain[i, home[sign]] += KEEP
        now = np.array([scores.symbols.get(cipher.table.get(ord(sign), sign), home[sign]) for sign in signs])
        rows = np.arange(len(signs))
        for _ in range(4 * len(signs)):
            free = letters.copy()
            free[now] = False
            alone = np.where(free[None, :], gain - gain[rows, now][:, None], -np.inf)
            i, to = np.unravel_index(int(alone.argmax()), alone.shape)
            swap = gain[:, now] + gain[:, now].T - gain[rows, now][:, None] - gain[rows, now][None, :]
            x, y = np.unravel_index(int(swap.argmax()), swap.shape)
            if max(alone[i, to], swap[x, y]) <= KEEP:
                break
            if alone[i, to] >= swap[x, y]:
                now[i] = to
            else:
                now[x], now[y] = now[y], now[x]
        out.append(Cipher(cipher.written, cipher.read, {sign: names[at] for sign, at in zip(signs, now) if at != home[sign]}))
    return out
