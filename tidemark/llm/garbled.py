"""Text decoded with the wrong character encoding: finding it and restoring it."""

from __future__ import annotations

import codecs
import functools
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ciphers import ENOUGH, POOR, Cipher, PageScores, best_starts, expected_contexts, moved, odds_of
from tidemark.runtime import staged

# Code pages that a text may wrongly be read in (all bytes get a sign).
READ_AS = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp850", "cp437", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859_2", "iso8859_15")
# Encodings of several bytes a sign that a text may wrongly be read in.
READ_AS_WIDE = ("gbk", "cp932", "big5", "euc_kr")
# Encodings a text may have had, besides UTF-8.
WRITTEN_NARROW = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp850", "cp437", "cp866", "mac_roman", "koi8_r", "iso8859_2")
WRITTEN_WIDE = ("gb18030", "euc_jp", "cp932", "big5", "euc_kr")
LOST = "�"
OPENING, CLOSING = "([{<«“‘„", ")]}>»”’“"
BAD = "￿"

CORE = re.compile(r"[^\x00-\x7f](?:[\x20-\x7e]{0,2}[^\x00-\x7f])*")


@functools.cache
def signs(page: str) -> str:
    """The 256 signs of a one-byte code page; bytes it leaves open stand for control signs."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(i))
    return "".join(out)


@functools.cache
def _to_bytes(page: str) -> dict[int, str]:
    """translate() table from a page's signs to Latin-1 ones; other signs of 0x80 to 0xff turn bad."""
    table = {i: BAD for i in range(0x80, 0x100)}
    table |= {i: chr(i) for i in range(0x80, 0xA0)}
    table |= {ord(c): chr(i) for i, c in enumerate(signs(page)) if i >= 0x80}
    return table


@functools.cache
def swap_table(read_as: str, written: str) -> dict[int, str]:
    """translate() table that undoes reading ``written`` as ``read_as``, sign by sign."""
    back = signs(written)
    return {k: BAD if v == BAD else back[ord(v)] for k, v in _to_bytes(read_as).items()}


def _bytes(s: str, page: str) -> bytes | None:
    try:
        return s.translate(_to_bytes(page)).encode("latin-1")
    except UnicodeEncodeError:
        return None


IMPROPER = re.compile("[\ufffd\uffff\x80-\x9f\ue000-\uf8ff]")


def _proper(s: str) -> bool:
    return IMPROPER.search(s) is None


def readings(s: str, depth: int = 3) -> list[tuple[str, str]]:
    """What a stretch may have been: (swap, proper reading), each reading once.

    A swap is named ``written<read_as``; several in a row, as of a text spoilt
    more than once, are joined by a blank.
    """
    return [(names[0], r) for r, names in swaps_by_reading(s, depth).items()]


def swaps_by_reading(s: str, depth: int = 3) -> dict[str, list[str]]:
    """The proper readings of a stretch, each with all swaps that give it."""
    out: dict[str, list[str]] = defaultdict(list)
    seen = {s}
    todo = [("", s, 0)]
    while todo:
        name, text, level = todo.pop()
        for page in (*READ_AS, *READ_AS_WIDE):
            if page in READ_AS_WIDE:
                try:
                    raw = text.encode(page)
                except UnicodeEncodeError:
                    continue
            elif (raw := _bytes(text, page)) is None:
                continue
            how = f"utf_8<{page}"
            try:
                got = raw.decode("utf-8")
            except UnicodeDecodeError:
                got = None
            if got is not None and got not in seen:
                seen.add(got)
                full = f"{name} {how}".strip()
                if _proper(got):
                    out[got].append(full)
                if level + 1 < depth and not got.isascii():
                    todo.append((full, got, level + 1))
            if level or page in READ_AS_WIDE:
                continue
            if page == "cp1252":
                for wide in WRITTEN_WIDE:
                    try:
                        got = raw.decode(wide)
                    except UnicodeDecodeError as e:
                        if e.start < len(raw) - 2 or e.start < 4:
                            continue
                        got = raw[: e.start].decode(wide) + raw[e.start :].decode("latin-1")
                    if got != s and _proper(got):
                        out[got].append(f"{wide}<{page}")
            for narrow in WRITTEN_NARROW:
                if narrow != page:
                    got = codecs.charmap_decode(raw, "strict", signs(narrow))[0]  # as by swap_table
                    if got != s and _proper(got):
                        out[got].append(f"{narrow}<{page}")
    return out


def stretches(text: str) -> list[tuple[int, int, int, int]]:
    """Where a text leaves ASCII: bounds of each stretch, and of its core without the letters around it.

    A stretch joins non-ASCII signs with at most two printable ASCII signs
    between them, and takes the ASCII letters next to it.
    """
    out = []
    for m in CORE.finditer(text):
        a, b = m.span()
        lo, hi = a, b
        before = out[-1][1] if out else 0
        while lo > before and text[lo - 1].isascii() and text[lo - 1].isalpha():
            lo -= 1
        while hi < len(text) and text[hi].isascii() and text[hi].isalpha():
            hi += 1
        out.append((lo, hi, a, b))
    return out


ASCII_SYMBOLS = {chr(i): chr(i).lower() if chr(i).isalpha() else "0" if chr(i).isdigit() else " " for i in range(128)}


def _symbols(s: str) -> str:
    """A stretch as the language model sees it; case counts outside ASCII, since some swaps only change it."""
    of = ASCII_SYMBOLS.get
    return "\x02" + "".join([of(c, c) for c in s]) + "\x03"


class Bigrams:
    """Smoothed model of which sign follows which."""

    VOCABULARY = 100_000.0

    def __init__(self, counts: dict[str, float]):
        self.pair = counts
        self.left: dict[str, float] = defaultdict(float)
        right: dict[str, float] = defaultdict(float)
        for p, n in counts.items():
            self.left[p[0]] += n
            right[p[1]] += n
        total = sum(right.values())
        self.base = {c: (n + 0.01) / (total + 0.01 * self.VOCABULARY) for c, n in right.items()}
        self.unseen = 0.01 / (total + 0.01 * self.VOCABULARY)
        self.cache: dict[str, float] = {}

    def score(self, s: str) -> float:
        """Log probability of a stretch."""
        z = _symbols(s)
        known, cache, out = self.cache.get, self.cache, 0.0
        for a, b in zip(z, z[1:]):
            p = a + b
            v = known(p)
            if v is None:
                base = self.base.get(p[1], self.unseen)
                v = cache[p] = math.log((self.pair.get(p, 0.0) + base) / (self.left.get(p[0], 0.0) + 1.0))
            out += v
        return out


    def score_without(self, s: str) -> float:
        """Log probability of a stretch by what the model knows from elsewhere: one count of each of its own pairs is left out."""
        z = _symbols(s)
        own = Counter(z[i : i + 2] for i in range(len(z) - 1))
        left: Counter = Counter()
        for p, n in own.items():
            left[p[0]] += n
        out = 0.0
        for p, n in own.items():
            base = self.base.get(p[1], self.unseen)
            out += n * math.log((max(self.pair.get(p, 0.0) - n, 0.0) + base) / (max(self.left.get(p[0], 0.0) - left[p[0]], 0.0) + 1.0))
        return out


def pairs_of(s: str) -> list[str]:
    z = _symbols(s)
    return [z[i : i + 2] for i in range(len(z) - 1)]


SOUND = ""
# Log odds from which a stretch speaks for a one-byte or East Asian swap, which a whole text then has to bear out.
CLEAR = 1.5
# What a distinct stretch that such a swap would spoil speaks against it at most.
AGAINST = 3.0
# Log shares granted to a swap before any stretch shows it, and the log odds of a control sign of 0x80 to 0x9f in sound text.
LEAST_UTF8, LEAST_SWAP, CONTROL = math.log(0.3), math.log(1e-4), -6.0


class SwapModel:
    """Which swaps a source's stretches went through: prior weights per source and a language model."""

    def __init__(self, counts: dict[str, float], priors: dict[tuple[str, str], float]):
        self.bigrams = Bigrams(counts)
        totals: dict[str, float] = defaultdict(float)
        for (source, _), n in priors.items():
            totals[source] += n
        self.prior = {k: math.log((n + 0.01) / (totals[k[0]] + 1.0)) for k, n in priors.items()}
        self.ciphers: dict[str, list[Cipher]] = {}
        self.weights: dict[tuple[str, str], float] = {}

    def weight(self, source: str, swap: str) -> float:
        """Log share of a swap among a source's stretches; never below what is granted before any was seen."""
        if (got := self.weights.get((source, swap))) is None:
            got = self.weights[source, swap] = self._weight(source, swap)
        return got

    def _weight(self, source: str, swap: str) -> float:
        if swap == SOUND:
            return self.prior.get((source, swap), 0.0)
        floor = LEAST_UTF8 if swap.startswith("utf_8") else LEAST_SWAP
        return max(floor, self.prior.get((source, swap), floor))

    def gains(self, source: str, s: str, options: list[tuple[str, str]]) -> list[tuple[float, str, str]]:
        """By how much (log odds) each reading beats taking the stretch as sound, best first."""
        own = self.bigrams.score_without(s) + self.weight(source, SOUND) + CONTROL * sum("\x80" <= c < "\xa0" for c in s)
        out = [(self.bigrams.score(r) + self.weight(source, h) - own, h, r) for h, r in options]
        return sorted(out, key=lambda x: (-x[0], x[1]))


def _collect_stretches(documents: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text.isascii():
                    found.update((source, text[lo:hi]) for lo, hi, *_ in stretches(text))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["source", "stretch", "n"])

    rows = documents.mapInArrow(run, "source string, stretch string, n bigint")
    return rows.groupBy("source", "stretch").agg(F.sum("n").alias("n"))


def _with_readings(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [readings(s) if LOST not in s else [] for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[h for h, _ in g] for g in got], pa.list_(pa.string())), pa.array([[r for _, r in g] for g in got], pa.list_(pa.string()))], ["source", "stretch", "n", "swaps", "texts"])

    return rows.select("source", "stretch", "n").mapInArrow(run, "source string, stretch string, n bigint, swaps array<string>, texts array<string>")


def _step(rows: DataFrame, model: SwapModel | None) -> SwapModel:
    """One round of expectation and maximisation over all distinct stretches."""

    def run(batches):
        pair: Counter = Counter()
        prior: Counter = Counter()
        for b in batches:
            for source, s, n, hs, rs in zip(*[c.to_pylist() for c in b.columns]):
                if LOST in s:
                    continue
                # Equal stretches count less than in proportion, or a repeated header would rule the model.
                n = 1.0 + math.log(n)
                shares = [(1.0, SOUND, s)]
                if model is not None and hs:
                    gains = [(0.0, SOUND, s), *model.gains(source, s, list(zip(hs, rs)))]
                    top = max(g for g, *_ in gains)
                    weights = [(math.exp(max(g - top, -60)), h, r) for g, h, r in gains]
                    total = sum(w for w, *_ in weights)
                    shares = [(w / total, h, r) for w, h, r in weights if w / total > 1e-3]
                for w, h, r in shares:
                    prior[source, h] += w * n
                    for p in pairs_of(r):
                        pair[p] += w * n
        keys = [("", p) for p in pair] + [k for k in prior]
        kinds = [0] * len(pair) + [1] * len(prior)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([*pair.values(), *prior.values()], pa.float64())], ["kind", "source", "key", "n"])

    counts = rows.mapInArrow(run, "kind int, source string, key string, n double").groupBy("kind", "source", "key").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # one row for each pair of signs that occurs, and for each source and swap
    pair, prior = {}, {}
    for kind, source, key, n in zip(*[table.column(c).to_pylist() for c in ("kind", "source", "key", "n")]):
        if kind == 0:
            pair[key] = n
        else:
            prior[source, key] = n
    return SwapModel(pair, prior)


def learn_swaps(documents: DataFrame, rounds: int = 3) -> SwapModel:
    """Fit the language model and the per-source weights of swaps by expectation-maximisation.

    ``documents(source, text)``. All stretches of all texts take part; equal
    ones of a source are one row. The first round takes every stretch as sound,
    which most are; each further round weighs the readings of a stretch by the
    model so far and counts signs in proportion, so that what garbled text left
    in the model fades.
    """
    known = documents.where("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), "text")
    rows = staged(_with_readings(_collect_stretches(known)), "p9-stretches")
    model = None
    for _ in range(rounds):
        model = _step(rows, model)
    model.ciphers = learn_ciphers(rows, model)
    return model


def _own_score(s: str, model: SwapModel) -> float:
    return model.bigrams.score_without(s) + CONTROL * sum("\x80" <= c < "\xa0" for c in s)


def learn_ciphers(rows: DataFrame, model: SwapModel, rounds: int = 2) -> dict[str, list[Cipher]]:
    """Per source the substitutions of signs that its unlikely stretches went through, by expectation-maximisation.

    Any one-byte encoding may have been read as any other: such a swap is a
    substitution cipher. Stretches that the language model finds unlikely, and
    which aren't UTF-8 read wrongly, are weighed under all pairs of pages,
    against the best of what they are and what known swaps make of them; pairs that a source's stretches bear out
    together are where its ciphers start. Then each round takes the expected
    neighbours of every sign, by the ciphers' shares in each stretch, and moves
    a sign to the letter that fits them best, so a source's own encoding need
    not be one that is known. Rows of all sources take part; what comes to the
    driver are sums per source and pair of pages, and per sign and neighbours
    of the ciphers found.
    """
    low = rows.where("stretch not like '%\ufffd%'")

    def unlikely(batches):
        for b in batches:
            for source, s, n, swaps, texts in zip(*[c.to_pylist() for c in b.columns]):
                own = _own_score(s, model)
                if own < POOR * (len(s) + 1):
                    scores = [(model.bigrams.score(r), h) for h, r in zip(swaps, texts)]
                    if not any(v > own and h.startswith("utf_8") for v, h in scores):
                        yield source, s, n, max([own, *[v for v, _ in scores]])

    def weigh(batches):
        scores, found = None, Counter()
        for source, s, _, own in unlikely(batches):
            scores = scores or PageScores(model.bigrams)
            for (written, read), gain in odds_of(s, own, scores).items():
                found[source, written, read] += gain
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)], pa.array(list(found.values()), pa.float64())], ["source", "written", "read", "gain"])

    evidence = low.mapInArrow(weigh, "source string, written int, read int, gain double").groupBy("source", "written", "read").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= ENOUGH)
    ciphers = best_starts({(r.source, r.written, r.read): r.gain for r in evidence.toLocalIterator()})
    for _ in range(rounds if ciphers else 0):

        def expect(batches, ciphers=ciphers):
            counts: Counter = Counter()
            for source, s, n, own in unlikely(batches):
                if source in ciphers:
                    expected_contexts(s, 1.0 + math.log(n), own, ciphers[source], model.bigrams, counts, source)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))] + [pa.array(list(counts.values()), pa.float64())], ["source", "cipher", "sign", "before", "after", "n"])

        by = ["source", "cipher", "sign", "before", "after"]
        sums = low.mapInArrow(expect, "source string, cipher int, sign string, before string, after string, n double").groupBy(*by).agg(F.sum("n").alias("n"))
        counts: dict[str, dict] = defaultdict(dict)
        for r in sums.toLocalIterator():
            counts[r.source][r.cipher, r.sign, r.before, r.after] = r.n
        scores = PageScores(model.bigrams)
        ciphers = {source: moved(c, counts[source], scores) for source, c in ciphers.items()}
    return ciphers


def _quoted(text: str, lo: int, hi: int) -> bool:
    """Whether a part of a line stands between quotes."""
    before = text[text.rfind("\n", 0, lo) + 1 : lo]
    end = text.find("\n", hi)
    after = text[hi : end if end >= 0 else len(text)]
    return any(before.count(q) % 2 and q in after for q in "\"'`") or (before[-1:] in OPENING and before != "" and after[:1] in CLOSING and after != "")


def _lost_in(text: str) -> bool:
    """Whether U+FFFD stands where a word or a sign between two words was lost.

    Beside a letter or digit, or alone between two words; also several in a
    row, or parted by single blanks, outside quotes and brackets, as of text
    that lost every letter. Else, alone at a line's end too, it is meant.
    """
    n = len(text)
    at = text.find(LOST)
    while at >= 0:
        end = at
        while end < n and text[end] == LOST:
            end += 1
        before, after = text[at - 1 : at], text[end : end + 1]
        if (before and before.isalnum()) or (after and after.isalnum()):
            return True
        if before == " " and after == " " and text[at - 2 : at - 1].isalnum() and text[end + 1 : end + 2].isalnum():
            return True
        if (end - at > 1 or text[end : end + 2] == " " + LOST) and not _quoted(text, at, end):
            return True
        at = text.find(LOST, end)
    return False


@functools.lru_cache(1 << 17)
def _changes(s: str, swap: str) -> bool:
    """Whether undoing a swap would change a stretch; of the signs that two code pages share it wouldn't."""
    written, read_as = swap.split("<")
    return written not in WRITTEN_NARROW or read_as not in READ_AS or s.translate(swap_table(read_as, written)) != s


def _weighed(s: str, source: str, model: SwapModel) -> tuple[list[tuple[float, str, str]], dict[str, tuple[float, str]], frozenset[str]]:
    """The best readings of a stretch, by swap the log odds of its reading, without the swap's share, and the reading, and the swaps but of UTF-8 that it speaks for."""
    names = swaps_by_reading(s) if LOST not in s else {}
    gains = model.gains(source, s, [(hs[0], r) for r, hs in names.items()])
    known = {h: (g - model.weight(source, k), r) for g, k, r in gains for h in names[r]}
    best = [g for g in gains if g[0] > -20][:6]
    texts = {r for _, _, r in best}
    return best, known, frozenset(h for h, (g, r) in known.items() if not h.startswith("utf_8") and (g >= CLEAR or r in texts))


def restore(text: str, source: str, model: SwapModel, cache: dict, least_utf8: float = 1.0, least_swap: float = 12.0) -> tuple[str, str] | None:
    """The swap by which a text was garbled, and the text with the garbled stretches restored; None if it is sound.

    A stretch is garbled if one of its readings beats taking it as sound, and
    not quoted: a line that holds the proper reading too shows both on purpose.
    A swap of UTF-8 needs less evidence in all, since few sound stretches make
    valid UTF-8 in another code page's bytes; any other swap needs more, which
    the text's stretches give together.
    """
    hits = []
    shown: set[str] = set()
    seen: set[str] = set()
    swaps: set[str] = set()
    evidence: dict[str, float] = defaultdict(float)
    for lo, hi, a, b in stretches(text):
        s = text[lo:hi]
        key = (source, s)
        if key not in cache:
            cache[key] = _weighed(s, source, model)
        gains, known, speaks = cache[key]
        if not gains:
            if s not in seen:
                seen.add(s)
                for h in swaps:
                    evidence[h] -= AGAINST * _changes(s, h)
            continue
        left, right = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
        around = text[left:lo] + "\0" + text[hi : right if right >= 0 else len(text)]
        best = gains[0][2]
        core = best[a - lo : len(best) - (hi - b)] if hi - b else best[a - lo :]
        if core and core in around:
            shown.add(s)
            continue
        hits.append((lo, hi, gains, known))
        if gains[0][0] > 0 and gains[0][1].startswith("utf_8"):
            evidence[gains[0][1]] += gains[0][0]
        if s not in seen:  # a repeated stretch is no further evidence
            seen.add(s)
            for h in speaks | swaps:
                odds = known[h][0] if h in known else -AGAINST * _changes(s, h)
                swaps.add(h)
                evidence[h] += odds if odds >= CLEAR else max(min(odds, 0.0), -AGAINST)
    cause = max(evidence, key=lambda h: (evidence[h], model.weight(source, h), h), default=None)
    if cause is not None and evidence[cause] < (least_utf8 if cause.startswith("utf_8") else least_swap):
        cause = None
    if model.ciphers.get(source):
        got = _deciphered(text, source, model, cache, shown, max(ENOUGH, evidence.get(cause, 0.0)))
        if got is not None:
            return got
    if cause is None:
        return ("lost", text) if LOST in text and _lost_in(text) else None
    out, end = [], 0
    for lo, hi, gains, known in hits:
        # Once a text is known to have gone through a swap, its share is no reason against it any more.
        if cause in known and known[cause][0] > 0:
            reading = known[cause][1]
        elif gains[0][0] > 0:
            reading = gains[0][2]
        else:
            continue
        out += [text[end:lo], reading]
        end = hi
    return cause, "".join([*out, text[end:]])


def _deciphered(text: str, source: str, model: SwapModel, cache: dict, without: set[str], enough: float) -> tuple[str, str] | None:
    """The source's cipher that a text's stretches bear out best, but for some, and the text read back by it; None below so much evidence."""
    ciphers = model.ciphers[source]
    known: dict[str, list[tuple[float, str] | None]] = {}
    places = []
    for lo, hi, _, _ in stretches(text):
        s = text[lo:hi]
        if s in without or LOST in s:
            continue
        if (key := ("cipher", source, s)) not in cache:
            own = _own_score(s, model)
            odds: list = []
            if own < POOR * (len(s) + 1):
                for c in ciphers:
                    r = c.read_back(s)
                    odds.append((model.bigrams.score(r) - own, r) if r != s and BAD not in r and _proper(r) else None)
            cache[key] = odds
        known[s] = cache[key]
        places.append((lo, hi, s))
    if not any(known.values()):
        return None
    best, cause = 0.0, -1
    for k in range(len(ciphers)):
        gains = [o[k][0] if o and o[k] is not None and not _shown(text, places, s, o[k][1]) else None for s, o in known.items()]
        total = sum(g if g is not None and g >= CLEAR else -AGAINST for g in gains)
        if total > best:
            best, cause = total, k
    if best < enough:
        return None
    out, end = [], 0
    for lo, hi, s in places:
        if known[s] and known[s][cause] is not None and known[s][cause][0] > 0:
            out += [text[end:lo], known[s][cause][1]]
            end = hi
    return ciphers[cause].name, "".join([*out, text[end:]])


def _shown(text: str, places: list[tuple[int, int, str]], s: str, reading: str) -> bool:
    """Whether a line that holds a stretch holds its proper reading too."""
    core = CORE.search(reading)
    for lo, hi, t in places:
        if t == s and core is not None:
            left, right = text.rfind("\n", 0, lo) + 1, text.find("\n", hi)
            if core.group() in text[left:lo] + "\0" + text[hi : right if right >= 0 else len(text)]:
                return True
    return False


def garbled_documents(documents: DataFrame, rounds: int = 3) -> DataFrame:
    """``doc_id, swap, restored, complete`` of each document with wrongly decoded text.

    ``swap`` names the encodings, ``written<read_as``, or is ``lost`` where
    signs were replaced by U+FFFD and nothing tells what they were; then, and
    where some of it is left in a restored text, ``complete`` is false.
    Null, empty and plain ASCII texts are sound, and so is a text that quotes
    wrong readings beside the proper ones or names U+FFFD itself. Repeated rows
    come out repeatedly. A null source counts as a source of its own.
    """
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    # Only texts outside ASCII can be garbled; the test runs in the JVM.
    docs = docs.where("text is not null and octet_length(text) > char_length(text)")
    model = learn_swaps(docs.select("source", "text"), rounds)

    def run(batches):
        cache: dict = {}
        for b in batches:
            ids, swaps, texts = [], [], []
            for doc, source, text in zip(*[c.to_pylist() for c in b.columns]):
                if len(cache) > 10_000:
                    cache.clear()
                if (got := restore(text, source or "", model, cache)) is not None:
                    ids.append(doc)
                    swaps.append(got[0])
                    texts.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(swaps, pa.string()), pa.array(texts, pa.string()), pa.array([LOST not in t for t in texts], pa.bool_())], ["doc_id", "swap", "restored", "complete"])

    return docs.mapInArrow(run, "doc_id bigint, swap string, restored string, complete boolean")
