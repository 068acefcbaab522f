"""Secret scan: three fixed patterns, and sliding-window Shannon entropy per character class.

Every candidate string (a long run of key characters; of a path each part between slashes) is put in a character class; a
window slides over it while the counts of its characters, and with them the entropy, are kept up to date incrementally.
Windows at or over the class's threshold are joined to spans if they don't read like names: a name's letters follow each
other as in words, and its digits stand together; in a key most neighbours are odd (see odd_pairs). Windows that touch a
stretch that the allow-list explains (a UUID, a placeholder word with the letters around it) don't count; others of the
candidate do.

Defined results: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an empty
table; columns other than the key and the text are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import map_batches, text_input

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns of the base scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Bits per character that a window of each class must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.4, "base64": 3.5, "letters": 3.3}

# Pairs of letters as words have them, besides those of a consonant and a vowel.
CONSONANTS = frozenset(
    "bb bl br bs cc ch ck cl cr cs ct dd dg dr ds ff fl fr ft gg gh gl gr gs ht kn ks ld lf lk ll lm lp ls lt lv mb mm mp ms "
    "nc nd nf ng nk nn ns nt nv ph pl pp pr ps pt rb rc rd rf rg rk rl rm rn rp rr rs rt rv sc sh sk sl sm sn sp ss st sw tch "
    "th tr ts tt tw wh wn wr ws xp xt".split()
)
VOWELS = frozenset("ai au ay ea ee ei eu ey ia ie io iu oa oe oi oo ou oy ua ue ui uo".split())
RARE = frozenset("ax ex ix ja je jo ju ox qu xi za ze zi zo az iz oz".split())
"""Pairs with j, q, x or z."""
ODD_SHARE = 0.43
"""Share of odd pairs, of those that can be odd, from which a window reads like a key."""
KEY_PART = 12
"""A string with slashes may be a key as a whole if its parts are this long on average."""

# Fixed patterns: stretches of a candidate that look random and are not secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:example|placeholder|changeme|dummy|abcdefgh|01234567)",
)


@dataclass(frozen=True)
class ScanSettings:
    window: int = 20
    min_assigned: int = 12
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    allowed: tuple[str, ...] = ALLOWED
    odd_share: float = ODD_SHARE


def char_class(s: str) -> str | None:
    """hex, alnum, base64 or letters; None if the string has no letter."""
    letters = sum(c.isalpha() for c in s)
    if not letters:
        return None
    if letters == len(s):
        return "letters"
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def word_pair(pair: str) -> bool:
    """Whether two letters follow each other in words."""
    a, b = pair
    if "j" in pair or "q" in pair or "x" in pair or "z" in pair:
        return pair in RARE or pair in CONSONANTS
    vowels = (a in "aeiou") + (b in "aeiou")
    return vowels == 1 or pair in (VOWELS if vowels else CONSONANTS)


_WORDLIKE = {a + b: word_pair(a + b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}


def odd_pairs(s: str) -> tuple[list[int], list[int]]:
    """Running counts of neighbours that can be odd, and of those that are: letters that don't follow each other in words, a
    letter beside a digit, and a capital that ends a word of three letters or fewer. A capital after a longer word, as in names
    of several words, digits among themselves and signs are neither."""
    can, odd, word = [0], [0], 1
    for a, b in zip(s, s[1:], strict=False):
        if a.isalpha() and b.isalpha():
            capital = a.islower() and b.isupper()
            strange = word < 4 if capital else not _WORDLIKE[(a + b).lower()]
            said = strange or not capital
            word = 1 if capital else word + 1
        else:
            said = strange = (a.isalpha() and b.isdigit()) or (a.isdigit() and b.isalpha())
            word = 1
        can.append(can[-1] + said)
        odd.append(odd[-1] + strange)
    return can, odd


def path_parts(s: str, share: float = ODD_SHARE) -> list[tuple[int, int]]:
    """The parts of a candidate that are judged by themselves: those between slashes, unless it reads like a key as a whole and has
    few of them."""
    cuts = [i for i, c in enumerate(s) if c == "/"]
    if cuts:
        can, odd = odd_pairs(s)
        if odd[-1] < share * can[-1] or len(s) < KEY_PART * (len(cuts) + 1):
            edges = [-1, *cuts, len(s)]
            return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b > a + 1]
    return [(0, len(s))]


def dense_windows(s: str, window: int, threshold: float, fits=lambda start, end: True) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy is at least the threshold and that fit.

    With counts c of a window of W characters, the entropy is log2 W - (sum of c log2 c) / W; moving the window by one
    character changes two counts only.
    """
    w = min(window, len(s))
    cost = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    most = (math.log2(w) - threshold) * w + 1e-9
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(s):
        n = counts.get(ch, 0)
        total += cost[min(n + 1, w)] - cost[n] if n < w else 0.0
        counts[ch] = n + 1
        if i >= w:
            old = s[i - w]
            n = counts[old]
            total += cost[n - 1] - cost[min(n, w)]
            counts[old] = n - 1
        start = i - w + 1
        if start >= 0 and total <= most and fits(start, i + 1):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _running(steps) -> list[int]:
    return [0, *accumulate(steps)]


class Scanner:
    def __init__(self, settings: ScanSettings = ScanSettings()):
        self.settings = settings
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        self.candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % settings.window)
        self.allowed = [re.compile(p) for p in settings.allowed]

    def mixed(self, s: str):
        """Whether a window of s reads like a key and touches nothing that the allow-list explains; in constant time by
        running counts."""
        blocked = [0] * (len(s) + 1)
        for p in self.allowed:
            done = 0
            for m in p.finditer(s):
                if m.start() >= done:  # else it lies in the stretch around the one before
                    start, end = m.span()
                    while start > done and s[start - 1].isalnum():
                        start -= 1
                    while end < len(s) and s[end].isalnum():
                        end += 1
                    blocked[start] += 1
                    blocked[end] -= 1
                    done = end
        allowed = _running(map(bool, accumulate(blocked)))
        can, odd = odd_pairs(s)
        share = self.settings.odd_share

        def fits(start: int, end: int) -> bool:
            if allowed[end] > allowed[start]:
                return False
            return odd[end - 1] - odd[start] >= max(share * (can[end - 1] - can[start]), (end - start) * share / 2)

        return fits

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind in KINDS, end), in order."""
        least = self.settings.min_assigned
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= least]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def entropic(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the base scan hasn't covered already."""
        out, at, reach = [], 0, 0
        for m in self.candidate.finditer(text):
            for a, b in self._windows(m.group()):
                a, b = a + m.start(), b + m.start()
                while at < len(known) and known[at][0] <= a:  # both are in order, so the base spans are passed once
                    reach = max(reach, known[at][2])
                    at += 1
                if reach < b:
                    out.append((a, 3, b))
        return out

    def _windows(self, candidate: str) -> list[tuple[int, int]]:
        out = []
        for begin, end in path_parts(candidate, self.settings.odd_share):
            s = candidate[begin:end]
            kind = char_class(s) if len(s) >= self.settings.window else None
            if kind is not None:
                found = dense_windows(s, self.settings.window, self.settings.thresholds[kind], self.mixed(s))
                out += [(a + begin, b + begin) for a, b in found]
        return out

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        base = self.base(text)
        return sorted(base + self.entropic(text, base))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: ScanSettings = ScanSettings()) -> DataFrame:
    """key, spans array<struct<kind, start, end>>: code points, end exclusive, by start and then kind as in KINDS."""

    def run(batches):
        scanner = Scanner(settings)
        for b in batches:
            spans = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.scan(t or "")]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(spans, pa.list_(_SPAN))], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    found = map_batches(
        text_input(docs, key, text), run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return found.withColumnRenamed("key", key)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", settings: ScanSettings = ScanSettings()) -> DataFrame:
    """docs with every span of a text replaced by the mark; null texts stay null, other columns are unchanged."""

    def run(batches):
        scanner = Scanner(settings)
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                if t:
                    parts, at = [], 0
                    for s, _, e in scanner.scan(t):
                        if s >= at:
                            parts += [t[at:s], mark]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]]) if at else t
                out.append(t)
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array(out, b.schema.field(i).type))

    return map_batches(docs, run, docs.schema)
