"""BPE encoding and decoding as streaming transducers.

Encoding. A pre-token's symbols come in one by one. Merges can change tokens near the end of what has been read as long
as more may follow, but only up to a distance that the merge list fixes: its sufficient lookahead. Tokens that end
earlier than that are stable and are emitted; the rest stays in the buffer. Memory is the lookahead plus one token,
however long the pre-token is.

The lookahead. Compare the merges of a text with those of a continuation of it. Before any merge the two agree on all
symbols of the text. A merge r = (a, b) can differ between them only where b touches the first place of disagreement,
and then that place moves left by len(a), to the start of a. From there on, the token at that place is a or something
that begins with a. So merge r2 = (a2, b2) of a later rank can follow r only if a is b2 or lies on the left edge of b2's
merge tree, and the disagreement moves at most

    reach(r2) = len(a2) + max(0, reach(r) for r earlier than r2 with r's left part on the left edge of b2)

to the left in all. The lookahead is the largest reach of any merge. (Equal ranks merge from the left, so a run of one
symbol is not disturbed by what follows it, except for its last symbol.)

A pre-token's end makes all of its tokens stable, which is how the pre-tokens of ordinary text are closed; longer runs
are emitted while they go on. A text passes through the cutter in slices, so neither its pre-tokens nor its ids are held.

Decoding. Token bytes pass through an incremental UTF-8 machine that emits a character as soon as it is complete.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import regex

from cairnflow.llm.common import kept_for_stage

CACHE = 100_000
"""Pre-tokens that a worker keeps with their tokens, twice (a young and an old generation)."""
CACHED_LENGTH = 48
"""Bytes of the longest pre-token that is kept, so that the cache's memory is bounded."""
SHORT = 64
"""Symbols up to which a list is merged faster than a heap."""
SLICE = 1 << 16
"""Characters of a text that are cut at once."""
CHUNK = 4096
_NONE = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class Merges:
    """Vocabulary and merge list of a tokenizer file, as integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for r, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault(a << 20 | b, r)
            self.parts.append((a, b))
            self.made.append(self.vocab[self.tokens[a] + self.tokens[b]])
        letters = byte_alphabet()
        self.inner = [self.vocab.get(c, -1) for c in letters]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in letters]
        self.units = {i: self._units(t) for i, t in self.tokens.items()}
        self.lookahead = self._lookahead()
        self.longest = max(self.units.values())

    def _units(self, token: str) -> int:
        """Bytes of a token."""
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) else len(token)

    def _lookahead(self) -> int:
        left: dict[int, int] = {}  # the left part of each token made by a merge
        for (a, _), t in zip(self.parts, self.made, strict=True):
            left.setdefault(t, a)
        best: dict[int, int] = {}  # by left part: the largest reach so far
        most = 1
        for a, b in self.parts:
            reach, edge = 0, b
            while True:
                reach = max(reach, best.get(edge, 0))
                if edge not in left:
                    break
                edge = left[edge]
            reach += self.units[a]
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a short list of symbols: the lowest rank first, from the left."""
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) != _NONE:
            i = ranks.index(r)
            t = ids[i] = made[r]
            del ids[i + 1], ranks[i]
            # Only the pairs on either side of the new token are new.
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | t, _NONE)
            if i < len(ranks):
                ranks[i] = rank(t << 20 | ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for windows of many symbols."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank.get, self.made
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a << 20 | b, _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(ids[i] << 20 | ids[k], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (q := rank(ids[h] << 20 | ids[i], _NONE)) != _NONE:
                heapq.heappush(heap, (q, h, ids[h], ids[i]))
        return [x for x in ids if x != -1]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in pieces; each is emitted as soon as it is stable."""
        run = Transducer(self)
        for piece in data:
            yield from run.feed(piece)
        yield from run.close()


class Transducer:
    """One pre-token. It holds the bytes whose tokens may still change, at most `most` of them."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held: list[int] = []
        self.last = -1  # the newest byte; it may be the final one, which is another symbol
        self.most = 2 * (merges.lookahead + merges.longest)

    def feed(self, data: bytes) -> Iterator[int]:
        m, at = self.merges, 0
        inner = m.inner
        while at < len(data):
            new = data[at : at + self.most - len(self.held)]
            at += len(new)
            if self.last >= 0:
                self.held.append(inner[self.last])
            self.held += [inner[x] for x in new[:-1]]
            self.last = new[-1]
            if len(self.held) >= self.most - 1:
                used = 0
                for t in m.merge_long(list(self.held)):
                    if used + m.units[t] > len(self.held) - m.lookahead:
                        break
                    used += m.units[t]
                    yield t
                del self.held[:used]

    def close(self) -> list[int]:
        """The end of the pre-token makes everything stable."""
        if self.last < 0:
            return []
        m, ids = self.merges, [*self.held, self.merges.final[self.last]]
        self.held, self.last = [], -1
        return m.merge(ids) if len(ids) <= SHORT else m.merge_long(ids)


# Fixed values of the tokenizer's file: how it cuts lower-cased text, with white space as its library defines it.
_SPACE = r"\t\n\x0b\f\r\x20\x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+"


# Characters whose letter class and lower case are the same in every Unicode version since 2012.
_SETTLED = regex.compile(r"[\x00-\u0557\u2000-\u206f\u20a0-\u20b9]*")


class Pieces(dict):
    """What the transducer gives for whole pre-tokens; short ones are kept. When it is full, the entries of the last
    round stay a round longer."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            data = piece.encode("utf-8", "replace")
            found = tuple(self.merges.stream([data]))
            if len(data) > CACHED_LENGTH:
                return found
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


@dataclass
class _Open:
    """A pre-token that the text so far ends in: a character of its class, "" if there is none, and its transducer."""

    sign: str = ""
    run: Transducer | None = None

    def close(self) -> list[int]:
        out = self.run.close() if self.run else []
        self.sign, self.run = "", None
        return out


_INSIDE = regex.compile(r"[a-zA-Z]{4}(?=[a-zA-Z])|(?P<digit>[0-9](?=[0-9]))|(?P<sign>[-=_.*#!/+~]{2}(?=[-=_.*#!/+~]))")
"""Places inside a run, away from the contractions that start with an apostrophe."""


class Encoder:
    def __init__(self, path: str):
        self.path = path
        self.merges = Merges(path)
        self.pieces = regex.compile(PIECES)
        special = "|".join(regex.escape(t) for t in self.merges.special)
        self.special = regex.compile(f"({special})") if special else None
        self.known = Pieces(self.merges)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character lower-cased by itself: a final sigma isn't told apart."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    @cached_property
    def library(self):
        """The tokenizers library's own normalizer and cutter, for texts with characters of newer Unicode versions."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        cut = pre_tokenizers.Split(Regex(spec["pattern"]["Regex"]), spec["behavior"].lower(), invert=spec["invert"])
        return Tokenizer.from_file(self.path).normalizer, cut

    def cut(self, text: str) -> list[str]:
        if text.isascii() or _SETTLED.fullmatch(text):
            return self.pieces.findall(self.normal(text))
        normalizer, cut = self.library
        return [p for p, _ in cut.pre_tokenize_str(normalizer.normalize_str(text))]

    def stream(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of one text that arrives in pieces of any size, in lists as they become known.

        Pre-tokens hold no white space, so a text is cut in front of its last blank and the rest waits for what follows.
        A stretch of SLICE characters without a blank is cut inside a run of letters, digits or signs, where neither
        normalization nor the cutter looks across; the run's pre-token stays open in a transducer. (A stretch without
        such a run waits for its end; its memory is its own length.)"""
        rest, state = "", _Open()
        for text in texts:
            for at in range(0, len(text), SLICE):
                rest = rest + text[at : at + SLICE] if rest else text[at : at + SLICE]
                cut = max(rest.rfind(" "), rest.rfind("\n"))
                if cut > 0:
                    yield self._ids(rest[:cut], state)
                    rest = rest[cut:]
                elif len(rest) >= SLICE and "<|" not in rest:
                    inside = None
                    for inside in _INSIDE.finditer(rest, len(rest) - SLICE // 2):
                        pass
                    if inside:
                        yield self._ids(rest[: inside.end()], state, "!" if inside["sign"] else "" if inside["digit"] else "a")
                        rest = rest[inside.end() :]
        yield self._ids(rest, state)

    def _ids(self, text: str, state: _Open, goes_on: str = "") -> list[int]:
        """goes_on: a character of the run that the text ends in and that goes on behind it."""
        out: list[int] = []
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if part in self.merges.special:
                out += state.close()
                out.append(self.merges.special[part])
                continue
            pieces = self.cut(state.sign + part)
            if state.sign and pieces:
                out += state.run.feed(pieces[0][1:].encode("utf-8", "replace"))
                if len(pieces) == 1 and goes_on == state.sign:
                    return out
                out += state.close()
                pieces = pieces[1:]
            if goes_on:
                out += chain.from_iterable(map(self.known.__getitem__, pieces[:-1]))
                state.sign, state.run = goes_on, Transducer(self.merges)
                out += state.run.feed(pieces[-1].encode("utf-8", "replace"))
            else:
                out += chain.from_iterable(map(self.known.__getitem__, pieces))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream((text,))))


class Decoder:
    """Tokens to text. surface: the tokens' own spelling, parted by blanks, which is what a file without a decoder
    asks for; else the bytes that they stand for, with a blank for each end of word."""

    def __init__(self, merges: Merges, surface: bool = True):
        if surface:
            self.bytes = {i: t.encode() + b" " for i, t in merges.tokens.items()}
        else:
            of = {c: b for b, c in enumerate(byte_alphabet())}
            end = merges.suffix
            self.bytes = {}
            for i, t in merges.tokens.items():
                body = t[: -len(end)] if end and t.endswith(end) else t
                raw = t.encode() if t in merges.special else bytes(of[c] for c in body)
                self.bytes[i] = raw + b" " * (len(body) < len(t))
        self.bytes |= {str(i): b for i, b in self.bytes.items()}

    def stream(self, ids: Iterable[int] | Iterable[str]) -> Iterator[str]:
        """Text as it becomes complete, of ids or their decimals; bytes that can't be text become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of, rest = self.bytes.__getitem__, iter(ids)
        while block := list(islice(rest, CHUNK)):
            yield machine.decode(b"".join(map(of, block)))
        yield machine.decode(b"", final=True)

    def decode(self, ids: Iterable[int] | Iterable[str]) -> str:
        text = "".join(self.stream(ids))
        return text[:-1] if text.endswith(" ") else text


@kept_for_stage
def encoder(path: str) -> Encoder:
    """A worker reads a tokenizer file once for a stage."""
    return Encoder(path)


@kept_for_stage
def decoder(path: str, surface: bool = True) -> Decoder:
    return Decoder(encoder(path).merges, surface)
