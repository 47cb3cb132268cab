"""Encoding and exact prefix counts for a BPE vocabulary with word ends (a ``tokenizers`` JSON file).

The file lower-cases, splits at white space and into runs of letters, single digits and runs of
signs, and never joins two such pieces.  So a text's ids are those of its pieces in order, and
pieces are cached.  Texts in which normalising moves letters (code points from U+0300, dotted
capital I, special tokens) are normalised and split once by the library; their pieces are counted
like those of other texts.  Only a prefix that ends before a combining sign is split again, from
its last pieces on; that takes the square of the number of signs on one letter.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_LONG = 64                     # letters of a piece from which it is counted step by step
_LOADED: dict[str, "WordBpe"] = {}


def load(path: str) -> "WordBpe":
    """One instance per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


class Memo(dict):
    """A dict that computes missing values and starts anew when full, so its memory is bounded."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 200:
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte, as byte-level vocabularies write them: printable
    Latin-1 letters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def byte_mapped(text: str) -> str:
    """UTF-8 bytes of ``text`` written with their stand-ins; plain ASCII signs stand for themselves."""
    if text.isascii() and text.isprintable() and " " not in text:
        return text
    return text.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)


def near_pattern(pattern: str) -> re.Pattern:
    """The same split for texts whose code points are all below U+0300, with the faster engine."""
    spaces = r"\t-\r \x85\xa0"
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{_class('L')}{_class('N')}]")
    for name, letters in ((r"\p{L}", _class("L")), (r"\p{N}", _class("N"))):
        inside = inside.replace(f"[{name}]", f"[{letters}]").replace(name, f"[{letters}]")
    return re.compile(inside.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]"))


@cache
def _seconds() -> set[str]:
    """Signs that normalising may join to the one before: of class 0, second in a composed letter."""
    pairs = (unicodedata.normalize("NFD", chr(c)) for c in range(0x110000) if unicodedata.decomposition(chr(c)))
    return {c for pair in pairs for c in pair[1:]} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


class Starts(dict):
    """Per code point, whether what comes before it normalises without it."""

    def __missing__(self, sign: str) -> bool:
        first = unicodedata.normalize("NFD", sign)[0]
        known = self[sign] = not unicodedata.combining(first) and first not in _seconds()
        return known


def _merges(model: dict) -> list[tuple[str, ...]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


class WordBpe:
    """Ids and prefix counts of one vocabulary file, with bounded caches of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.library = Tokenizer.from_file(path)
        self._path, model, self.end = path, described["model"], described["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        #: merges up to a word's end
        self.whole = BPE(vocab=self.vocab, merges=_merges(model), end_of_word_suffix=self.end)
        splits = [p["pattern"]["Regex"] for p in described["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.near = near_pattern(splits[0])
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.starts = Starts()
        self.forms = Memo(self.library.normalizer.normalize_str, 100_000)
        self.far = re.compile("[İ̀-\U0010ffff]").search
        self.word_ids = Memo(self._encode_word, 300_000)
        self.word_counts = Memo(self._count_word, 250_000)
        self._states: dict = {}
        self._fit_open: dict[int, bool] = {}
        self._fit_closed: dict[int, bool] = {}

    # tables for counting alone, built when a count is asked for

    @cached_property
    def inner(self) -> BPE:
        """Merges inside a word."""
        with open(self._path, encoding="utf-8") as f:
            return BPE(vocab=self.vocab, merges=_merges(json.load(f)["model"]))

    @cached_property
    def named(self) -> list[str]:
        """Tokens by number from 1."""
        return ["", *self.vocab]

    @cached_property
    def endings(self) -> ahocorasick.Automaton:
        """Every token with its length and its numbers inside a word and at its end."""
        tokens = {t: i for i, t in enumerate(self.named) if i}
        closed = {t.removesuffix(self.end): i for t, i in tokens.items() if t.endswith(self.end)}
        found = ahocorasick.Automaton()
        for t in tokens.keys() | closed.keys():
            found.add_word(t, (len(t), tokens.get(t, 0), closed.get(t, 0)))
        found.make_automaton()
        return found

    @cached_property
    def longest(self) -> int:
        return max(len(t.removesuffix(self.end)) for t in self.vocab)

    def _plain(self, text: str) -> bool:
        """Whether lower-casing is all that normalising does, letter by letter."""
        return not (("<|" in text and any(s in text for s in self.specials)) or not text.isascii() and self.far(text))

    # ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self._plain(text):
            return b"".join(map(self.word_ids.__getitem__, self.near.findall(text.lower())))
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def _encode_word(self, word: str) -> bytes:
        return packed([t.id for t in self.whole.tokenize(byte_mapped(word))])

    # exact counts of every prefix

    def count(self, text: str) -> int:
        """The token count of a text: what the table below holds for its longest prefix."""
        if self._plain(text):
            return sum([c[-1] for c in map(self.word_counts.__getitem__, self.near.findall(text.lower()))])
        parts, counts = self.special.split(text), self.word_counts
        return len(parts) - 1 + sum(counts[w][-1] for part in parts for w in self._split(self.forms[part]))

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token count of ``text[:p]`` for every p from 0 to ``len(text)``."""
        out, total = np.zeros(len(text) + 1, dtype=np.int64), 0
        for start, counts, whole in self._tables(text):
            out[start + 1:start + 1 + len(counts)] = [total + c for c in counts]
            total += whole
        # white space adds no token: it repeats the count before it
        known = np.maximum.accumulate(np.where(out > 0, np.arange(len(out)), 0))
        return out[known]

    def fitting(self, text: str, limit: int) -> int:
        """The length of the longest prefix of at most ``limit`` tokens, from the stored counts."""
        total = 0
        for start, counts, whole in self._tables(text, limit):
            if total + whole > limit:
                return start + max((p for p, n in enumerate(counts, 1) if total + n <= limit), default=0)
            total += whole
        return len(text)

    def _tables(self, text: str, limit: float = float("inf")) -> Iterator[tuple[int, Sequence[int], int]]:
        """Start, prefix counts and count of each piece, or of each chunk in which normalising moves
        letters.  Counts may be left out from where on all are above the limit."""
        if self._plain(text):
            for found in self.near.finditer(text.lower()):
                counts = self.word_counts[found[0]]
                yield found.start(), counts, counts[-1]
            return
        for chunk in regex.finditer(r"\P{White_Space}+", text):
            if self._plain(chunk[0]):
                for found in self.near.finditer(chunk[0].lower()):
                    counts = self.word_counts[found[0]]
                    yield chunk.start() + found.start(), counts, counts[-1]
            else:
                yield chunk.start(), *self._chunk(chunk[0], limit)

    def _chunk(self, chunk: str, limit: float) -> tuple[list[int], int]:
        """Prefix counts and count of a chunk; a special token that is cut short is plain text."""
        counts, total, at = [], 0, 0
        for found in self.special.finditer(chunk):
            size = found.start() - at
            part = self._far(chunk[at:found.end() - 1], limit - total)
            counts += [total + n for n in part]
            if len(counts) < found.end() - 1:
                # left out above the limit, maybe only where the special token is cut short
                if len(part) < size:
                    return counts, limit + 1
                counts += [limit + 1] * (found.end() - 1 - len(counts))
            total += 1 + (part[size - 1] if size else 0)
            counts.append(total)
            at = found.end()
        if at < len(chunk):
            part = self._far(chunk[at:], limit - total)
            counts += [total + n for n in part]
            total = counts[-1] if len(counts) == len(chunk) else limit + 1
        return counts, total

    def _split(self, normal: str) -> list[str]:
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _far(self, text: str, limit: float) -> list[int]:
        """The count of every prefix of a text without special tokens, by the pieces of the whole.

        The text falls into segments that normalise each on its own.  A prefix that ends with one is
        a prefix of the normal form; another one has pieces of its own at its end.
        """
        marks = [0, *(p for p in range(1, len(text)) if self.starts[text[p]]), len(text)]
        forms = [self.forms[text[a:b]] for a, b in pairwise(marks)]
        normal = "".join(forms)
        if normal != self.forms[text]:         # the library knows other letters than this Python
            return [self.count(text[:p]) for p in range(1, len(text) + 1)]
        spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        out: list[int] = []
        before, k, q, run = [0], -1, 0, None   # tokens before each piece; last piece begun; letters done
        for (a, b), form in zip(pairwise(marks), forms):
            for p in range(a + 1, b):
                out.append(self._cut(normal, q, self.forms[text[a:p]], spans, before, k, run))
            q += len(form)
            while k + 1 < len(spans) and spans[k + 1][0] < q:
                k += 1
                word = normal[slice(*spans[k])]
                run = _Run(self, word, limit - before[k]) if len(word) > _LONG else None
                counts = run.counts if run else self.word_counts[word]
                before.append(before[k] + counts[-1] if len(counts) == len(word) else limit + 1)
            if k >= 3 and before[k - 2] > limit:
                break
            place = min(q, spans[k][1]) - spans[k][0] if k >= 0 else 0
            if place > (len(counts) if k >= 0 else 0):
                break
            out.append(before[k] + counts[place - 1] if k >= 0 else 0)
        return out

    def _cut(self, normal: str, q: int, tail: str, spans: list, before: list[int], k: int, run: "_Run | None") -> int:
        """The count of ``normal[:q] + tail``; ``k`` is the last piece that begins before ``q``.

        A piece of four letters or more is a run, and what follows does not change it; a shortened
        form reaches over two pieces before the last one.
        """
        if run and spans[k][1] >= q and q - spans[k][0] > _LONG:
            end = normal[q - 3:q] + tail
            (_, (_, to)), *others = self.library.pre_tokenizer.pre_tokenize_str(end)
            rest = sum(self.word_counts[end[a:b]][-1] for _, (a, b) in others)
            return before[k] + run.followed(q - spans[k][0], end[3:to]) + rest
        r = k
        while r > max(k - 2, 0) and spans[r - 1][1] - spans[r - 1][0] < 4:
            r -= 1
        if r < 0 or spans[k][1] < q and spans[k][1] - spans[k][0] >= 4:
            r = k + 1
        start = spans[r][0] if r <= k else q
        return before[r] + sum(self.word_counts[w][-1] for w in self._split(normal[start:q] + tail))

    def _count_word(self, word: str):
        """For every prefix of a piece, the tokens it has as a text of its own.

        The encoding of a prefix ends in the one token whose pair with the last token before it
        merges no further; so the last token and the count of each prefix follow from those of
        shorter prefixes.  A shortened form such as 're is one piece, cut short it is two.
        """
        if word[0] == "'" and len(word) == 3 and word[1] in "rvl":
            sign = self.word_counts["'"][0]
            return [sign, sign + self.word_counts[word[1]][0], self._walk(word)[-1]]
        if word.isascii():
            return self._walk(byte_mapped(word))
        counts, ends = self._walk(byte_mapped(word)), accumulate(len(c.encode("utf-8")) for c in word)
        return type(counts)(counts[e - 1] for e in ends)

    def _walk(self, s: str):
        """Token counts of the prefixes of a piece, as a sequence of numbers.

        Kept per prefix: the last token inside a word, the count inside a word, and the counts of all
        its prefixes as whole words.  Pieces that begin alike share them.
        """
        n, memo = len(s), self._states
        if n > 40:
            memo = {}                          # by length, as the prefixes of a long piece add up
        elif len(memo) > 400_000:
            memo.clear()
        at, state = n if n <= 40 else 0, None
        while at:
            state = memo.get(s[:at])
            if state is not None:
                break
            at -= 1
        known, counts = at, (state[2] if state is not None else b"" if n <= 40 else [])
        fit_open, fit_closed = self._fit_open, self._fit_closed
        last = inside = whole = 0
        # all tokens that end at a place, places in order
        for end, (size, t, c) in self.endings.iter(s):
            if end < known:
                continue
            if end == at:
                if at > known:
                    counts = counts + bytes((whole,)) if n <= 40 else (counts.append(whole) or counts)
                    memo[s[:at] if n <= 40 else at] = (last, inside, counts)
                at, last, whole = end + 1, 0, 0
            if last and whole:
                continue
            before, below, _ = memo[s[:at - size] if n <= 40 else at - size] if at > size else (0, 0, None)
            if not last and t:
                pair = before << 20 | t
                if fit_open[pair] if pair in fit_open else self._fits(pair, before, s[at - size:at], False):
                    last, inside = t, below + 1
            if not whole and c:
                pair = before << 20 | c
                if fit_closed[pair] if pair in fit_closed else self._fits(pair, before, s[at - size:at], True):
                    whole = below + 1
        if at > known:
            counts = counts + bytes((whole,)) if n <= 40 else (counts.append(whole) or counts)
            memo[s[:at] if n <= 40 else at] = (last, inside, counts)
        return counts

    def _grow(self, s: str, last: list[int], inside: list[int], whole: list[int], limit: float = float("inf")) -> None:
        """The table of ``_walk`` as three lists by length, carried on from the lengths that they hold
        to all of ``s``, or to where every longer prefix has more than ``limit`` tokens."""
        known, above = len(last) - 1, 0
        for end, (size, t, c) in self.endings.iter(s, max(0, known + 1 - self.longest)):
            at = end + 1
            if at <= known:
                continue
            if at == len(last):
                # the last token of a prefix is no longer than the longest one
                above = above + 1 if inside[-1] >= limit else 0
                if above > self.longest:
                    return
                last.append(0), inside.append(0), whole.append(0)
            before, below = last[at - size], inside[at - size]
            token = s[at - size:at]
            if t and not last[at] and self._stands(before, t, token, False):
                last[at], inside[at] = t, below + 1
            if c and not whole[at] and self._stands(before, c, token, True):
                whole[at] = below + 1

    def _stands(self, before: int, number: int, token: str, closed: bool) -> bool:
        pair, known = before << 20 | number, self._fit_closed if closed else self._fit_open
        return known[pair] if pair in known else self._fits(pair, before, token, closed)

    def _fits(self, pair: int, before: int, token: str, closed: bool) -> bool:
        """Whether BPE leaves ``token`` standing behind the last token before it."""
        known = self._fit_closed if closed else self._fit_open
        if len(known) > 500_000:
            known.clear()
        first = [self.named[before]] if before else []
        got = (self.whole if closed else self.inner).tokenize("".join(first) + token)
        fits = known[pair] = [t.value for t in got] == first + [token + self.end if closed else token]
        return fits


class _Run:
    """The counts of a long piece by letters, which a prefix that ends in other letters carries on."""

    def __init__(self, bpe: WordBpe, word: str, limit: float):
        self.bpe, self.bytes = bpe, byte_mapped(word)
        self.ends = [0, *accumulate(len(c.encode("utf-8")) for c in word)]
        self.last, self.inside, self.whole = [0], [0], [0]
        bpe._grow(self.bytes, self.last, self.inside, self.whole, limit)
        self.counts = [self.whole[e] for e in self.ends[1:] if e < len(self.whole)]

    def followed(self, letters: int, more: str) -> int:
        """The count of the first ``letters`` letters and ``more`` as one piece."""
        at = self.ends[letters]
        if not more:
            return self.whole[at]
        first = max(0, at - self.bpe.longest)
        kept = slice(first, at + 1)
        last, inside, whole = self.last[kept], self.inside[kept], self.whole[kept]
        self.bpe._grow(self.bytes[first:at] + byte_mapped(more), last, inside, whole)
        return whole[-1]
