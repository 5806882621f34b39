"""Held-out items that leaked into a corpus.

The n-grams of the normalised items form a hash set, built once and broadcast; workers slide over the
tokens of each document and look their n-grams up. Around the hits an alignment of document and
item decides: a leak is a passage of at least ``least`` consecutive item words of which at most one
in ten is changed, missing or added. A passage begins and ends with a word that both share.

With n = 5 no such passage escapes the lookup: 12 words with one error keep three n-grams, and longer
passages keep more. Items that share fewer n-grams with a place of the document aren't aligned. Words
that a document divides, as "held out" for "held-out", are looked up joined as well, in every
combination that gives words of the items.

Markup is taken out by scanners that read each character a bounded number of times, whatever the
length of a tag, comment or link. What is taken out and long enough is searched as a text of its own.

Leaks come out as pairs, as places in the text, or as the texts without them. Held-out items are sent
out in blocks of bounded size; with more than one block the corpus is normalised once, and every block
reads the words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polyvec.plans.shared import checkpoint

GRAM = 5

_UNICODE_ESCAPE = re.compile(r"\\u\{?([0-9a-fA-F]{4,6})\}?|\\x([0-9a-fA-F]{2})")
_BREAK_ESCAPE = re.compile(r"\\[nrtfv](?![a-z]*+\{)")
_CHAR_ESCAPE = re.compile(r"\\(?=[^\w\s])")
_TERMINAL = re.compile(r"\x1b\[[0-9;?]*+[A-Za-z]")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_COMMAND = re.compile(r"\\[a-zA-Z]++\*?\{")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_INLINE = frozenset("em i b strong span mark u a s sub sup font code wbr small big tt kbd abbr cite q ins del".split())
_TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:_-]*+)")
_TAG_STOP = re.compile(r"=\s*+[\"']|[<>]")
_VALUE = re.compile(r"(?<![^\s\"'])[^\s=<>\"']*+\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)")
BARE = 5  # so many words without a value aren't attributes
_LINK = re.compile(r"\]\((?:[^()\s]|\([^()\s]*+\))*+(?:\s++(?:\"[^\"]*+\"|'[^']*+'))?+\s*+\)")
_DIVIDED = re.compile(r"[-\u2010\u2011\u00ac\u00ad](?<=\w[-\u2010\u2011\u00ac\u00ad])[-\u2010\u2011\u00ac\u00ad]*+[ \t]*+(?:\r\n?|\n|\u2028)\s*+(?:[>|*#]++\s*+)*+(?=\w)")
_SENTENCE = re.compile(r"[.!?](?<=[a-z0-9][.!?])[.!?]*+(?=[A-Z][a-z])")
_THOUSAND = re.compile(r",(?=\d{3}\b)(?<=\d,)")
_PARTERS = r"\s\u2012-\u2015\u2026,;:|()\[\]{}<>=\"\u201c\u201d\u201e\u00ab\u00bb\u00b7\u2022"
_PARTING = re.compile(rf"[{_PARTERS}]+")
_PART = re.compile(rf"[^{_PARTERS}]+")
_NOT_WORD = re.compile(r"[\W_]+")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_SOFT = re.compile("\u00ad")
_ASCII = {c: " " if _PARTING.match(chr(c)) else None for c in range(128) if _NOT_WORD.match(chr(c))}
_INVISIBLE = {c: None for c in [0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), *range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]}
_INVISIBLE_CLASS = re.compile("[" + "".join(re.escape(chr(c)) for c in _INVISIBLE) + "]+")
_PILE = re.compile("[\u0300-\u036f]{30}")
_CLUSTER = regex.compile(r"\X")
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
LONG = 48  # characters of markup that may hold a passage


def _unpercent(m: re.Match) -> str:
    raw = bytes.fromhex(m.group().replace("%", ""))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def _unescape(m: re.Match) -> str:
    return chr(min(int(m.group(1) or m.group(2), 16), 0x10FFFF))


class _Plain:
    """A text under substitution."""

    def __init__(self, text: str) -> None:
        self.text = text

    def sub(self, pattern: re.Pattern, new: str | Callable[[re.Match], str]) -> None:
        self.text = pattern.sub(new, self.text)

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        out, at = [], 0
        for a, b, new in spans:
            out += (self.text[at:a], new)
            at = b
        self.text = "".join([*out, self.text[at:]])

    def unescape(self) -> None:
        self.text = html.unescape(self.text)

    def compose(self) -> None:
        self.text = _INVISIBLE_CLASS.sub("", unicodedata.normalize("NFKC", self.text))

    def fold(self) -> None:
        self.text = self.text.casefold()

    def part(self, a: int, b: int) -> _Plain:
        return _Plain(self.text[a:b])


class _Tracked(_Plain):
    """A text under substitution that knows where in the first text each character comes from."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text = text
        self.starts = np.arange(len(text)) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def sub(self, pattern: re.Pattern, new: str | Callable[[re.Match], str]) -> None:
        self.replace([(m.start(), m.end(), new if isinstance(new, str) else new(m)) for m in pattern.finditer(self.text)])

    def replace(self, spans: list[tuple[int, int, str]]) -> None:
        if not spans:
            return
        starts, ends, at = [], [], 0
        for a, b, new in spans:
            starts += (self.starts[at:a], np.full(len(new), self.starts[a] if a < b else 0))
            ends += (self.ends[at:a], np.full(len(new), self.ends[b - 1] if a < b else 0))
            at = b
        starts.append(self.starts[at:])
        ends.append(self.ends[at:])
        super().replace(spans)
        self.starts, self.ends = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)

    def unescape(self) -> None:
        self.sub(_ENTITY, lambda m: html.unescape(m.group()))

    def compose(self) -> None:
        self.sub(_CLUSTER, lambda m: unicodedata.normalize("NFKC", m.group()))
        self.sub(_INVISIBLE_CLASS, "")

    def fold(self) -> None:
        self.sub(_NOT_ASCII, lambda m: m.group().casefold())
        self.text = self.text.lower() if self.text.isascii() else self.text.translate({c: c + 32 for c in range(65, 91)})

    def part(self, a: int, b: int) -> _Tracked:
        return _Tracked(self.text[a:b], self.starts[a:b], self.ends[a:b])


def markup(text: str) -> list[tuple[int, int, str]]:
    """Comments, tags and other declarations ``(from, to, what stands for it)``, in order.

    A quoted value may hold any character. A tag that isn't closed before the next one is text. Where
    a scan over quoted values failed, the same stretch is scanned without them only.
    """
    out, at, quoted, closing = [], 0, 0, {}

    def close(what: str, a: int) -> int:
        """The next ``what``; a search that failed once isn't made again."""
        if closing.get(what, 0) < 0:
            return -1
        closing[what] = text.find(what, a)
        return closing[what]

    while (at := text.find("<", at)) >= 0:
        if text.startswith("<!--", at):
            end = close("-->", at + 4)
            if end >= 0:
                out.append((at, end + 3, " "))
                at = end + 3
            else:
                at += 4
            continue
        name = _TAG_NAME.match(text, at)
        if not name and text[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        p, end = name.end() if name else at + 2, -1
        careful = at >= quoted
        while stop := _TAG_STOP.search(text, p):
            mark = stop.group()[-1]
            if mark in "<>":
                end = stop.end() if mark == ">" else -1
                p = stop.start()
                break
            p = stop.end()
            if careful and (q := close(mark, p)) >= 0:
                p = q + 1
        if end < 0 and careful:  # once more, without quoted values
            quoted = max(quoted, p)
            stop = re.compile("[<>]").search(text, at + 1)
            end = stop.end() if stop and stop.group() == ">" else -1
        if end < 0 or name and len(_VALUE.sub(" ", text[name.end() : end - 1]).split()) > BARE:
            at += 1
            continue
        out.append((at, end, "" if name and name.group(1).lower() in _INLINE else " "))
        at = end
    return out


def _cleaned(t: _Plain) -> list[_Plain]:
    """``t`` without markup, escapes and so on, and after it the long pieces of markup that were taken out."""
    taken = []
    if "\\" in t.text:
        t.sub(_UNICODE_ESCAPE, _unescape)
        t.sub(_BREAK_ESCAPE, "\n")
        t.sub(_COMMAND, "")
        t.sub(_CHAR_ESCAPE, "")
    if "\x1b" in t.text:
        t.sub(_TERMINAL, "")
    if "%" in t.text:
        t.sub(_PERCENT, _unpercent)
    for _ in range(2):
        if "&" in t.text:
            t.unescape()
    if "<" in t.text:
        spans = markup(t.text)
        taken += [t.part(a + 1, b - 1) for a, b, _ in spans if b - a > LONG]
        t.replace(spans)
    if "](" in t.text:
        spans = [(m.start(), m.end(), " ") for m in _LINK.finditer(t.text)]
        taken += [t.part(a + 2, b - 1) for a, b, _ in spans if b - a > LONG]
        t.replace(spans)
    if not t.text.isascii():
        t.sub(_PILE, lambda m: m.group() + "\u034f")  # keeps the composition linear
        t.compose()
    if "\n" in t.text or "\r" in t.text:
        t.sub(_DIVIDED, "")
    if "\u00ad" in t.text:
        t.sub(_SOFT, "")
    t.sub(_SENTENCE, " ")
    t.sub(_THOUSAND, "")
    t.fold()
    return [t, *taken]


def _pieces(text: str) -> Iterator[_Plain]:
    """The cleaned text, then what its markup held."""
    waiting = [_Plain(text)]
    while waiting:
        done, *more = _cleaned(waiting.pop())
        waiting += more
        yield done


def _words(text: str) -> list[str]:
    if text.isascii():
        return text.translate(_ASCII).split()
    return [w for w in (_NOT_WORD.sub("", w) if not w.isalnum() else w for w in _PARTING.split(text)) if w]


def normalise(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, escapes, entities, width and invisible characters."""
    return _words(_cleaned(_Plain(text))[0].text)


def normalised(text: str) -> list[list[str]]:
    """The words of a text, and those of each long piece of its markup."""
    return [_words(p.text) for p in _pieces(text)]


def placed_words(text: str) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """``normalised`` with where each word begins and ends in the text."""
    out, waiting = [], [_Tracked(text)]
    while waiting:
        t, *more = _cleaned(waiting.pop())
        waiting += more
        words, starts, ends = [], [], []
        for m in _PART.finditer(t.text):
            if w := _NOT_WORD.sub("", m.group()):
                core = _CORE.search(m.group())
                words.append(w)
                starts.append(t.starts[m.start() + core.start()])
                ends.append(t.ends[m.start() + core.end() - 1])
        out.append((words, np.array(starts, np.int64), np.array(ends, np.int64)))
    return out


def passages(item: list[str], words: list[str], least: int = 12, share: int = 10, widest: int = 2) -> Iterator[tuple[int, int]]:
    """Ranges of ``words`` that hold at least ``least`` consecutive words of ``item``, one in ``share`` changed, missing or added."""
    most = len(item) // share
    where: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    first: dict[tuple[int, int], list[tuple[int, int]]] = {}  # cell -> first item word and first word, by number of errors
    none = (len(item) + 1, 0)
    for j, w in enumerate(words):
        ends = [(i, 1) for i in where.get(w, ())]
        for width in range(2, min(widest, j + 1) + 1):  # a word that punctuation held together may come as several
            ends += [(i, width) for i in where.get("".join(words[j - width + 1 : j + 1]), ())]
        for i, width in ends:
            best = first.get((i - 1, j - width))
            if best is None:
                best = [none] * (most + 1)
                best[0] = (i, j - width + 1)
                for di in range(1, most + 2):
                    for dj in range(1, most + 2):
                        cost = max(di, dj) - 1
                        if cost and (other := first.get((i - di, j - width + 1 - dj))) is not None:
                            for e in range(most + 1 - cost):
                                if other[e] < best[e + cost]:
                                    best[e + cost] = other[e]
            first[i, j] = best
            for e, (start, begin) in enumerate(best):
                span = i - start + 1
                if span >= least and share * e <= span:
                    yield begin, j + 1
                    break


def aligned(item: list[str], words: list[str], least: int = 12, share: int = 10, widest: int = 2) -> bool:
    """Whether ``words`` hold such a passage."""
    return next(passages(item, words, least, share, widest), None) is not None


_BEGINS, _ENDS = 1, 2


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        return 0


class Items:
    """A block of items with the hash set of their n-grams.

    Words are numbers of a vocabulary, n-grams a sorted array of hashes with the items of each, so that
    a built block is sent out as it is, at about three times the size of its texts.
    """

    def __init__(self, items: list[tuple], gram: int = GRAM, share: int = 10) -> None:
        self.gram, self.share, self.widest = gram, share, 2  # widest: how many parts a word may come in
        self.keys = [key for key, _ in items]
        number: dict[str, int] = {}
        ids, ends, parts = [], [0], []
        for _, text in items:
            marked = _PARTING.split(_cleaned(_Plain(text or ""))[0].text)
            counts = [len([x for x in _NOT_WORD.split(w) if x]) for w in marked]
            words = [w for w in (_NOT_WORD.sub("", w) for w in marked) if w]
            parts.append(sum(max(n - 1, 0) for n in counts))
            self.widest = max(self.widest, *counts)
            ids += [number.setdefault(w, len(number)) for w in words]
            ends.append(len(ids))
        self.vocabulary = list(number)
        self.ids, self.ends, self.parts = np.array(ids, np.int32), np.array(ends, np.int64), np.array(parts, np.int64)
        n = len(ids) - gram + 1
        held = np.repeat(np.arange(len(items)), np.diff(self.ends))
        at = np.flatnonzero(held[: max(n, 0)] == held[gram - 1 :]) if n > 0 else np.empty(0, int)
        plain = self.ids.astype(np.uint64)
        both = np.stack([self._hash([plain[at + i] for i in range(gram)]), held[at].astype(np.uint64)], 1)
        both, self.times = np.unique(both.reshape(-1, 2), axis=0, return_counts=True)
        self.hashes, first = np.unique(both[:, 0], return_index=True)
        self.firsts = np.append(first, len(both))
        self.holders = both[:, 1].astype(np.int32)
        self._index()

    def _index(self) -> None:
        """A number for every word of a document: its place in the vocabulary from 1, and whether it begins or ends a longer word."""
        begins = {w[:n] for w in self.vocabulary for n in range(1, len(w))}
        ends = {w[n:] for w in self.vocabulary for n in range(1, len(w))}
        codes = {w: _BEGINS * (w in begins) | _ENDS * (w in ends) for w in begins | ends}
        for i, w in enumerate(self.vocabulary, 1):
            codes[w] = codes.get(w, 0) | i * 4
        self.codes = _Codes(codes)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def words(self, item: int) -> list[str]:
        return [self.vocabulary[i] for i in self.ids[self.ends[item] : self.ends[item + 1]]]

    def fewest(self, least: int) -> int:
        """N-grams that any passage keeps: errors divide it in runs, each of which lacks ``gram - 1``."""
        kept = (n - n // self.share - (n // self.share + 1) * (self.gram - 1) for n in range(least, least + 5 * self.share))
        return max(1, min(kept))

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, the places of n-grams that they have, in order, and which n-grams."""
        none = (np.empty(0, np.int64),) * 3
        if not words or not len(self.hashes):
            return none
        n, gram = len(words), self.gram
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, n)
        ids = (codes >> 2) - 1
        good = np.concatenate(([0], np.cumsum(ids >= 0)))
        at = np.flatnonzero(good[gram:] - good[:-gram] == gram) if n >= gram else none[0]
        plain = ids.astype(np.uint64)
        places, grams = self._joined(words, codes, ids)
        places = np.concatenate([at, places])
        h = np.concatenate([self._hash([plain[at + i] for i in range(gram)]), self._hash([grams[:, i] for i in range(gram)])])
        if not len(h):
            return none
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[slot] == h
        if not hit.any():
            return none
        slot, places = slot[hit], places[hit]
        counts = self.firsts[slot + 1] - self.firsts[slot]
        index = np.repeat(self.firsts[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        rows = np.unique(np.stack([self.holders[index].astype(np.int64), np.repeat(places, counts), index], 1), axis=0)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def _joined(self, words: list[str], codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams, and their places, of which the document has a word in several parts."""
        joins: dict[int, list[tuple[int, int]]] = defaultdict(list)
        ending: dict[int, list[int]] = defaultdict(list)
        code, n = self.codes, len(words)
        begins = codes[:-1] & _BEGINS > 0
        for p in np.flatnonzero(begins & (codes[1:] & _ENDS > 0) if self.widest == 2 else begins).tolist():
            head = words[p]
            for end in range(p + 1, min(n, p + self.widest)):
                head += words[end]
                found = code[head]
                if found >> 2:
                    joins[p].append((end + 1, (found >> 2) - 1))
                    ending[end + 1].append(p)
                if not found & _BEGINS:
                    break
        places, grams = [], []
        starts = set()
        for p in joins:
            reached = {p}
            for _ in range(self.gram - 1):
                reached |= {q - 1 for q in reached if q and ids[q - 1] >= 0} | {s for q in reached for s in ending.get(q, ())}
            starts |= reached
        for s in starts:
            paths = [(s, ())]
            for _ in range(self.gram):
                paths = [(end, (*gram, w)) for p, gram in paths if p < n for end, w in ((p + 1, int(ids[p])), *joins.get(p, ())) if w >= 0]
            for end, gram in paths:
                if end > s + self.gram:
                    places.append(s)
                    grams.append(gram)
        return np.array(places, np.int64), np.array(grams, np.uint64).reshape(-1, self.gram)

    def touched(self, texts: list[list[str]], least: int) -> list[int]:
        """Which of several texts may hold a passage: one lookup for all of them."""
        words, ends = [], []
        for text in texts:
            words += text
            words += ("",) * self.gram  # no n-gram crosses it
            ends.append(len(words))
        items, places, _ = self.hits(words)
        texts_of = np.searchsorted(ends, places, side="right")
        found, counts = np.unique(np.stack([texts_of, items], 1), axis=0, return_counts=True) if len(items) else (np.empty((0, 2), int), np.empty(0, int))
        return np.unique(found[counts >= self.fewest(least), 0]).tolist()

    def regions(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """``(item, from, to)``: where enough n-grams of an item lie together for a passage."""
        items, places, grams = self.hits(words)
        if not len(items):
            return
        fewest = self.fewest(least)
        sizes = self.ends[items + 1] - self.ends[items]
        reach = sizes + sizes // self.share + 1 + self.parts[items]
        begins = np.flatnonzero(np.concatenate(([True], (items[1:] != items[:-1]) | (places[1:] - places[:-1] > reach[1:]))))
        for a, b in zip(begins, np.append(begins[1:], len(items))):
            if b - a >= fewest and self.times[np.unique(grams[a:b])].sum() >= fewest:
                yield int(items[a]), max(0, int(places[a] - reach[a])), min(len(words), int(places[b - 1] + self.gram * self.widest + reach[a]))

    def leaked(self, words: list[str], least: int) -> list[tuple[object, int, int]]:
        """``(item key, from, to)``: items whose passage ``words`` hold, each once, and where it begins and ends."""
        out, known = [], set()
        for item, a, b in self.regions(words, least):
            if item not in known and (found := next(passages(self.words(item), words[a:b], least, self.share, self.widest), None)):
                known.add(item)
                out.append((self.keys[item], a + found[0], a + found[1]))
        return out

    def spans(self, words: list[str], least: int) -> list[tuple[object, int, int]]:
        """``(item key, from, to)``: every passage, overlapping ones of an item as one."""
        out: list[tuple[object, int, int]] = []
        for item, a, b in self.regions(words, least):
            at = None
            for begin, end in sorted(passages(self.words(item), words[a:b], least, self.share, self.widest)):
                if at is not None and begin <= at[1]:
                    at[1] = max(at[1], end)
                    continue
                if at is not None:
                    out.append((self.keys[item], a + at[0], a + at[1]))
                at = [begin, end]
            if at is not None:
                out.append((self.keys[item], a + at[0], a + at[1]))
        return out


def leaks_of(items: Items, texts: list[list[list[str]]], least: int) -> Iterator[tuple[int, object]]:
    """``(row, item key)`` of the texts of a batch, each as its lists of words; each pair once."""
    flat = [(row, words) for row, text in enumerate(texts) for words in text]
    at = 0
    while at < len(flat):
        size, end = 0, at
        while end < len(flat) and (size < 500_000 or end == at):
            size += len(flat[end][1])
            end += 1
        known: dict[int, set] = defaultdict(set)
        for i in items.touched([words for _, words in flat[at:end]], least):
            row, words = flat[at + i]
            for key, _, _ in items.leaked(words, least):
                if key not in known[row]:
                    known[row].add(key)
                    yield row, key
        while 0 < end < len(flat) and flat[end][0] == flat[end - 1][0]:  # further pieces of the last row's markup
            row, words = flat[end]
            for key, _, _ in items.leaked(words, least):
                if key not in known[row]:
                    known[row].add(key)
                    yield row, key
            end += 1
        at = end


def text_spans(items: Items, text: str, least: int) -> list[tuple[object, int, int]]:
    """``(item key, start, end)``: passages in code points of the text. Only a text with a leak is tracked through its normalisation."""
    if not any(items.leaked(words, least) for words in normalised(text)):
        return []
    found = []
    for words, starts, ends in placed_words(text):
        found += [(key, int(starts[a]), int(ends[b - 1])) for key, a, b in items.spans(words, least)]
    return found


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator:
    """Broadcast blocks of built items; their number follows from the counted size of the texts."""
    clean = items.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    size = clean.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        yield items.sparkSession.sparkContext.broadcast(Items([(r["k"], r["t"]) for r in part.collect()]))


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, block_bytes: int = 8_000_000) -> DataFrame:
    """``(<key>, <item_key>)``: documents and the items of which they hold a passage, each pair once per document row.

    Null and empty texts hold nothing; items with fewer than ``least`` words can't leak; a null item
    is none. Blocks have at most about ``block_bytes`` of text. Other columns are ignored.
    """
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    arrow = to_arrow_type(items.schema[item_key].dataType)
    blocks = list(_blocks(items, item_key, item_text, block_bytes))
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([normalised(batch.column(1)[at].as_py())], pa.list_(pa.list_(pa.string())))], names=["key", "words"])

    def search(shared, read: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows = list(leaks_of(known, [read(value.as_py()) for value in batch.column(1)], least))
                at, found = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, arrow)], names=["key", "item"])

        return run

    if len(blocks) > 1:
        docs = checkpoint(docs.mapInArrow(prepare, f"key {kind}, words array<array<string>>"))
    out = None
    for shared in blocks:
        found = docs.mapInArrow(search(shared, normalised if len(blocks) == 1 else lambda words: words), f"key {kind}, item {item_kind}")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key))


def leak_spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, block_bytes: int = 8_000_000) -> DataFrame:
    """``(<key>, <item_key>, start, end)``: every passage, in code points of the text as it is stored.

    Rows as in ``find_leaks``, one a passage; passages of an item that overlap are one.
    """
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    arrow = to_arrow_type(items.schema[item_key].dataType)
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for shared in _blocks(items, item_key, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows = [(row, *s) for row, value in enumerate(batch.column(1)) for s in text_spans(known, value.as_py(), least)]
                at, found, starts, ends = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, arrow), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "item", "start", "end"])

        found = docs.mapInArrow(run, f"key {kind}, item {item_kind}, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "start", "end")


def remove_spans(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, block_bytes: int = 8_000_000) -> DataFrame:
    """``(<key>, <text>, removed)``: every row, its text without the passages, and how many characters were taken out.

    Null and empty texts stay as they are. One pass, nothing is shuffled; a text loses the passages of one
    block of items after those of another.
    """
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("removed"))
    for shared in _blocks(items, item_key, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                texts, removed = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for row, value in enumerate(texts):
                    kept, at = [], 0
                    for _, a, b in sorted(text_spans(known, value, least), key=lambda s: s[1:]) if value else ():
                        kept.append(value[at:a])
                        at = max(at, b)
                    if at:
                        texts[row] = "".join([*kept, value[at:]])
                        removed[row] += len(value) - len(texts[row])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["key", "text", "removed"])

        out = out.mapInArrow(run, f"key {kind}, text string, removed bigint")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "removed")


def remove_leaking(df: DataFrame, key: str, leaks: DataFrame) -> DataFrame:
    """The documents that are in no leak, with all their columns."""
    return df.join(leaks.select(key).distinct(), key, "left_anti")
