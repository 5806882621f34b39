"""Text statistics per document, and the kind of text that isn't natural prose.

The statistics come from counts over fragments of lines that add up: characters of several classes,
words, tokens, common words, separators. Almost all of them are functions of a token (a run without
white space), so that a token is looked at once and afterwards looked up; lines and texts are sums
over arrays of tokens. A text of ordinary size is one fragment list in one task. A huge text is cut
into chunks, each chunk is summarised by itself, and summaries are merged pairwise up a tree.

A cut may fall anywhere. Every count depends on at most ``REACH`` characters to either side, so a
summary keeps its first and last line open, with their outermost characters; where two of them meet,
the counts of the characters around the cut are put in place of those of the two parts. The result is
that of the whole text.

One fragment over and over is found by word shingles: those of five words that come at least six
times cover more than half of the words' characters. A summary counts the shingles of smallest hash
only, and of these every occurrence, whatever the chunks; up to ``SAMPLE`` distinct ones that is all.

Words are runs of letters and digits; each Chinese or Japanese character is a word by itself.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.plans.shared import checkpoint

# Common words of English, German, French and Spanish.
COMMON = frozenset(
    "the of and to in a is that for on was with as by it not but from or than are at this which one had were its has have you your before when how does since both may only will be been he she they we his her their there if no so what all can more some into out up about who do did i my me our us them these those "
    "der die das und ist nicht ein eine einer eines den dem des im mit von zu auf für sich auch als an nach bei aus ob weil ohne seit jede war hat sie er es wir ihr oder wie nur noch über "
    "le la les de des du et un une est dans que qui pour sur par avec pas mais plus ce cette ces son sa ses au aux ou où il elle ils on nous vous se sans chaque depuis chez "
    "el los las y en del al se con por para una uno no es su sus lo como más pero sin aunque fue puede desde toda todo este esta".split()
)

_LINES = re.compile(r"\r\n|[\n\r\v\f\x85  ]")
_IDEOGRAPH = r"぀-ヿ㐀-䶿一-鿿가-힯"
_WORD = re.compile(rf"[{_IDEOGRAPH}]|[^\W_{_IDEOGRAPH}]+")
_RUN = re.compile(rf"[^\W_{_IDEOGRAPH}]")
_IDEO = re.compile(rf"[{_IDEOGRAPH}]")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]」]{0,16}$|\[\d{1,9}\]\.?$")
_LINE_END = re.compile(r"[.!?:;,…。！？；：，\"'”’»)\]]$")
_MARKED = re.compile(r"(?:[-*+•‣▪●◦⁃–—·>☐-☒□]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)\]:]|\d{1,3}(?=\s)|#(?=\w)|\[[ xX]?\])\s*(?=\S)")
_BROKEN = re.compile(r"[ÂÃÅÄâƒ][\u0080-¿ŒœŠšŸŽžˆ˜–-›€™�ÂÃ]|�")
_BOX = re.compile(r"[�■-◿☐-☒¿?]")
_GAP = re.compile(r"(?:(?<=\s\s)|(?<=\t))(?=\S)")
_TIGHT = re.compile(r"(?<=[^\s,]),(?=[^\s,])")
_TIGHT_SEMI = re.compile(r"(?<=\S);(?=\S)")
_NUMBER = re.compile(r"[(\[]?[-+$€£]?\d[\d.,:/%-]*[)\]%]?$")
_VOWELS = re.compile(r"[aeiouyà-æè-öù-ý]")
_LATIN = re.compile(r"[a-zß-öø-ÿ]")
_CODE = re.compile(r"(?:[0-9a-f]{16,}|[A-Za-z0-9+/]{24,}={0,2}|(?=[A-Za-z0-9+/_=-]*\d)(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,})$")
_LONG_CODE = re.compile(r"[A-Za-z0-9+/=]{65,}")
_LETTERS = re.compile(r"[a-z]{4,}")
_NO_WORD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[aeiou]{5}|q(?!u)|[jvx][bdfgjkqwxz]|[bcdfgkmpqvwxz][jqx]|(?:w|z)[vxqj]|[^aeiouy]{4}$|^[^aeiouy]{4}|(.)\1\1")
_RULE = re.compile(r"[|+:=-]")
_SYMBOL = re.compile(r"[^\w\s]|_")

#: What is counted of a token, in this order.
TOKEN = ("tokens", "solid", "symbols", "words", "word_chars", "common", "numbers", "single", "ideographs", "stops", "semis", "bars", "dots", "slashes", "tight", "tight_semis", "broken", "boxes", "vowels", "latin", "code_chars", "upper", "rules", "noise")
#: And of a line or a fragment of one: first the statistics of the text as it stands, then with character entities resolved.
RAW = ("symbols", "words", "word_chars", "common", "solid")
FEATURES = (*(f"raw_{n}" for n in RAW), *TOKEN, "commas", "tabs", "gaps")
_AT = {name: i for i, name in enumerate(FEATURES)}
_RAW = [TOKEN.index(n) for n in RAW]
REACH = 256  # characters beside a cut on which a count may depend; no token feature looks farther
SHORT = 64  # numbers, codes and noise are tokens of at most so many characters; the edges of a line too
BINS = 256
SHINGLE, OFTEN = 5, 6  # words of a shingle; a shingle that comes so many times is a repeated one
EDGE = SHINGLE + 1  # words kept at each edge of a chunk
SAMPLE = 4096
WORD = 64  # characters of a word that are told apart
KINDS = ("table", "list", "junk")

#: Sums over closed lines, in this order.
SUMS = ("lines", "punct_lines", "symbols", "words", "word_chars", "common", "solid", "prose_chars", "table_chars", "list_chars", "junk_chars", "short_chars", "all_chars", "short_words", "short_common", "short_lines", "stops")


def _key(word: str) -> int:
    return zlib.crc32(word[:WORD].encode("utf-8", "surrogatepass"))


def _token(t: str) -> tuple[list[int], list[int], list[int]]:
    """``TOKEN`` of one token; keys and lengths of its words."""
    lower = t.lower()
    words = _WORD.findall(lower)
    plain, n = t.isascii(), len(t)
    latin = len(_LATIN.findall(lower))
    noise = n if n <= SHORT and _LETTERS.search(lower) and _NO_WORD.search(_LETTERS.search(lower).group()) else 0
    counts = [
        1, n, len(_SYMBOL.findall(t)), len(words), sum(map(len, words)), sum(w in COMMON for w in words), int(n <= SHORT and bool(_NUMBER.match(t))), int(n == 1 and t.isalpha() and not _IDEO.match(t)), 0 if plain else len(_IDEO.findall(t)),
        int(bool(_SENTENCE_END.search(t)) and (n > 4 or not t[0].isdigit())) + (0 if plain else t.count("。") + t.count("？") + t.count("！")), int(t[-1] == ";"), t.count("|"), int(t in ("·", "•", "‣", "▪", "–", "—")), int(t == "/"),
        len(_TIGHT.findall(t)) if "," in t else 0, len(_TIGHT_SEMI.findall(t)) if ";" in t else 0, 0 if plain else len(_BROKEN.findall(t)), len(_BOX.findall(t)), len(_VOWELS.findall(lower)) if latin else 0, latin,
        (n if n >= 16 and _CODE.match(t) else 0) if n <= SHORT else sum(map(len, _LONG_CODE.findall(t))), int(t[0].isupper()), len(_RULE.findall(t)), noise,
    ]
    return counts, [_key(w) for w in words], [len(w) for w in words]


class _Tokens(dict):
    """Numbers of the tokens seen so far, and arrays of what is known of each."""

    most, most_chars = 300_000, 30_000_000

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.counts, self.keys, self.lengths, self.ends, self.chars, self.arrays = [], [], [], [0], 0, None

    def __missing__(self, t: str) -> int:
        counts, keys, lengths = _token(t)
        self.counts.append(counts)
        self.keys += keys
        self.lengths += lengths
        self.ends.append(len(self.keys))
        self.chars += len(t)
        self[t] = n = len(self)
        return n

    def ready(self) -> tuple[np.ndarray, ...]:
        if self.arrays is None or len(self.arrays[0]) < len(self.counts):
            old = self.arrays or (np.empty((0, len(TOKEN)), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.int64))
            have = [len(x) for x in old]
            new = (self.counts[have[0] :], self.keys[have[1] :], self.lengths[have[2] :], self.ends[have[3] :])
            self.arrays = tuple(np.concatenate([x, np.array(y, x.dtype).reshape(-1, *x.shape[1:])]) for x, y in zip(old, new))
        return self.arrays


_tokens = _Tokens()


def measure(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``FEATURES`` of lines or fragments of them, one row each; the tokens of the lines as they stand, and how many each line has."""
    if len(_tokens) > _tokens.most or _tokens.chars > _tokens.most_chars:
        _tokens.reset()
    number = _tokens.__getitem__
    raw, sizes, other, other_at, other_sizes = [], [], [], [], []
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    commas, tabs, gaps = [], [], []
    for i, line in enumerate(lines):
        tokens = line.split()
        raw += map(number, tokens)
        sizes.append(len(tokens))
        if "&" in line:
            plain = html.unescape(line)
            if plain != line:
                line = plain
                tokens = line.split()
                other += map(number, tokens)
                other_at.append(i)
                other_sizes.append(len(tokens))
        commas.append(line.count(", "))
        tabs.append(n := line.count("\t"))
        gaps.append(len(_GAP.findall(line)) if n or len(line) - len("".join(tokens)) >= len(tokens) else 0)
    counts = _tokens.ready()[0]

    def sums(ids: list[int], sizes: np.ndarray) -> np.ndarray:
        found = np.zeros((len(sizes), len(TOKEN)), np.int64)
        starts = np.cumsum(sizes) - sizes
        if len(ids):
            found[sizes > 0] = np.add.reduceat(counts[np.array(ids, np.int64)], starts[sizes > 0])
        return found

    raw, sizes = np.array(raw, np.int64), np.array(sizes, np.int64)
    first = sums(raw, sizes)
    out[:, : len(RAW)] = first[:, _RAW]
    if other_at:
        first[other_at] = sums(other, np.array(other_sizes, np.int64))
    out[:, len(RAW) : len(RAW) + len(TOKEN)] = first
    out[:, -3], out[:, -2], out[:, -1] = commas, tabs, gaps
    return out, raw, sizes


def edges(line: str) -> tuple[bool, bool, bool, bool]:
    """Whether a line begins with a mark of a list, ends a sentence, ends in punctuation, is set in by a gap."""
    head, tail = line.lstrip(), line.rstrip()
    if not head:
        return False, False, False, False
    lead = line[: len(line) - len(head)]
    tail = tail[-SHORT:]
    return bool(_MARKED.match(head[:SHORT])), bool(_SENTENCE_END.search(tail)), bool(_LINE_END.search(tail)), len(lead) > 1 or lead == "\t"


def line_kinds(f: np.ndarray, e: np.ndarray) -> np.ndarray:
    """0 blank, else by place: 1 prose, 2 table, 3 list, 4 junk, 5 short (an entry or a piece of a narrow paragraph); ``e`` are the ``edges``."""
    g = lambda name: f[:, _AT[name]]
    solid, words, tokens, stops, common, numbers = g("solid"), g("words"), g("tokens"), g("stops"), g("common"), g("numbers")
    marked, ends_stop = e[:, 0], e[:, 1]
    gaps = g("gaps") - e[:, 3]
    pure = words - g("ideographs")
    bars, fields = g("bars"), np.maximum(g("tight"), g("tight_semis"))
    separators = np.maximum.reduce([bars, g("dots"), g("slashes"), g("semis"), g("commas")])
    rules = [
        (solid == 0, 0),
        (g("code_chars") * 2 > solid, 4),
        ((g("broken") * 12 > solid) | (g("boxes") * 3 > solid) & (solid > 3), 4),
        ((tokens >= 6) & (g("single") * 10 >= tokens * 6), 4),
        ((bars >= 2) & ((bars * 5 >= tokens) & (numbers >= 2) & (g("word_chars") * 2 > solid) | (g("rules") == solid)), 2),
        ((g("tabs") >= 2) & (common * 4 <= words) & ((numbers * 4 >= tokens) | (g("tabs") * 3 >= tokens) & (stops == 0)), 2),
        ((fields >= 3) & (fields * 3 >= tokens) & (common * 6 <= words), 2),
        ((gaps >= 2) & (common * 5 <= words) & ((numbers * 4 >= tokens) | (gaps * 3 >= tokens) & (tokens <= 12) & (stops + common + g("commas") == 0)), 2),
        ((tokens >= 3) & (numbers * 2 >= tokens) & (common * 6 <= words), 2),
        ((g("symbols") * 2 > solid) | (g("word_chars") * 3 < solid), 4),
        ((g("latin") >= 20) & (g("vowels") * 100 < g("latin") * 18) & (g("ideographs") == 0), 4),
        ((tokens >= 2) & (g("noise") * 2 > solid) & (common * 8 <= words), 4),
        ((separators >= 4) & (pure <= 4.5 * (separators + 1)) & (common * 12 <= words) & (g("ideographs") * 3 < solid), 3),
        (marked & (pure <= 9) & ~(ends_stop & (pure > 5)) & (common * 4 <= words), 3),
        ((pure <= 7) & (g("ideographs") <= 12) & (stops == 0), 5),
    ]
    return np.select([r for r, _ in rules], [k for _, k in rules], 1)


def closed(f: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``SUMS`` of whole lines, one row each."""
    kind = line_kinds(f, e)
    out = np.zeros((len(f), len(SUMS)), np.int64)
    lined = f[:, _AT["raw_solid"]] > 0
    solid, short = f[:, _AT["solid"]], kind == 5
    out[:, 0], out[:, 1] = lined, lined & e[:, 2]
    for at, name in enumerate(RAW, 2):
        out[:, at] = f[:, _AT[f"raw_{name}"]]
    for k in range(1, 6):
        out[:, 6 + k] = np.where(kind == k, solid, 0)
    out[:, 12] = np.where(kind > 0, solid, 0)
    out[:, 13], out[:, 14], out[:, 15] = np.where(short, f[:, _AT["words"]], 0), np.where(short, f[:, _AT["common"]], 0), short
    out[:, 16] = np.where(kind > 0, f[:, _AT["stops"]], 0)
    return out


class Fragment:
    """What is known of an open line or part of one: its counts and its outermost characters."""

    __slots__ = ("counts", "head", "tail", "mark", "end", "lead")

    def __init__(self, counts, head: str, tail: str, mark: str, end: str, lead: bool) -> None:
        self.counts, self.head, self.tail = np.array(counts, np.int64), head, tail
        self.mark, self.end, self.lead = mark, end, lead  # characters from the first and up to the last that isn't white space; whether a gap comes before

    @classmethod
    def of(cls, text: str, counts: np.ndarray | None = None) -> Fragment:
        counts = measure([text])[0][0] if counts is None else counts
        return cls(counts, text[:REACH], text[-REACH:], text.lstrip()[:SHORT], text.rstrip()[-SHORT:], edges(text)[3])

    def __add__(self, other: Fragment) -> Fragment:
        both, left, right = measure([self.tail + other.head, self.tail, other.head])[0]
        head = self.head if len(self.head) == REACH else (self.head + other.head)[:REACH]
        tail = other.tail if len(other.tail) == REACH else (self.tail + other.tail)[-REACH:]
        mark = (self.mark + other.head)[:SHORT] if self.mark and len(self.mark) < SHORT else self.mark or other.mark
        if not other.end:
            end = self.end
        else:
            end = other.end if len(other.end) == SHORT else (self.tail + other.end)[-SHORT:]
        lead = self.lead if self.mark else bool(other.mark) and (edges(self.tail + other.head)[3] if other.head.strip() else True)
        return Fragment(self.counts + other.counts + both - left - right, head, tail, mark, end, lead)

    def close(self) -> np.ndarray:
        e = (bool(_MARKED.match(self.mark)), bool(_SENTENCE_END.search(self.end)), bool(_LINE_END.search(self.end)), self.lead)
        return closed(self.counts[None], np.array([e], bool))[0]

    def pack(self) -> list:
        return [self.counts.tolist(), self.head, self.tail, self.mark, self.end, self.lead]


class Shingles:
    """Occurrences and characters of the ``SAMPLE`` distinct shingles of smallest hash; characters of all."""

    __slots__ = ("hashes", "counts", "chars", "total")

    def __init__(self, hashes=(), counts=(), chars=(), total: int = 0) -> None:
        self.hashes, self.counts, self.chars = np.array(hashes, np.uint64), np.array(counts, np.int64), np.array(chars, np.int64)
        self.total = total

    def plus(self, hashes: np.ndarray, counts: np.ndarray, chars: np.ndarray, total: int) -> Shingles:
        out = Shingles(total=self.total + total)
        out.hashes, at = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        out.counts, out.chars = (np.bincount(at, np.concatenate(both), len(out.hashes)).astype(np.int64) for both in ((self.counts, counts), (self.chars, chars)))
        out.hashes, out.counts, out.chars = out.hashes[:SAMPLE], out.counts[:SAMPLE], out.chars[:SAMPLE]
        return out

    def repeated(self) -> float:
        """Characters of the repeated shingles. What isn't repeated is carried on from the sample: a few repeated ones need not be in it."""
        single = float(self.chars[self.counts < OFTEN].sum())
        if len(self.hashes) == SAMPLE:  # of SAMPLE - 1 below the last hash
            single = float(self.chars[:-1][self.counts[:-1] < OFTEN].sum()) / ((float(self.hashes[-1]) + 1) / 2.0**64)
        return max(self.total - single, 0.0)

    def pack(self) -> list:
        return [self.hashes.tolist(), self.counts.tolist(), self.chars.tolist(), self.total]


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(EDGE)], np.uint64)


def _hashed(keys: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, evenly spread over 64 bits."""
    n = len(keys) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h += keys[i : i + n] * _FACTORS[i]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


class Summary:
    """What is known of a chunk: sums over its closed lines, word bins and shingles of its closed words, and its open first and last line.

    The first and the last word are open. ``first`` and ``last`` hold ``EDGE`` words each, as their first
    characters and length; a chunk of at most twice as many words has all in ``first`` and none closed.
    """

    __slots__ = ("sums", "bins", "short", "long", "first", "last", "head", "tail", "left", "right")

    def __init__(self) -> None:
        self.sums = np.zeros(len(SUMS), np.int64)
        self.bins = np.zeros(BINS, np.int64)
        self.short, self.long = Shingles(), Shingles()  # of SHINGLE and EDGE words
        self.first: list[tuple[str, int]] = []
        self.last: list[tuple[str, int]] | None = None
        self.head: Fragment | None = None  # the only line if tail is None
        self.tail: Fragment | None = None
        self.left = self.right = False  # begins, ends inside a word

    def close_words(self, words: list[tuple[str, int]], lo: int, hi: int, begin: int = 0, end: int | None = None, whole: bool = False) -> None:
        """Words ``lo`` to ``hi`` are closed now, those from ``begin`` to ``end`` were or are: count the former, and the shingles with one of them.

        Shingles of a ``whole`` text are left out where words that come often enough are too few to make it a case.
        """
        end = len(words) if end is None else end
        if lo >= hi:
            return
        keys = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w, _ in words), np.uint64, len(words))
        at = keys[lo:hi].astype(np.int64) % BINS
        self.bins += np.bincount(at, minlength=BINS)
        lengths = np.fromiter((n for _, n in words), np.int64, len(words))
        if whole and lengths[self.bins[at] >= OFTEN].sum() * 2 <= lengths.sum():
            return
        chars = np.concatenate([[0], np.cumsum(lengths)])
        for name, width, inner in (("short", SHINGLE, 0), ("long", EDGE, 1)):
            a, b = max(begin, lo - width + 1), min(end - width + 1, hi)
            if a < b:
                at = np.arange(a, b)
                weight = chars[at + width - inner] - chars[at + inner]  # of a longer one: what its two shorter ones share
                setattr(self, name, getattr(self, name).plus(_hashed(keys[a : b + width - 1], width), np.ones(b - a, np.int64), weight, int(weight.sum())))

    def open_words(self, words: list[tuple[str, int]]) -> None:
        """Take the words of a text of which none is counted yet."""
        self.first = words
        if len(words) > 2 * EDGE:
            self.close_words(words, 1, len(words) - 1, 1, len(words) - 1)
            self.first, self.last = words[:EDGE], words[-EDGE:]

    def covered(self) -> float:
        """Characters of words in repeated shingles: neighbours in a run of such share all words but two."""
        return self.short.repeated() - self.long.repeated()

    def pack(self) -> str:
        return json.dumps([self.sums.tolist(), self.bins.tolist(), self.short.pack(), self.long.pack(), self.first, self.last, self.head.pack(), self.tail and self.tail.pack(), self.left, self.right])

    @classmethod
    def unpack(cls, packed: str) -> Summary:
        self = cls()
        sums, bins, short, long, self.first, self.last, head, tail, self.left, self.right = json.loads(packed)
        self.sums, self.bins = np.array(sums, np.int64), np.array(bins, np.int64)
        self.short, self.long = Shingles(*short), Shingles(*long)
        self.head, self.tail = Fragment(*head), tail and Fragment(*tail)
        return self


def summarise(chunk: str, whole: bool = False) -> Summary:
    """The summary of one chunk; ``merge`` puts summaries of consecutive chunks together, not that of a ``whole`` text."""
    out = Summary()
    words = [(word[:WORD], len(word)) for word in _WORD.findall(chunk.lower())]
    if whole:
        out.close_words(words, 0, len(words), whole=True)
    else:
        out.open_words(words)
    lines = _LINES.split(chunk)
    counts = measure(lines)[0]
    out.head = Fragment.of(lines[0], counts[0])
    if len(lines) > 1:
        out.tail = Fragment.of(lines[-1], counts[-1])
        if len(lines) > 2:
            out.sums += closed(counts[1:-1], np.array([edges(line) for line in lines[1:-1]], bool)).sum(0)
    out.left, out.right = bool(_RUN.match(chunk[:1])), bool(_RUN.match(chunk[-1:]))
    return out


def _merge_words(out: Summary, a: Summary, b: Summary) -> None:
    """The words of ``a`` and ``b``: one that was cut in two is joined, those at the cut are closed."""
    out.bins = a.bins + b.bins
    for name in ("short", "long"):
        x, y = getattr(a, name), getattr(b, name)
        setattr(out, name, x.plus(y.hashes, y.counts, y.chars, y.total) if y.total else x)
    x, y = a.first if a.last is None else a.last, b.first
    if a.right and b.left:
        words = [*x[:-1], ((x[-1][0] + y[0][0])[:WORD], x[-1][1] + y[0][1]), *y[1:]]
    else:
        words = [*x, *y]
    if a.last is None and b.last is None:
        return out.open_words(words)
    lo, begin = (1, 1) if a.last is None else (EDGE - 1, 0)
    hi, end = (len(words) - 1, len(words) - 1) if b.last is None else (len(words) - EDGE + 1, len(words))
    out.close_words(words, lo, hi, begin, end)
    out.first = words[:EDGE] if a.last is None else a.first
    out.last = words[-EDGE:] if b.last is None else b.last


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of two neighbouring chunks; associative."""
    out = Summary()
    out.sums = a.sums + b.sums
    _merge_words(out, a, b)
    # A chunk that lies inside a word begins and ends in it; an empty one is inside where its neighbour is.
    out.left = a.left if a.head.head or a.tail else b.left
    out.right = b.right if b.head.head or b.tail else a.right
    line = (a.tail or a.head) + b.head
    if a.tail is None and b.tail is None:
        out.head = line
    elif a.tail is None:
        out.head, out.tail = line, b.tail
    elif b.tail is None:
        out.head, out.tail = a.head, line
    else:
        out.sums = out.sums + line.close()
        out.head, out.tail = a.head, b.tail
    return out


STATISTICS = ("words", "mean_word_length", "symbol_ratio", "punct_line_share", "common_share", "kind")


def derive(summary: Summary) -> tuple[int, float | None, float | None, float | None, float | None, str | None]:
    """``STATISTICS`` of a whole text; ratios without anything to count are null, ``kind`` is null for prose and blank texts."""
    whole = Summary()
    whole.bins, whole.short, whole.long = summary.bins.copy(), summary.short, summary.long
    if summary.last is None:
        whole.close_words(summary.first, 0, len(summary.first))
    else:
        whole.close_words(summary.first, 0, 1)
        whole.close_words(summary.last, EDGE - 1, EDGE)
    sums = summary.sums + sum(f.close() for f in (summary.head, summary.tail) if f is not None)
    return _result(sums, int((whole.bins > 0).sum()), whole.covered())


def _result(sums: np.ndarray, used: int, covered: float) -> tuple:
    s = dict(zip(SUMS, sums.tolist()))
    ratio = lambda a, b: a / b if b else None
    return (s["words"], ratio(s["word_chars"], s["words"]), ratio(s["symbols"], s["solid"]), ratio(s["punct_lines"], s["lines"]), ratio(s["common"], s["words"]), _kind(s, used, covered))


def _kind(s: dict[str, int], used: int, covered: float) -> str | None:
    solid = s["all_chars"]
    if not solid:
        return None
    if covered * 2 > s["word_chars"] and s["table_chars"] * 2 <= solid:
        return "junk"  # one fragment over and over
    if s["words"] >= 12 and used * 5 <= s["words"] and used <= 24 and s["table_chars"] * 2 <= solid:
        return "junk"  # the same few words
    short = s["short_chars"]
    # Short lines with common words and sentence ends are a narrow paragraph.
    as_prose = s["short_common"] * 12 >= s["short_words"] or s["short_lines"] < 3 or s["stops"] * 8 >= s["short_lines"]
    listed = s["list_chars"] + (0 if as_prose else short)
    groups = {"table": s["table_chars"], "list": listed, "junk": s["junk_chars"]}
    if sum(groups.values()) * 2 <= solid:
        return None
    return max(KINDS, key=lambda k: groups[k])


def statistics(texts: list[str | None], most: int = 2_000_000) -> list[tuple]:
    """``STATISTICS`` of many whole texts, as ``derive(summarise(text))`` gives them, some ``most`` characters at a time."""
    out: list[tuple] = []
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end] or "")
            end += 1
        out += _statistics([t or "" for t in texts[at:end]])
        at = end
    return out


def _statistics(texts: list[str]) -> list[tuple]:
    lines, holder, edge = [], [], []
    for i, text in enumerate(texts):
        for line in _LINES.split(text):
            if line and not line.isspace():
                lines.append(line)
                holder.append(i)
                edge.append(edges(line))
    if not lines:
        return [_result(np.zeros(len(SUMS), np.int64), 0, 0.0) for _ in texts]
    counts, tokens, sizes = measure(lines)
    holder = np.array(holder)
    sums = np.zeros((len(texts), len(SUMS)), np.int64)
    starts = np.flatnonzero(np.append(True, holder[1:] != holder[:-1]))
    sums[holder[starts]] = np.add.reduceat(closed(counts, np.array(edge, bool)), starts)
    # Words of all texts in one array; texts of which words that come often make up half the characters are looked at for shingles.
    _, keys, lengths, ends = _tokens.ready()
    words = ends[tokens + 1] - ends[tokens]
    index = np.repeat(ends[tokens] - np.cumsum(words) + words, words) + np.arange(words.sum())
    text_of = np.repeat(np.repeat(holder, sizes), words)
    key, length = keys[index], lengths[index]
    bins = np.unique(text_of * BINS + (key % np.uint64(BINS)).astype(np.int64))
    used = np.bincount(bins // BINS, minlength=len(texts))
    named, which, times = np.unique((text_of.astype(np.uint64) << np.uint64(32)) | key, return_inverse=True, return_counts=True)
    often = times[which] >= OFTEN
    repeated = np.bincount(text_of, length * often, len(texts)) * 2 > np.bincount(text_of, length, len(texts))
    return [_result(sums[i], int(used[i]), summarise(text, whole=True).covered() if repeated[i] else 0.0) for i, text in enumerate(texts)]


def chunks(text: str, size: int) -> Iterator[str]:
    """Cuts of ``size`` characters, anywhere."""
    for at in range(0, max(1, len(text)), size):
        yield text[at : at + size]


def text_statistics(df: DataFrame, key: str, text: str, chunk: int = 1_000_000, fan: int = 64) -> DataFrame:
    """``(<key>, words, mean_word_length, symbol_ratio, punct_line_share, common_share, kind)`` per input row.

    ``symbol_ratio`` is symbols to characters other than white space, ``punct_line_share`` and
    ``common_share`` are of the lines that aren't blank and of the words. Null, empty and blank texts
    have 0 words, null ratios and no kind. The table is read once: results of ordinary texts and the
    chunks of those over ``chunk`` characters are written to the checkpoint folder. Only chunks are
    shuffled: they spread over the cluster and come back together in groups of ``fan``, level by level.
    """
    kind = df.schema[key].dataType.simpleString()
    result = "words bigint, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, kind string"
    types = [pa.int64(), *[pa.float64()] * 4, pa.string()]
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    columns = lambda found: [pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * len(types), types)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            huge = np.array([len(t or "") > chunk for t in texts], bool)
            small = pa.array(np.flatnonzero(~huge))
            if len(small):
                n = len(small)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(small), batch.column(1).take(small), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *columns(statistics([texts[i.as_py()] for i in small]))], names=["row", "key", "n", "text", *STATISTICS])
            for row in np.flatnonzero(huge):
                for n, part in enumerate(chunks(texts[row], chunk)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([n], pa.int64()), pa.array([part]), *(pa.nulls(1, t) for t in types)], names=["row", "key", "n", "text", *STATISTICS])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([summarise(t.as_py()).pack() for t in batch.column(3)], pa.string())], names=["row", "key", "n", "state"])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        parts = [Summary.unpack(packed) for packed in table.column("state").to_pylist()]
        while len(parts) > 1:
            parts = [merge(*pair) if len(pair) == 2 else pair[0] for pair in (parts[i : i + 2] for i in range(0, len(parts), 2))]
        one = table.slice(0, 1)
        return pa.table({"row": one.column("row"), "key": one.column("key"), "n": pa.array([one.column("n")[0].as_py() // fan], pa.int64()), "state": [parts[0].pack()]})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns([derive(Summary.unpack(p.as_py())) for p in batch.column(3)])], names=["key", *STATISTICS])

    state = f"row bigint, key {kind}, n bigint, state string"
    once = checkpoint(rows.mapInArrow(first, f"row bigint, key {kind}, n bigint, text string, {result}"))
    level = once.where("n is not null").select("row", "key", "n", "text").repartition("row", "n").mapInArrow(each, state)
    levels = max(1, -(-(31 - max(1, chunk.bit_length() - 1)) // max(1, fan.bit_length() - 1)))
    for _ in range(levels):  # enough for the longest string there can be
        level = level.groupBy("row", F.floor(F.col("n") / fan).alias("up")).applyInArrow(fold, state)
    ordinary = once.where("n is null").select("key", *STATISTICS)
    return ordinary.unionByName(level.mapInArrow(finish, f"key {kind}, {result}")).withColumnRenamed("key", key)
