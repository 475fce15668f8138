"""Statistics of each text, the fixed-threshold rules that it fails, and what most of it is.

All texts of an Arrow batch are one buffer of bytes. Words, lines and the runs of
lines between blank ones are index ranges of it, and every statistic is a
difference of prefix sums at their bounds, so no Python runs a text, a line or a
word at a time.

The rules hold at two levels. Each run of lines is tested for length, symbols,
bullets, fields, punctuation, common and repeated words; the first rule that it
fails names its class and is recorded. A document fails by its own statistics,
and by ``running sentences`` where less than half of it passes the rules of runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
COMMON = """the of to in and a that was for is by as with on at from this be it not are were had has have which while will would
    could their there than or an but its into after before between because so when we our they who what if
    der die das und zu den von ist sich auf für dass dem des ein eine im nicht mit aus was wie um es war wird bei auch denn
    le la les de et en du à que pour un une dans est au aux sur par ce qui ne pas il elle mais plus avec a été sont
    el los las y por con se al lo como del su más es una para mientras aunque desde sin""".split()

#: Common words of Dutch, Italian, Portuguese, Polish, Czech, Turkish, Swedish, Danish, Finnish, Hungarian,
#: Romanian, Indonesian, Russian, Ukrainian, Greek, Arabic and Hebrew.
COMMON_ELSEWHERE = """het een van niet zijn voor ook maar che di il della sono nel alla gli não uma dos com mais foi
    nie się jest oraz przez jak ale že není jako byl své bir bu ve için olarak ile çok och att som är inte det på til ikke af
    ja on ei oli että hogy nem az és egy și nu este pentru dan yang untuk dengan tidak dari
    и в не на что с по как это к и й що на та є до και το να της του στο في من على أن إلى של את על לא הוא""".split()

#: Characters that stand for others: spaces, none, dashes, marks of items, quotes, ends of sentences, signs.
SPELLED = (
    ("[\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]", " "),
    ("[\u200b-\u200d\u2060\ufeff\xad]", ""),
    ("[\u2013\u2014\u2212]", "-"),
    ("[\u2022\u25e6\u25aa\u2023\xb7]", "*"),
    ('[\xab\xbb\u201c\u201d\u201e]', '"'),
    ('[\u2019\u2018]', "'"),
    ("\u2026", "..."),
    ("[\u3002\uff01\uff1f\u0964\u061f\u06d4]", ". "),
    ("[\u3001\uff0c\uff1b\uff1a]", ", "),
    ("[\u20ac\xa3\xa5]", "$"),
)


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds for natural prose: those of a document as published for web text, and those of a run of lines."""

    min_words: int = 50
    max_words: int = 100_000
    min_mean_word: float = 3.0
    max_mean_word: float = 10.0
    max_symbols_per_word: float = 0.1
    max_bullet_lines: float = 0.9
    max_ellipsis_lines: float = 0.3
    min_alphabetic_words: float = 0.8
    min_common_words: int = 2
    min_prose: float = 0.5
    #: Of a run: most code, symbols and mangled characters a character; most single characters and unpronounceable words a word.
    run_code: float = 0.4
    run_symbols: float = 0.25
    run_mangled: float = 0.04
    run_single: float = 0.6
    run_unpronounceable: float = 0.35
    #: Of a run of 20 words or more: least different words and pairs of words; least common words or punctuation a word.
    run_different: float = 0.2
    run_punctuation: float = 0.04
    run_letters: float = 0.2
    #: Common words a word that make a sentence where no stop ends it.
    sentence_common: float = 0.12


#: Rules of runs of lines in the order of their tests, and the class of what fails them.
RUN_RULES = (
    ("markup", "junk"), ("fields", "table"), ("bullets", "list"), ("code", "junk"), ("symbols", "junk"), ("mangled", "junk"), ("single characters", "junk"),
    ("unpronounceable", "junk"), ("repeated words", "junk"), ("no punctuation or common words", "junk"), ("few letters", "junk"), ("enumeration", "list"),
    ("no sentence", "list"), ("short lines", "list"),
)
_RULE = {name: i for i, (name, _) in enumerate(RUN_RULES)}
PASSED = len(RUN_RULES)
CLASSES = ("prose", "list", "table", "junk")
_CLASS = np.array([CLASSES.index(kind) for _, kind in RUN_RULES] + [0])

MARK = re.compile(rb"^(?:[-*+o\"]|\[[xX]?\]|\(?(?:\d{1,3}|[A-Za-z]|[ivx]{1,5})[.)]|\d{1,2}:\d{2})$")
#: Tags, template marks and statements of code.
MARKUP = re.compile(rb"</?[A-Za-z][^<>\n]*>|\{\{|\}\}|\b(?:var|let|const|function)\b[^.;\n]*[=({]|[;{}]\s*$", re.M)
#: Signs of a missing number.
ABSENT = (b"n.a.", b"n.a", b"n/a", b"na", b"-", b"--", b"---", b"..")
BUFFER = 1 << 18  # bytes of text looked at together


def _bytes(chars: str, high: bool = False) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    t[128:] = high
    return t


_ABC = "abcdefghijklmnopqrstuvwxyz"
_ABC += _ABC.upper()
LETTER = _bytes(_ABC, True)
VOWEL = _bytes("aeiouyAEIOUY", True)  # bytes of other letters count as vowels, so that no accented word looks like one without
NUMERIC = _bytes("0123456789.,:/%-+()[]$\"'*")
HEX = _bytes("0123456789abcdefABCDEFxX")
BASE64 = _bytes(_ABC + "0123456789+/=_-")
PLAIN = _bytes("".join(map(chr, range(33))) + _ABC + "0123456789.,;:!?'\"()-%/", True)
CLOSER, END = _bytes("\"')]"), _bytes(".!?:")
#: Bits of a byte's classes.
SPACE, WORD, DIGIT, SYMBOL, STOP, PAUSE, FIELD, BLANK = (1 << k for k in range(8))
_BITS = (_bytes("\t\n\x0b\x0c\r "), LETTER, _bytes("0123456789"), ~PLAIN, _bytes(".!?"), _bytes(".,;:!?|\n\t"), _bytes("\t|;"), _bytes("\t\x0b\x0c\r "))
CODES = sum(m.astype(np.uint8) << k for k, m in enumerate(_BITS)).astype(np.uint8).tobytes()
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CONSONANTS = (LETTER & ~VOWEL).astype(np.uint8).tobytes()
VOWELS = VOWEL.astype(np.uint8).tobytes()


def _packed(word: bytes) -> int:
    return int.from_bytes(word[:8], "little")


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """Up to eight first and last bytes of ranges, as numbers and as hashes."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.eight[start] & _MASK[np.minimum(end - start, 8)]

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = np.minimum(end - start, 8)
        with np.errstate(over="ignore"):
            h = (self.eight[start] & _MASK[size]) * _MIX ^ (self.eight[end - size] & _MASK[size]) + (end - start).astype(np.uint64)
            h *= _MIX
        return h ^ (h >> np.uint64(29))


def _word_set(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _Words(np.frombuffer(joined, np.uint8)).hashed(starts, ends)


class _Lookup:
    """Places of hashes in a list of words, by a table of their low bits; -1 where there is none."""

    def __init__(self, words: list[str]):
        hashes = _word_set(words)
        self.bits = 16
        while len(np.unique(hashes & np.uint64((1 << self.bits) - 1))) < len(np.unique(hashes)):
            self.bits += 1
        self.low = np.uint64((1 << self.bits) - 1)
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.place[hashes & self.low] = np.arange(len(hashes))
        self.hashes = np.append(hashes, 0)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.place[h & self.low]
        return np.where(self.hashes[at] == h, at, -1)


_KNOWN = _Lookup([*dict.fromkeys(COMMON), *dict.fromkeys(w for w in COMMON_ELSEWHERE if w not in COMMON)])
_FIRST_ELSEWHERE = len(dict.fromkeys(COMMON))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _mapped(buf: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(buf.tobytes().translate(table), np.uint8)


class _At:
    """Counts of sorted places in ranges."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def within(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, end) - np.searchsorted(self.at, start)

    def per(self, starts: np.ndarray) -> np.ndarray:
        """Of the ranges that begin at ``starts``, each up to the next."""
        return np.bincount(np.searchsorted(starts, self.at, "right") - 1, minlength=len(starts))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the mask begins and ends with False."""
    at = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return at[::2].copy(), at[1::2].copy()


def _flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all ranges one after the other, and for each which range it is of."""
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + starts[which], which


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a line end and the texts, two line ends after each, and where each text starts."""
    texts = pc.binary_join_element_wise(texts, "\n\n", "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.concatenate([np.array([10], np.uint8), data]), (offsets[:-1] - offsets[0] + 1).astype(np.int64)


def _replaced(texts: pa.Array, rows: np.ndarray, patterns: tuple) -> pa.Array:
    some = texts.take(pa.array(rows))
    for pattern, by in patterns:
        some = pc.replace_substring_regex(some, pattern, by)
    mask = np.zeros(len(texts), bool)
    mask[rows] = True
    return pc.replace_with_mask(texts, pa.array(mask), some)


def _spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with every character of SPELLED as its plain one, without carriage returns and marks of quoted lines."""
    buf, starts = _buffer(texts)

    def rows_of(at: np.ndarray) -> np.ndarray:
        return np.unique(np.searchsorted(starts, at, "right") - 1)

    special = np.flatnonzero((buf >= 0x80) | (buf == 13))  # a byte beyond ASCII, or a carriage return
    if len(special):
        texts = _replaced(texts, rows_of(special), (*SPELLED, ("\r\n?", "\n")))
        buf, starts = _buffer(texts)
    quoted = np.flatnonzero((buf[:-1] == 62) & ((buf[1:] == 32) | (buf[1:] == 9)))
    if len(quoted):
        texts = _replaced(texts, rows_of(quoted), ((r"(?m)^[ \t]*(?:>[ \t]+)+", ""),))
        buf, starts = _buffer(texts)
    return buf, starts


class Batch:
    """The statistics of the texts of one buffer."""

    def __init__(self, texts: pa.Array, rules: Rules):
        self.rules = rules
        self.buf, self.docs = _spelled(texts)
        buf = self.buf
        self.code = code = _mapped(buf, CODES)
        self.raw8, self.low8 = _Words(buf), _Words(_mapped(buf, LOWERED))
        self.ts, self.te = _runs((code & SPACE) == 0)  # tokens
        self.ws, self.we = _runs((code & WORD) != 0)  # words of letters
        ends = np.flatnonzero(buf == 10)
        self.ls, self.le = ends[:-1] + 1, ends[1:]  # lines, without their ends
        bounds = np.searchsorted(self.ts, np.append(self.ls, len(buf)))
        self.first, self.last = bounds[:-1], bounds[1:]  # tokens of each line
        self.n = self.last - self.first
        at = np.flatnonzero((code & STOP) != 0)
        after = np.append(at, 0)[:-1] + 1
        self.stop = _At(at[((code[after] & SPACE) != 0) | CLOSER[buf[after]]])
        self.pause, self.symbol, self.digit = (_At(np.flatnonzero((code & k) != 0)) for k in (PAUSE, SYMBOL, DIGIT))
        high = buf.view(np.int8)
        self.inner = _At(np.flatnonzero(high < -64))  # bytes within a character
        # Kana and ideographs, which no spaces part, begin with E3 to E9.
        self.ideograph = _At(np.flatnonzero((high >= -29) & (high <= -23)))
        self._tokens()
        self._words()
        self._lines()
        self._segments()

    def _tokens(self) -> None:
        s, e = self.ts, self.te
        length = e - s
        self.size = length - self.inner.per(s) if len(s) and len(self.inner.at) else length
        digits = self.digit.per(s) if len(s) else length
        self.number = np.zeros(len(s), bool)
        some = np.flatnonzero(digits)
        at, of = _flat(s[some], length[some])
        self.number[some] = np.bincount(of, NUMERIC[self.buf[at]], minlength=len(some)) == length[some]
        tiny = np.flatnonzero((length <= 4) & (digits == 0))
        self.number[tiny] = np.isin(self.raw8.first(s[tiny], e[tiny]), [_packed(x) for x in ABSENT])
        first, last = self.buf[s], self.buf[e - 1]
        self.lettered = LETTER[first]
        other = np.flatnonzero(~self.lettered)
        self.lettered[other] = np.searchsorted(self.ws, e[other]) > np.searchsorted(self.ws, s[other])
        code = np.zeros(len(s), bool)
        long = np.flatnonzero((self.size >= 16) | (self.size >= 6) & HEX[first] & HEX[last] & HEX[self.buf[np.minimum(s + 2, e - 1)]])
        if len(long):
            at, of = _flat(s[long], length[long])
            b, whole, size = self.buf[at], length[long], self.size[long]
            full = lambda mask: np.bincount(of, mask, minlength=len(long)) == whole
            plain = 2 * np.bincount(of, b >= 0x80, minlength=len(long)) <= whole
            code[long] = full(HEX[b]) | plain & ((size >= 16) & (digits[long] > 0) & self.lettered[long] & full(BASE64[b]) | (size >= 26))
        self.coded = _prefix(np.where(code, self.size, 0))
        self.part_end = (last == 44) | (last == 59)  # a comma or semicolon before a space
        self.chars, self.single, self.numbers = _prefix(self.size), _prefix(self.size == 1), _prefix(self.number)

    def _words(self) -> None:
        self.hash = self.low8.hashed(self.ws, self.we)
        self.place = _KNOWN(self.hash)
        self.common = _prefix((self.place >= 0) & (self.place < _FIRST_ELSEWHERE))
        self.usual = _prefix(self.place >= 0)
        self.letters = _prefix(self.we - self.ws)

    def _unpronounceable(self, some: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """Of the runs ``some``, whose words are w0..w1: whether too many of their words of four letters or more have five
        consonants in a row, or one vowel in more than five letters."""
        out = np.zeros(len(w0), bool)
        if not len(some):
            return out
        if not hasattr(self, "consonant"):
            c = _mapped(self.buf, CONSONANTS).view(bool)
            self.consonant = np.flatnonzero(c[:-4] & c[1:-3] & c[2:-2] & c[3:-1] & c[4:])
            self.vowel = _prefix(_mapped(self.buf, VOWELS))
        at, of = _flat(w0[some], (w1 - w0)[some])
        s, e = self.ws[at], self.we[at]
        long = e - s >= 4
        five = np.searchsorted(self.consonant, e) > np.searchsorted(self.consonant, s)
        hard = long & (five | (5 * (self.vowel[e] - self.vowel[s]) < e - s))
        count = np.bincount(of, long, minlength=len(some))
        out[some] = (count >= 5) & (np.bincount(of, hard, minlength=len(some)) > self.rules.run_unpronounceable * count)
        return out

    def _lines(self) -> None:
        """Marks of items, ends of sentences, fields, and the runs of visible lines."""
        seen = np.flatnonzero(self.n > 0)
        self.seen, f, z = seen, self.first[seen], self.last[seen]
        self.doc = np.searchsorted(self.docs, self.ls[seen], "right") - 1
        self.block = np.cumsum(self.n == 0)[seen]
        head = self.raw8.first(self.ts[f], self.te[f])
        n, length, last = self.n[seen], self.te[f] - self.ts[f], self.buf[self.te[f] - 1]
        likely = np.flatnonzero((n > 1) & (length <= 8) & ((length == 1) | np.isin(last, list(b".)]0123456789"))))
        different, which = np.unique(head[likely], return_inverse=True)
        marks = np.array([bool(MARK.match(int(x).to_bytes(8, "little").rstrip(b"\0"))) for x in different], bool)
        boxed = (head == _packed(b"[")) & (n > 2)
        boxed[boxed] = self.raw8.first(self.ts[f[boxed] + 1], self.te[f[boxed] + 1]) == _packed(b"]")
        self.mark = boxed.copy()
        self.mark[likely] |= marks[which]
        self.skip = np.where(boxed, 2, np.where(self.mark, 1, 0))
        at = self.te[z - 1] - 1
        for _ in range(4):
            at = np.where(CLOSER[self.buf[at]] & (at > self.ts[f]), at - 1, at)
        self.final = END[self.buf[at]]
        self.b0, self.b1 = self.ts[np.minimum(f + self.skip, z - 1)], self.te[z - 1]
        self.stops = self.stop.within(self.b0, self.b1)
        self.digits = self.digit.within(self.b0, self.b1)

    def _fields(self) -> tuple[np.ndarray, np.ndarray]:
        """Fields of each visible line and those that are numbers, where it has a row's form; 0 else."""
        buf, f, z = self.buf, self.first[self.seen], self.last[self.seen]
        code = self.code
        parts = (code & FIELD) != 0
        blank = (code & BLANK) != 0
        parts[:-1] |= blank[:-1] & blank[1:]
        comma = np.flatnonzero(buf == 44)
        parts[comma[(code[comma + 1] & SPACE) == 0]] = True
        fields, numbers = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
        inside = np.flatnonzero(parts)
        line = np.searchsorted(self.b0, inside, "right") - 1
        some = np.unique(line[(line >= 0) & (inside < self.b1[line])]) if len(f) else np.zeros(0, np.int64)
        if len(some):
            a, z1 = self.ts[f[some]], self.te[z[some] - 1]
            at, of = _flat(a, z1 - a)
            apart = _prefix(parts[at])[:-1]
            content = ~parts[at] & ((code[at] & SPACE) == 0)
            at, of, apart = at[content], of[content], apart[content]
            new = np.ones(len(at), bool)
            new[1:] = (of[1:] != of[:-1]) | (apart[1:] != apart[:-1])
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(at))
            owner, first = of[begin], at[begin]
            numeric, digits = _prefix(NUMERIC[buf[at]]), _prefix((code[at] & DIGIT) != 0)
            size = stop - begin
            number = (digits[stop] - digits[begin] > 0) & (numeric[stop] - numeric[begin] == size)
            number |= (size <= 4) & np.isin(self.raw8.first(first, first + size), [_packed(x) for x in ABSENT])
            fields[some] = np.bincount(owner, minlength=len(some))
            numbers[some] = np.bincount(owner, number, minlength=len(some)).astype(np.int64)
        few = fields < 3
        fields[few], numbers[few] = 0, 0
        # A row of words and trailing numbers.
        other = np.maximum.accumulate(np.where(self.number, -1, np.arange(len(self.number)))) if len(self.number) else np.zeros(0, np.int64)
        tail = z - 1 - np.maximum(other[z - 1], f - 1) if len(f) else np.zeros(0, np.int64)
        rows = few & (tail >= 2) & (3 * tail >= z - f)
        fields[rows], numbers[rows] = tail[rows] + 1, tail[rows]
        return fields, numbers

    def _rows(self) -> np.ndarray:
        """Whether a visible line is a row: a layout in common with a neighbour, numbers in most fields, or the heads of columns."""
        n, k = self._fields()
        same = np.append(self.block[1:] == self.block[:-1], False)
        full = (n >= 3) & (2 * k >= n - 1)

        def near(test) -> np.ndarray:
            out = np.zeros(len(n), bool)
            here = np.flatnonzero(same)
            out[here] |= test(here + 1, here)
            out[here + 1] |= test(here, here + 1)
            return out

        row = (n >= 3) & (full | near(lambda m, i: full[m] & (np.abs(n[m] - n[i]) <= 1)))
        row &= ~((k == 0) & ~near(lambda m, i: n[m] == n[i]) & (self.stops > 0))
        opening = np.append(True, ~same[:-1]) if len(n) else same
        return row | (near(lambda m, i: full[m]) & (self.stops == 0) & (opening | (n > 0)) & (self.digits >= 4) & ~self.mark)

    def _markup(self) -> np.ndarray:
        """Whether a visible line is of a run of tags and code."""
        out = np.zeros(len(self.seen), bool)
        open_tag = (self.buf == 60) | (self.buf == 123)
        if not open_tag.any():
            return out
        begin = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1])) if len(out) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(out))
        marks, braces = _At(np.flatnonzero(open_tag)), _At(np.flatnonzero(self.buf == 123))
        head = marks.within(self.ls[self.seen[begin]], self.b1[begin]) > 0
        foot = braces.within(self.b0[stop - 1], self.b1[stop - 1]) > 0
        for i in np.flatnonzero(head | foot):
            text = self.buf[self.ls[self.seen[begin[i]]] : self.b1[stop[i] - 1]].tobytes()
            out[begin[i] : stop[i]] = len(MARKUP.findall(text)) >= 0.7 * (stop[i] - begin[i])
        return out

    def _enumerated(self, a: np.ndarray, z: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether the tokens a..z are one run of short phrases between commas or semicolons."""
        out = np.zeros(len(a), bool)
        cuts = _prefix(self.part_end)
        inner = cuts[np.maximum(z - 1, a)] - cuts[a]  # the last token's mark divides nothing
        some = np.flatnonzero((inner >= 4) & (stops <= 1) & (z - a <= 5 * (inner + 1)))
        if len(some):
            at, of = _flat(a[some], z[some] - a[some])
            end = self.part_end[at]
            end[np.cumsum(z[some] - a[some]) - 1] = True
            where = np.flatnonzero(end)
            size = np.diff(np.append(-1, where))
            short = np.bincount(of[where], size <= 4, minlength=len(some))
            parts = np.bincount(of[where], minlength=len(some))
            out[some] = short >= parts // 2 + 1
        return out

    def _between(self, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Sums over the words that begin in s..e."""
        return sums[np.searchsorted(self.ws, e)] - sums[np.searchsorted(self.ws, s)]

    def _segments(self) -> None:
        """The rule that each run of lines fails, and its visible characters."""
        r, seen = self.rules, self.seen
        a, z = self.first[seen] + self.skip, self.last[seen]
        rule = np.full(len(seen), -1)
        rule[self._rows()] = _RULE["fields"]
        rule[self._markup()] = _RULE["markup"]
        n = z - a
        usual = self._between(self.usual, self.b0, self.b1)
        sentence = np.where(self.final, n >= 4, (n >= 12) & (usual >= r.sentence_common * n))
        items = (rule < 0) & self.mark
        item = items & (~sentence | self._enumerated(a, z, self.stops))
        rule[item] = _RULE["bullets"]
        free = rule < 0
        # A run of free lines goes on in the next line of its block, unless that begins with a mark.
        goes_on = np.zeros(len(seen), bool)
        goes_on[1:] = free[1:] & free[:-1] & (self.block[1:] == self.block[:-1]) & ~self.mark[1:]
        begin = np.flatnonzero(free & ~goes_on)
        after = np.flatnonzero(free & ~np.append(goes_on[1:], False)) + 1
        bad = self._tested(begin, after, a, z, usual)
        whole = rule >= 0
        chars = self.chars
        f = self.first[seen]
        self.parts = np.concatenate([chars[z[whole]] - chars[f[whole]], chars[z[after - 1]] - chars[a[begin]]]) if len(seen) else np.zeros(0, np.int64)
        self.part_rule = np.concatenate([rule[whole], bad])
        self.part_doc = np.concatenate([self.doc[whole], self.doc[begin]])

    def _tested(self, begin: np.ndarray, after: np.ndarray, a: np.ndarray, z: np.ndarray, usual_in_line: np.ndarray) -> np.ndarray:
        """For runs of the visible lines begin..after the first rule failed, or PASSED."""
        r = self.rules
        if not len(begin):
            return np.zeros(0, np.int64)
        t0, t1 = a[begin], z[after - 1]
        s, e = self.b0[begin], self.b1[after - 1]
        n, k = t1 - t0, after - begin
        size = self.chars[t1] - self.chars[t0]
        w0, w1 = np.searchsorted(self.ws, s), np.searchsorted(self.ws, e)
        words = w1 - w0
        common, usual = self.common[w1] - self.common[w0], self.usual[w1] - self.usual[w0]
        letters, apart = self.letters[w1] - self.letters[w0], self.ideograph.within(s, e)
        pauses, stops = self.pause.within(s, e), self.stop.within(s, e)
        length = n + apart // 2  # words that no spaces part are about two characters
        by_line = lambda values, how: how.reduceat(values, np.column_stack([begin, after]).ravel()[: 2 * len(begin) - (after[-1] == len(a))])[::2]
        ended = by_line(self.final.astype(np.int64), np.add)
        longest = by_line(z - a, np.maximum)
        tests = {
            "code": self.coded[t1] - self.coded[t0] > r.run_code * size,
            "symbols": self.symbol.within(s, e) > r.run_symbols * size,
            "mangled": self._mangled(s, e) > r.run_mangled * size,
            "single characters": (n >= 8) & (self.single[t1] - self.single[t0] > r.run_single * n),
            "unpronounceable": self._unpronounceable(np.flatnonzero((usual < 0.1 * words) & (words >= 5)), w0, w1),
            "repeated words": self._repeated(w0, w1),
            "no punctuation or common words": (words >= 20) & (usual < r.run_punctuation * words) & (pauses < r.run_punctuation * words),
            "few letters": (letters < r.run_letters * size) & (self.numbers[t1] == self.numbers[t0]),
            "enumeration": self._enumerated(t0, t1, stops),
        }
        rule = np.full(len(begin), PASSED)
        for name in reversed(tests):
            rule[tests[name]] = _RULE[name]
        final = self.final[after - 1]
        sentence = np.where(final, length >= 4, (n >= 12) & (usual >= r.sentence_common * n)) | (n >= 5) & (usual >= r.sentence_common * n) & (k > 1)
        rule[(rule == PASSED) & ~sentence] = _RULE["no sentence"]
        short = (k >= 3) & (n <= 6 * k) & (longest <= 8) & (4 * np.maximum(ended, stops) <= k) & ((common < 0.2 * n) | (n <= 5 * k))
        rule[(rule == PASSED) & short] = _RULE["short lines"]
        return rule

    def _mangled(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Marks of text that was decoded in another encoding than its own."""
        b = self.buf
        here = np.flatnonzero((b == 0xC3) | (b == 0xEF))  # each text ends with two line ends
        one, two = b[here + 1], b[here + 2]
        c3, ef = b[here] == 0xC3, b[here] == 0xEF
        bad = c3 & ((one == 0x83) | (one == 0x82) | (one == 0xA2) & ((two == 0x24) | (two == 0xE2)) | (one == 0xAF) & (two == 0xC2)) | ef & (one == 0xBF) & (two == 0xBD)
        at = here[bad]
        return np.searchsorted(at, e) - np.searchsorted(at, s)

    def _repeated(self, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """Whether a run of 20 words or more says the same again and again."""
        least, out = self.rules.run_different, np.zeros(len(w0), bool)
        some = np.flatnonzero(w1 - w0 >= 20)
        if not len(some):
            return out
        at, of = _flat(w0[some], w1[some] - w0[some])
        taken = np.zeros((len(some), 1024), bool)  # a word takes a slot, so slots are at most the different words
        taken[of, self.hash[at] & np.uint64(1023)] = True
        for i in some[taken.sum(1) < least * (w1 - w0)[some]]:
            h = self.hash[w0[i] : w1[i]]
            with np.errstate(over="ignore"):
                pairs = h[1:] * _MIX ^ h[:-1]
            out[i] = len(np.unique(h)) < least * len(h) and len(np.unique(pairs)) < least * len(h)
        return out

    def _dots(self) -> np.ndarray:
        """Where three dots begin, each dot in one of them."""
        b = self.buf
        at = np.flatnonzero(b == 46)
        if not len(at):
            return at
        begin = np.append(True, np.diff(at) > 1)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        return at[(place % 3 == 0) & (b[at + 1] == 46) & (b[at + 2] == 46)]

    def documents(self) -> list[pa.Array]:
        """The columns of FIELDS, one row a text."""
        r, m = self.rules, len(self.docs)
        end_of = np.append(self.docs[1:], len(self.buf))
        tokens, words = (np.searchsorted(x, np.append(self.docs, len(self.buf))) for x in (self.ts, self.ws))
        of = lambda prefix, bounds: prefix[bounds[1:]] - prefix[bounds[:-1]]
        count = lambda doc, weights=None: np.bincount(doc, weights, minlength=m)
        per = lambda x, y: np.divide(x, y, out=np.zeros(m), where=y > 0)
        n, size, lines, n_words = np.diff(tokens), of(self.chars, tokens), count(self.doc), np.diff(words)
        symbols = per(_At(self._dots()).within(self.docs, end_of) + _At(np.flatnonzero(self.buf == 35)).within(self.docs, end_of), n)
        ends = self.te[self.last[self.seen] - 1]
        trailing = (self.buf[ends - 1] == 46) & (self.buf[ends - 2] == 46) & (self.buf[np.maximum(ends - 3, 0)] == 46)
        known = np.flatnonzero(self.place >= 0)
        flags = np.zeros((m, len(_KNOWN.hashes) - 1), bool)
        flags[np.repeat(np.arange(m), of(self.usual, words)), self.place[known]] = True
        different = np.maximum(flags[:, :_FIRST_ELSEWHERE].sum(1), flags[:, _FIRST_ELSEWHERE:].sum(1))
        apart = self.ideograph.within(self.docs, end_of)
        unparted, length = 3 * apart > size, n + apart // 2
        mean, final, bullets = per(size, n), per(count(self.doc, self.final), lines), per(count(self.doc, self.mark), lines)
        ellipses, alphabetic = per(count(self.doc, trailing), lines), per(of(_prefix(self.lettered), tokens), n)
        common = per(of(self.common, words), n_words)
        by_rule = np.bincount(self.part_doc * (PASSED + 1) + self.part_rule, self.parts, minlength=m * (PASSED + 1)).reshape(m, PASSED + 1)
        total = by_rule.sum(1)
        by_class = np.stack([by_rule[:, _CLASS == c].sum(1) for c in range(4)], 1)
        share = [per(by_class[:, c], total) for c in range(4)]
        prose = share[0] >= r.min_prose
        rest = np.array(["junk", "table", "list"])[np.argmax(by_class[:, [3, 2, 1]], 1)]
        shape = np.where((total > 0) & prose, "prose", rest)
        worst = np.array([name for name, _ in RUN_RULES])[np.argmax(by_rule[:, :PASSED], 1)]
        failed = [
            ("too few words", length < r.min_words),
            ("too many words", length > r.max_words),
            ("mean word length", (n > 0) & ~unparted & ~((mean >= r.min_mean_word) & (mean <= r.max_mean_word))),
            ("symbols per word", symbols > r.max_symbols_per_word),
            ("bullet lines", bullets > r.max_bullet_lines),
            ("ellipsis lines", ellipses > r.max_ellipsis_lines),
            ("alphabetic words", (n > 0) & (alphabetic < r.min_alphabetic_words)),
            ("common words", ~unparted & (different < r.min_common_words)),
            (RUNNING, ~prose | (total == 0)),
        ]
        matrix = np.stack([bad for _, bad in failed], 1)
        doc, which = np.nonzero(matrix)
        names = np.array([name for name, _ in failed], object)[which]
        offsets = np.concatenate([[0], np.cumsum(matrix.sum(1))]).astype(np.int32)
        reason = pa.array([w if t > p else None for w, t, p in zip(worst.tolist(), total.tolist(), by_rule[:, PASSED].tolist())], pa.string())
        symbol_share = per(self.symbol.within(self.docs, end_of), size)
        numbers = [mean, symbols, symbol_share, final, bullets, ellipses, alphabetic, common, *share]
        failures = pa.ListArray.from_arrays(pa.array(offsets), pa.array(names.tolist(), pa.string()))
        return [pa.array(n, pa.int64()), pa.array(lines, pa.int64()), *(pa.array(x, pa.float64()) for x in numbers), failures, reason, pa.array(shape.tolist(), pa.string())]


#: The rule by which a document isn't natural prose.
RUNNING = "running sentences"

FIELDS = (
    ("n_words", "bigint"),
    ("n_lines", "bigint"),
    ("mean_word_length", "double"),
    ("symbols_per_word", "double"),
    ("symbol_share", "double"),
    ("final_punctuation_lines", "double"),
    ("bullet_lines", "double"),
    ("ellipsis_lines", "double"),
    ("alphabetic_words", "double"),
    ("common_words", "double"),
    ("prose_share", "double"),
    ("list_share", "double"),
    ("table_share", "double"),
    ("junk_share", "double"),
    ("failed", "array<string>"),
    ("run_rule", "string"),
    ("shape", "string"),
)


def measure(texts: pa.Array, rules: Rules = Rules()) -> pa.RecordBatch:
    """The columns of FIELDS for an array of texts without nulls."""
    return pa.RecordBatch.from_arrays(Batch(texts.cast(pa.string()), rules).documents(), [name for name, _ in FIELDS])


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of BUFFER bytes at most, or a single longer text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    at = 0
    while at < len(texts):
        most = (sizes[at - 1] if at else 0) + BUFFER - 1
        end = max(at + 1, int(np.searchsorted(sizes, most, "right")))
        yield at, end
        at = end


def _measure(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, z in _pieces(b.column(1)):
            piece = b.slice(a, z - a)
            columns = Batch(piece.column(1).cast(pa.string()), rules).documents()
            yield pa.RecordBatch.from_arrays([piece.column(0), *columns], ["doc_id", *(name for name, _ in FIELDS)])


def text_statistics(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows (doc_id, statistics..., failed, run_rule, shape), one for each document with text.

    failed lists the document's rules that the text doesn't meet; run_rule is the rule of runs that most of its characters
    outside prose fail, NULL where all is prose. shape is ``prose`` where at least half of the visible characters are in
    runs that pass, else what most of the rest is: ``list``, ``table`` or ``junk``. A run that a stop ends is a sentence in
    any language; one that none ends is, if enough of its words are common. Characters of SPELLED count as the plain ones.
    Whole texts are read, in place and without a shuffle. Defined results: null texts give no row; empty and blank texts
    have zero statistics and the shape junk; repeated documents give repeated rows; an empty table an empty result;
    other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    return rows.mapInArrow(lambda b: _measure(b, rules), "doc_id bigint, " + ", ".join(f"{n} {k}" for n, k in FIELDS))


def not_prose(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows (doc_id, shape) of the documents that fail the rule of running sentences."""
    return text_statistics(documents, rules).where(F.array_contains("failed", RUNNING)).select("doc_id", "shape")
