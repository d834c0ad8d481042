"""Near-duplicate lines by a segment-partition edit join and a join on rare word groups (operator 3).

Equal lines of any length are one item from the start. Two unequal lines of ``MIN_CHARS`` code
points or more are near-duplicates within ``DISTANCE`` edits of code points, or within one edit of
words per ``WORDS_PER_EDIT`` words of the shorter line, so that the edits grow with the length
(edit: one inserted, deleted or replaced).

* Code points: of two such lines one has ``DISTANCE + 1`` segments of which at least one appears
  in the other unchanged, at a place that the lengths allow. A line is put under the hash of
  (length, segment number, segment), and looks itself up under the substrings that lines of its
  own length and up to ``DISTANCE`` shorter could have there (the multi-match-aware windows: 12
  keys a line at 2 edits).
* Words, up to ``SHARED`` edits: an edit takes one word at most and adds one, so of 2k + 1 shares
  into which the words are dealt by hash, lines within k edits have one with the same words. A line
  is put under the hash of (k, number, words) of each share, and under those of one edit less if a
  line of so few could be within its edits. Shares of hardly any letters are put under their hash
  with that of each share of a second dealing.
* Words, more edits: an edit changes at most ``GRAM`` of a line's groups of that many consecutive
  words, so lines within k edits have all but ``k * GRAM`` groups in common, and the
  ``k * GRAM + 1`` first of each - the longest, which are the rarest, then by hash, then place -
  share one (prefix filter). A line is put under the hashes of (class of its number of words,
  group) of these, and under the next class too if a line within its edits could be in that one.
* An edit of a code point takes and adds at most four words, or is three edits of words, so lines
  of as many shares or edits meet by words and need no segments.

A word is a run of letters and digits; other visible characters, and each character of a script
that writes without spaces, are words of their own.

A line's marks are its numbers of code points and words, and which of 64 folded code points and of
128 folded words it has an odd number of times: an edit changes two of the latter at most. Lines that
meet are compared by these first, and only those that may be alike have their texts joined.

Lines that meet are verified (banded bit-parallel edit distance of code points; of words, the
number of words in common and then a bit-parallel edit distance) and joined into classes
(``linking``).

Of each class the first line of the corpus stays - smallest document id (null last), smallest
text hash, first in its text - and the other occurrences are dropped from their documents.
Blank lines of under ``MIN_CHARS`` code points are always kept.

Items are named by 64-bit hashes (two different lines of 2 million share one with probability
1e-7).

Cases: null texts stay null; an empty text, or one whose every line is dropped, is the empty
text and its row stays; rows that repeat (same id and text) keep the same lines; a text of any
length is taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from . import textbytes as tb
from .scratch import stage_alone as stage

DISTANCE = 2
#: Shorter lines are only compared for equality.
MIN_CHARS = 24
WORDS_PER_EDIT = 25
#: Consecutive words under which lines meet.
GRAM = 4
#: Edits of words up to which lines meet by shares of their words, and above by groups.
SHARED = 7
#: A share whose words have fewer code points besides their first ones is too common to be a key by itself.
PLAIN = 4
#: Words that one edit of a code point takes or adds at most (as edits of words, three), and by which it changes their number.
_WORD_CHANGES, _WORD_SHIFT = 4, 2
#: Groups come by length, from _LONGEST code points on as one, then by hash: bits of hash, and of both, below a row's number.
#: Rows of so many edits have 8 * WORDS_PER_EDIT bytes at least, so a slice has less than 1 << 17 of them.
_LONGEST, _LENGTH, _ROW = 63, 41, 47
#: Pairs verified in one pass.
GROUP = 4096
#: Pairs for a line up to which the words in common are counted pair by pair.
FEW_PAIRS = 4
#: Line hashes that a task remembers before it starts anew (8 bytes each).
KNOWN_LINES = 1 << 20
#: Bytes of lines whose keys are made at once.
KEYED = 1 << 18
#: Candidate lines that are sent to all tasks to fetch their texts (8 bytes each); more are joined by shuffle.
SENT_LINES = 500_000

_U = np.uint64
_INVERSE = _U(pow(int(tb.BASE), -1, 1 << 64))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the offsets of its rows in them."""
    data, off = tb.view(column)
    starts = np.concatenate(([0], np.cumsum(tb.code_points(data), dtype=np.int64)))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts[off]


@functools.lru_cache(maxsize=2)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    power, back = np.full(size, tb.BASE), np.full(size, _INVERSE)
    power[0] = back[0] = 1
    return np.cumprod(power), np.cumprod(back)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    power, back = _power_table(1 << (n - 1).bit_length())
    return power[:n], back[:n]


class _Seen:
    """Which lines of a task are new, so that a frequent one leaves a task once in ``KNOWN_LINES``."""

    def __init__(self):
        self.known: list[np.ndarray] = []

    def new(self, node: np.ndarray) -> np.ndarray:
        nodes, first = np.unique(node, return_index=True)
        for held in self.known:
            fresh = held[np.minimum(np.searchsorted(held, nodes), len(held) - 1)] != nodes
            nodes, first = nodes[fresh], first[fresh]
        if len(nodes):
            self.known.append(nodes)
        if len(self.known) > 16:
            merged = np.sort(np.concatenate(self.known))
            self.known = [merged] if len(merged) < KNOWN_LINES else []
        return first


def segment_keys(column: pa.Array, distance: int = DISTANCE, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) under which each line is filed or looks for others; a key may come twice."""
    points, off = _points(column)
    length = np.diff(off)
    power, back = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + _U(1)) * power[:-1], out=total[1:])
    rows, keys = [], []
    n = distance + 1
    for shorter in range(distance + 1):
        size = length - shorter
        some = np.flatnonzero(size >= max(least, n))
        size, begin, whole = size[some], off[:-1][some], length[some]
        small, extra = size // n, size % n
        for i in range(n):
            # the last `extra` segments are one longer
            place = i * small + np.maximum(0, i - (n - extra))
            width = small + (i >= n - extra)
            for shift in range(max(-i, shorter - (distance - i)), min(i, shorter + distance - i) + 1):
                at = place + shift
                ok = (at >= 0) & (at + width <= whole)
                a = (begin + at)[ok]
                found = (total[a + width[ok]] - total[a]) * back[a]
                tag = (size[ok].astype(np.uint64) * _U(n) + _U(i) + _U(1)) * tb.BASE
                rows.append(some[ok])
                keys.append(tb.mix(found ^ tb.mix(tag)))
    return np.concatenate(rows), np.concatenate(keys)


#: Code points that are words of their own: signs, and scripts that write without spaces (Thai to Lao, Burmese, Khmer, CJK).
_SINGLE = ((0xA1, 0xC0), (0x2000, 0x2C00), (0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xAC00), (0xF900, 0xFB00), (0x20000, 0x40000))
_ALNUM = np.zeros(128, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 between words, 1 in runs, 2 a word of its own."""
    kind = np.ones(0x110000, np.uint8)
    for low, high in _SINGLE:
        kind[low:high] = 2
    kind[:128] = np.where(_ALNUM, 1, 2)
    kind[:0x21] = kind[[0xA0, 0x3000]] = 0
    return kind


def _words(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, code points) of every word in text order."""
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _kinds()[points]
    run, single = kind == 1, kind == 2
    cut = np.zeros(len(points) + 1, bool)
    cut[off] = True
    # a run goes on from the code point before
    on = np.zeros(len(points) + 1, bool)
    np.logical_and(run[1:], run[:-1], out=on[1:-1])
    on &= ~cut
    start = np.flatnonzero(single | run & ~on[:-1])
    end = np.flatnonzero(single | run & ~on[1:]) + 1
    power, back = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + _U(1)) * power[:-1], out=total[1:])
    per_row = np.diff(np.searchsorted(start, off))
    return tb.mix((total[end] - total[start]) * back[start]), np.repeat(np.arange(len(per_row)), per_row), end - start


#: Numbers of words at which the next class of line lengths begins.
_SIZES = np.unique((WORDS_PER_EDIT * 1.15 ** np.arange(140)).astype(np.int64))


def allowed(n_words):
    """Edits of words within which two lines are alike, the shorter of which has so many words."""
    return n_words // WORDS_PER_EDIT


def word_keys(column: pa.Array, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) under which lines of a slice meet by their words, and the number of words of each row."""
    points, off = _points(column)
    words, row, size = _words(points, off)
    n = np.bincount(row, minlength=len(column))
    wanted = np.where(np.diff(off) >= least, allowed(n), 0)
    few, few_keys = _share_keys(n, wanted, words, size)
    many, many_keys = _gram_keys(n, np.where(wanted > SHARED, wanted, 0), words, row, size)
    return np.concatenate([few, many]), np.concatenate([few_keys, many_keys]), n


def _share_keys(n: np.ndarray, wanted: np.ndarray, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines of few edits: of each share of the words, its number and content."""
    begin = np.cumsum(n) - n
    rows, keys = [], []
    # a line is longer than one of fewer edits by that many words at most, so it meets those of one edit less
    for down in (0, 1):
        edits = wanted - down
        some = np.flatnonzero((edits > 0) & (edits <= SHARED) & (n - WORDS_PER_EDIT * (edits + 1) < edits))
        shares = 2 * edits[some] + 1
        first = np.concatenate(([0], np.cumsum(shares)))
        own = np.repeat(np.arange(len(some)), n[some])
        at = np.arange(len(own)) + np.repeat(begin[some] - (np.cumsum(n[some]) - n[some]), n[some])
        word, line = words[at], np.repeat(np.arange(len(some)), shares)
        tag = tb.mix((edits[some][line] * 4 * SHARED + np.arange(first[-1]) - first[line] + 1).astype(np.uint64) * tb.BASE)

        def content(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share = first[own] + (((drawn >> _U(32)) * shares[own].astype(np.uint64)) >> _U(32)).astype(np.int64)
            total = np.zeros(first[-1], np.uint64)
            np.add.at(total, share, word)
            return share, tb.mix(total ^ tag)

        share, key = content(word)
        plain = np.bincount(share, size[at] - 1, first[-1]) < PLAIN
        rows.append(some[line[~plain]])
        keys.append(key[~plain])
        plain = np.flatnonzero(plain)
        if len(plain):
            # each with every share of a second dealing
            _, second = content(tb.mix(word + tb.BASE))
            times = shares[line[plain]]
            which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[line[plain]], times)
            rows.append(some[np.repeat(line[plain], times)])
            keys.append(tb.mix(np.repeat(tb.mix(key[plain]), times) + second[which]))
    return np.concatenate(rows), np.concatenate(keys)


def _gram_keys(n: np.ndarray, wanted: np.ndarray, words: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines of many edits: the first of their groups of words."""
    whole = np.flatnonzero(wanted)
    some = wanted[row] > 0
    number = np.repeat(np.arange(len(whole)), n[whole])
    grams, first = tb.windows(words[some], number, GRAM)
    chars = np.concatenate(([0], np.cumsum(size[some])))
    chars = np.minimum(chars[first + GRAM] - chars[first], _LONGEST)
    order = np.sort((number[first] << _ROW | (_LONGEST - chars) << _LENGTH).astype(np.uint64) | grams >> _U(64 - _LENGTH))
    at = (order >> _U(_ROW)).astype(np.int64)
    few = np.arange(len(at)) - np.searchsorted(at, np.arange(len(whole)))[at] <= wanted[whole][at] * GRAM
    few[1:] &= order[1:] != order[:-1]
    at, grams = whole[at[few]], order[few] & _U((1 << _ROW) - 1)
    class_ = np.searchsorted(_SIZES, n, "right")
    above = np.flatnonzero((np.searchsorted(_SIZES, n + wanted, "right") > class_)[at])
    class_ = np.concatenate([class_[at], class_[at[above]] + 1])
    at, grams = np.concatenate([at, at[above]]), np.concatenate([grams, grams[above]])
    return at, tb.mix(tb.mix(grams) ^ tb.mix(class_.astype(np.uint64) * tb.BASE))


def word_edits(a: list[int], b: list[int]) -> int:
    """The edit distance of two lists (Myers' bit vectors, as whole numbers of any length)."""
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    end = 0
    while end < min(len(a), len(b)) - at and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[at:len(a) - end], b[at:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for y in b:
        same = where.get(y, 0)
        low = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (~(level | up) & mask), up & level
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & mask, less << 1 & mask
        up, down = less | (~(low | more) & mask), more & low
    return score


#: A line's marks (see above).
MARK = {"chars": "int", "words": "int", "letters": "bigint", "low": "bigint", "high": "bigint"}


def line_marks(column: pa.Array) -> pa.StructArray:
    """The marks of each line."""
    points, off = _points(column)
    return _marks(points, off, *_words(points, off)[:2])


def _marks(points: np.ndarray, off: np.ndarray, words: np.ndarray, row: np.ndarray) -> pa.StructArray:
    n = np.bincount(row, minlength=len(off) - 1)
    ends = np.concatenate(([0], np.cumsum(n)))
    place, bit = words >> _U(57), _U(1) << ((words >> _U(51)) & _U(63))
    odd = [_odd_letters(points, off),
           *(_odd(np.where(place & _U(1) == side, bit, _U(0)), ends) for side in (0, 1))]
    return pa.StructArray.from_arrays([pa.array(np.diff(off).astype(np.int32)), pa.array(n.astype(np.int32)),
                                       *(pa.array(x.view(np.int64)) for x in odd)], [*MARK])


def _odd(bits: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which bits each row (its offsets in ``off``) has an odd number of times."""
    total = np.zeros(len(bits) + 1, np.uint64)
    np.bitwise_xor.accumulate(bits, out=total[1:])
    return total[off[1:]] ^ total[off[:-1]]


def _odd_letters(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    return _odd(_U(1) << (points.astype(np.uint64) & _U(63)), off)


class EditDistance:
    """Lines are alike within a number of edits."""

    def __init__(self, distance: int = DISTANCE):
        self.distance = distance

    def pairs(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        (lp, lo), (rp, ro) = _points(left), _points(right)
        unlike = np.bitwise_count(_odd_letters(lp, lo) ^ _odd_letters(rp, ro))
        out = np.zeros(len(left), bool)
        some = np.flatnonzero(unlike <= 2 * self.distance)
        out[some] = self._within(lp, lo, rp, ro, some, some)
        return out

    def blocks(self, left: pa.Array, right: pa.Array, roots: np.ndarray, others: np.ndarray):
        (lp, lo), (rp, ro) = _points(left), _points(right)
        near = np.abs(np.diff(lo)[:, None] - np.diff(ro)[None, :]) <= self.distance
        near &= roots[:, None] != others[None, :]
        # an edit changes at most two of the 64 folded letter counts by one
        near &= sum(np.abs(x[:, None] - y[None, :]) for x, y in
                    zip(_letters(lp, lo).T, _letters(rp, ro).T, strict=True)) <= 2 * self.distance
        x, y = np.nonzero(near)
        good = self._within(lp, lo, rp, ro, x, y)
        return x[good], y[good]

    def _within(self, lp, lo, rp, ro, x, y) -> np.ndarray:
        n, m = np.diff(lo)[x], np.diff(ro)[y]
        out = np.zeros(len(x), bool)
        some = np.flatnonzero(np.abs(n - m) <= self.distance)
        some = some[np.argsort(n[some], kind="stable")]
        for at in range(0, len(some), GROUP):
            part = some[at:at + GROUP]
            out[part] = self._banded(lp, lo[x[part]], n[part], rp, ro[y[part]], m[part])
        return out

    def _banded(self, lp, a, n, rp, b, m) -> np.ndarray:
        """One pass over pairs in order of left length; bit d + distance of a level's state says
        that left prefix i and right prefix i + d are within that many edits."""
        k = self.distance
        mask = np.uint8((1 << (2 * k + 1)) - 1)
        level = [np.full(len(n), sum(1 << (k + d) for d in range(e + 1)), np.uint8) for e in range(k + 1)]
        good = np.zeros(len(n), bool)
        live = np.arange(len(n))
        final = (np.uint8(1) << (k + m - n).astype(np.uint8)).astype(np.uint8)
        done = 0
        for i in range(int(n.max()) + 1):
            upto = int(np.searchsorted(n, i, "right"))
            if upto > done:
                ended = np.flatnonzero(n[live] == i)
                good[live[ended]] = (level[k][ended] & final[live[ended]]) > 0
                done = upto
            if i % 16 == 0 or upto == len(n):
                keep = (n[live] > i) & (level[k] > 0)
                live, level = live[keep], [x[keep] for x in level]
                if not len(live):
                    break
            letter = lp[np.minimum(a[live] + i, len(lp) - 1)]
            match = np.zeros(len(live), np.uint8)
            for d in range(-k, k + 1):
                j = i + d
                if j >= 0:
                    same = (rp[np.minimum(b[live] + j, len(rp) - 1)] == letter) & (j < m[live])
                    match |= same.astype(np.uint8) << np.uint8(k + d)
            fresh = [level[0] & match]
            for e in range(1, k + 1):
                fresh.append(((level[e] & match) | level[e - 1] | (level[e - 1] >> 1) | (fresh[e - 1] << 1)) & mask)
            level = fresh
        return good


class NearLines:
    """Lines are alike within a number of edits of code points, or of words by their length."""

    def __init__(self, distance: int = DISTANCE):
        self.points = EditDistance(distance)

    def may(self, x: Column, y: Column) -> Column:
        """Whether lines with these marks can be alike."""
        unlike = lambda *fields: sum(F.bit_count(x[f].bitwiseXOR(y[f])) for f in fields)
        edits = F.floor(F.least(x["words"], y["words"]) / WORDS_PER_EDIT)
        near = (F.abs(x["chars"] - y["chars"]) <= self.points.distance) & (unlike("letters") <= 2 * self.points.distance)
        return near | (edits > 0) & (F.abs(x["words"] - y["words"]) <= edits) & (unlike("low", "high") <= 2 * edits)

    def may_blocks(self, left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
        """The same for each of some marks with each of others."""
        near, words = self._may_blocks(left, right)
        return near | words

    def _may_blocks(self, left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        x = {f: left.field(f).to_numpy()[:, None] for f in MARK}
        y = {f: right.field(f).to_numpy()[None, :] for f in x}
        unlike = lambda f: np.bitwise_count((x[f] ^ y[f]).view(np.uint64)).astype(np.int64)
        edits = allowed(np.minimum(x["words"], y["words"]))
        near = (np.abs(x["chars"] - y["chars"]) <= self.points.distance) & (unlike("letters") <= 2 * self.points.distance)
        return near, (edits > 0) & (np.abs(x["words"] - y["words"]) <= edits) & (unlike("low") + unlike("high") <= 2 * edits)

    def pairs(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        good = self.points.pairs(left, right)
        rest = np.flatnonzero(~good)
        if len(rest):
            (lt, li), (rt, ri) = (_words(*_points(side.take(pa.array(rest))))[:2] for side in (left, right))
            n, m = np.bincount(li, minlength=len(rest)), np.bincount(ri, minlength=len(rest))
            edits = allowed(np.minimum(n, m))
            both = linking.common(*linking.tokens(None, lambda _: (lt, li)), *linking.tokens(None, lambda _: (rt, ri)), len(rest))
            some = np.flatnonzero((edits > 0) & (both >= np.maximum(n, m) - edits))
            good[rest[some]] = self._within(lt, li, rt, ri, some, some, edits[some])
        return good

    def blocks(self, left: pa.Array, right: pa.Array, roots: np.ndarray, others: np.ndarray):
        (lp, lo), (rp, ro) = _points(left), _points(right)
        (lt, li), (rt, ri) = _words(lp, lo)[:2], _words(rp, ro)[:2]
        near, by_words = self._may_blocks(_marks(lp, lo, lt, li), _marks(rp, ro, rt, ri))
        other = roots[:, None] != others[None, :]
        x, y = np.nonzero(near & other)
        good = self.points._within(lp, lo, rp, ro, x, y)
        x, y = x[good], y[good]
        by_words &= other
        by_words[x, y] = False
        u, v = np.nonzero(by_words)
        n, m = np.bincount(li, minlength=len(left)), np.bincount(ri, minlength=len(right))
        edits = allowed(np.minimum(n[u], m[v]))
        some = (edits > 0) & (np.abs(n[u] - m[v]) <= edits)
        u, v, edits = u[some], v[some], edits[some]
        if len(u):
            # the words in common: of each pair, or of all lines that are left if these are in many pairs
            (lk, lw, lr), (rk, rw, rr) = _of_rows(lt, li, u), _of_rows(rt, ri, v)
            if len(u) <= FEW_PAIRS * (len(lk) + len(rk)):
                both = linking.common(*linking.tokens(None, lambda _: _of_each(lt, li, u)), *linking.tokens(None, lambda _: _of_each(rt, ri, v)), len(u))
            else:
                both = linking.common_all(*linking.tokens(None, lambda _: (lw, lr)), *linking.tokens(None, lambda _: (rw, rr)), len(lk), len(rk))
                both = both[np.searchsorted(lk, u), np.searchsorted(rk, v)]
            some = both >= np.maximum(n[u], m[v]) - edits
            u, v = u[some], v[some]
            good = self._within(lt, li, rt, ri, u, v, edits[some])
            x, y = np.concatenate([x, u[good]]), np.concatenate([y, v[good]])
        return x, y

    def _within(self, lt, li, rt, ri, x, y, edits) -> np.ndarray:
        a, b = (np.searchsorted(row, [i, i + 1]) for row, i in ((li, x), (ri, y)))
        return np.array([word_edits(lt[s:e].tolist(), rt[t:f].tolist()) <= k
                         for s, e, t, f, k in zip(*a, *b, edits, strict=True)], bool)


def _of_each(words: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each wanted row, as often as it is wanted, and their places among the wanted."""
    start = np.searchsorted(row, wanted)
    n = np.searchsorted(row, wanted, "right") - start
    return words[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)], np.repeat(np.arange(len(wanted)), n)


def _of_rows(words: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows wanted, once each in order; their words, and the number of each word's row among them."""
    rows = np.unique(wanted)
    at = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
    own = rows[at] == row
    return rows, words[own], at[own]


def _letters(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    return np.bincount(row * 64 + points % 64, minlength=n * 64).reshape(n, 64).astype(np.int16)


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, body hash, place, node, line) of every line but short blank ones."""
    return docs.select("doc_id", text, F.xxhash64(text).alias("body")).select("doc_id", "body", F.posexplode(F.split(F.col(text), "\n")).alias("place", "line")) \
        .filter((F.length("line") >= MIN_CHARS) | F.col("line").rlike(r"\S")).select("doc_id", "body", "place", F.xxhash64("line").alias("node"), "line")


def line_classes(docs: DataFrame, text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(node, root, n_links) of the lines of ``docs`` that have near-duplicates."""
    return _classes(stage(_lines(docs, text).select("node", "line"), "lines"), distance)


def _classes(lines: DataFrame, distance: int) -> DataFrame:
    lines = lines.select("node", "line")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            batch = batch.take(pa.array(seen.new(batch.column("node").to_numpy())))
            for piece in tb.slices(batch, "line", KEYED):
                line = piece.column("line")
                by_word, word_key, n_words = word_keys(line)
                few = np.flatnonzero(2 * allowed(n_words - _WORD_SHIFT * distance) < _WORD_CHANGES * distance)
                row, key = segment_keys(line.take(pa.array(few)), distance)
                row, key = np.concatenate([few[row], by_word]), np.concatenate([key, word_key])
                node = piece.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row])], names=["key", "node"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.slices(batch, "body", KEYED):
                yield pa.RecordBatch.from_arrays([*piece.columns, *line_marks(piece.column("body")).flatten()], names=["node", "body", *MARK])

    def texts(nodes: DataFrame) -> DataFrame:
        """The lines that meet any other: (node, body, mark)."""
        held = stage(nodes, "candidate-lines")
        wanted = F.broadcast(held) if held.count() <= SENT_LINES else held
        found = lines.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("line").alias("body"))
        found = found.mapInArrow(mark, "node bigint, body string, " + ", ".join(f"{f} {kind}" for f, kind in MARK.items()))
        return found.select("node", "body", F.struct(*MARK).alias("mark"))

    return linking.classes(lines.mapInArrow(file, "key bigint, node bigint"), texts, NearLines(distance), "mark")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, body, drop, n_near): the places of the lines to drop in each document that has any."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lines = stage(_lines(docs, "text"), "lines")
    seen = lines.drop("line")
    at: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "place")
    per_line = seen.groupBy("node").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    roots = _classes(lines, distance)
    classed = stage(per_line.join(roots, "node", "left").select(
        "node", "first", "n", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("near")), "line-classes")
    firsts = classed.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    wanted = classed.select("node", "root", "near").join(firsts, "root").select("node", "first", "near")
    return seen.join(wanted, "node").filter(at != F.col("first")).groupBy("doc_id", "body") \
        .agg(F.collect_set("place").alias("drop"), F.sum(F.col("near").cast("bigint")).alias("n_near"))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE,
                        dropped: str | None = None) -> DataFrame:
    """``docs`` without repeated lines; ``dropped`` names a column for their number."""
    found = repeated_lines(docs, text, doc_id, distance)
    found = found.select(F.col("doc_id").alias("_i"), F.col("body").alias("_b"), F.col("drop").alias("_d"))
    home = F.col(f"d.`{doc_id}`")
    held = docs.alias("d").join(found.alias("f"), (F.xxhash64(F.col(f"d.`{text}`")) == F.col("f._b"))
                                & home.eqNullSafe(F.col("f._i")), "left")
    body = F.col(f"d.`{text}`")
    kept = F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains(F.col("f._d"), i))
    fixed = F.when(F.col("f._d").isNull(), body).otherwise(F.array_join(kept, "\n"))
    columns = [fixed.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    more = [F.coalesce(F.size("f._d"), F.lit(0)).cast("bigint").alias(dropped)] if dropped else []
    return held.select(*columns, *more)
