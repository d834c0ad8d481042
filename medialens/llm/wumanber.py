"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 4).

Patterns are the windows of ``WINDOW`` consecutive words of the benchmark items (an item of
fewer words is one shorter pattern). For each pattern length a shift table, indexed by the hash
of a block of words, says how far a cursor may jump because no pattern can end there; where it
says zero, the patterns with the same suffix and prefix blocks are compared with the text
directly. Long texts are cut into lanes of cursor positions, and all lanes of an Arrow slice
advance together in numpy, so no text is too long for one step and none is cut off.

The patterns go to the tasks in blocks of at most ``BLOCK_BYTES`` of item text, whatever the
size of the benchmark; documents pass every block. No shuffle of documents.

Cases: null or empty texts have no words and no hits; items without words have no windows; an
item id that occurs twice counts once; items without an id mark hits but are not listed;
repeated documents give equal rows; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .scratch import stage

WINDOW = 10
#: Words in a block of the shift tables.
BLOCK_WORDS = 3
#: Item text sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Cursor positions in a lane.
LANE = 256

#: Separators after lower-casing A-Z: ASCII other than 0-9 and a-z.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = False
_SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False


class Words:
    """The normalised words of a slice: hashes, rows, and their text joined by single spaces."""

    def __init__(self, column: pa.Array):
        data, self.off = tb.view(column)
        data = tb.LOWER[data]
        spans = tb.Spans(data, self.off, _SEPARATOR)
        self.row, self.n_rows, self.hash = spans.row, spans.n_rows, spans.hashes()
        length = spans.end - spans.start
        self.at = np.concatenate(([0], np.cumsum(length + 1)))
        joined = np.full(int(self.at[-1]), 0x20, np.uint8)
        joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[spans.inside]
        self.text = joined.tobytes()
        self.first = np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def passage(self, word: int, n: int) -> bytes:
        return self.text[self.at[word]:self.at[word + n] - 1]


def _blocks(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that end at each word (the first n - 1 entries are unused)."""
    out = np.zeros(len(hashes), np.uint64)
    m = len(hashes) - n + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for i in range(n):
            acc = acc * tb.BASE + hashes[i:i + m]
        out[n - 1:] = tb.mix(acc)
    return out


class Group:
    """Shift and bucket tables of the patterns of one length."""

    def __init__(self, n: int, patterns: dict[bytes, tuple[np.ndarray, set]]):
        self.n, self.block = n, min(BLOCK_WORDS, n)
        self.texts, self.items = list(patterns), [ids for _, ids in patterns.values()]
        words = np.stack([h for h, _ in patterns.values()])
        ends = np.stack([_blocks(w, self.block) for w in words])
        bits = max(16, math.ceil(math.log2(len(words) * n * 8)))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, n - self.block + 1, np.uint8)
        for j in range(self.block - 1, n):
            np.minimum.at(self.shift, (ends[:, j] & self.mask).astype(np.int64), n - 1 - j)
        keys = tb.mix(ends[:, -1] * tb.BASE + ends[:, self.block - 1])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, words: Words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        count = np.diff(words.first)
        rows = np.flatnonzero(count >= self.n)
        if not len(rows):
            return []
        lo, hi = words.first[rows] + self.n - 1, words.first[rows + 1]
        lanes = -(-(hi - lo) // LANE)
        start = np.repeat(lo, lanes) + LANE * (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE, np.repeat(hi, lanes))
        block = _blocks(words.hash, self.block)
        jump = self.shift[(block & self.mask).astype(np.int64)]
        cursor, halts = start, []
        while len(cursor):
            step = jump[cursor]
            halts.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        end = np.concatenate(halts)
        key = tb.mix(block[end] * tb.BASE + block[end - self.n + self.block])
        left, right = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = []
        for i in np.flatnonzero(right > left):
            first = int(end[i]) - self.n + 1
            passage = words.passage(first, self.n)
            out += [(first, int(p)) for p in self.order[left[i]:right[i]] if self.texts[p] == passage]
        return out


def compile_patterns(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[Group]:
    """The search tables of a bounded block of (item id, text)."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = defaultdict(dict)
    if items:
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            n = min(window, b - a)
            for first in range(a, b - n + 1) if n else ():
                ids = by_length[n].setdefault(words.passage(first, n), (words.hash[first:first + n], set()))[1]
                if item is not None:
                    ids.add(item)
    return [Group(n, patterns) for n, patterns in sorted(by_length.items())]


def _search(groups: list[Group]):
    def work(column: pa.Array):
        words = Words(column)
        hit = np.zeros(len(words.row), bool)
        items: dict[int, set] = defaultdict(set)
        for group in groups:
            for first, pattern in group.find(words):
                hit[first:first + group.n] = True
                items[int(words.row[first])] |= group.items[pattern]
        at = np.flatnonzero(hit)
        bounds = np.searchsorted(at, words.first)
        place = (at - words.first[words.row[at]]).astype(np.int64)
        return [np.diff(words.first), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place)),
                [sorted(items[r]) if r in items else [] for r in range(words.n_rows)]]

    return work


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", into: str = "passages", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct: n_words, the places of hit words, and the ids (as text) of items found."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(size / (BLOCK_BYTES * 0.8)))
    parts, out = [], docs
    for block in range(n_blocks):
        held = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block)
        tables = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in held.collect()], window))
        part = tb.fresh(out, f"_part{block}")
        out = tb.map_text(out, text, part, "n_words bigint, places array<bigint>, items array<string>",
                          lambda tables=tables: _search(tables.value))
        if block + 1 < n_blocks:
            out = stage(out, "passages")
        parts.append(part)
    both = lambda f: F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"{p}.{f}") for p in parts)))))
    return out.withColumn(into, F.struct(F.col(f"{parts[0]}.n_words"), both("places").alias("places"),
                                         both("items").alias("items"))).drop(*parts)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Only the documents that hold no window of any item, with the columns of ``docs``."""
    into = tb.fresh(docs, "_passages")
    return find_passages(docs, items, text, into=into).filter(F.size(f"{into}.places") == 0).drop(into)
