"""Numpy views of Arrow text batches: words and lines as byte spans with 64-bit hashes.

Everything works on the UTF-8 buffer of a whole batch at once, so no Python code runs per
word. Batches are cut into slices of at most ``SLICE`` bytes of text; a longer single text is
a slice of its own. Working memory is about 50 bytes per byte of a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

SLICE = 2 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BASE = _U(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)

#: Separators of words as the contracts for whitespace words define them: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of ``column``, or one row."""
    _, off = view(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Spans:
    """Maximal runs of non-separator bytes, never across rows: ``start``, ``end``, ``row``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, separator: np.ndarray):
        self.data, self.off, self.n_rows = data, off, len(off) - 1
        inside = ~separator[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def per_row(self, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(self.row, weights, self.n_rows)
        return out.astype(np.int64)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.data if data is None else data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial of random byte values, finalised.

    The spans are ascending and do not overlap.
    """
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    longest = int(length.max())
    power = np.ones(longest, np.uint64)
    power[1:] = BASE
    power = np.cumprod(power)
    at = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), np.int64)
    first[start] = start
    at -= np.maximum.accumulate(first)
    term = _BYTE[data] * power[np.minimum(at, longest - 1)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(term, out=total[1:])
    return mix((total[end] - total[start]) ^ (length.astype(np.uint64) * BASE))


def within(spans: Spans, mask: np.ndarray) -> np.ndarray:
    """How many marked bytes each span has."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[spans.end] - total[spans.start]


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive spans of one row, and the index of their first span."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * BASE + hashes[i:i + m]
    first = np.flatnonzero(row[:m] == row[n - 1:n - 1 + m])
    return mix(out[first] + _U(n)), first


def repeated(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans in text order: is its (row, hash) found twice or more; is it not the first."""
    key = mix(hashes ^ (row.astype(np.uint64) * BASE))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    later[order[1:]] = same
    return any_, later


def covered(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the spans inside any window of n spans that begins at one of ``first``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (names clash without regard to case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def map_text(df: DataFrame, column: str, into: str, ddl: str,
             make: Callable[[], Callable[[pa.Array], Sequence]], limit: int = SLICE) -> DataFrame:
    """Append struct column ``into`` (fields of ``ddl``), computed from slices of a text column.

    ``make`` runs once per task and returns the function from a text slice to one array per
    field. No shuffle; one output row per input row, whatever the other columns hold.
    """
    fields = StructType.fromDDL(ddl)
    schema = StructType([*df.schema.fields, StructField(into, fields)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(fields)]
        work = make()
        for batch in batches:
            for piece in slices(batch, column, limit):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, kind) for a, kind in
                          zip(work(piece.column(column)), kinds, strict=True)]
                made = pa.StructArray.from_arrays(arrays, fields=[pa.field(f.name, k) for f, k in
                                                                  zip(fields, kinds, strict=True)])
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, into])

    return df.mapInArrow(run, schema)
