"""Periodic runs of words (operator 13).

A run is a stretch of consecutive words of smallest period q, of at least ``max(MIN_RUN, 4 * q)``
words, that no neighbour extends. Periods below ``DIRECT`` are found by direct scans: the words
are compared with themselves at every lag. Longer periods are found scale by scale, for periods
in [L, 2L), by minimizers: every window of 2L consecutive places selects its places of least
hash of the L words there. In a run of period q the windows repeat at distance q, and so do the
places they select; equal selected grams at a distance of [L, 2L) are the seeds, which are
extended both ways by doubling steps over prefix hashes and then compared word by word.

Grams inside a run of a period of at most L/4 (all found at lower scales) are never selected:
what is left of one gram lies more than L/4 apart, so a place has at most eight partners, and a
run of period q >= L always has other grams in each stretch of q places. All texts of a slice
are worked at once, parted by words that equal no other; the work is a few array passes per
scale, and a scale only sees the texts long enough for it.

Words are numbered by their exact bytes, never by hashes. A hash that misleads the extension is
noticed by the comparison, and that lag is then scanned directly.

Cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated
rows give equal rows; texts of any length are read whole (about 150 bytes of memory per word of
the longest); an empty table gives an empty table; other columns stay, whatever they hold, and a
column that is already called as the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .blocks import take_runs

MIN_RUN = 6
#: A run holds its period at least so many times.
TIMES = 4
#: Periods below this are scanned directly.
DIRECT = 8

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_BACK = _U(pow(int(tb.BASE), -1, 1 << 64))

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lag_runs(words: np.ndarray, lag: int) -> Runs:
    """(start, end, period) of the maximal stretches long enough whose words equal those ``lag`` on."""
    same = np.zeros(max(len(words) - lag, 0) + 2, np.int8)
    same[1:-1] = words[lag:] == words[:len(words) - lag] if len(words) > lag else 0
    step = np.diff(same)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + lag
    long = end - start >= max(MIN_RUN, TIMES * lag)
    return start[long], end[long], np.full(int(long.sum()), lag, np.int64)


def _sliding(values: np.ndarray, width: int, best: np.ufunc, neutral: np.uint64) -> np.ndarray:
    """``best`` of every ``width`` consecutive values: running bests of blocks from both their ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, neutral, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1:width - 1 + n])


class _Prefix:
    """Prefix hashes of a word sequence: equality of two stretches in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power = np.full(n + 1, tb.BASE)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(tb.mix(words.astype(np.uint64) + _U(1)) * self.power[:-1], out=self.total[1:])

    def grams(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words at every place, equal for equal grams."""
        n = len(self.total) - size
        back = np.full(n, _BACK)
        back[:1] = 1
        return tb.mix((self.total[size:] - self.total[:n]) * np.cumprod(back))

    def same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words at ``a`` equal those at ``b``, further on."""
        return (self.total[a + size] - self.total[a]) * self.power[b - a] == self.total[b + size] - self.total[b]

    def extend(self, at: np.ndarray, lag: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the stretch around each place that keeps its lag."""
        n = len(self.total) - 1
        steps = [1 << k for k in range(limit.bit_length(), -1, -1)]
        start, end = at.copy(), at + lag
        for step in steps:
            fits = np.flatnonzero(start >= step)
            fits = fits[self.same(start[fits] - step, start[fits] - step + lag[fits], step)]
            start[fits] -= step
            fits = np.flatnonzero(end + step <= n)
            fits = fits[self.same(end[fits] - lag[fits], end[fits], step)]
            end[fits] += step
        return start, end


def _seeds(grams: np.ndarray, shut: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal selected grams at distances of [size, 2 * size)."""
    width = 2 * size
    if len(grams) < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    open_ = np.where(shut, _NONE, grams)
    least = _sliding(open_, width, np.minimum, _NONE)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1:width - 1 + len(least)] = least
    chosen = np.flatnonzero((_sliding(around, width, np.maximum, _U(0)) == open_) & ~shut)
    chosen = chosen[np.argsort(open_[chosen], kind="stable")]
    value, at, lag = open_[chosen], [], []
    hop = 1
    while hop < len(chosen):
        distance = chosen[hop:] - chosen[:-hop]
        near = (value[hop:] == value[:-hop]) & (distance < width)
        if not near.any():
            break
        fits = np.flatnonzero(near & (distance >= size))
        at.append(chosen[fits])
        lag.append(distance[fits])
        hop += 1
    return (np.concatenate(at), np.concatenate(lag)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))


def _checked(words: np.ndarray, prefix: _Prefix, at: np.ndarray, lag: np.ndarray, limit: int) -> Runs:
    """The runs around the seeds, with every word compared."""
    start, end = prefix.extend(at, lag, limit)
    long = end - start >= TIMES * lag
    found = np.unique(np.stack([start[long], end[long], lag[long]]), axis=1)
    start, end, lag = found
    first = np.concatenate(([0], np.cumsum(end - start - lag)))
    places = np.arange(first[-1]) + np.repeat(start - first[:-1], np.diff(first))
    differs = np.concatenate(([0], np.cumsum(words[places] != words[places + np.repeat(lag, np.diff(first))])))
    wrong = differs[first[1:]] > differs[first[:-1]]
    inner = start > 0
    wrong[inner] |= words[start[inner] - 1] == words[start[inner] - 1 + lag[inner]]
    inner = end < len(words)
    wrong[inner] |= words[end[inner]] == words[end[inner] - lag[inner]]
    parts = [tuple(found[:, ~wrong]), *(_lag_runs(words, q) for q in np.unique(lag[wrong]).tolist())]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _shut(runs: list[Runs], size: int, n: int, places: np.ndarray) -> np.ndarray:
    """Marks the places whose gram lies in a run of a period of at most a quarter of its size."""
    step = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        inside = (4 * period <= size) & (end - start >= size)
        np.add.at(step, start[inside], 1)
        np.add.at(step, end[inside] - size + 1, -1)
    return np.cumsum(step[:-1])[places] > 0


def find_runs(words: np.ndarray, lengths: np.ndarray) -> Runs:
    """(start, end, period) of all runs, ordered by start and period.

    ``words`` numbers the words of some texts; a number that is used nowhere else ends each text.
    ``lengths``: the words of each text, its end not counted.
    """
    n = len(words)
    found = [_lag_runs(words, q) for q in range(1, DIRECT)]
    size, longest = DIRECT, int(lengths.max(initial=0))
    while TIMES * size <= longest:
        places = np.flatnonzero(np.repeat(lengths >= TIMES * size, lengths + 1))
        own = words[places]
        prefix = _Prefix(own)
        grams = prefix.grams(size)
        at, lag = _seeds(grams, _shut(found, size, n, places[:len(grams)]), size)
        start, end, period = _checked(own, prefix, at, lag, longest)
        found.append((places[start], places[end - 1] + 1, period))
        size *= 2
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    # a stretch with several periods is a run of the smallest, with the same ends
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _join(data: np.ndarray, words: tb.Spans, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by single spaces."""
    which = np.flatnonzero(kept)
    row = words.row[which]
    length = (words.end - words.start)[which]
    room = length.copy()
    room[:-1] += row[1:] == row[:-1]
    end = np.cumsum(room)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    inner, _ = take_runs(np.concatenate(([0], np.cumsum(length))), np.arange(len(which)))
    shift = np.cumsum(length) - length
    out[inner + np.repeat(end - room - shift, length)] = data[inner + np.repeat(words.start[which] - shift, length)]
    off = np.concatenate(([0], np.cumsum(np.bincount(row, room, words.n_rows)))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), words.n_rows,
                                 [None, pa.py_buffer(off), pa.py_buffer(out)]).cast(pa.string())


def _slice(column: pa.Array) -> list:
    data, off = tb.view(column)
    words = tb.Spans(data, off, tb.SPACE)
    bounds = np.concatenate(([0], np.cumsum(words.end - words.start))).astype(np.int64)
    spelled = pa.Array.from_buffers(pa.large_binary(), len(words), [
        None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[words.inside]))])
    lengths = words.per_row()
    # a word's place in the sequence: its number in the slice, plus one end for each row before
    place = np.arange(len(words)) + words.row
    sequence = np.empty(len(words) + len(lengths), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    sequence[ends] = len(words) + np.arange(len(lengths))
    sequence[place] = spelled.dictionary_encode().indices.to_numpy()
    start, end, period = find_runs(sequence, lengths)
    row = np.searchsorted(ends, start)
    gone = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    runs = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start - (ends - lengths)[row], end - start, period)],
        names=["start", "length", "period"])
    per_row = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lengths))))).astype(np.int32)
    return [pa.array(lengths), pa.ListArray.from_arrays(pa.array(per_row), runs),
            _join(data, words, np.cumsum(gone[:-1])[place] == 0)]


def periodic_runs(df: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """``df`` with a struct of n_words, its runs (start, length, period; by start, then period) and
    the collapsed text: the words that no run holds after its first period, joined by spaces."""
    raw = tb.fresh(df, "_runs")
    out = tb.map_text(df, text, raw, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                                     "collapsed string", lambda: _slice)
    return out.withColumn(into, out[raw]).drop(raw)
