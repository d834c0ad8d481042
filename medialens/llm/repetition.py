"""Quality rules by repetition coverage (operator 2).

Rolling word-window hashes of several lengths, computed in numpy over whole Arrow slices,
measure how many characters lie inside windows that occur twice or more in the same text, and
how many lie in repeated lines. No shuffle, no state between rows.

Cases: a null or empty text, or one of white space alone, has zero words and fails; repeated
rows are judged one by one with equal results; a null id stays null; other columns are not
looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Percent of a text's word characters that may lie in repeated windows, by window length in words.
#: All lie below what REPEAT_LIMIT lets pass, so that they decide.
WINDOW_LIMITS = {5: 15, 7: 13, 10: 10}
#: Percent of line characters that may lie in lines equal to an earlier one.
LINE_LIMIT = 30
#: Percent of word characters that may be symbols.
SYMBOL_LIMIT = 10
MIN_WORDS = 10
REPEAT_LIMIT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "line_chars bigint, dup_line_chars bigint, "
           + ", ".join(f"repeat_chars_{n} bigint" for n in WINDOW_LIMITS))


def _measure(column: pa.Array) -> list[np.ndarray]:
    data, off = tb.view(column)
    words = tb.Spans(data, off, tb.SPACE)
    points = tb.code_points(data)
    chars = tb.within(words, points)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
    hashes = words.hashes()

    def in_repeats(n: int) -> np.ndarray:
        found, first = tb.windows(hashes, words.row, n)
        again, _ = tb.repeated(found, words.row[first])
        return tb.covered(first[again], n, len(words))

    lines = tb.Spans(data, off, tb.NEWLINE)
    full = tb.within(lines, words.inside) > 0
    line_chars = tb.within(lines, points) * full
    _, later = tb.repeated(lines.hashes(), lines.row)
    later &= full
    spread = {n: in_repeats(n) for n in {5, *WINDOW_LIMITS}}
    return [words.per_row(), words.per_row(chars), symbols[off[1:]] - symbols[off[:-1]],
            lines.per_row(later), words.per_row(spread[5]), lines.per_row(line_chars),
            lines.per_row(line_chars * later), *(words.per_row(spread[n] * chars) for n in WINDOW_LIMITS)]


def measure(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """``df`` with a struct column of repetition figures; ``base_failed`` and ``kept`` are its verdicts."""
    raw = tb.fresh(df, "_figures")
    out = tb.map_text(df, text, raw, _FIELDS, lambda: _measure)
    f = lambda name: F.col(f"{raw}.{name}")
    failed = (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > REPEAT_LIMIT * f("n_words"))
    bad = (100 * f("n_symbols") > SYMBOL_LIMIT * f("word_chars")) | \
          (100 * f("dup_line_chars") > LINE_LIMIT * f("line_chars"))
    for n, limit in WINDOW_LIMITS.items():
        bad = bad | (100 * f(f"repeat_chars_{n}") > limit * f("word_chars"))
    return out.withColumn(into, F.struct(f"{raw}.*", failed.alias("base_failed"),
                                         (~failed & ~bad).alias("kept"))).drop(raw)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the rows whose text passes, with the columns of ``df``."""
    into = tb.fresh(df, "_quality")
    return measure(df, text, into).filter(F.col(f"{into}.kept")).drop(into)
