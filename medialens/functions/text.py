"""Text helpers as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes all whitespace; Spark's one-argument trim() only spaces.
# The character-set form of trim is a plain scan (no regex); the set is Python's own
# definition of whitespace, built by rule.
WS_CHARS = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())

# Word-token classes (Unicode letters/digits/underscore). Spelled out so the same
# pattern means the same thing in Java regex and in RE2.
WORD2 = r"[\p{L}\p{N}_]{2,}"
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """Strip leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


def compose_text(*cols, sep: str = " ") -> Column:
    """null -> '' then join with ``sep``; separators stay when a part is null."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c), F.lit("")))
    return F.concat(*parts)


def slug(c) -> Column:
    """Runs of anything but ASCII letters and digits -> '_', trimmed of '_', lower-cased."""
    s = F.regexp_replace(_c(c), r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(s, r"^_+|_+$", ""))


def single_line(c) -> Column:
    """Newline and CR -> space, then whitespace-stripped (T1 preprocessing)."""
    return ws_trim(F.translate(F.coalesce(_c(c), F.lit("")), "\n\r", "  "))


def build_prompt(c, template: str) -> Column:
    """Insert the single-line text into ``template`` at ``{text}``."""
    head, _, tail = template.partition("{text}")
    return F.concat(F.lit(head), single_line(c), F.lit(tail))


def word_tokens(c, pattern: str = WORD_OR_PUNCT) -> Column:
    """Array of regex tokens of the whole text (default: words and single punctuation marks)."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(pattern), 0)


def word2_tokens(c) -> Column:
    """Tokens of two or more word characters (the WORD2 pattern), by splitting on non-word
    runs and dropping pieces shorter than two: the same tokens, found faster than by
    extracting every regex match."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda x: F.length(x) >= 2)


def token_count(c, pattern: str = WORD_OR_PUNCT) -> Column:
    """Number of regex tokens, counted without materialising the token array."""
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(pattern))


def null_tokens(c, tokens) -> Column:
    """Map pandas' default NA strings to NULL (S3)."""
    return F.when(_c(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(_c(c))


# The strings pandas.read_csv treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
