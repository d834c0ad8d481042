"""Label normalisers and label-derived scalars.

The reference uses five label normalisers that disagree; each is a named policy here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim

# Class names, scores, sentinels and display names.
CLASSES = ["Left", "Centre", "Right"]
SCORE = {"Left": -1, "Center": 0, "Right": 1}
LETTER_SCORE = {"left": -1, "centre": 0, "center": 0, "neutral": 0, "right": 1}
SENTIMENT = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive"}
FAILED_PATTERN = r"^\[(ERROR|Error|Failed)\]"
FAILED_EXACT = ["error", "Unknown"]
MODEL_DISPLAY = {"bert": "BERT", "deepseek": "DeepSeek", "gemini": "Gemini", "claude": "Claude"}
WAR_DISPLAY = {"Israel-Palestine": "Hamas-Israel"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null() -> Column:
    return F.lit(None).cast("string")


def norm_substring(c) -> Column:
    """L1: strip+lower; contains left -> Left, else centre/center -> Centre, else right -> Right."""
    s = F.lower(ws_trim(_c(c)))
    return (F.when(s.contains("left"), F.lit("Left"))
             .when(s.contains("centre") | s.contains("center"), F.lit("Centre"))
             .when(s.contains("right"), F.lit("Right"))
             .otherwise(_null()))


def letters_score(c) -> Column:
    """L2: lower, keep only a-z, exact lookup -> -1/0/1, else null."""
    s = F.regexp_replace(F.lower(_c(c)), "[^a-z]", "")
    e = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in LETTER_SCORE.items():
        e = e.when(s == k, F.lit(v))
    return e


def norm_letters(c) -> Column:
    """L2 as a label: Left / Centre / Right from the letter-only lookup."""
    sc = letters_score(c)
    return (F.when(sc == -1, F.lit("Left")).when(sc == 0, F.lit("Centre"))
             .when(sc == 1, F.lit("Right")).otherwise(_null()))


def norm_title(c) -> Column:
    """L3: title-case + strip, exact Left/Center/Right only (a 'Centre' is lost)."""
    s = F.lower(ws_trim(_c(c)))
    return (F.when(s == "left", F.lit("Left")).when(s == "center", F.lit("Center"))
             .when(s == "right", F.lit("Right")).otherwise(_null()))


def norm_capitalize(c) -> Column:
    """L4: strip, first letter upper and rest lower, Center -> Centre; everything else kept."""
    s = ws_trim(_c(c))
    cap = F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
    return F.when(cap == "Center", F.lit("Centre")).otherwise(cap)


def parse_reply(c) -> Column:
    """Free-text model reply -> Left / Right / Center / first-word lookup / Unknown.

    Word-bounded, precedence Left > Right > Center. An empty reply gives NULL, which
    means "ask the backup prompt" to the classifier.
    """
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    # A first word equal to one of the class words is itself a whole word, so the
    # word-bounded tests below already cover a "first word" lookup.
    return (F.when(ws_trim(s) == "", _null())
             .when(s.rlike(r"\bleft\b"), F.lit("Left"))
             .when(s.rlike(r"\bright\b"), F.lit("Right"))
             .when(s.rlike(r"\b(center|centre|neutral)\b"), F.lit("Center"))
             .otherwise(F.lit("Unknown")))


def map_sentiment(c) -> Column:
    """LABEL_0/1/2 -> negative/neutral/positive, other -> unknown."""
    e = F.when(F.lit(False), _null())
    for k, v in SENTIMENT.items():
        e = e.when(_c(c) == k, F.lit(v))
    return e.otherwise(F.lit("unknown"))


def title_score(c) -> Column:
    """L3 followed by L7 in one CASE: Left -1, Center 0, Right 1 after strip + title-case."""
    s = F.lower(ws_trim(_c(c)))
    return (F.when(s == "left", F.lit(-1)).when(s == "center", F.lit(0))
             .when(s == "right", F.lit(1)))


def label_score(c) -> Column:
    """Left -1, Center 0, Right 1, else null (applied after L3)."""
    e = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in SCORE.items():
        e = e.when(_c(c) == k, F.lit(v))
    return e


def label_status(c) -> Column:
    """Ok / failed from the failure sentinels; null label -> null."""
    return (F.when(_c(c).isNull(), _null())
             .when(_c(c).isin(FAILED_EXACT) | _c(c).rlike(FAILED_PATTERN), F.lit("failed"))
             .otherwise(F.lit("ok")))


def display_name(c, mapping: dict[str, str]) -> Column:
    """Lookup with unmapped values kept."""
    e = F.when(F.lit(False), _null())
    for k, v in mapping.items():
        e = e.when(_c(c) == k, F.lit(v))
    return e.otherwise(_c(c))


POLICIES = {
    "substring": norm_substring,
    "letters": norm_letters,
    "title": norm_title,
    "capitalize": norm_capitalize,
    "reply": parse_reply,
}


def normalize_label(c, policy: str) -> Column:
    """Apply one named normaliser policy."""
    return POLICIES[policy](c)
