"""HTML body -> visible text (S6) as one native expression.

The text is split at tags, comments and whole script or style elements; each piece has its
character references decoded and is stripped, empty ones are skipped and the rest are joined
by a separator. Text inside ``template`` elements is hidden too: pages that have one go through a
running stack of open elements (``aggregate``), in which an element left open ends with the one
around it. No Python worker and no exchange. A missing input gives ''.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, ws_trim

#: A tag: its attributes may hold any character between quotes. What the end of the page cuts off is text.
_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+(?:>|["'][^>]*+>)"""
BOUNDARY = (r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\z)|<!--.*?-->|<![^d\[>-][^>]*+>|</?[a-z]" + _ATTRIBUTES)
#: Document types and processing instructions are no boundaries: text around them is one piece.
DECLARATION = r"(?i)<(?:!d|\?)[^>]*+>"

# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

#: Named references that count without a semicolon, longest first.
SHORT_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: Numeric references to 0x80-0x9F mean the Windows character of that byte.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_SEP = "\x1f"


def _names() -> Column:
    """All named references as one map (folded to a literal)."""
    split = lambda xs: F.split(F.lit(_SEP.join(xs)), _SEP)
    return F.map_from_arrays(split(html5), split(html5.values()))


def _code_point(number: Column) -> Column:
    """The character of a numeric reference ``#123;`` or ``#x7B;``."""
    digits = F.regexp_extract(number, "([0-9a-fA-F]+);?$", 1)
    n = F.when(F.lower(F.substring(number, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
    n = F.coalesce(n.try_cast("bigint"), F.lit(1 << 40))
    windows = F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv])
    low = n.bitwiseAND(F.lit(0xFFFF))
    nothing = (n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("�"))
             .when(n.between(0x80, 0x9F), F.try_element_at(windows, n.cast("int")))
             .when(nothing, F.lit("")).otherwise(char))


def unescape(text: Column) -> Column:
    """Character references decoded, as the HTML standard has it."""
    def one(part: Column) -> Column:
        number = F.regexp_extract(part, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
        name = F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]*;", 0)
        short = F.regexp_extract(part, f"^(?:{'|'.join(SHORT_NAMES)})", 0)
        rest = lambda taken: F.substring(part, F.length(taken) + 1, F.length(part))
        named = F.try_element_at(_names(), name)
        return (F.when(number != "", F.concat(_code_point(number), rest(number)))
                 .when((name != "") & named.isNotNull(), F.concat(named, rest(name)))
                 .when(short != "", F.concat(F.try_element_at(_names(), short), rest(short)))
                 .otherwise(F.concat(F.lit("&"), part)))
    parts = F.split(text, "&")
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def _shown(html: Column) -> Column:
    """The pieces outside ``template`` elements."""
    tags = F.regexp_extract_all(html, F.lit(BOUNDARY), F.lit(0))
    steps = F.zip_with(tags, F.slice(F.split(html, BOUNDARY), F.lit(2), F.size(tags) + 1), lambda t, p: F.struct(t.alias("tag"), p.alias("piece")))
    first = F.split(html, BOUNDARY)[0]
    state = F.struct(F.array().cast("array<string>").alias("open"), F.array(first).alias("shown"))

    def step(acc: Column, s: Column) -> Column:
        name = F.lower(F.regexp_extract(s["tag"], "^</?([A-Za-z][^\\s/>]*)", 1))
        closing, whole = s["tag"].startswith("</"), s["tag"].startswith("<!") | s["tag"].rlike("(?is)^<(?:script|style)\\b|/>$")
        depth = F.size(acc["open"])
        # the last open element of that name, from the end
        back = F.array_position(F.reverse(acc["open"]), name).cast("int")
        closed = F.when(back > 0, F.slice(acc["open"], F.lit(1), depth - back)).otherwise(acc["open"])
        opened = F.when(whole | name.isin(VOID) | (name == ""), acc["open"]).otherwise(F.array_append(acc["open"], name))
        now = F.when(closing, closed).otherwise(opened)
        shown = F.when(F.array_contains(now, "template"), acc["shown"]).otherwise(F.array_append(acc["shown"], s["piece"]))
        return F.struct(now.alias("open"), shown.alias("shown"))
    return F.aggregate(steps, state, step)["shown"]


def html_text(html: Column | str, sep: str = "\n") -> Column:
    """The visible text of an HTML string."""
    html = F.coalesce((F.col(html) if isinstance(html, str) else html).cast("string"), F.lit(""))
    pieces = F.when(html.rlike("(?i)<template"), _shown(html)).otherwise(F.split(html, BOUNDARY))
    plain = F.transform(pieces, lambda p: ws_trim(unescape(F.regexp_replace(p, DECLARATION, ""))))
    return F.array_join(F.filter(plain, lambda p: p != ""), sep)


def extract_html_text(df: DataFrame, col: str, out: str = "text", sep: str = "\n") -> DataFrame:
    """Add ``out`` = visible text of ``col`` to every row; all other columns pass through."""
    return df.withColumn(out, html_text(col, sep))


def html_text_sql(html: str, sep: str = "chr(10)") -> str:
    """DuckDB SQL for :func:`html_text` on pages without ``template`` elements."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    tag = r"""(?is)<script\b[^>]*>.*?(?:</script\b[^>]*>|\z)|<style\b[^>]*>.*?(?:</style\b[^>]*>|\z)|<!--.*?-->|<![^d\[>-][^>]*>""" \
          r"""|</?[a-z](?:[^'">]|"[^"]*"|'[^']*')*(?:>|["'][^>]*>)"""
    named = ", ".join(f"{q(n)}: {q(v)}" for n, v in html5.items())
    windows = ", ".join(f"{n}: {q(c)}" for n, c in WINDOWS.items())
    number = r"regexp_extract(part, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?')"
    name = r"regexp_extract(part, '^[A-Za-z][A-Za-z0-9]*;')"
    short = f"regexp_extract(part, '^(?:{'|'.join(SHORT_NAMES)})')"
    cp = (f"COALESCE(CASE WHEN lower({number}[2]) = 'x' THEN TRY_CAST('0x' || regexp_extract({number}, '([0-9a-fA-F]+);?$', 1) AS BIGINT) "
          f"ELSE TRY_CAST(regexp_extract({number}, '([0-9]+);?$', 1) AS BIGINT) END, 1099511627776)")
    char = (f"CASE WHEN {cp} = 0 OR {cp} BETWEEN 55296 AND 57343 OR {cp} > 1114111 THEN chr(65533) "
            f"WHEN {cp} BETWEEN 128 AND 159 THEN (MAP {{{windows}}})[{cp}] "
            f"WHEN {cp} BETWEEN 1 AND 8 OR {cp} = 11 OR {cp} BETWEEN 14 AND 31 OR {cp} = 127 OR {cp} BETWEEN 64976 AND 65007 "
            f"OR {cp} & 65535 >= 65534 THEN '' ELSE chr(CAST({cp} AS INTEGER)) END")
    names = f"(MAP {{{named}}})"
    one = (f"CASE WHEN {number} <> '' THEN {char} || part[length({number}) + 1:] "
           f"WHEN {name} <> '' AND {names}[{name}] IS NOT NULL THEN {names}[{name}] || part[length({name}) + 1:] "
           f"WHEN {short} <> '' THEN {names}[{short}] || part[length({short}) + 1:] ELSE '&' || part END")
    bare = "regexp_replace(piece, '(?i)<(?:!d|\\?)[^>]*>', '', 'g')"
    decoded = (f"CASE WHEN contains({bare}, '&') THEN string_split({bare}, '&')[1] || "
               f"array_to_string(list_transform(string_split({bare}, '&')[2:], lambda part: {one}), '') ELSE {bare} END")
    pieces = f"regexp_split_to_array(COALESCE({html}, ''), {q(tag)})"
    plain = f"list_transform({pieces}, lambda piece: trim({decoded}, {q(WS_CHARS)}))"
    return f"array_to_string(list_filter({plain}, lambda piece: piece <> ''), {sep})"
