"""Format-preserving pseudonyms of personal data by keyed Feistel permutations (operator 9).

Payment cards (Luhn), bank accounts (mod 97), social-security numbers, telephone numbers, IPv4
addresses, e-mail addresses and calendar dates are found and validated; each valid one is mapped
by a keyed permutation of all values of its own format, so the result is valid again, and equal
values become equal pseudonyms in every document. A match that fails validation may hold a value
and something beside it (a card and its expiry date): its groups are tried, then what follows the
first of them. A number that fails all that stays as it is. Where a pseudonym would make a match
valid that was tried in vain before, the next pseudonym in the permutation is taken, so that it can
be undone; there, and for dates as month/day, equal values may have different pseudonyms.

The permutation is a Feistel network on the value's bits with keyed BLAKE2 rounds; results
outside the format are walked through the permutation again until one is inside. Only whoever
holds the key can compute or undo it. Rows are independent: no shuffle, no table of values.

Cases: null texts stay null with nothing found; empty texts stay empty; texts of any length are
scanned whole; equal rows give equal results; other columns are kept as they are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from datetime import date, timedelta
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "phone", "ip", "email", "date")
_FIRST, _LAST = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (_LAST - _FIRST).days + 1

_FIND = re.compile(r"""
   (?P<email>(?<![\w.+%-])[^\W_][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-]))
 | (?P<iban>(?<!\w)[A-Z]{2}[0-9][0-9](?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
 | (?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)
     |(?<![\w(+.-])(?<![0-9]\ )(?:1[ .-])?(?:\([2-9][0-8][0-9]\)[ .-]?|[2-9][0-8][0-9][ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|[ .][0-9]))
 | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9][0-9]-[0-9]{4}(?![\w-]))
 | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9][0-9]-[0-9][0-9]|[0-9][0-9][/.][0-9][0-9][/.][0-9]{4})(?![\w/-]|\.[0-9]))
 | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
 | (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
""", re.X)

_HAS_MARK = re.compile(r"[0-9@]").search
#: Bytes of which every value has one: digits and the at sign.
_MARK = np.zeros(256, bool)
_MARK[[*range(0x30, 0x3A), 0x40]] = True


def permute(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    left = max(1, (size - 1).bit_length() // 2)
    right = max(1, (size - 1).bit_length() - left)

    def noise(i: int, half: int, bits: int) -> int:
        out = b""
        while len(out) * 8 < bits:
            out += blake2b(b"%d|%d|%d|" % (i, half, len(out)) + tweak, key=key, digest_size=32).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    while True:
        a, b = value >> right, value & ((1 << right) - 1)
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if i % 2:
                b ^= noise(i, a, right)
            else:
                a ^= noise(i, b, left)
        value = a << right | b
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + check a valid card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


def _walk(digits: str, key: bytes, tweak: bytes, inverse: bool, valid: Callable[[str], bool]) -> str:
    """Permutes decimal strings of one length among those that are valid."""
    while True:
        digits = str(permute(int(digits), 10 ** len(digits), key, tweak, inverse)).zfill(len(digits))
        if valid(digits):
            return digits


def _card(raw: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", raw)
    if int(digits) == 0 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = _walk(digits[:-1], key, b"card%d" % len(digits), inverse, lambda d: d.strip("0") != "")
    return _refill(raw, body + str(luhn(body)))


def _letters_value(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(raw: str, key: bytes, inverse: bool) -> str | None:
    flat = raw.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _letters_value(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _spelled(flat[4:], key, b"iban" + flat[:2].encode(), inverse)
    check = 98 - _letters_value(body + flat[:2] + "00") % 97
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(next(it) if c != " " else c for c in raw)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(raw: str, key: bytes, inverse: bool) -> str | None:
    digits = raw.replace("-", "")
    return _refill(raw, _walk(digits, key, b"ssn", inverse, _ssn_valid)) if _ssn_valid(digits) else None


def _american(digits: str, key: bytes, inverse: bool) -> str:
    """Ten digits; whether they can stand without +1 is kept, so that both spellings have one pseudonym."""
    national = lambda d: d[0] in "23456789" and d[1] != "9"
    return _walk(digits, key, b"phone+1", inverse, lambda d: national(d) == national(digits))


def _phone(raw: str, key: bytes, inverse: bool) -> str | None:
    if raw[0] != "+":
        at = 1 if raw[0] == "1" else 0
        return raw[:at] + _refill(raw[at:], _american(re.sub(r"\D", "", raw[at:]), key, inverse))
    country = re.match(r"\+[0-9]{1,3}", raw)[0] if not raw.startswith("+1") else "+1"
    rest = re.sub(r"\D", "", raw[len(country):])
    if not 8 <= len(rest) + len(country) - 1 <= 15 or len(rest) < 4 or (country == "+1" and len(rest) != 10):
        return None
    moved = _american(rest, key, inverse) if country == "+1" else \
        _walk(rest, key, b"phone" + country.encode(), inverse, lambda d: True)
    return country + _refill(raw[len(country):], moved)


def _ip(raw: str, key: bytes, inverse: bool) -> str | None:
    parts = raw.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    out = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip", inverse)
    return ".".join(map(str, out.to_bytes(4, "big")))


#: Character classes that a spelled value keeps: first character, size.
_CLASSES = (("a", 26), ("A", 26), ("0", 10), ("à", 23), ("ø", 8))


def _spelled(text: str, key: bytes, tweak: bytes, inverse: bool) -> str:
    """Permutes all strings with the same character classes; other characters stay."""
    value, size, places = 0, 1, []
    for c in text:
        where = next(((first, n) for first, n in _CLASSES if 0 <= ord(c) - ord(first) < n), None)
        places.append(where)
        if where:
            value = value * where[1] + ord(c) - ord(where[0])
            size *= where[1]
    shape = "".join(p[0] if p else c for p, c in zip(places, text, strict=True))
    value = permute(value, size, key, tweak + shape.encode(), inverse)
    out = []
    for c, where in zip(reversed(text), reversed(places), strict=True):
        if where:
            value, digit = divmod(value, where[1])
            c = chr(ord(where[0]) + digit)
        out.append(c)
    return "".join(reversed(out))


def _email(raw: str, key: bytes, inverse: bool) -> str | None:
    local, _, host = raw.rpartition("@")
    return f"{_spelled(local, key, b'mail@' + host.lower().encode(), inverse)}@{host}"


def _date(raw: str, key: bytes, inverse: bool) -> str | None:
    iso, mark = raw[4] == "-", raw[2]
    parts = list(map(int, raw.split("-"))) if iso else list(map(int, reversed(raw.split(mark))))
    # month/day where day/month is no date: the day is over 12 and stays so
    american = not iso and mark == "/" and parts[1] > 12
    if american:
        parts[1:] = parts[:0:-1]
    try:
        day = date(*parts)
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    while True:
        day = _FIRST + timedelta(permute((day - _FIRST).days, _DAYS, key, b"date", inverse))
        if not american or day.day > 12:
            break
    year, month, n = day.isoformat().split("-")
    return day.isoformat() if iso else mark.join((month, n, year) if american else (n, month, year))


_MAPS = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "email": _email, "date": _date}


@functools.lru_cache(100_000)
def pseudonym(kind: str, raw: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of a found value (or, inverted, the value again); None if it isn't valid."""
    return _MAPS[kind](raw, key, inverse)


_GROUP = re.compile(r"[^\W_]+")
#: Characters that a match of figures can reach beyond a value in it.
REACH = 128
#: Lengths of the groups in which cards are printed.
_PRINTED = ((4, 4, 4, 4), (4, 6, 5))


def _spans(kind: str, raw: str) -> list[tuple[int, int]]:
    """Where the value may be in a match: cards as printed, all of it, then fewer groups of it, longest first."""
    if kind not in ("card", "iban", "phone"):
        return [(0, len(raw))]
    groups = [g.span() for g in _GROUP.finditer(raw)]
    sizes = [e - s for s, e in groups]
    printed, parts = [], []
    for i in range(len(groups)) if kind == "card" else range(1):
        for j in range(i + 1, len(groups) + 1):
            span = groups[i][0] if i else 0, groups[j - 1][1]
            if kind == "card" and tuple(sizes[i:j]) in _PRINTED:
                printed.append(span)
            elif j - i < len(groups) and (kind != "card" or 13 <= sum(sizes[i:j]) <= 19):
                parts.append(span)
    return [*printed, (0, len(raw)), *sorted(parts, key=lambda x: x[0] - x[1])]


def _next(line: str, at: int, key: bytes, inverse: bool) -> tuple[str, int, int, str, int | None] | None:
    """(kind, start, end, pseudonym, first match over it that was tried in vain) of the first valid value from ``at`` on."""
    vain: list[tuple[int, int]] = []
    while m := _FIND.search(line, at):
        for s, e in _spans(m.lastgroup, m[0]):
            out = pseudonym(m.lastgroup, m[0][s:e], key, inverse)
            start = m.start() + s
            if out is not None:
                return m.lastgroup, start, m.start() + e, out, next((f for f, t in vain if t > start), None)
            vain.append((m.start(), m.end()))
        vain = [x for x in vain if x[1] > m.start()]
        # the rest of the match may begin a value of another kind
        at = min(_GROUP.search(line, m.start()).end(), m.end())
    return None


def _replace_line(line: str, key: bytes, inverse: bool, found: list[tuple[str, str, str]]) -> str:
    done, at = [], 0
    while hit := _next(line, at, key, inverse):
        kind, start, end, out, vain = hit
        found.append((kind, line[start:end], out))
        if vain is not None:
            # what was tried in vain must not become valid by the change, or the value couldn't be found again
            low, rest = max(0, vain - 2), line[end:end + REACH]
            while (again := _next(line[low:start] + out + rest, vain - low, key, inverse)) is None or \
                    again[:3] != (kind, start - low, start - low + len(out)):
                out = pseudonym(kind, out, key, inverse)
            found[-1] = found[-1][:2] + (out,)
        done += [line[at:start], out]
        at = end
    return "".join(done) + line[at:]


def replace_all(text: str, key: bytes, inverse: bool = False) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with every valid value replaced, and (kind, value, pseudonym) in text order."""
    found: list[tuple[str, str, str]] = []
    # no format spans lines, and every value holds a digit or an at sign
    return "\n".join(_replace_line(x, key, inverse, found) if _HAS_MARK(x) else x for x in text.split("\n")), found


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", into: str = "private",
                 inverse: bool = False) -> DataFrame:
    """``df`` with a struct: the changed text, the count of replaced values, their kinds and pseudonyms."""
    def work(column: pa.Array):
        data, off = tb.view(column)
        marks = np.concatenate(([0], np.cumsum(_MARK[data], dtype=np.int64)))[off]
        done = [(t, []) if not marked else replace_all(t, key, inverse)
                for t, marked in zip(column.to_pylist(), np.diff(marks), strict=True)]
        return [[t for t, _ in done], [len(f) for _, f in done], [[x[0] for x in f] for _, f in done],
                [[x[2] for x in f] for _, f in done]]

    return tb.map_text(df, text, into, "text string, n_found bigint, kinds array<string>, pseudonyms array<string>",
                       lambda: work)
