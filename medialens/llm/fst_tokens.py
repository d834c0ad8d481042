"""Token counts by compiled finite-state transducers (operator 5).

Two deterministic transducers are compiled from a byte-level BPE tokenizer file:

* the splitter reads character classes with one character of look-ahead and says where pieces
  begin. A slice of texts is cut into chunks of ``CHUNK`` characters; each chunk's map from entry
  state to exit state is found for all states at once, the maps are composed by a parallel
  prefix scan, and a second pass from the now known entry states writes the boundaries. Text
  rows and special strings reset the state, so chunks need not follow rows;
* the merger reads a piece byte by byte. A state holds the bytes that may still grow into a
  vocabulary entry and the last token at each of their positions; a transition is annotated
  with the number of tokens that it adds (negative where a merge takes tokens back). States are
  compiled when first reached and kept for the life of the worker, up to ``MAX_STATES``, after
  which the table starts anew.

The next token of a prefix is the longest vocabulary entry that ends there and may follow the
token before it; two tokens may be neighbours when the vocabulary's merges leave them apart.

Cases: null and empty texts have 0 bytes and 0 tokens; a special string inside a text is one
token; texts of any length are counted whole; repeated rows give equal rows.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb

CHUNK = 128
#: Characters after which chunk maps are checked for having become constant.
SETTLE = 16
SLICE = 4 << 20
MAX_STATES = 400_000
#: Piece counts that a worker remembers.
MAX_PIECES = 1_000_000

# character classes; "has next" variants are chosen by look-ahead
_LETTER, _NUMBER, _SPACE, _WHITE, _QUOTE, _OTHER = range(6)

# splitter symbols
(_S_SPACE_LAST, _S_SPACE, _S_WHITE_LAST, _S_WHITE, _S_TAIL1, _S_TAIL2, _S_LETTER, _S_NUMBER, _S_OTHER,
 _S_QUOTE) = range(10)
# splitter states: what the characters so far end in
(_FRESH, _AFTER_SPACE, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _AT_QUOTE, _MID_TAIL, _TAIL_DONE, _BEGIN) = range(9)


@functools.lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letters, numbers, the space, other white space, the quote, others."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a:b + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    out[0x20], out[0x27] = _SPACE, _QUOTE
    return out


@functools.lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a piece) by state and symbol; symbols + 10 are the first of a row."""
    after = {_S_SPACE_LAST: _AFTER_SPACE, _S_SPACE: _AFTER_SPACE, _S_WHITE_LAST: _FRESH, _S_WHITE: _FRESH,
             _S_TAIL1: _IN_LETTERS, _S_TAIL2: _IN_LETTERS, _S_LETTER: _IN_LETTERS, _S_NUMBER: _IN_NUMBERS,
             _S_OTHER: _IN_OTHERS, _S_QUOTE: _AT_QUOTE}
    step, begins = np.zeros((9, 20), np.uint8), np.ones((9, 20), bool)
    for state in range(9):
        for symbol, to in after.items():
            begin = True
            if symbol <= _S_WHITE:
                # inside a run of white space only its last character before a word stands apart
                begin = state not in (_FRESH, _AFTER_SPACE) or symbol in (_S_SPACE_LAST, _S_WHITE_LAST)
            elif state == _AFTER_SPACE:
                begin, to = False, _IN_OTHERS if symbol == _S_QUOTE else to
            elif state == _AT_QUOTE and symbol == _S_TAIL1:
                begin, to = False, _TAIL_DONE
            elif state == _AT_QUOTE and symbol == _S_TAIL2:
                begin, to = False, _MID_TAIL
            elif state == _MID_TAIL:
                begin, to = False, _TAIL_DONE
            elif (state, to) in ((_IN_LETTERS, _IN_LETTERS), (_IN_NUMBERS, _IN_NUMBERS)):
                begin = False
            elif state in (_IN_OTHERS, _AT_QUOTE) and symbol in (_S_OTHER, _S_QUOTE):
                begin, to = False, _IN_OTHERS
            step[state, symbol], begins[state, symbol] = to, begin
    for symbol in range(10):
        step[:, symbol + 10] = step[_BEGIN, symbol]
    return step, begins


def _symbols(points: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Splitter symbols of code points; ``row_start`` marks the first of each row."""
    kind = char_classes()[points]
    white = (kind == _SPACE) | (kind == _WHITE)
    n = len(points)
    has_next = np.zeros(n, bool)
    has_next[:-1] = ~row_start[1:]
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~white[1:]
    word_next &= has_next
    following = np.zeros(n, points.dtype)
    following[:-1] = points[1:]
    following[~has_next] = 0
    out = np.array([_S_LETTER, _S_NUMBER, _S_SPACE, _S_WHITE, _S_QUOTE, _S_OTHER], np.uint8)[kind]
    out[(kind == _SPACE) & word_next] = _S_SPACE_LAST
    out[(kind == _WHITE) & word_next] = _S_WHITE_LAST
    # tails of contractions only matter after a quote
    quoted = np.flatnonzero(kind[:-1] == _QUOTE) + 1
    c, d = points[quoted], following[quoted]
    one = (c == ord("s")) | (c == ord("t")) | (c == ord("m")) | (c == ord("d"))
    two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
    out[quoted[one]] = _S_TAIL1
    out[quoted[two]] = _S_TAIL2
    out[row_start] += 10
    return out


def piece_starts(points: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Marks the code points that begin a piece: chunk maps, their prefix scan, then one pass."""
    step, begins = splitter()
    n = len(points)
    lanes = -(-n // CHUNK)
    padded = np.zeros(lanes * CHUNK, np.uint8)
    padded[:n] = _symbols(points, row_start)
    symbols = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    flat = step.ravel()
    maps = np.tile(np.arange(9, dtype=np.uint8), (lanes, 1))
    for row in symbols[:SETTLE]:
        maps = flat[maps.astype(np.int16) * 20 + row[:, None]]
    # most maps are constant by now: those go on with one state, the others with all
    settled = (maps == maps[:, :1]).all(1)
    state, wide = maps[:, 0], np.flatnonzero(~settled)
    open_maps = maps[wide]
    for row in symbols[SETTLE:]:
        state = flat[state.astype(np.int16) * 20 + row]
        open_maps = flat[open_maps.astype(np.int16) * 20 + row[wide][:, None]]
    maps = np.repeat(state[:, None], 9, 1)
    maps[wide] = open_maps
    hop = 1
    while hop < lanes:
        maps[hop:] = np.take_along_axis(maps[hop:], maps[:-hop].astype(np.int64), 1)
        hop *= 2
    state = np.full(lanes, _BEGIN, np.uint8)
    state[1:] = maps[:-1, _BEGIN]
    found = np.empty((CHUNK, lanes), bool)
    flat_begins = begins.ravel()
    for i, row in enumerate(symbols):
        at = state.astype(np.int16) * 20 + row
        found[i] = flat_begins[at]
        state = flat[at]
    return found.T.ravel()[:n]


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Merger:
    """The merging transducer, compiled state by state."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.letters = _byte_letters()
        spec = json.loads(tokenizer_json)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.model = Tokenizer.from_str(tokenizer_json).model
        vocab = spec["model"]["vocab"]
        self.whole = {piece for piece in vocab if len(self.model.tokenize(piece)) == 1}
        self.grows = {piece[:i] for piece in vocab for i in range(1, len(piece))}
        self.apart: dict[str, dict[str, bool]] = {}
        self.counts: dict[int, int] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: the bytes (as letters) that may still grow, and the token that ends at each position where
        # a vocabulary entry may have begun, with its count less the present count
        self.apart.clear()
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.edges: dict[int, tuple[int, int]] = {}
        self._state(("", ((None, 0),)))

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def _neighbours(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        known = self.apart.setdefault(a, {})
        if b not in known:
            cut = self.model.tokenize(a + b)
            known[b] = len(cut) == 2 and cut[0].value == a
        return known[b]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        tail, lasts = self.keys[state]
        text = tail + self.letters[byte]
        open_, emitted, token = [], None, ""
        for i in range(len(text)):
            rest = text[i:]
            if lasts[i] is None:
                continue
            if rest in self.grows:
                open_.append(i)
            if emitted is None and rest in self.whole and self._neighbours(lasts[i][0], rest):
                emitted, token = lasts[i][1] + 1, rest
        if emitted is None:
            raise ValueError(f"no token ends at {text!r}")
        keep = open_[0] if open_ else len(text)
        ends = [None] * (len(text) - keep) + [(token, 0)]
        for i in open_:
            before, count = lasts[i]
            ends[i - keep] = (before, count - emitted)
        return self._state((text[keep:], tuple(ends))), emitted

    def count(self, raw: bytes) -> int:
        if len(self.keys) > MAX_STATES:
            self._reset()
        state = total = 0
        edges = self.edges
        for byte in raw:
            at = state << 8 | byte
            edge = edges.get(at)
            if edge is None:
                edge = edges[at] = self._compile(state, byte)
            state = edge[0]
            total += edge[1]
        return total


@functools.lru_cache(2)
def merger(tokenizer_json: str) -> Merger:
    return Merger(tokenizer_json)


def count_slice(column: pa.Array, machine: Merger) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of a slice."""
    data, off = tb.view(column)
    n_bytes = np.diff(off)
    n_tokens = np.zeros(len(n_bytes), np.int64)
    if not len(data):
        return n_bytes, n_tokens
    raw = data.tobytes()
    cuts, holes = set(off[:-1].tolist()), np.zeros(len(data) + 1, np.int64)
    for special in machine.special:
        at = raw.find(special)
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            if at + len(special) <= off[row + 1]:
                cuts |= {at, at + len(special)}
                holes[at] += 1
                holes[at + len(special)] -= 1
                n_tokens[row] += 1
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
    byte_at = np.flatnonzero(tb.code_points(data))
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[list(cuts)] = True
    start = byte_at[piece_starts(points, edge[byte_at])]
    end = np.append(start[1:], len(data))
    plain = np.cumsum(holes)[start] == 0
    row = np.searchsorted(off, start, "right") - 1
    hashes, where, inverse = np.unique(tb.span_hashes(data, start, end), return_index=True, return_inverse=True)
    known, counts = machine.counts, np.empty(len(hashes), np.int64)
    if len(known) > MAX_PIECES:
        known.clear()
    for i, (key, j) in enumerate(zip(hashes.tolist(), where.tolist(), strict=True)):
        n = known.get(key)
        if n is None:
            n = known[key] = machine.count(raw[start[j]:end[j]])
        counts[i] = n
    n_tokens += np.bincount(row, counts[inverse] * plain, len(n_bytes)).astype(np.int64)
    return n_bytes, n_tokens


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """``df`` with a struct of n_bytes and n_tokens. ``tokenizer_path`` is a byte-level BPE file
    on the driver; its content (a few MB, as large as its vocabulary) is sent to the tasks."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        machine = merger(spec.value)
        return lambda column: count_slice(column, machine)

    return tb.map_text(df, text, into, "n_bytes bigint, n_tokens bigint", make, SLICE)
