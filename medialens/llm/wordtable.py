"""BPE encoding and decoding through a table of distinct words (operator 7).

Texts are split into words in Spark (numpy byte spans, kept as blocks); the blocks' distinct
words meet in hash buckets, where each distinct word of the corpus is encoded once; the ids come
back to every occurrence by block and place and are strung together in text order; a join of
the ids with the tokenizer's id-to-piece table (as large as its vocabulary) decodes them.

A word here is a run of text that the tokenizer never joins with its neighbours: it ends at
ASCII white space, and between an ASCII letter or digit and ASCII punctuation other than the
quote (contractions stay whole). Special strings are never cut.

Cases: null and empty texts have no ids and decode to the empty text; a special string inside a
text is its own id, as the library has it; repeated rows give repeated rows; null ids stay.
"""

from __future__ import annotations

import functools
import json
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import blocks as bk
from . import textbytes as tb

#: Distinct words handed to the tokenizer at once.
ENCODED_AT_ONCE = 10_000

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Punctuation that a word boundary may touch: ASCII, neither white space nor the quote.
_MARK = ~_WORDLIKE
_MARK[0x80:] = False
_MARK[:0x21] = False
_MARK[[0x27, 0x7F]] = False


def split(column: pa.Array, specials: list[bytes]) -> tuple[np.ndarray, tb.Spans]:
    """Lower-cased bytes (special strings as they are) and the spans of words."""
    original, off = tb.view(column)
    data = tb.LOWER[original]
    raw, low = original.tobytes(), data.tobytes()
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (_WORDLIKE[data[:-1]] & _MARK[data[1:]]) | (_MARK[data[:-1]] & _WORDLIKE[data[1:]])
    for special in specials:
        at = low.find(special)
        while at >= 0:
            cut[at + 1:at + len(special)] = False
            if raw[at:at + len(special)] != special:
                data[at:at + len(special)] = original[at:at + len(special)]
            at = low.find(special, at + 1)
    return data, CutSpans(data, off, cut)


class CutSpans(tb.Spans):
    """Runs of non-white bytes, further divided before the bytes marked in ``cut``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, cut: np.ndarray):
        super().__init__(data, off, tb.SPACE)
        begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        begins[self.start] = ends[self.end] = True
        inner = cut.copy()
        inner[:-1] &= self.inside
        inner[1:] &= self.inside
        begins |= inner
        ends |= inner
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.row = np.searchsorted(off, self.start, "right") - 1


def _specials(spec: str) -> list[bytes]:
    return [t["content"].encode() for t in json.loads(spec)["added_tokens"]]


def _piece_table(spec: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokenizer's pieces by id: their bytes and offsets."""
    table = json.loads(spec)
    named = {**{i: p for p, i in table["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in table["added_tokens"]}}
    spelled = [named.get(i, "").encode() for i in range(max(named) + 1)]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in spelled])))


@functools.lru_cache(1)
def _tokenizer(spec: str):
    """The library's tokenizer, built once per worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(made: DataFrame, spec) -> DataFrame:
    """(block, places, sizes, ids): the packed ids of the words at some places of a block.

    ``spec`` is a broadcast tokenizer file. Every distinct word of all blocks is encoded once.
    """
    def work(table: pa.Table) -> pa.Table:
        tokenizer = _tokenizer(spec.value)
        lists = [bk.unpack_words(w.as_py()) for w in table.column("words")]
        distinct, which = bk.gather(lists)
        sizes, parts = [], []
        for at in range(0, len(distinct), ENCODED_AT_ONCE):
            done = tokenizer.encode_batch([w.decode("utf-8") for w in distinct[at:at + ENCODED_AT_ONCE]],
                                          add_special_tokens=False)
            sizes += [len(e.ids) for e in done]
            parts.append(np.fromiter((i for e in done for i in e.ids), np.uint32))
        sizes, ids = np.array(sizes, np.int64), np.concatenate(parts)
        off = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        own = [which[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"block": table.column("block"), "places": table.column("places"),
                         "sizes": pa.array([bk.pack(sizes[x]) for x in own], pa.binary()),
                         "ids": pa.array([bk.pack(ids[bk.take_runs(off, x)[0]]) for x in own], pa.binary())})

    return bk.ask(made, work, "block bigint, places binary, sizes binary, ids binary")


def encode_decode(df: DataFrame, tokenizer_path: str, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns of each row, n_tokens, ids (little-endian unsigned 32-bit) and decoded text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    context = df.sparkSession.sparkContext
    # as large as the tokenizer's vocabulary, whatever the corpus
    sent, pieces = context.broadcast(spec), context.broadcast(_piece_table(spec))
    specials = _specials(spec)
    made = bk.blocks(df, keys, text, lambda column: split(column, specials), "bpe-blocks")
    schema = StructType([*made.schema["keys"].dataType.elementType.fields,
                         *StructType.fromDDL("n_tokens bigint, ids binary, decoded string").fields])

    def string_together(block: pa.Table, answers: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = []
        for row in range(block.num_rows):
            sizes, ids = np.zeros(block.column("n_distinct")[row].as_py() + 1, np.int32), []
            order = []
            for answer in answers.to_pylist():
                at = bk.unpack_rising(answer["places"])
                sizes[at] = bk.unpack(answer["sizes"])
                order.append(at)
                ids.append(bk.unpack(answer["ids"]))
            # where each place's ids lie in the concatenation of all answers
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            told = np.concatenate(order).astype(np.int64) if order else np.zeros(0, np.int64)
            first = np.zeros(len(sizes), np.int32)
            first[told] = np.cumsum(sizes[told]) - sizes[told]
            places = bk.unpack_sequence(block.column("places")[row].as_py())
            length = sizes[places]
            end = np.cumsum(length, dtype=np.int64)
            total = int(end[-1]) if len(end) else 0
            start = (first[places] - (end - length)).astype(np.int32)
            tokens = flat[np.arange(total, dtype=np.int32) + np.repeat(start, length)].astype("<u4")
            del first, start, length, flat, ids
            word_end = np.cumsum(np.asarray(block.column("lengths")[row].values, dtype=np.int64))
            bounds = np.concatenate(([0], end))[np.concatenate(([0], word_end))]
            spelled, off = pieces.value
            raw = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
                None, pa.py_buffer((4 * bounds).astype(np.int64)), pa.py_buffer(tokens.tobytes())])
            text = pa.array((_joined(spelled, off, tokens[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)),
                            pa.string())
            keys = block.column("keys")[row].values
            out.append(pa.Table.from_arrays([*keys.flatten(), pa.array(np.diff(bounds)), raw, text], names=schema.names)
                       .cast(to_arrow_schema(schema)))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return bk.per_block(made, encode_words(made, sent), string_together, schema, ("keys", "lengths", "n_distinct", "places"))


def _joined(text: np.ndarray, off: np.ndarray, which: np.ndarray) -> str:
    """The chosen strings joined by single spaces."""
    index, length = bk.take_runs(off, which)
    if not len(which):
        return ""
    out = np.full(len(index) + len(which) - 1, 0x20, np.uint8)
    out[np.arange(len(index)) + np.repeat(np.arange(len(which)), length)] = text[index]
    return out.tobytes().decode("utf-8")


def digests(df: DataFrame) -> DataFrame:
    """``ids_sha256`` and ``decoded_sha256`` in place of ids and decoded text."""
    return df.select(*[c for c in df.columns if c not in ("ids", "decoded")],
                     F.sha2("ids", 256).alias("ids_sha256"),
                     F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
