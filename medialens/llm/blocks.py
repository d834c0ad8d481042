"""Corpora as blocks of word places, so that tables keyed by word can meet every occurrence.

A block holds the texts of some consecutive rows (about ``BLOCK_WORDS`` words, or one longer
text): its distinct words, the place in that list of every word occurrence (byte planes,
compressed), and the rows' key columns. Each block deals its distinct words out to buckets by
hash, as one compressed row per bucket; a bucket sees every block that has its words, answers
once per distinct word, and the answers come back to the blocks by place. So a word that is in
every text travels once per block, not once per occurrence, and no key is hot: the number of
buckets follows the number of words dealt (``BUCKET_WORDS`` each). Blocks are written to the
shared folder, so later passes agree on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import textbytes as tb
from .scratch import stage

BLOCK_WORDS = 1_200_000
BUCKET_WORDS = 250_000

Split = Callable[[pa.Array], tuple[np.ndarray, tb.Spans]]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Non-negative integers of ``width`` bytes as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    """Ascending integers, as their differences."""
    return pack(np.diff(values, prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.int64))


#: Bytes of the first stream of a packed sequence that stand for a word that occurs once, and for a rarer word.
_ONCE, _RARE = 254, 255


def pack_sequence(places: np.ndarray, n_often: int) -> bytes:
    """Word places in text order. Places from ``n_often`` on occur once, in ascending order."""
    once = places >= n_often
    rare = ~once & (places >= _ONCE)
    first = squeeze(np.where(once, _ONCE, np.where(rare, _RARE, places)).astype(np.uint8).tobytes())
    return len(first).to_bytes(4, "little") + n_often.to_bytes(4, "little") + first + pack(places[rare])


def unpack_sequence(data: bytes) -> np.ndarray:
    size, n_often = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    first = np.frombuffer(unsqueeze(data[8:8 + size]), np.uint8)
    out = first.astype(np.int32)
    once = first == _ONCE
    out[once] = n_often + np.arange(int(once.sum()))
    out[first == _RARE] = unpack(data[8 + size:])
    return out


def pack_words(words: list[bytes]) -> bytes:
    """Words without line feeds as one compressed string."""
    return squeeze(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = unsqueeze(data)
    return raw.split(b"\n") if raw else []


class _Block:
    def __init__(self) -> None:
        self.keys: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.words: dict[int, bytes] = {}
        self.n = 0

    def add(self, keys: pa.Array, data: np.ndarray, spans: tb.Spans) -> None:
        hashes = spans.hashes(data)
        distinct, first = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        for key, a, b in zip(distinct.tolist(), spans.start[first].tolist(), spans.end[first].tolist(), strict=True):
            if key not in self.words:
                self.words[key] = raw[a:b]
        self.keys.append(keys)
        self.lengths.append(spans.per_row())
        self.hashes.append(hashes)
        self.n += len(hashes)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        distinct, first, inverse, counts = np.unique(np.concatenate(self.hashes), return_index=True,
                                                     return_inverse=True, return_counts=True)
        order = np.lexsort((first, -counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys = pa.concat_arrays(self.keys)
        lengths = np.concatenate(self.lengths)
        one = lambda values, n: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
        words = pack_words([self.words[h] for h in distinct[order].tolist()])
        columns = [pa.array([number], pa.int64()), one(keys, len(keys)), one(pa.array(lengths), len(lengths)),
                   pa.array([len(order)], pa.int64()), pa.array([words], pa.binary()),
                   pa.array([pack_sequence(rank[inverse], int((counts > 1).sum()))], pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks(df: DataFrame, keys: list[str], text: str, split: Split, name: str) -> DataFrame:
    """Written blocks of ``df``: block, keys (array of structs), lengths, n_distinct, words, places.

    ``split`` turns a text slice into the bytes that words are spelled with and their spans.
    """
    df = df.select(F.struct(*(F.col(f"`{k}`").alias(k) for k in keys)).alias("keys"), F.col(f"`{text}`").alias("text"))
    schema = StructType([
        StructField("block", LongType()), StructField("keys", ArrayType(df.schema["keys"].dataType)),
        StructField("lengths", ArrayType(LongType())), StructField("n_distinct", LongType()),
        StructField("words", BinaryType()), StructField("places", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for piece in tb.slices(batch, "text"):
                block.add(piece.column("keys"), *split(piece.column("text")))
                if block.n >= BLOCK_WORDS:
                    yield block.row(number, arrow)
                    number, block = number + 1, _Block()
        if block.keys:
            yield block.row(number, arrow)

    return stage(df.mapInArrow(run, schema), name)


def ask(made: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, columns: tuple[str, ...] = (),
        note: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """Deal the words of all blocks to buckets and answer them: ``work`` of each bucket's table.

    The table has one row per block: block, places (packed), words (packed) and, with ``note``,
    its number for each word (packed), made from the block row's ``columns``.
    """
    total = made.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    n_buckets = max(1, math.ceil(total / BUCKET_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.array(unpack_words(row["words"]), object)
                if not len(words):
                    continue
                spelled = pa.array(words, pa.large_binary()).cast(pa.large_string())
                data, off = tb.view(spelled)
                bucket = tb.span_hashes(data, off[:-1], off[1:]) % np.uint64(n_buckets)
                noted = note(row) if note else np.zeros(len(words), np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1).astype(np.uint64))
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    at = order[bounds[b]:bounds[b + 1]]
                    yield pa.RecordBatch.from_pylist([{
                        "bucket": b, "block": row["block"], "places": pack_rising(at), "words": pack_words(words[at].tolist()),
                        "notes": pack(noted[at])}])

    dealt = made.select("block", "words", *columns).mapInArrow(
        deal, "bucket bigint, block bigint, places binary, words binary, notes binary")
    return dealt.groupBy("bucket").applyInArrow(work, schema)


def gather(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of some lists, and for every word of all lists in order its index there."""
    index: dict[bytes, int] = {}
    which = [index.setdefault(w, len(index)) for own in words for w in own]
    return list(index), np.array(which, np.int64)


def per_block(made: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table],
              schema: StructType | str, columns: tuple[str, ...]) -> DataFrame:
    """Bring answers to their blocks: ``work(block table, answers)`` gives rows of ``schema``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return work(left, right)

    left = made.select(F.col("block").alias("home"), *columns)
    right = answers.select(F.col("block").alias("of"), *[c for c in answers.columns if c != "block"])
    return left.groupBy("home").cogroup(right.groupBy("of")).applyInArrow(run, schema)


def take_runs(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenated runs ``offsets[w]:offsets[w + 1]`` for w in ``which``, and run lengths."""
    length = (offsets[1:] - offsets[:-1])[which]
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(offsets[:-1][which] - (end - length), length), length
