"""Lookups of a text's tokens in a large table without shuffling the texts.

The distinct tokens of the corpus (pre-aggregated per task) meet the table once; the entries
that some text needs are written to the shared folder, measured, and sent to the tasks in parts
of at most ``PART_BYTES``: one part if the table is small, one pass over the token arrays for
each further part if it is not. So the shuffle follows the distinct tokens, a frequent token is
one row per task however many texts hold it, and the texts stay where they are.

A Python worker holds one part and the answers of ``PIECE_TOKENS`` tokens at a time: between two
parts the rows are written to the shared folder, and a batch's answers leave in pieces.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Bytes of entries (tokens, values and offsets) that are sent to the tasks at once.
PART_BYTES = 64 << 20
#: Tokens that are answered at once (a single row may have more).
PIECE_TOKENS = 1 << 18


def needed_entries(df: DataFrame, tokens: str, table: DataFrame, token: str = "token") -> DataFrame:
    """The rows of ``table`` whose token occurs in an array of ``df``."""
    seen = df.select(F.explode(F.array_distinct(tokens)).alias(token)).distinct()
    return table.join(seen, token, "left_semi")


def lookup(df: DataFrame, tokens: str, table: DataFrame, token: str = "token", value: str = "value",
           out: str = "values", part_bytes: int = PART_BYTES) -> DataFrame:
    """Append array column ``out``: the table's value of every token in the array ``tokens``, in order.

    A token without an entry gives null, a null array null; of several entries of one token the
    least value counts. ``table`` may be of any size and is read once.
    """
    spark = df.sparkSession
    entries = table.select(F.col(token).alias("token"), F.col(value).alias("value")).filter("token IS NOT NULL AND value IS NOT NULL")
    entries = needed_entries(df, tokens, entries).groupBy("token").agg(F.min("value").alias("value"))
    path = scratch_dir(spark, f"entries-{uuid.uuid4().hex}")
    # a value's length as JSON is at least near its size in memory
    sized = F.length("token") + F.coalesce(F.length(F.to_json(F.struct("value"))), F.lit(0)) + 16
    entries.withColumn("bytes", sized.cast("bigint")).write.parquet(path)
    entries = spark.read.parquet(path)
    parts = max(1, math.ceil((entries.agg(F.sum("bytes")).first()[0] or 0) / part_bytes))
    kind = entries.schema["value"].dataType
    for part in range(parts):
        own = entries.filter(F.pmod(F.xxhash64("token"), F.lit(parts)) == part).select("token", "value")
        answer = _answer(spark.sparkContext.broadcast(_as_bytes(own.toArrow())), kind)
        found = answer(F.col(tokens))
        df = df.withColumn(out, found if part == 0 else F.zip_with(out, found, lambda a, b: F.coalesce(a, b)))
        if part + 1 < parts:
            # the next part has workers of its own, after these have ended
            path = scratch_dir(spark, f"answers-{uuid.uuid4().hex}")
            df.write.parquet(path)
            df = spark.read.schema(df.schema).parquet(path)
    return df


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _answer(sent, kind):
    """An Arrow UDF from token arrays to arrays of values; a piece's distinct tokens are looked up once."""
    import pyarrow.compute as pc

    def pieces(lists: pa.Array) -> Iterator[pa.Array]:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(lists):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_TOKENS, "right")))
            yield lists.slice(at, upto - at)
            at = upto

    def values_of(lists: pa.Array, table: pa.Table) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        at = pc.index_in(flat.dictionary, value_set=table.column("token"))
        values = table.column("value").take(at).combine_chunks() if table.num_rows else pa.nulls(len(at), table.schema.field("value").type)
        values = values.take(flat.indices)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
        off = pc.cumulative_sum(lengths).to_pylist()
        starts = [0, *off]
        offsets = pa.array([None if n else s for n, s in zip([*lists.is_null().to_pylist(), False], starts, strict=True)], pa.int32())
        return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else values.combine_chunks())

    @F.arrow_udf(f"array<{kind.simpleString()}>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        for lists in batches:
            for piece in pieces(lists):
                yield values_of(piece, table)

    return answer
