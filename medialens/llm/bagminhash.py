"""Near-duplicate texts by BagMinHash on word shingles (operator 1).

A text is the multiset of its windows of ``SHINGLE`` words (fewer words: one window). Its
signature has ``BANDS * ROWS`` registers; two signatures agree in a register with probability
equal to the weighted Jaccard similarity of the multisets. Registers are filled by hierarchical
Poisson processes over discretised weights: a shingle's weight axis is cut into the dyadic
blocks [0, 1), [1, 2), [2, 4), [4, 8) ..., each block has one process whose points come in order
of time with a register and a position in the block, and a point counts if its position (read
bit by bit, half by half) lies below the shingle's count. Points are only made up to a horizon
at which the text's registers are expected to be full; texts that have empty registers then go
on with twice the horizon. So the work is about shingles + registers * log(registers), not
their product.

Equal texts are collapsed first. Texts that agree in a whole band are candidates; ``linking``
verifies their multiset overlap and joins links into classes without forming all pairs.

Cases: null texts and texts without words are in no class but their own; any two texts of equal
words are copies, whatever the white space; the class id is the smallest doc id in the class
(null ids last, null if there is no other); repeated rows and repeated ids are separate rows;
a class keeps one row: the smallest id, then the smallest text, then any of equal rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linking
from . import textbytes as tb
from .scratch import stage

SHINGLE = 5
THRESHOLD = 0.8
#: 18 bands of 4 registers: a pair at 0.8 is missed with probability 8e-5.
BANDS, ROWS = 18, 4
#: exp(-exp(-HORIZON)) of the texts fill their registers in the first round.
HORIZON = 1.5

_U = np.uint64


def _words(column: pa.Array) -> tuple[tb.Spans, np.ndarray]:
    data, off = tb.view(column)
    words = tb.Spans(data, off, tb.SPACE)
    return words, words.hashes()


def shingles(words: tb.Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word window."""
    found, first = tb.windows(hashes, words.row, SHINGLE)
    row = words.row[first]
    count = words.per_row()
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            start = np.searchsorted(words.row, short)
            one = np.zeros(len(short), np.uint64)
            for i in range(n):
                one = one * tb.BASE + hashes[start + i]
            found, row = np.concatenate([found, tb.mix(one + _U(n))]), np.concatenate([row, short])
    return found, row


def _text_digest(words: tb.Spans, hashes: np.ndarray) -> list[pa.Array]:
    """Two hashes of each row's word sequence; null where it has no words."""
    place = np.arange(len(hashes)) - np.searchsorted(words.row, np.arange(words.n_rows))[words.row]
    full, first = np.unique(words.row, return_index=True)
    out = []
    for salt in (tb.BASE, _U(0xD1B54A32D192ED03)):
        sums = np.zeros(words.n_rows, np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(tb.mix(hashes ^ tb.mix((place.astype(np.uint64) + _U(1)) * salt)), first)
        out.append(pa.array(sums.view(np.int64), mask=np.bincount(words.row, minlength=words.n_rows) == 0))
    return out


def _processes(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(seed, row, rate, weight inside the block) of the dyadic blocks of each distinct (row, shingle)."""
    key = tb.mix(hashes ^ (row.astype(np.uint64) * tb.BASE))
    order = np.argsort(key)
    h, r, key = hashes[order], row[order], key[order]
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    h, r = h[first], r[first]
    out, low, level = [], 0, 0
    while len(h):
        size = 1 if level == 0 else low
        out.append((tb.mix(h + _U(level * int(tb.BASE) & (2**64 - 1))), r, np.full(len(h), float(size)), np.minimum(count - low, size)))
        low += size
        more = count > low
        h, r, count, level = h[more], r[more], count[more], level + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(hashes: np.ndarray, row: np.ndarray, n_rows: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signature of each row's multiset of hashes; rows without any have zeros."""
    out = np.zeros((n_rows, registers), np.uint64)
    if not len(hashes):
        return out
    best = np.full(n_rows * registers, np.inf)
    flat = out.ravel()
    seed, own, rate, inside = _processes(hashes, row)
    weight = np.bincount(row, minlength=n_rows)
    filled = np.where(weight > 0, 0, registers)
    with np.errstate(divide="ignore"):
        horizon = registers / weight * (np.log(registers) + HORIZON)
    time, step = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    waiting = np.arange(len(seed))
    draw = np.full(len(seed), np.nan)
    while len(waiting):
        live = waiting
        found: list[tuple[np.ndarray, ...]] = []
        while len(live):
            # the next point of each process: its time, unless one is still waiting beyond the horizon
            fresh = np.isnan(draw[live])
            go = live[fresh]
            bits = tb.mix(seed[go] + (step[go] * _U(2) + _U(1)) * tb.BASE)
            time[go] += -np.log(((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate[go]
            draw[go] = 1
            live = live[time[live] <= horizon[own[live]]]
            mark = tb.mix(seed[live] + (step[live] * _U(2) + _U(2)) * tb.BASE)
            register = (mark >> _U(40)) * _U(registers) >> _U(24)
            position = ((mark & _U((1 << 40) - 1)).astype(np.float64) * 2.0 ** -40) * rate[live]
            counts = position < inside[live]
            found.append((own[live][counts] * registers + register[counts].astype(np.int64), time[live][counts],
                          mark[counts]))
            step[live] += _U(1)
            draw[live] = np.nan
        cell, when, mark = (np.concatenate(x) for x in zip(*found, strict=True))
        np.minimum.at(best, cell, when)
        earliest = best[cell] == when
        flat[cell[earliest]] = mark[earliest]
        filled = np.isfinite(best.reshape(n_rows, registers)).sum(1)
        filled[weight == 0] = registers
        waiting = waiting[filled[own[waiting]] < registers]
        horizon[filled < registers] *= 2
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for i in range(ROWS):
        keys = keys * tb.BASE + signature[:, i::ROWS][:, :BANDS]
    return tb.mix(keys + np.arange(BANDS, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


def _sign(column: pa.Array) -> list[pa.Array]:
    words, hashes = _words(column)
    found, row = shingles(words, hashes)
    has = np.bincount(row, minlength=words.n_rows) > 0
    keys = _bands(signatures(found, row, words.n_rows)).view(np.int64)
    sizes = np.where(has, BANDS, 0)
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                     pa.array(keys[has].ravel()))
    return [*_text_digest(words, hashes), bands]


def _digest(column: pa.Array) -> list[pa.Array]:
    return _text_digest(*_words(column))


def _bag(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*_words(column))


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, doc_id: str = "doc_id") -> DataFrame:
    """One row (text_1, text_2, doc_id, class_id, n_links, n_copies) per row of ``docs``.

    text_1 and text_2 name the text (null: no words); n_links counts the verified links of its
    text that joined the class; n_copies the rows with the same words.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = stage(tb.map_text(docs, "text", "s", "text_1 bigint, text_2 bigint, bands array<bigint>", lambda: _sign)
                   .select("doc_id", "s.*"), "bags")
    worded = signed.filter("text_1 is not null")
    texts = stage(worded.groupBy("text_1", "text_2")
                  .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
                  .withColumn("node", F.monotonically_increasing_id()), "bag-texts")
    members = texts.select(F.explode("bands").alias("key"), "node")

    def bodies(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(nodes, "node").select("node", F.col("text_1").alias("a"), F.col("text_2").alias("b"),
                                                  F.col("first_id").alias("i"))
        held = tb.map_text(docs, "text", "s", "text_1 bigint, text_2 bigint", lambda: _digest)
        return held.join(wanted, (F.col("s.text_1") == F.col("a")) & (F.col("s.text_2") == F.col("b"))
                         & F.col("doc_id").eqNullSafe(F.col("i"))) \
            .select("node", F.col("text").alias("body")).dropDuplicates(["node"])

    linked = linking.classes(members, bodies, linking.Overlap(_bag, threshold))
    roots = texts.join(linked, "node", "left").select(
        "text_1", "text_2", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "first_id")
    ids = roots.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = roots.join(ids, "root").select(F.col("text_1").alias("a"), F.col("text_2").alias("b"), "class_id", "n_links",
                                           "n_copies", "root")
    # texts without words get keys that match nothing, spread over all partitions
    key = F.coalesce("text_1", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    return signed.join(named, (key == F.col("a")) & F.col("text_2").eqNullSafe(F.col("b")), "left").select(
        "doc_id", "text_1", "text_2", F.coalesce("class_id", F.when(F.col("text_1").isNull(), F.col("doc_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "root")


def keep_first(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, doc_id: str = "doc_id") -> DataFrame:
    """One row of each class (and every row without words), with the columns of ``docs``."""
    found = classes(docs, text, threshold, doc_id)
    best = found.filter("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_1", "text_2")).alias("w")) \
        .select(F.col("w.doc_id").alias("i"), F.col("w.text_1").alias("a"), F.col("w.text_2").alias("b"))
    digest, rank = tb.fresh(docs, "_digest"), tb.fresh(docs, "_rank")
    held = tb.map_text(docs, text, digest, "text_1 bigint, text_2 bigint", lambda: _digest)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wordless = held.filter(F.col(f"{digest}.text_1").isNull()).select(*columns)
    chosen = held.join(best, (F.col(f"{digest}.text_1") == F.col("a")) & (F.col(f"{digest}.text_2") == F.col("b"))
                       & F.col(doc_id).eqNullSafe(F.col("i")), "left_semi")
    one = Window.partitionBy(f"{digest}.text_1", f"{digest}.text_2", doc_id).orderBy(text)
    chosen = chosen.withColumn(rank, F.row_number().over(one)).filter(F.col(rank) == 1).select(*columns)
    return chosen.unionByName(wordless)


