"""Hard-negative mining by a secondary-sort shuffle (operator 12).

Every anchor is scored against every row, in tiles: rows are packed into blocks of up to
``BLOCK`` vectors, anchors into blocks of up to ``ANCHORS``, and a grid of groups of blocks brings
each pair of blocks together once (a stated query set against all rows). Scores are integer
inner products, by matrix products that are exact in double precision or else by integers of
any size.

1. Positives: a tile passes on its first ``positives`` rows of the anchor's label; the first of
   all tiles are the anchor's positives and open its windows.
2. Negatives: a tile passes on, for each window, its first ``negatives`` rows of other labels
   inside. A row that is not among the first of its tile is not among the first of all, so
   nothing is lost, and an anchor sends a few rows per tile in place of one per row.
3. Both meet as packed keys (anchor, descending score, kind, id, row), whose bytes sort in that
   order: partitioned by anchor and sorted within partitions (``repartition`` and
   ``sortWithinPartitions``, the DataFrame form of repartitionAndSortWithinPartitions). One pass
   over the sorted stream opens a window at each positive and gives out the negatives that
   follow, holding only the windows of the current anchor; no anchor's rows are gathered.

Cases: rows with a null id, label or vector, or a null component, take no part; vectors of
different lengths are not compared; repeated rows, also of one id, are rows of their own and an
anchor's own copies may be its positives; ties go by id, then by place in the input (equal rows,
so equal results); an anchor without positives, or a window without negatives, gives no row; an
empty table gives none; other columns are not looked at. Scores beyond 64 bits are held at the
least or greatest 64-bit integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

BLOCK = 4096
ANCHORS = 1024
#: Blocks of rows, and of anchors, that a group of the grid holds: 64 MB and 8 MB at 256 components.
ROW_GROUP, ANCHOR_GROUP = 8, 4
#: Scores worked on at once.
CELLS = 4 << 20
#: Bits of a row's place in its block, and of a block's number in its task.
_IN_BLOCK, _IN_TASK = 12, 24

_BLOCKS = "block bigint, dim int, ids binary, places binary, labels binary, vectors binary"
_NONE = np.iinfo(np.int64).min
_KEY = np.dtype([("anchor", ">u8"), ("anchor_place", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8"), ("place", ">u8")])
_SIGN = np.uint64(1 << 63)


def _pack(rows: list[tuple], limit: int) -> Iterator[dict]:
    """(ids, places, labels, vectors) of one length as blocks of at most ``limit`` rows."""
    ids, places, labels, vectors = (np.concatenate(x) for x in zip(*rows, strict=True))
    for at in range(0, len(ids), limit):
        part = slice(at, at + limit)
        yield {"dim": vectors.shape[1], "ids": ids[part].tobytes(), "places": places[part].tobytes(),
               "labels": labels[part].tobytes(), "vectors": vectors[part].tobytes()}


def _unpack(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of blocks of one length: ids, places, labels, vectors."""
    join = lambda name: np.frombuffer(b"".join(r[name] for r in rows), np.int64)
    ids = join("ids")
    return ids, join("places"), join("labels"), join("vectors").reshape(len(ids), rows[0]["dim"])


def _number(task: int, block: int) -> int:
    return task << _IN_TASK | block


def _row_blocks(df: DataFrame) -> DataFrame:
    """Written blocks of (id, label, vector) rows; a row's place is its block and its place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n_blocks, held = TaskContext.get().partitionId(), 0, {}
        arrow = _arrow(_BLOCKS)

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal n_blocks
            number = _number(task, n_blocks)
            n_blocks += 1
            rows = held.pop(dim)
            n = sum(len(r[0]) for r in rows)
            places = number << _IN_BLOCK | np.arange(n)
            ids, labels, vectors = (np.concatenate(x) for x in zip(*rows, strict=True))
            [row] = _pack([(ids, places, labels, vectors)], BLOCK)
            return pa.RecordBatch.from_pylist([{"block": number, **row}], schema=arrow)

        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            lists = batch.column("vector")
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(off)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                vectors = values[off[own][:, None] + np.arange(dim)].astype(np.int64).reshape(len(own), dim)
                done = 0
                while done < len(own):
                    room = BLOCK - sum(len(r[0]) for r in held.get(dim, []))
                    part = slice(done, done + room)
                    held.setdefault(dim, []).append((ids[own[part]], labels[own[part]], vectors[part]))
                    done += room
                    if done <= len(own):
                        yield emit(dim)
        for dim in sorted(held):
            yield emit(dim)

    return stage(df.mapInArrow(run, _BLOCKS), "negatives-rows")


def _anchor_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """Written blocks of the rows whose id is divisible by ``every``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n_blocks, held = TaskContext.get().partitionId(), 0, {}
        arrow = _arrow(_BLOCKS)

        def emit(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal n_blocks
            for row in _pack(held.pop(dim), ANCHORS):
                yield pa.RecordBatch.from_pylist([{"block": _number(task, n_blocks), **row}], schema=arrow)
                n_blocks += 1

        for batch in batches:
            for row in batch.to_pylist():
                ids, places, labels, vectors = _unpack([row])
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    held.setdefault(row["dim"], []).append((ids[own], places[own], labels[own], vectors[own]))
                    if sum(len(r[0]) for r in held[row["dim"]]) >= ANCHORS:
                        yield from emit(row["dim"])
        for dim in sorted(held):
            yield from emit(dim)

    return stage(blocks.mapInArrow(run, _BLOCKS), "negatives-anchors")


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of plain columns (a task has no session to parse DDL with)."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    # in Python integers: the magnitude of the least 64-bit integer does not fit its type
    most = lambda x: max(int(x.max()), -int(x.min()))
    bound = a.shape[1] * most(a) * most(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` allowed columns of the highest scores, ties by column: row and column numbers."""
    open_ = np.where(allowed, scores, _NONE)
    if open_.shape[1] > k:
        least = np.partition(open_, open_.shape[1] - k, axis=1)[:, -k]
        allowed = allowed & (open_ >= least[:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def _keys(anchor: np.ndarray, anchor_place: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray,
          places: np.ndarray) -> pa.RecordBatch:
    out = np.empty(len(ids), _KEY)
    up = lambda x: x.astype(np.int64).view(np.uint64) ^ _SIGN
    out["anchor"], out["anchor_place"], out["score"] = up(anchor), up(anchor_place), up(~scores)
    out["kind"], out["id"], out["place"] = kind, up(ids), up(places)
    off = np.arange(len(out) + 1, dtype=np.int32) * _KEY.itemsize
    key = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(off), pa.py_buffer(out.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchor_place, pa.int64()), key], names=["anchor_place", "key"])


def _read_keys(column: pa.Array) -> dict[str, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    down = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return {**{n: down(raw[n]) for n in ("anchor", "anchor_place", "id", "place")},
            "score": ~down(raw["score"]), "kind": raw["kind"]}


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work) -> DataFrame:
    """Packed keys from every pair of a group of row blocks and a group of anchor blocks.

    Either side is dealt to groups of a bounded number of blocks and sent to each group of the
    other, so a task holds two bounded groups whatever the tables' sizes.
    """
    across, down = max(1, math.ceil(n_rows / ROW_GROUP)), max(1, math.ceil(n_anchors / ANCHOR_GROUP))
    # blocks numbered without gaps would need a pass of their own: groups are dealt by hash
    left = rows.withColumn("i", F.pmod(F.xxhash64("block"), F.lit(across))).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))))
    right = anchors.withColumn("j", F.pmod(F.xxhash64("block"), F.lit(down))).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own, asked = own.to_pylist(), asked.to_pylist()
        out = []
        for question in asked:
            same = [b for b in own if b["dim"] == question["dim"]]
            for at in range(0, len(same), ROW_GROUP):  # a group dealt more blocks is worked in parts
                ids, places, labels, vectors = _unpack(same[at:at + ROW_GROUP])
                order = np.lexsort((places, ids))
                out += work(question, ids[order], places[order], labels[order], vectors[order])
        return pa.Table.from_batches(out, _arrow("anchor_place bigint, key binary"))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "anchor_place bigint, key binary")


def _parts(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def _positives(k: int):
    def work(question, ids, places, labels, vectors):
        a_ids, a_places, a_labels, a_vectors = _unpack([question])
        for label in np.unique(a_labels).tolist():
            asked, own = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
            for part in _parts(len(asked), len(own)):
                at = asked[part]
                scores = _scores(a_vectors[at], vectors[own])
                row, column = _first(scores, a_places[at][:, None] != places[own][None, :], k)
                yield _keys(a_ids[at][row], a_places[at][row], scores[row, column], 0, ids[own][column], places[own][column])
    return work


def _negatives(k: int, low: int, high: int):
    def work(question, ids, places, labels, vectors):
        a_ids, a_places, a_labels, a_vectors = _unpack([question])
        windows = np.frombuffer(question["windows"], np.int64).reshape(len(a_ids), -1)
        for part in _parts(len(a_ids), len(ids)):
            scores = _scores(a_vectors[part], vectors)
            other = a_labels[part][:, None] != labels[None, :]
            found = []
            for window in windows[part].T:
                bounds = [_window(int(p), low, high) for p in window]
                least, most = (np.array(x)[:, None] for x in zip(*bounds, strict=True))
                row, column = _first(scores, other & (scores >= least) & (scores <= most), k)
                found.append(row * len(ids) + column)
            row, column = np.divmod(np.unique(np.concatenate(found)), max(1, len(ids)))
            yield _keys(a_ids[part][row], a_places[part][row], scores[row, column], 1, ids[column], places[column])
    return work


def _window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest score n with low * p <= 100 * n <= high * p (none: an empty range)."""
    if positive == _NONE:
        return 1, 0
    return -(-low * positive // 100), high * positive // 100


def _with_windows(anchors: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """Anchor blocks with the scores of each anchor's positives (64-bit, the least one where it has fewer)."""
    of_block = anchors.select("block", "places").mapInArrow(_members, "block bigint, anchor_place bigint")
    told = positives.join(of_block, "anchor_place").select(F.col("block").alias("of"), "anchor_place", "key")

    def run(blocks: pa.Table, keys: pa.Table) -> pa.Table:
        keys = _read_keys(keys.column("key").combine_chunks()) if keys.num_rows else None
        out = []
        for row in blocks.to_pylist():
            places = np.frombuffer(row["places"], np.int64)
            windows = np.full((len(places), k), _NONE)
            if keys is not None:
                order = np.argsort(places)
                at = order[np.searchsorted(places[order], keys["anchor_place"])]
                by = np.argsort(at, kind="stable")
                nth = np.arange(len(by)) - np.searchsorted(at[by], at[by])
                windows[at[by], nth] = keys["score"][by]
            out.append({**row, "windows": windows.tobytes()})
        return pa.Table.from_pylist(out, _arrow(f"{_BLOCKS}, windows binary"))

    return anchors.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, f"{_BLOCKS}, windows binary")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            places = np.frombuffer(row["places"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), row["block"])), pa.array(places)],
                                             names=["block", "anchor_place"])


def _sorted(keys: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's keys in one partition, in the order of their bytes."""
    return keys.repartition("anchor_place").sortWithinPartitions("key")


def _take_first(k: int):
    """The first ``k`` keys of each anchor of a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, place in enumerate(batch.column("anchor_place").to_pylist()):
                last, taken = place, taken + 1 if place == last else 1
                keep[i] = taken <= k
            yield batch.filter(pa.array(keep))
    return run


def _mined(k: int, low: int, high: int):
    """Windows over a sorted stream: a positive opens one, negatives inside go out until it has ``k``."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, current, windows = _arrow(_MINED), None, []
        for batch in batches:
            keys = _read_keys(batch.column("key"))
            out = []
            for anchor, place, score, kind, id_ in zip(*(keys[n].tolist() for n in (
                    "anchor", "anchor_place", "score", "kind", "id")), strict=True):
                if place != current:
                    current, windows = place, []
                if kind == 0:
                    windows.append([id_, score, *_window(score, low, high), 0])
                    continue
                for window in windows:
                    positive, positive_score, least, most, given = window
                    if least <= score <= most and given < k:
                        window[4] = given + 1
                        out.append((anchor, positive, given + 1, id_, positive_score, score))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                zip(*out, strict=True) if out else [[]] * len(names), arrow, strict=True)], schema=arrow)
    return run


_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, every: int, id_: str = "id", label: str = "label", vector: str = "vector",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Negatives of the rows whose id is divisible by ``every``, for each of their positives.

    Ids and labels are integers, vectors lists of integers. A window of a positive of score p
    holds the rows of other labels with scores n, ``low`` * p <= 100 * n <= ``high`` * p.
    """
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(c(id_).cast("bigint").alias("id"), c(label).cast("bigint").alias("label"),
                     c(vector).cast("array<bigint>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                       & ~F.exists("vector", lambda x: x.isNull()))
    blocks = _row_blocks(rows)
    anchors = _anchor_blocks(blocks, every)
    sizes = blocks.count(), anchors.count()
    found = _tiles(blocks, anchors, *sizes, _positives(positives))
    first = stage(_sorted(found).mapInArrow(_take_first(positives), "anchor_place bigint, key binary"), "negatives-positives")
    asked = _with_windows(anchors, first, positives)
    rest = _tiles(blocks, asked, *sizes, _negatives(negatives, low, high))
    return _sorted(first.unionByName(rest)).mapInArrow(_mined(negatives, low, high), _MINED)


def finite(vector: str) -> Column:
    """Whether a vector is there and every component is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
