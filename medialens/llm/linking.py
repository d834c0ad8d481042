"""Classes of near-equal items from buckets of candidates, without forming all pairs of a bucket.

1. Star: in every bucket each member is verified against the smallest member only.
2. Verified links join members into classes (connected components).
3. Where the other members of a bucket are still of several classes, they are compared: as
   pairs of different classes in buckets of up to ``SMALL`` members (``SMALL_MARKED``, if they have marks, see below); in larger ones as blocks of
   about ``BLOCK_ITEMS / 2`` members, two by two inside tasks, of which only the links that
   join different classes come out. Then step 2 again.

Where items have marks - a few numbers that alike items have nearly in common - pairs are
compared by them first, and only what they allow has its body joined. The blocks of large
buckets are formed of bodies.

Every candidate pair is so either ruled out by its marks, or verified, or already in one class by links that were: no
partner is capped and no link lost. Rows that are shuffled or made stay in proportion to bucket
sizes (times the number of blocks for the unresolved rest), never to their squares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .scratch import stage_alone as stage

BLOCK_ITEMS = 512
SMALL = 16
#: The same where items have marks, which are compared for every pair before anything is written.
SMALL_MARKED = 128
#: Columns of one dense product when blocks are compared by overlap.
PRODUCT_COLUMNS = 4096


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps of map-reduce connected components until
    every component is a star; each step's edges are written to the shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a != b").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stage(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none if it has a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .filter(F.col("up") + F.col("down") > 1).count() == 0


def classes(members: DataFrame, bodies: Callable[[DataFrame], DataFrame], alike, marks: DataFrame | str | None = None) -> DataFrame:
    """(node, root, n_links) of the nodes that any verified link touches.

    ``members`` has (key, node) rows, ``bodies`` brings (node, body) for a table of nodes, and
    ``alike`` decides: ``alike.pairs(left bodies, right bodies)`` and ``alike.blocks(left, right)``.
    ``marks`` has (node, mark), one row a node, or names the column in which ``bodies`` brings them;
    ``alike.may(mark, mark)`` tells which pairs may be alike.
    """
    bucket = Window.partitionBy("key")
    full = stage(members.withColumns({"low": F.min("node").over(bucket), "high": F.max("node").over(bucket)})
                 .filter("low != high").distinct(), "buckets")
    stars = full.filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    texts = None
    if marks is None or isinstance(marks, str):
        texts = stage(bodies(full.select("node").distinct()), "bodies")
        marks = marks and texts.select("node", F.col(marks).alias("mark"))
        texts = texts.select("node", "body")
    else:
        marks = stage(marks, "marks")
    if marks is not None:
        for side in "ab":
            stars = stars.join(marks.select(F.col("node").alias(side), F.col("mark").alias(f"mark_{side}")), side)
        stars = stage(stars.filter(alike.may(F.col("mark_a"), F.col("mark_b"))).select("a", "b"), "stars")
    links = stage(_verify(_with_bodies(stars, texts, bodies), alike), "links")
    roots = stage(components(links), "roots")
    known = stage(full.filter("node != low").select("key", "node").join(roots, "node", "left")
                  .select("key", "node", F.coalesce("root", "node").alias("root")), "unresolved")
    spread = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")) \
        .filter("low != high").select("key", "n")
    open_ = known.join(spread, "key")
    may = F.lit(True)
    if marks is not None:
        open_ = open_.join(marks, "node")
        may = alike.may(F.col("x.mark"), F.col("y.mark"))
    open_ = stage(open_, "unresolved")
    small = SMALL if marks is None else SMALL_MARKED
    few = open_.filter(F.col("n") <= small)
    pairs = few.alias("x").join(few.alias("y"), "key").filter(F.expr("x.node < y.node and x.root != y.root") & may) \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    many = open_.filter(F.col("n") > small).select("key", "node", "root", "n")
    if texts is None:
        pairs = stage(pairs, "pairs")
        texts = stage(bodies(pairs.select(F.explode(F.array("a", "b")).alias("node"))
                             .unionByName(many.select("node")).distinct()), "bodies")
    more = stage(_verify(_with_bodies(pairs, texts, bodies), alike).unionByName(_block_links(many, texts, alike)), "links")
    all_links = links.unionByName(more).distinct()
    final = stage(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    degree = all_links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    return final.join(degree, "node", "left").select("node", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _verify(pairs: DataFrame, alike) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tb.slices(batch, "left"):
                for part in tb.slices(piece, "right"):
                    good = pa.array(alike.pairs(part.column("left"), part.column("right")))
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(good)

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _with_bodies(pairs: DataFrame, texts: DataFrame | None, bodies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, left, right): pairs with their texts, which ``bodies`` brings where there are none yet."""
    if texts is None:
        texts = stage(bodies(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "bodies")
    left = texts.select(F.col("node").alias("a"), F.col("body").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("right"))
    return pairs.join(left, "a").join(right, "b")


def _dealt(members: DataFrame) -> DataFrame:
    """A member's block is drawn by hash, about BLOCK_ITEMS / 2 members each; a row for every two blocks (i, j) that it is in."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / BLOCK_ITEMS)).cast("int")
    return members.withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("n", "blocks", "other")


def _block_links(members: DataFrame, texts: DataFrame, alike) -> DataFrame:
    """Links between different classes of each bucket: (key, node, root, n) in, (a, b) out."""
    held = _dealt(members).join(texts, "node")

    def run(table: pa.Table) -> pa.Table:
        # pairs inside a block are compared where it meets itself, pairs across where i < j
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block = table.column("block").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        a = np.flatnonzero(block == i)
        b = np.flatnonzero(block == j)
        body = table.column("body").combine_chunks()
        links = []
        if len(a) and len(b):
            x, y = alike.blocks(body.take(pa.array(a)), body.take(pa.array(b)), root[a], root[b])
            parent: dict[int, int] = {}

            def find(r: int) -> int:
                while parent.get(r, r) != r:
                    r = parent[r]
                return r

            for p, q in zip(a[x].tolist(), b[y].tolist(), strict=True):
                r, s = find(int(root[p])), find(int(root[q]))
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    links.append((min(int(node[p]), int(node[q])), max(int(node[p]), int(node[q]))))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return held.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def tokens(bodies: pa.Array, bag: Callable) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: (token, item), where the k-th equal element of an item is token (element, k)."""
    hashes, row = bag(bodies)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return tb.mix(h + (np.arange(len(h)) - start).astype(np.uint64) * tb.BASE), r


def common(lt: np.ndarray, li: np.ndarray, rt: np.ndarray, ri: np.ndarray, n: int) -> np.ndarray:
    """How many tokens the left and the right item of each of n pairs share."""
    key = np.concatenate([tb.mix(lt ^ (li.astype(np.uint64) * tb.BASE)), tb.mix(rt ^ (ri.astype(np.uint64) * tb.BASE))])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return np.bincount(np.concatenate([li, ri])[order[1:][same]], minlength=n)


def common_all(lt: np.ndarray, li: np.ndarray, rt: np.ndarray, ri: np.ndarray, n: int, m: int) -> np.ndarray:
    """How many tokens each of n left items shares with each of m right items."""
    shared = np.intersect1d(lt, rt)
    lk, rk = np.searchsorted(shared, lt), np.searchsorted(shared, rt)
    lin = (lk < len(shared)) & (shared[np.minimum(lk, len(shared) - 1)] == lt) if len(shared) else np.zeros(len(lt), bool)
    rin = (rk < len(shared)) & (shared[np.minimum(rk, len(shared) - 1)] == rt) if len(shared) else np.zeros(len(rt), bool)
    both = np.zeros((n, m), np.float32)
    for at in range(0, len(shared), PRODUCT_COLUMNS):
        x, y = np.zeros((n, PRODUCT_COLUMNS), np.float32), np.zeros((m, PRODUCT_COLUMNS), np.float32)
        u, v = lin & (lk >= at) & (lk < at + PRODUCT_COLUMNS), rin & (rk >= at) & (rk < at + PRODUCT_COLUMNS)
        x[li[u], lk[u] - at] = 1
        y[ri[v], rk[v] - at] = 1
        both += x @ y.T
    return both


class Overlap:
    """Items are alike when the weighted Jaccard similarity of their bags reaches a threshold."""

    def __init__(self, bag: Callable, threshold: float):
        self.bag, self.threshold = bag, threshold

    def _enough(self, both, left, right):
        # compared as both >= threshold * union without a division
        return both >= self.threshold * (left + right - both) - 1e-9

    def pairs(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        n = len(left)
        (lt, li), (rt, ri) = tokens(left, self.bag), tokens(right, self.bag)
        return self._enough(common(lt, li, rt, ri, n), np.bincount(li, minlength=n), np.bincount(ri, minlength=n))

    def blocks(self, left: pa.Array, right: pa.Array, roots: np.ndarray, others: np.ndarray):
        """Index pairs (left, right) of alike items of different classes."""
        (lt, li), (rt, ri) = tokens(left, self.bag), tokens(right, self.bag)
        n, m = len(left), len(right)
        ln, rn = np.bincount(li, minlength=n), np.bincount(ri, minlength=m)
        both = common_all(lt, li, rt, ri, n, m)
        good = self._enough(both, ln[:, None], rn[None, :]) & (roots[:, None] != others[None, :])
        return np.nonzero(good)
