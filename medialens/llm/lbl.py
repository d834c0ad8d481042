"""Language-model scores by a log-bilinear model with noise-contrastive estimation (operator 8).

Spark counts every training word and every pair of neighbouring word classes of all training
texts. The classes are the text end, the ``TOP_WORDS`` most frequent words, and ``TAILS``
buckets of the other words by their ending, so the model's size is a parameter while its counts
cover the whole corpus. On the driver, numpy fits

    s(w | c) = r_c . M . q_w + b_w

(class vectors r, q of ``DIM`` numbers, an interaction matrix M, biases b) to the counted pairs
by noise-contrastive estimation against the class unigram, its expectation over the noise taken
exactly. One batched matrix product then gives all scores, normalised over the classes; a
bucketed word's probability is its class's times its share of the bucket (add-``SMOOTH``
counts with one unseen word per bucket), so token probabilities sum to one.

Words come to their texts as blocks (see ``blocks``): counts are looked up once per distinct
word of a block. The base score is the add-``SMOOTH`` unigram log-probability.

Cases: null and empty texts are one token, the end; with no training text every count is zero
and both scores stay finite; a null id counts as the empty string, which is held out; repeated
rows are scored (and, in training, counted) one by one; ties in frequency go to the smaller word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import blocks as bk
from . import textbytes as tb
from .scratch import stage

TOP_WORDS = 511
TAILS = 256
#: Characters of a word's end that choose its bucket.
TAIL_CHARS = 3
DIM = 32
#: Noise samples per observed pair that the objective stands for.
NOISE = 25
STEPS = 400
RATE = 0.05
#: Weight of the Gaussian prior on class vectors, in observed pairs: small corpora stay near the unigram.
PRIOR = 40.0
SMOOTH = 0.1
N_CLASSES = 1 + TOP_WORDS + TAILS
END = 0


def _split(column: pa.Array) -> tuple[np.ndarray, tb.Spans]:
    data, off = tb.view(column)
    data = tb.LOWER[data]
    return data, tb.Spans(data, off, tb.SPACE)


def _bucket(word: str) -> int:
    return 1 + TOP_WORDS + zlib.crc32(word[-TAIL_CHARS:].encode()) % TAILS


def train(pairs: np.ndarray) -> np.ndarray:
    """log10 probabilities [context, target] of a model fitted to counts of class pairs."""
    n = pairs.shape[0]
    total = pairs.sum()
    if not total:
        return np.full((n, n), -np.log10(n))
    rng = np.random.default_rng(0)
    unigram = (pairs.sum(0) + SMOOTH) / (total + SMOOTH * n)
    contexts = pairs.sum(1)
    data = pairs / total
    noise = NOISE * np.outer(contexts / total, unigram)
    log_noise = np.log(NOISE * unigram)
    weights = [rng.normal(0, 0.1, (n, DIM)), np.eye(DIM), rng.normal(0, 0.1, (n, DIM)), np.log(unigram)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        r, m, q, b = weights
        rm = r @ m
        odds = rm @ q.T + b - log_noise
        sure = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        slope = noise * sure - data * (1 - sure)
        sq = slope @ q
        shrink = PRIOR / total
        grads = [sq @ m.T + shrink * r, r.T @ sq, slope.T @ rm + shrink * q, slope.sum(0)]
        rate = RATE * (1 - (step - 1) / STEPS)
        for w, g, u, v in zip(weights, grads, first, second, strict=True):
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            w -= rate * (u / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    r, m, q, b = weights
    scores = r @ m @ q.T + b
    scores -= scores.max(1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(1, keepdims=True))) / np.log(10)


def score(df: DataFrame, train_on: Column, keys: list[str], text: str = "text") -> DataFrame:
    """Key columns, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``train_on`` says which rows the counts and the model learn from; all rows are scored.
    """
    learn = tb.fresh(df, "_learn")
    rows = df.withColumn(learn, F.coalesce(train_on, F.lit(False)))
    made = bk.blocks(rows, [*keys, learn], text, _split, "lm-blocks")
    replies = stage(_count_words(made, learn), "lm-words")
    n_end = made.select(F.explode(f"keys.{learn}").alias("t")).agg(F.coalesce(F.sum(F.col("t").cast("bigint")), F.lit(0))).first()[0]
    # TAILS rows at most
    tails = replies.filter("word is null and block is null").groupBy("kind").agg(F.sum("words"), F.sum("c")).collect()
    rest = np.zeros((N_CLASSES, 2))
    for kind, words, tokens in tails:
        rest[kind] = words, tokens
    n, v = int(rest[:, 1].sum()) + n_end, int(rest[:, 0].sum()) + (n_end > 0)
    # TOP_WORDS rows
    frequent = replies.filter("word is not null").orderBy(F.desc("c"), "word").limit(TOP_WORDS).select("word", "c").collect()
    top = {r.word: i + 1 for i, r in enumerate(frequent)}
    for r in frequent:
        rest[_bucket(r.word)] -= 1, r.c
    facts = replies.filter("block is not null").select("block", "places", "counts")
    keyed = made.schema["keys"].dataType.elementType.fields
    schema = StructType([StructField("keys", made.schema["keys"].dataType), *StructType.fromDDL(
        "n_tokens array<bigint>, n_known array<bigint>, base array<double>, tail array<double>, classes binary").fields])
    floor = N_CLASSES - TAILS

    def look_up(block: pa.Table, facts: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = []
        for row in range(block.num_rows):
            words = [w.decode("utf-8") for w in bk.unpack_words(block.column("words")[row].as_py())]
            counts = np.zeros(len(words))
            for reply in facts.to_pylist():
                counts[bk.unpack_rising(reply["places"])] = bk.unpack(reply["counts"], 8)
            kinds = np.array([top[w] if w in top else _bucket(w) for w in words], np.int64)
            in_bucket = rest[kinds]
            base = np.log10((counts + SMOOTH) / (n + SMOOTH * (v + 1)))
            tail = np.where(kinds >= floor, np.log10(
                (counts + SMOOTH) / (in_bucket[:, 1] + SMOOTH * (in_bucket[:, 0] + 1))), 0.0)
            places = bk.unpack_sequence(block.column("places")[row].as_py())
            lengths = np.asarray(block.column("lengths")[row].values, dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            total = lambda x: _sums(x[places], bounds)  # noqa: B023, E731
            ended = np.log10((n_end + SMOOTH) / (n + SMOOTH * (v + 1)))
            columns = [lengths + 1, total((counts > 0).astype(np.float64)).astype(np.int64) + (n_end > 0),
                       total(base) + ended, total(tail)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
            out.append(pa.Table.from_arrays(
                [block.column("keys").slice(row, 1), *lists, pa.array([bk.pack(kinds[places])], pa.binary())],
                names=schema.names).cast(to_arrow_schema(schema)))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    coded = stage(bk.per_block(made, facts, look_up, schema, ("keys", "lengths", "words", "places")), "lm-classes")
    pairs = np.zeros((N_CLASSES, N_CLASSES))
    # N_CLASSES squared rows at most
    for context, target, times in _class_pairs(coded, learn).collect():
        pairs[context, target] = times
    model = df.sparkSession.sparkContext.broadcast(train(pairs))
    held = StructType([*keyed, *StructType.fromDDL(
        "n_tokens bigint, n_known bigint, base_score double, score double").fields])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        table = model.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch.column(name)[row].values for name in ("n_tokens", "n_known", "base", "tail")]
                at, context, target = _neighbours(batch, row)
                scores = np.bincount(at, table[context, target], len(own[0])) + own[3].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*batch.column("keys")[row].values.flatten(), own[0], own[1], own[2], pa.array(scores)],
                    schema=to_arrow_schema(held))

    names = [f"`{k}`" for k in keys]
    return coded.mapInArrow(final, held).select(
        *names, (~F.col(learn)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score", "score")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], each added up on its own."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def _neighbours(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context class, target class) of every token of a block, ends included."""
    lengths = np.asarray(batch.column("n_tokens")[row].values, dtype=np.int64)
    kinds = bk.unpack(batch.column("classes")[row].as_py()).astype(np.int64)
    end = np.cumsum(lengths)
    total = int(end[-1]) if len(end) else 0
    target = np.full(total, END, np.int64)
    inner = np.ones(total, bool)
    inner[end - 1] = False
    target[inner] = kinds
    context = np.full(total, END, np.int64)
    context[1:] = target[:-1]
    return np.repeat(np.arange(len(lengths)), lengths), context, target


def _count_words(made: DataFrame, learn: str) -> DataFrame:
    """What the training texts hold, counted in word buckets. Three kinds of rows:

    (block, places, counts): how often the words at some places of a block occur;
    (word, c): the ``TOP_WORDS`` most frequent words of a bucket;
    (kind, words, c): distinct words and occurrences by class of ending.
    """
    def note(row: dict) -> np.ndarray:
        taught = np.repeat([k[learn] for k in row["keys"]], row["lengths"])
        return np.bincount(bk.unpack_sequence(row["places"])[taught.astype(bool)], minlength=row["n_distinct"])

    def work(table: pa.Table) -> pa.Table:
        lists = [bk.unpack_words(w.as_py()) for w in table.column("words")]
        distinct, which = bk.gather(lists)
        counts = np.bincount(which, np.concatenate([bk.unpack(x.as_py()) for x in table.column("notes")]),
                             len(distinct)).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        rows = [{"block": block.as_py(), "places": places.as_py(), "counts": bk.pack(counts[which[a:b]], 8)}
                for block, places, a, b in zip(table.column("block"), table.column("places"), bounds[:-1], bounds[1:], strict=True)]
        seen = sorted(((-c, w.decode("utf-8")) for w, c in zip(distinct, counts.tolist(), strict=True) if c > 0))
        rows += [{"word": w, "c": -c} for c, w in seen[:TOP_WORDS]]
        kinds = np.array([_bucket(w) for _, w in seen], np.int64)
        tokens = np.bincount(kinds, [-c for c, _ in seen], N_CLASSES).astype(np.int64) if seen else np.zeros(N_CLASSES, np.int64)
        words = np.bincount(kinds, minlength=N_CLASSES)
        rows += [{"kind": int(k), "words": int(words[k]), "c": int(tokens[k])} for k in np.flatnonzero(words)]
        return pa.Table.from_pylist(rows, schema=pa.schema([
            ("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("word", pa.string()),
            ("kind", pa.int32()), ("words", pa.int64()), ("c", pa.int64())]))

    return bk.ask(made, work, "block bigint, places binary, counts binary, word string, kind int, words bigint, c bigint",
                  ("keys", "lengths", "places", "n_distinct"), note)


def _class_pairs(coded: DataFrame, learn: str) -> DataFrame:
    """(context, target, times) over all training texts; each task sums its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(N_CLASSES * N_CLASSES, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, context, target = _neighbours(batch, row)
                taught = batch.column("taught")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                use = taught[at]
                seen += np.bincount(context[use] * N_CLASSES + target[use], minlength=len(seen))
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells // N_CLASSES, pa.int32()), pa.array(cells % N_CLASSES, pa.int32()),
                                          pa.array(seen[cells])], names=["context", "target", "times"])

    return coded.select("n_tokens", "classes", F.col(f"keys.{learn}").alias("taught")) \
        .mapInArrow(run, "context int, target int, times bigint") \
        .groupBy("context", "target").agg(F.sum("times").alias("times"))
