"""Byte-level BPE encoding and decoding by DuckDB's recursive queries, partition by partition (operator 11).

A task reads its texts in slices, cuts them into pieces (the pattern of the vocabulary, by the
splitter of operator 5) and keeps each distinct piece once, by its bytes. DuckDB, inside the task,
encodes the pieces that the worker has not met yet: a piece is its list of token numbers; a
recursive query lays the lists out as token-position rows, joins neighbours with the merge table
(every way to cut a vocabulary entry in two entries, with the entry's rank), contracts each
word's leftmost pair of least rank, and goes on with the words that changed until none does. A
piece that is itself an entry is that entry. The ids go back to the occurrences in text order;
an ordered aggregation over the ids, joined with the vocabulary, decodes them.

Pieces of over ``LONG`` bytes take a second form of the query that keeps one list per word
(``USING KEY``) and contracts all the places of the least rank at once where that must come to
the same: where no pair made with the new token ranks below it.

Memory per task is bounded by the slice (about 100 bytes per byte of text), ``WORDS_AT_ONCE``
words in a query, ``KNOWN`` remembered words, and the tokens of ``DECODED_AT_ONCE`` places.

Cases: null and empty texts have no ids and decode to no bytes; special strings are ordinary text;
repeated rows give equal rows; texts of any length are encoded whole; an empty table gives an
empty table; other columns stay, whatever they hold, and a column called as the result is
replaced. A vocabulary without one of the 256 bytes is refused.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .blocks import take_runs
from .fst_tokens import piece_starts

SLICE = 2 << 20
LONG = 48
WORDS_AT_ONCE = 50_000
#: Distinct pieces that a worker remembers before it begins anew.
KNOWN = 600_000
DECODED_AT_ONCE = 500_000
#: DuckDB's own limit; what a query holds stays far below it. Nothing is written to local disk.
MEMORY = "700MB"

_CONTRACT = """
WITH RECURSIVE coded(word, ids) AS (
  SELECT word, ids FROM fresh
  UNION ALL
  (WITH places AS (
     SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS place
     FROM coded WHERE len(ids) > 1),
   best AS (
     SELECT word, min((made << 32) | place) AS least FROM places JOIN merges ON pair = (a::BIGINT << 32) + b GROUP BY word)
   SELECT word, ids[:(least & 4294967295) - 1] || [(least >> 32)::INTEGER] || ids[(least & 4294967295) + 2:]
   FROM best JOIN coded USING (word)))
SELECT word, arg_min(ids, len(ids)) AS ids FROM coded GROUP BY word"""

_CONTRACT_LONG = """
WITH RECURSIVE coded(word, ids) USING KEY (word) AS (
  SELECT word, ids FROM fresh
  UNION
  (WITH tokens AS (SELECT word, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM coded),
   pairs AS (
     SELECT x.word, x.place, made FROM tokens x JOIN tokens y ON y.word = x.word AND y.place = x.place + 1
     JOIN merges ON pair = (x.id::BIGINT << 32) + y.id),
   best AS (SELECT word, min(made) AS made FROM pairs GROUP BY word),
   hits AS (
     SELECT word, place, made, row_number() OVER (PARTITION BY word ORDER BY place) AS nth
     FROM pairs SEMI JOIN best USING (word, made)),
   -- of hits that overlap in a row, every second
   chosen AS (
     SELECT word, place, made FROM (
       SELECT *, row_number() OVER (PARTITION BY word, place - nth ORDER BY place) AS in_row FROM hits)
     WHERE in_row % 2 = 1 AND (nth = 1 OR made NOT IN (SELECT id FROM hasty)))
   SELECT t.word, list(coalesce(c.made::INTEGER, t.id) ORDER BY t.place) AS ids
   FROM tokens t SEMI JOIN best USING (word)
     LEFT JOIN chosen c ON c.word = t.word AND c.place = t.place
     ANTI JOIN chosen d ON d.word = t.word AND d.place = t.place - 1
   GROUP BY t.word))
SELECT word, ids FROM coded"""


def read_ranks(path: str) -> bytes:
    """A rank file (base64 of the bytes, a space, the rank, one entry per line)."""
    with open(path, "rb") as file:
        return file.read()


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column without nulls."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    off = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int64)
    return lists.values.to_numpy()[off[0]:off[-1]].astype(kind), np.diff(off)


class Coder:
    """A worker's DuckDB with the merge table, the vocabulary and the pieces met so far."""

    def __init__(self, ranks: bytes):
        import duckdb

        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        if missing := [b for b in range(256) if bytes([b]) not in rank]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        cuts = [(rank[e[:i]], rank[e[i:]], r) for e, r in rank.items() for i in range(1, len(e))
                if e[:i] in rank and e[i:] in rank]
        a, b, made = np.array(cuts, np.int64).reshape(-1, 3).T
        self.of_byte = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "",
                                         "preserve_insertion_order": False})
        self._table("merges", pa.table({"pair": (a << 32) + b, "made": made}))
        self._table("vocabulary", pa.table({"id": pa.array(rank.values(), pa.int32()), "piece": pa.array(rank, pa.binary())}))
        # tokens that may pair with a neighbour at a rank below their own
        self._table("hasty", pa.table({"id": np.unique(np.concatenate([a[made < a], b[made < b]]))}))
        self._forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE known (piece BLOB, ids INTEGER[])")
        self.n_known = 0

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces that are no entries, and remember them."""
        data, off = tb_view(pieces)
        tokens = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(self.of_byte[data]))
        given = pa.table({"word": np.arange(len(pieces)), "piece": pieces, "ids": tokens})
        long = np.diff(off) > LONG
        for query, own in ((_CONTRACT, ~long), (_CONTRACT_LONG, long)):
            rows = given.filter(pa.array(own))
            for at in range(0, len(rows), WORDS_AT_ONCE):
                self.db.register("fresh", rows.slice(at, WORDS_AT_ONCE))
                self.db.execute(f"INSERT INTO known SELECT piece, c.ids FROM fresh JOIN ({query}) c USING (word)")
                self.db.unregister("fresh")

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        if self.n_known + len(pieces) > KNOWN:
            self._forget()
        self._table("asked", pa.table({"nth": np.arange(len(pieces)), "piece": pieces}))
        self.db.execute("INSERT INTO known SELECT piece, [id] FROM asked JOIN vocabulary USING (piece) "
                        "ANTI JOIN known USING (piece)")
        new = self.db.sql("SELECT piece FROM asked ANTI JOIN known USING (piece)").to_arrow_table().column("piece")
        if len(new):
            self._learn(pa.concat_arrays(new.chunks))
        self.n_known = self.db.sql("SELECT count(*) FROM known").fetchall()[0][0]
        ids = self.db.sql("SELECT ids FROM asked JOIN known USING (piece) ORDER BY nth").to_arrow_table()
        return _flat(ids.column("ids"), np.uint32)

    def decode(self, ids: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
        """The bytes that the ids of each row spell, in order."""
        raw, size = [], np.zeros(n_rows, np.int64)
        for at in range(0, len(ids), DECODED_AT_ONCE):
            part = slice(at, at + DECODED_AT_ONCE)
            self.db.register("tokens", pa.table({"row": row[part], "place": np.arange(len(ids[part]), dtype=np.int32),
                                                 "id": ids[part].astype(np.int32)}))
            told = self.db.sql("SELECT row, list(piece ORDER BY place) AS pieces FROM tokens JOIN vocabulary USING (id) "
                               "GROUP BY row ORDER BY row").to_arrow_table().combine_chunks()
            self.db.unregister("tokens")
            lists = told.column("pieces").chunk(0)
            data, off = tb_view(lists.values)
            ends = off[lists.offsets.to_numpy()]
            raw.append(data[ends[0]:ends[-1]])
            size[told.column("row").to_numpy()] += np.diff(ends)
        return _binary(np.concatenate(raw) if raw else np.empty(0, np.uint8), size)


def tb_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary column without nulls."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


@functools.lru_cache(1)
def coder(ranks: bytes) -> Coder:
    return Coder(ranks)


def code_slice(column: pa.Array, own: Coder) -> list:
    """(n_tokens, ids, decoded) of each text of a slice."""
    data, off = tb.view(column)
    if not len(data):
        nothing = _binary(data, np.zeros(len(column), np.int64))
        return [np.zeros(len(column), np.int64), nothing, nothing]
    raw = np.ascontiguousarray(data)
    byte_at = np.flatnonzero(tb.code_points(data))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    edge = np.zeros(len(data) + 1, bool)
    edge[off[:-1]] = True
    start = byte_at[piece_starts(points, edge[byte_at])]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    flat, sizes = own.encode(pieces.dictionary)
    index, length = take_runs(np.concatenate(([0], np.cumsum(sizes))), pieces.indices.to_numpy())
    ids = flat[index]
    row = (np.searchsorted(off, start, "right") - 1).astype(np.int32)
    n_tokens = np.bincount(row, length, len(column)).astype(np.int64)
    return [n_tokens, _binary(ids.astype("<u4"), 4 * n_tokens), own.decode(ids, np.repeat(row, length), len(column))]


def encode_decode(df: DataFrame, ranks_path: str, text: str = "text", into: str = "coded") -> DataFrame:
    """``df`` with a struct of n_tokens, ids (little-endian unsigned 32-bit) and the decoded bytes.

    ``ranks_path`` is a rank file on the driver; its content (as large as the vocabulary) goes to the tasks.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        own = coder(ranks.value)
        return lambda column: code_slice(column, own)

    raw = tb.fresh(df, "_coded")
    out = tb.map_text(df, text, raw, "n_tokens bigint, ids binary, decoded binary", make, SLICE)
    return out.withColumn(into, out[raw]).drop(raw)
