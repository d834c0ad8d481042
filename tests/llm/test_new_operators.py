"""Operators 11 to 13 against the library, SQL and brute force, and their edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medialens.llm import merge_sql, negatives, periodic, queries
from medialens.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"
RANKS = queries.tokenizer("byte_bpe_50k.tiktoken")


# operator 11

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, merge_sql.read_ranks(RANKS).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return merge_sql.Coder(merge_sql.read_ranks(RANKS))


def agrees(texts, coder, library):
    counts, ids, decoded = merge_sql.code_slice(pa.array(texts, pa.string()), coder)
    for text, n, own, back in zip(texts, counts, ids.to_pylist(), decoded.to_pylist(), strict=True):
        want = library.encode_ordinary(text or "")
        assert np.frombuffer(own, "<u4").tolist() == want, text
        assert n == len(want) and back == (text or "").encode()


def test_bpe_equals_the_library(coder, library):
    rnd = random.Random(3)
    parts = ["'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Don't", "'", "1", "23", "é", "ß", "漢字", "🙂", "\xa0", "!", "--",
             "<|endoftext|>", "the", "ing", "\r\n", "²", "\x00", "\x85", "İ", "\x1c", "　"]
    agrees(["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(2000)] + [None, ""], coder, library)


def test_bpe_of_long_words(coder, library):
    """The second form of the query: words around and far above its threshold, with repeats that overlap."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeeeeaaattt") for _ in range(n)) for n in range(40, 300)]
    words += ["a" * n for n in range(44, 120)] + ["ab" * n + "a" for n in range(20, 60)] + ["漢" * 300, "!" * 700, "\n" * 300]
    agrees(words, coder, library)


def test_bpe_forgets_and_learns_again(coder, library, monkeypatch):
    monkeypatch.setattr(merge_sql, "KNOWN", 3)
    monkeypatch.setattr(merge_sql, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(merge_sql, "DECODED_AT_ONCE", 3)
    agrees(["unseen wordlings flurble", "flurble unseen", "", "gnarfest blickering"], coder, library)


def test_bpe_edge_rows(spark, edge, nothing, library):
    coded = merge_sql.encode_decode(edge, RANKS)
    assert coded.columns == [*edge.columns, "coded"]
    rows = coded.collect()
    assert len(rows) == edge.count()
    for row in rows:
        want = library.encode_ordinary(row.text or "")
        assert (row.coded.n_tokens, bytes(row.coded.decoded)) == (len(want), (row.text or "").encode())
    assert merge_sql.encode_decode(nothing, RANKS).count() == 0
    assert merge_sql.encode_decode(coded, RANKS).columns == coded.columns


def test_bpe_refuses_a_vocabulary_without_bytes():
    with pytest.raises(ValueError, match="lacks the bytes"):
        merge_sql.Coder(base64.b64encode(b"a") + b" 0\n")


def test_bpe_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = library.encode_ordinary(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


# operator 12

def brute_negatives(rows):
    """(anchor, positive, rank, negative, scores) of (id, label, vector) rows, in Python integers."""
    rows = [r for r in rows if None not in r and None not in r[2]]
    out = []
    for i, (anchor, label, vector) in enumerate(rows):
        if anchor % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v, strict=True)), id_, own == label)
                        for j, (id_, own, v) in enumerate(rows) if j != i and len(v) == len(vector))
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            inside = [s for s in scored if not s[2] and 50 * -score <= 100 * -s[0] <= 95 * -score]
            out += [(anchor, positive, n + 1, s[1], -score, -s[0]) for n, s in enumerate(inside[:3])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, label bigint, vector array<bigint>, rank string")
    return sorted(tuple(r) for r in negatives.mine(df, 50).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    for module_limit in ("BLOCK", "ANCHORS", "CELLS"):
        monkeypatch.setattr(negatives, module_limit, 16)
    rows = [(i, rnd.randrange(4), [rnd.randint(-3, 6) for _ in range(5)]) for i in range(-60, 260)]
    rows += [(50, 1, [1, 2, 3, 4, 5]), (50, 1, [1, 2, 3, 4, 5]), (7, 2, [0, 0, 0, 0, 0]), (None, 1, [1] * 5), (100, None, [1] * 5),
             (100, 1, None), (100, 1, [1, None, 1, 1, 1]), (150, 2, [1, 2]), (151, 2, [2, 2]), (152, 3, [1, 1]), (153, 1, [])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_at_zero_ties_and_wide_scores(spark):
    rows = [(100, 1, [0, 0]), (101, 1, [1, 1]), (3, 2, [1, 0]), (1, 2, [5, 5]), (200, 1, [-1, -1]), (2, 3, [0, 0])]
    assert mined(spark, rows) == brute_negatives(rows)
    wide = [(50, 1, [1 << 31, 1]), (51, 1, [1 << 30, 3]), (52, 2, [3 << 28, 5]), (53, 2, [3 << 28, 4]), (54, 1, [-(1 << 31), 7])]
    assert mined(spark, wide) == brute_negatives(wide)
    beyond = [(50, 1, [1 << 62, 1]), (51, 1, [1 << 62, 3]), (52, 2, [2, 5])]
    assert mined(spark, beyond) == []


def test_negatives_of_one_label_of_no_rows_and_of_equal_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(i, 1, [1, i]) for i in range(101)]) == []
    same = [(i, i % 2, [3, 4]) for i in range(101)]
    assert mined(spark, same) == brute_negatives(same) == []
    half = [(i, i % 2, [4, 4] if i % 2 else [6, 6]) for i in range(101)]
    assert mined(spark, half) == brute_negatives(half) != []


def test_negatives_query_equals_sql(spark):
    name = "op12_hard_negatives"
    assert compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)["ok"]


# operator 13

def brute_runs(words):
    """Runs by comparing at every lag; a stretch belongs to its smallest period."""
    words, found = np.array(words), {}
    for q in range(1, len(words) // 4 + 1):
        differs = np.flatnonzero(words[q:] != words[:-q])
        ends = [-1, *differs.tolist(), len(words) - q]
        for before, after in zip(ends, ends[1:]):
            start, end = before + 1, after + q
            if after > start and end - start >= max(6, 4 * q):
                found.setdefault((start, end), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def numbered(texts):
    """Some texts as one sequence, each ended by a number of its own."""
    flat = [w for i, t in enumerate(texts) for w in (*t, -1 - i)]
    return np.array(flat, np.int64) + len(texts), np.array([len(t) for t in texts], np.int64)


def runs_of(texts):
    words, lengths = numbered(texts)
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = [[] for _ in texts]
    for start, end, period in zip(*(x.tolist() for x in periodic.find_runs(words, lengths)), strict=True):
        row = int(np.searchsorted(first, start, "right")) - 1
        out[row].append((start - int(first[row]), end - start, period))
    return out


def some_texts(seed):
    rnd = random.Random(seed)
    for _ in range(250):
        text = [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 4)):
            part = [rnd.randrange(rnd.choice([1, 2, 50])) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))]
            if rnd.random() < .5:  # a part that is periodic itself
                part = part * rnd.randint(1, 6) + [rnd.randrange(3)] * rnd.randint(0, 3)
            times = rnd.randint(2, 7)
            text += (part * times)[:len(part) * times - rnd.randrange(len(part))] + [rnd.randrange(60) for _ in range(rnd.randint(0, 9))]
        yield text


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = list(some_texts(seed))
    assert runs_of(texts) == [brute_runs(t) for t in texts]
    assert sum(q >= 8 for t in texts for _, _, q in brute_runs(t)) > 50


def test_runs_of_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(2100)]
    blocks = ([1] * 50 + [2] * 50) * 4
    texts = [b, thue, thue * 4, blocks, [0] * 3000, (b * 5)[:3001]]
    assert runs_of(texts) == [brute_runs(t) for t in texts]


def test_misleading_hashes_do_not_change_the_runs(monkeypatch):
    monkeypatch.setattr(periodic.tb, "mix", lambda x: x * 0 + np.uint64(5))
    texts = [list(range(30)) * 5 + list(range(100, 150)), [1, 2] * 40 + list(range(40))]
    assert set(runs_of(texts)[1]) == set(brute_runs(texts[1]))
    found = runs_of(texts)[0]
    assert set(found) <= set(brute_runs(texts[0]))


def test_runs_edge_rows(spark, edge, nothing):
    found = periodic.periodic_runs(edge)
    assert found.columns == [*edge.columns, "periodic"] and found.count() == edge.count()
    told = {r.doc_id: r.periodic for r in found.collect()}
    assert (told[1].n_words, told[1].runs, told[1].collapsed) == (0, [], "") == (told[2].n_words, told[2].runs, told[2].collapsed)
    assert [tuple(r) for r in told[6].runs] == [(0, 30000, 1)] and told[6].collapsed == "word"
    assert told[4].runs == [] and told[5].collapsed == ""
    assert periodic.periodic_runs(nothing).count() == 0
    assert periodic.periodic_runs(found).columns == found.columns


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(rows) == len(docs)
    with_runs = 0
    for doc in docs:
        words = (doc.text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
        runs = brute_runs(words)
        row, best = rows[doc.doc_id], min(((-l, s, q) for s, l, q in runs), default=None)
        want = (-best[0], best[1], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        assert (row.n_runs, (row.length, row.start, row.period, row.exponent_milli)) == (len(runs), want)
        told = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        assert row.runs_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 5


def test_planted_periods_of_edge_rows(spark, edge):
    rows = [(10, None), (None, "a b"), *((i, "a\tb  c") for i in range(200))]
    out = queries.with_periods(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", F.col("text"))
    for row in out.filter("doc_id is not null and text is not null").collect():
        h = zlib.crc32(str(row.doc_id).encode())
        if h % 10:
            assert row.text == "a\tb  c"
        else:
            a = h // 10 % 3
            p = 1 + (3 - a) // (3 + h // 10 % 8)
            words = ["a", "b", "c"]
            assert row.text.split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(3)]
