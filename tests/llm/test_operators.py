"""The ten operators on edge cases and against brute force, libraries and round trips."""

import collections
import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medialens.llm import (bagminhash, blocks, feistel, fst_tokens, lbl, licenses, linededup, queries, repetition,
                           textbytes, treescore, wordtable, wumanber)

BYTE_BPE, WORD_BPE = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def fuzz(parts, n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


PARTS = ["'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Don't", "'", "1", "23", "é", "é", "ß", "漢字", "🙂", "\xa0", " ",
         "!", "--", "<|endoftext|>", "<|ENDoftext|>", "<|endo", "the", "ing", "\r\n", "²", "\x00", "\x85", "İ", "</w>"]


def test_edge_cases_keep_rows(spark, edge):
    n = edge.count()
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (None, None)], "item_id int, text string")
    assert repetition.measure(edge).count() == n
    assert {r.doc_id for r in repetition.keep_good(edge).collect()} == {None, 4}
    found = {r.doc_id: r.passages for r in wumanber.find_passages(edge, bench).collect()}
    assert found[4].places == list(range(1, 11)) and found[4]["items"] == ["1"] and found[2].n_words == 0
    assert {r.doc_id for r in wumanber.keep_clean(edge, bench).collect()} == {1, 2, 5, 6}
    counts = {r.doc_id: r.tokens for r in fst_tokens.count_tokens(edge, BYTE_BPE).collect()}
    assert (counts[1].n_tokens, counts[2].n_bytes, counts[6].n_bytes) == (0, 0, 150000)
    assert feistel.pseudonymise(edge, b"k").filter("text <=> private.text").count() == n
    coded = {r.doc_id: r for r in wordtable.encode_decode(edge, WORD_BPE, ["doc_id"]).collect()}
    assert (coded[2].n_tokens, coded[2].decoded, coded[6].n_tokens) == (0, "", 30000)
    classes = [(r.doc_id, r.class_id, r.n_copies) for r in bagminhash.classes(edge).collect()]
    assert {c[1:] for c in classes if c[0] in (None, 4)} == {(4, 3)} and (1, 1, 1) in classes
    kept = bagminhash.keep_first(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]
    lines = linededup.drop_repeated_lines(edge, dropped="gone")
    assert sorted((r.doc_id or 0, r.text, r.gone) for r in lines.filter("gone > 0").collect()) == [(0, "", 1)]
    assert lines.count() == n
    scores = lbl.score(edge, queries.not_held_out(), ["doc_id"]).collect()
    assert len(scores) == n and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in scores)
    scans = licenses.scan(edge.withColumn("path", F.concat(F.lit("a/"), "doc_id"))).collect()
    assert len(scans) == n


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id int, text string")
    for out in (repetition.keep_good(nothing), wumanber.keep_clean(nothing, bench), linededup.drop_repeated_lines(nothing),
                bagminhash.keep_first(nothing), fst_tokens.count_tokens(nothing, BYTE_BPE),
                wordtable.encode_decode(nothing, WORD_BPE, ["doc_id"]), feistel.pseudonymise(nothing, b"k"),
                lbl.score(nothing, queries.not_held_out(), ["doc_id"]), licenses.scan(nothing.withColumn("path", F.lit("a/b")))):
        assert out.count() == 0


ARTICLE = ("<p>First paragraph, with commas, and some length to it for sure.</p>"
           "<p>Second one, equally long, to make points here, really.</p>")
ARTICLE_TEXT = "First paragraph, with commas, and some length to it for sure.\nSecond one, equally long, to make points here, really."


@pytest.mark.parametrize("around", [
    '<div class="content with-sidebar">{}</div>', '<article class="post comment-open">{}</article>', '<div id="social-policy">{}</div>',
    '<div class="share-price-news">{}</div>', '<div class="sidebar">{}</div>', "<main class='menu'>{}</main>",
    "<nav>a</nav><div>{}</div><footer>b</footer>", '<div>{}</div><div class="comments"><p>Nice, very nice, good, my friend, ok.</p></div>',
    '<article>{}</article><div id="comment-list"><article class="comment"><p>Nice, very nice, good, my friend.</p></article></div>',
    '<div>{}</div><div class="related-posts"><a href=x>Another post</a></div>', '<article>{}<aside>x, y, z</aside></article>'])
def test_articles_are_found_whatever_they_are_called(around):
    assert treescore.main_text(f"<html><body>{around.format(ARTICLE)}</body></html>") == ARTICLE_TEXT


def test_lists_and_further_articles_belong_to_the_text():
    links = "<ul><li><a href=x>Reference one is a long link</a></li><li><a href=y>Reference two also</a></li></ul>"
    assert treescore.main_text(f"<article>{ARTICLE}{links}</article>") == ARTICLE_TEXT + "\nReference one is a long link\nReference two also"
    assert treescore.main_text(f"<article>{ARTICLE}</article>" * 3) == "\n".join([ARTICLE_TEXT] * 3)
    menu = "<ul><li><a href=x>Home page</a></li><li><a href=y>All news</a></li></ul>"
    assert treescore.main_text(f"<div>{menu}{ARTICLE}</div>") == ARTICLE_TEXT


def test_deep_pages_take_linear_time():
    import time
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert treescore.main_text("<div>" * n + "x, y") == "x, y" and treescore.main_text("<b>" * n + "x" + "</i>" * n) == "x"
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_html_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<p>x", "c"), (3, "<p>x", "c"), (None, "<p>" + "long, " * 50000, "d"), (4, "<div", "e")]
    pages = spark.createDataFrame([(*r, "u") for r in rows], "page_id int, html string, url string, main_text string")
    out = treescore.extract(pages)
    assert sorted(out.columns) == sorted(pages.columns)
    got = [(r.page_id, r.main_text) for r in out.collect()]
    assert got.count((3, "x")) == 2 and (1, "") in got and (2, "") in got and (4, "") in got
    assert next(len(t) for i, t in got if i is None) == 50000 * 6 - 1
    assert treescore.extract(pages.limit(0)).count() == 0


def test_pages_keep_their_articles(spark):
    """On the given pages: what the article element holds, by a parser of its own."""
    import re
    from html import unescape
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for (html,) in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)
        text = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        assert treescore.main_text(html) == "\n".join(t for t in text if t)


def test_word_windows_decide(spark):
    """A text below the base rule's share of repeated words goes for the characters in them."""
    fresh = " ".join(f"w{i}" for i in range(60))
    long = " ".join("extraordinarily" + str(i) for i in range(5))
    rows = [(1, fresh), (2, f"{long} {fresh} {long}"), (3, fresh + " " + " ".join(f"v{i}" for i in range(60)))]
    got = {r.doc_id: r.quality for r in repetition.measure(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].kept and got[3].kept
    assert not got[2].base_failed and got[2].n_symbols == 0 and not got[2].kept


def test_token_counts_equal_the_library():
    texts = fuzz(PARTS, 3000)
    with open(BYTE_BPE, encoding="utf-8") as file:
        machine = fst_tokens.merger(file.read())
    got = fst_tokens.count_slice(pa.array(texts), machine)[1].tolist()
    assert got == [len(e.ids) for e in library(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_bpe_round_trip_equals_the_library(spark):
    texts = fuzz(PARTS, 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded)
           for r in wordtable.encode_decode(docs, WORD_BPE, ["doc_id"]).collect()}
    t = library(WORD_BPE)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == (e.ids, t.decode(e.ids, skip_special_tokens=False)), texts[i]


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    places = np.concatenate([rng.integers(0, 700, 5000), [700, 3, 701, 702]])
    assert (blocks.unpack_sequence(blocks.pack_sequence(places, 700)) == places).all()
    big = np.array([0, 2 ** 40, 5])
    assert (blocks.unpack(blocks.pack(big, 8), 8) == big).all()
    up = np.array([0, 3, 9])
    assert (blocks.unpack_rising(blocks.pack_rising(up)) == up).all()


def test_bagminhash_is_unbiased():
    rnd, gaps = random.Random(3), []
    for t in range(60):
        a = collections.Counter({i: rnd.choice([1, 1, 2, 3, 9]) for i in range(20)})
        b = collections.Counter({i: n if rnd.random() < 0.7 else rnd.choice([0, 1, 4, 30]) for i, n in a.items()})
        pair = [[textbytes.mix(np.array([i + 1000 * t + 1], np.uint64) * textbytes.BASE)[0] for i in x.elements()] for x in (a, +b)]
        h = np.array(pair[0] + pair[1], np.uint64)
        row = np.array([0] * len(pair[0]) + [1] * len(pair[1]))
        s = bagminhash.signatures(h, row, 2, 512)
        gaps.append((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.01


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_edit_join_finds_and_verifies_every_pair():
    rnd = random.Random(2)

    def change(s):
        s = list(s)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(s))
            s[i:i + 1] = rnd.choice([[], ["é"], [s[i], "b"]])
        return "".join(s)

    a = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(26, 60))) for _ in range(400)]
    b = [change(x) for x in a]
    near = np.array([edits(x, y) <= 2 for x, y in zip(a, b)])
    assert (linededup.EditDistance().pairs(pa.array(a), pa.array(b)) == near).all()
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, texts in zip(keys, (a, b)):
        for row, key in zip(*linededup.segment_keys(pa.array(texts))):
            side[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in np.flatnonzero(near) if min(len(a[i]), len(b[i])) >= linededup.MIN_CHARS)


def test_word_join_finds_and_verifies_every_pair():
    rnd = random.Random(7)

    def change(words):
        words = list(words)
        for _ in range(rnd.randint(1, 12)):
            i = rnd.randrange(len(words))
            words[i:i + 1] = rnd.choice([[], [f"new{rnd.randrange(99)}"], [words[i], "more"]])
        return words

    a = [[f"w{rnd.randrange(60)}" for _ in range(rnd.randint(15, 160))] for _ in range(500)]
    b = [change(x) for x in a]
    assert [linededup.word_edits(x, y) for x, y in zip(a, b)] == [edits(x, y) for x, y in zip(a, b)]
    near = np.array([edits(x, y) <= min(len(x), len(y)) // linededup.WORDS_PER_EDIT for x, y in zip(a, b)])
    left, right = (pa.array([" ".join(x) for x in side]) for side in (a, b))
    close = linededup.EditDistance().pairs(left, right)
    assert 100 < near.sum() < 450 and (linededup.NearLines().pairs(left, right) == near | close).all()
    n = np.arange(len(a))
    x, y = linededup.NearLines().blocks(left, right, n, n + len(a))
    assert set(np.flatnonzero(near)) <= {i for i, j in zip(x, y) if i == j}
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for side, column in zip(keys, (left, right)):
        for row, key in zip(*linededup.word_keys(column)[:2]):
            side[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in np.flatnonzero(near))


def test_lines_that_share_a_passage_only_do_not_meet():
    """A passage or frequent words in common are no candidates: buckets stay small, whatever the corpus repeats."""
    rnd = random.Random(13)
    passage = " ".join(f"w{i}" for i in range(20))
    other = lambda n: " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(n))
    lines = pa.array([other(rnd.randint(0, 40)) + " " + passage + " " + other(rnd.randint(40, 80)) for _ in range(200)])
    rows, keys, _ = linededup.word_keys(lines)
    assert set(rows.tolist()) == set(range(200))
    assert np.unique(keys, return_counts=True)[1].max() < 5


def test_edits_of_signs_and_spaces_leave_a_common_key():
    rnd = random.Random(14)
    for _ in range(400):
        a = " ".join(rnd.choice(["ab", f"w{rnd.randrange(300)}", "a,b", "x;", "zzz"]) for _ in range(rnd.randrange(20, 330)))
        b = list(a)
        for _ in range(2):
            i = rnd.randrange(len(b))
            b[i:i + 1] = rnd.choice([[","], [], ["q"], [b[i], ","], [b[i], " "]])
        keys = []
        for line in (a, "".join(b)):
            _, by_word, n = linededup.word_keys(pa.array([line]))
            few = 2 * linededup.allowed(n[0] - 2 * linededup._WORD_SHIFT) < 2 * linededup._WORD_CHANGES
            keys.append({*by_word.tolist(), *(linededup.segment_keys(pa.array([line]))[1].tolist() if few else ())})
        assert keys[0] & keys[1], (a, "".join(b))


def test_blocks_of_long_lines_count_words_either_way(monkeypatch):
    rnd = random.Random(15)
    base = [[f"w{rnd.randrange(99)}" for _ in range(rnd.randint(30, 120))] for _ in range(12)]
    lines = []
    for _ in range(90):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(9)}"
        lines.append(" ".join(words))
    lines, n = pa.array(lines), np.arange(90)
    i, j = np.divmod(np.arange(8100), 90)
    near = linededup.NearLines().pairs(lines.take(pa.array(i)), lines.take(pa.array(j)))
    for few in (0, 10 ** 6):
        monkeypatch.setattr(linededup, "FEW_PAIRS", few)
        x, y = linededup.NearLines().blocks(lines, lines, n, n - 1 - 90)
        assert set(zip(x.tolist(), y.tolist())) == set(zip(i[near].tolist(), j[near].tolist()))


def test_a_written_stage_leaves_no_shuffle_files(spark):
    from medialens.llm import scratch
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())}
    before = {x for x in files() if x.startswith("shuffle_")}
    was = spark.conf.get(scratch.CLEANUP)
    out = scratch.stage_alone(spark.range(5000).groupBy((F.col("id") % 100).alias("a")).count(), "test")
    end = time.time() + 20
    while {x for x in files() - before if x.startswith("shuffle_") and x.endswith(".data")}:
        assert time.time() < end
        time.sleep(0.2)
    assert len(out.collect()) == 100 and spark.conf.get(scratch.CLEANUP) == was


def test_marks_never_rule_out_near_lines(spark):
    rnd = random.Random(11)

    def change(line):
        line = list(line)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(line))
            line[i:i + 1] = rnd.choice([[], ["é"], [line[i], " new "], ["😀"], list(" two words ")])
        return "".join(line)

    a = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(3, 160))) for _ in range(400)] + [" " * 30, "—" * 30]
    b = [change(x) for x in a]
    left, right = pa.array(a), pa.array(b)
    lines = linededup.NearLines()
    x, y = linededup.line_marks(left), linededup.line_marks(right)
    may = lines.may_blocks(x, y)
    assert (may.diagonal() | ~lines.pairs(left, right)).all() and 300 < may.diagonal().sum() and may.sum() < 0.02 * may.size
    both = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist()))],
                                 ", ".join(["i int", *(f"{s} struct<{','.join(f'{f}:{k}' for f, k in linededup.MARK.items())}>" for s in "xy")]))
    assert {r.i for r in both.filter(lines.may(F.col("x"), F.col("y"))).collect()} == set(np.flatnonzero(may.diagonal()))


def test_only_lines_that_may_be_alike_are_fetched(spark):
    """Lines that share keys but not their marks: no text of theirs is fetched."""
    from medialens.llm import linking
    rnd = random.Random(12)
    near = ["".join(chr(rnd.randrange(65, 123)) for _ in range(60)) for _ in range(40)]
    texts = [*near, *(x[:9] + "x" + x[10:] for x in near[:10]), *("q" * i for i in range(40, 100))]
    marks = linededup.line_marks(pa.array(texts)).to_pylist()
    marked = spark.createDataFrame([(i, m) for i, m in enumerate(marks)],
                                   f"node bigint, mark struct<{','.join(f'{f}:{k}' for f, k in linededup.MARK.items())}>")
    held = spark.createDataFrame(list(enumerate(texts)), "node bigint, body string")
    # buckets of unlike letter lines and of near ones, and of q lines
    members = [(1 + i, j) for i in range(10) for j in (i, i + 10, i + 20, i + 30, i + 40)] + [(20, i) for i in range(50, 60)]
    asked = []

    def bodies(nodes):
        asked.append({r.node for r in nodes.collect()})
        return held.join(nodes, "node", "left_semi")

    members = spark.createDataFrame(members, "key bigint, node bigint")
    find = lambda *more: {(r.node, r.root) for r in linking.classes(members, bodies, linededup.NearLines(), *more).collect()}
    whole, (all_,) = find(), asked
    asked.clear()
    assert find(marked) == whole >= {(40 + i, i) for i in range(10)} and len(all_) == 60
    assert len(set().union(*asked)) < 40


def test_long_lines_within_words_and_short_equal_lines_go(spark):
    rnd = random.Random(9)
    line = [f"word{rnd.randrange(10 ** 4)}" for _ in range(70)]
    other = " ".join(line[:30] + ["something"] + line[31:])
    signs = "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(80))
    rows = [(1, " ".join(line) + "\nAll rights reserved.\n\n" + signs), (2, "kept\n\nAll rights reserved.\n" + other),
            (3, "All rights\n" + signs[:30] + "x" + signs[31:33] + "y" + signs[34:57] + "z" + signs[58:])]
    out = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), dropped="gone").collect()
    assert {r.doc_id: (r.text, r.gone) for r in out} == {1: (rows[0][1], 0), 2: ("kept\n", 2), 3: ("All rights", 1)}


def test_near_copies_join_one_class(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1:])) for i in range(120)]
    rows += [(1000 + i, " ".join(f"z{rnd.randrange(10 ** 6)}" for _ in range(80))) for i in range(20)]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


def test_block_comparison_finds_links_beyond_the_leader(spark):
    from medialens.llm import linking
    # a chain: every text is near the next one only, all in one bucket larger than SMALL
    words = [f"w{i}" for i in range(400)]
    bodies = [" ".join(words[6 * i:6 * i + 100]) for i in range(30)]
    members = spark.createDataFrame([(1, i) for i in range(30)], "key bigint, node bigint")
    texts = spark.createDataFrame(list(enumerate(bodies)), "node bigint, body string")
    out = linking.classes(members, lambda nodes: texts.join(nodes, "node", "left_semi"),
                          linking.Overlap(bagminhash._bag, 0.8)).collect()
    assert {(r.node, r.root) for r in out} == {(i, 0) for i in range(30)}


@pytest.mark.parametrize("html, text", [
    ("<body><nav>Home, a</nav><article><h1>T &amp; x</h1><p>one<br>two <b>b<p>three</article><footer>f</footer>", "T & x\none two b\nthree"),
    ("<div id=sidebar>no</div><div><p>Long enough text, with commas, here.</p><p>Short</p></div><div class='comments'>hi</div>",
     "Long enough text, with commas, here.\nShort"),
    ("<article>a < b<script>var x='</p>'</script> c<!-- x --></article>", "a < b c"),
    ("<p>cut <a href=\"x", "cut"), ("", ""), (None, ""), ("<script>never closed", "")])
def test_main_text(html, text):
    assert treescore.main_text(html) == text


def test_pseudonyms_keep_format_and_links():
    text = "mail al.x99@a.org card 4994226020900891 4111 1111 1111 1111 ip 10.0.0.1 on 2024-02-29, +1 (659) 555-3949 no 1234567890123456"
    out, found = feistel.replace_all(text, b"key")
    assert {k for k, _, _ in found} >= {"email", "card", "ip", "date", "phone"} and "1234567890123456" in out
    assert feistel.replace_all(out, b"key", inverse=True)[0] == text and feistel.replace_all(text, b"key")[0] == out
    assert sorted(feistel.permute(i, 1000, b"k", b"t") for i in range(1000)) == list(range(1000))


@pytest.mark.parametrize("text, kind, value", [
    ("4111 1111 1111 1111 12/26", "card", "4111 1111 1111 1111"), ("x 4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"),
    ("7 4111-1111-1111-1111", "card", "4111-1111-1111-1111"), ("GB82 WEST 1234 5698 7654 32 2024", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("DE89 3704 0044 0532 0130 00 BANK", "iban", "DE89 3704 0044 0532 0130 00"), ("AB12 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("call (555) 123-4567 now", "phone", "(555) 123-4567"), ("1-415-555-2671", "phone", "1-415-555-2671"),
    ("on 12/31/2020.", "date", "12/31/2020"), ("on 31/12/2020.", "date", "31/12/2020")])
def test_pseudonyms_beside_other_groups_and_national_forms(text, kind, value):
    for key in (b"%d" % i for i in range(60)):
        out, found = feistel.replace_all(text, key)
        assert (kind, value) in [f[:2] for f in found] and value not in out and len(out) == len(text)
        assert feistel.replace_all(out, key, inverse=True)[0] == text


def test_licences_are_named_and_inherited(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", "code"), ("a/b/y", "z\nLicensed under CC BY-NC 4.0.\n" + "w " * 50),
             ("c/x", "nothing"), (None, None)]
    got = {r.path: r.licence for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert (got["a/LICENSE"].own, got["a/b/x"].inherited, got["a/b/x"].directory) == ("MIT", "MIT", "a")
    assert (got["a/b/y"].own, got["c/x"].inherited, got[None].own) == ("CC-BY-NC-4.0", None, None)


def test_wrapped_headers_and_identifiers_are_named(spark):
    import textwrap
    wrapped = {a: "\n".join(f"# {x}" for x in textwrap.wrap(t, 60)) for a, t in licenses.TEMPLATES if len(t) > 150}
    files = [(f"w/{a}", "#!/bin/sh\n# Copyright 2020 A. Person\n" + t + "\n#\nimport os\nprint(os.name)\n") for a, t in wrapped.items()]
    ids = sorted({a for a, _ in licenses.TEMPLATES})
    files += [(f"s/{a}", f"/* Copyright (c) 2020 A. Person, SPDX-License-Identifier: {a} */\nint main() {{}}\n") for a in ids]
    files += [("s/GPL-3.0/x", "// SPDX-License-Identifier: GPL-3.0-or-later\ncode\n"), ("n/None", "# Copyright 2020 A. Person\nx = 1\n" * 9)]
    got = {r.path: r.licence.own for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert len(wrapped) > 3 and got == {p: None if p[0] == "n" else p.split("/")[1] for p, _ in files}


def test_model_beats_the_unigram_on_held_out_text(spark):
    out = queries.op8_lm_score(spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t, left = library(WORD_BPE), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
    rows = {r.doc_id: r.text for r in left.collect()}
    assert len(out) == len(rows)
    for r in out:
        ids = t.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
