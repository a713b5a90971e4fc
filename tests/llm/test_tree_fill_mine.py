"""Tree-concatenated encoding, fill-in-the-middle texts and hard negatives, against the library and brute force."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rxweave.llm import fillmiddle, negatives, queries, treebpe
from tests.compare import compare, connect
from tests.llm.rows import by_id, frame, prose, texts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return treebpe.TreeCoder(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PIECES = ["a", "ab", "the", "ing", "Ä", "中文", "😀", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "1", "=", "'s", "<|endoftext|>", "<|endof"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=60), st.sampled_from([1, 3, 8, 1000]))
def test_ids_are_those_of_the_library(parts, leaf):
    coder, kept = SHARED, treebpe.LEAF
    treebpe.LEAF = leaf
    try:
        coder.leaf_ids, coder.of_raw.known, coder.of_mapped.known = {}, {}, {}
        text = "".join(parts)
        ids = coder.ids(coder.encode([text])[0][0])
    finally:
        treebpe.LEAF = kept
    assert ids.tolist() == library_ids(text)
    assert coder.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False) == text


SHARED = treebpe.TreeCoder(PATH)


@pytest.mark.parametrize("unit", ["a", "ab", "=", " ", "zq", "é", "中", "abcdefghij", "\n\n \n"])
def test_long_unsplit_text(coder, unit):
    for n in (1, 7, 64, 4001):
        text = unit * n
        assert coder.ids(coder.encode([text])[0][0]).tolist() == library_ids(text)
    r = random.Random(unit)
    text = "".join(r.choice("abc" + unit) for _ in range(20_000))
    assert coder.ids(coder.encode([text])[0][0]).tolist() == library_ids(text)


def test_a_join_grows_until_both_sides_agree(coder, monkeypatch):
    sizes = []
    plain = coder.merged
    monkeypatch.setattr(coder, "merged", lambda m: sizes.append(len(m)) or plain(m))
    left, right = plain("a" * 4001), plain("a" * 333)
    sizes.clear()
    assert coder.joined(left, right) == plain("a" * 4334)
    assert len(sizes) > 3 and sizes == sorted(sizes)


def test_documents_and_their_pieces(spark):
    r = random.Random(4)
    rows = [*texts(), (20, "start " + "".join(r.choice("abcdé") for _ in range(3000)) + "<|endoftext|>" + "z" * 700 + " end"), (21, "ü" * 900), (22, "中" * 500), (23, "<|endoftext|>"), (None, "q" * 601)]
    want = sorted(((i is None, i, library_ids(t)) for i, t in rows), key=str)
    for spread, leaf in ((treebpe.SPREAD, treebpe.SPREAD_LEAF), (200, 64), (40, 7)):
        out = treebpe.encoded_documents(frame(spark, rows), PATH, spread=spread, leaf=leaf)
        got = [(x["doc_id"] is None, x["doc_id"], SHARED.ids(bytes(x["ids"])).tolist()) for x in out.collect()]
        assert sorted(got, key=str) == want
    back = treebpe.decoded_documents(out, PATH)
    assert sorted(((x["doc_id"], x["text"]) for x in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    for x in treebpe.digests(out.where("doc_id = 20"), PATH).collect():
        ids = library_ids(rows[-5][1])
        assert (x["n_tokens"], x["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x["decoded_sha256"] == hashlib.sha256(rows[-5][1].encode()).hexdigest()
    assert treebpe.encoded_documents(frame(spark, []), PATH).count() == 0


def test_bytes_that_are_no_text(coder):
    ids = np.array([*library_ids("中")[:1], 10 ** 6, -1, *library_ids("a")])
    assert coder.decode(ids) == LIBRARY.decode([int(i) for i in ids if 0 <= i < coder.size], skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.integers(0, 200_000), st.integers(1, 9)), st.tuples(st.integers(0, 200_000), st.sampled_from([300, 9000, 70_000]))), min_size=1, max_size=12), st.booleans())
def test_selects_in_a_boundary_set(spans, thin):
    offsets = np.unique(np.concatenate([np.arange(a, a + n, 2 if thin else 1) for a, n in spans])).astype(np.int64)
    held = fillmiddle.BoundarySet(offsets)
    assert len(held) == len(offsets)
    for k in {0, len(offsets) // 3, len(offsets) // 2, len(offsets) - 1, *np.linspace(0, len(offsets) - 1, 25).astype(int).tolist()}:
        assert held.select(k) == offsets[k]


def test_containers_take_their_smallest_form():
    kind = lambda values: type(fillmiddle.container(np.array(values, np.int32)))
    assert kind([5, 900, 1801]) is fillmiddle.Array
    assert kind(range(100, 5000)) is fillmiddle.Runs
    assert kind(range(0, 65536, 2)) is fillmiddle.Bitmap
    mixed = fillmiddle.BoundarySet(np.concatenate([[1, 7], np.arange(65536, 131072, 2), np.arange(200000, 210000)]).astype(np.int64))
    assert [type(c) for c in mixed.containers] == [fillmiddle.Array, fillmiddle.Bitmap, fillmiddle.Runs]


def plain_fill(doc_id, text, fim=100, spm=50):
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i:i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_the_middle(spark):
    rows = [*texts(), (30, "a <P> b\nc\n"), (31, "one\n\n\n\ntwo\n"), (32, "é中\n" * 5000), (33, "\n" * 70_000), (34, "<S"), (35, "x\n<\nP>\n" * 9), *[(i, prose(i, 60)) for i in range(100, 140)]]
    out = fillmiddle.fill_in_middle(frame(spark, rows))
    back = fillmiddle.restored_texts(out, keep=("doc_id", "form", "n", "prefix_chars", "middle_chars", "output"))
    got = sorted(((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"], x["restored"]) for x in back.collect()), key=str)
    assert got == sorted(((i, *plain_fill(i, t or ""), t or "") for i, t in rows), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    some = by_id(fillmiddle.fill_in_middle(frame(spark, rows), fim_percent=40, spm_percent=0))
    assert all(tuple(x)[1:] == plain_fill(i, t or "", 40, 0) for i, t in rows if i in (30, 31, 32, 33) or (i or 0) >= 100 for x in some[i])
    assert fillmiddle.fill_in_middle(frame(spark, [])).count() == 0


def plain_negatives(rows, k_pos=5, k_neg=3, every=50, low=50, high=95, noise=(7, 1, 10)):
    """Brute force over all pairs of (id, label, vector) rows."""
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if noise and i % noise[0] == 0:
            label = (label + noise[1]) % noise[2]
        new = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, new), new)
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in held.items() if i != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:k_pos]:
            found = [(i, -s) for s, i, other in scored if other != label and low * -ps <= 100 * -s <= high * -ps][:k_neg]
            out += [(a, p, rank, i, -ps, s) for rank, (i, s) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, label, v, "x", 1, 2) for i, label, v in rows], "vec_id long, label int, embedding array<float>, block string, chunk int, dim int")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, noise=(7, 1, 10), **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", (25, 60, 4096)[seed])
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", (2, 100, 1)[seed])
    monkeypatch.setattr(negatives, "FIRST_DEPTH", (1, 2, 16)[seed])
    r = np.random.default_rng(seed)
    dims = (3, 8, 1)[seed]
    rows = []
    for i in range(400):
        v = np.round(r.normal(size=dims) * (3 if seed == 1 else 30)) / 64  # many equal scores
        rows.append((i, int(r.choice([0, 0, 0, 1, 2, 9])), v.astype(float).tolist()))
    same = rows[50][2]
    rows += [(1000 + i, i % 2, same) for i in range(120)]  # a frequent vector
    rows += [(600, None, same), (601, 1, None), (602, 1, [None] * dims), (603, 1, [math.nan] * dims), (604, 1, [math.inf] * dims), (None, 1, same)]
    rows += [(650, 1, same), (650, 1, same), (650, 0, same), (700, 3, [0.0] * dims), (750, 1, [0.5] * (dims + 1)), (751, 1, [0.5] * (dims + 1)), (752, 2, [0.3] * (dims + 1)), (800, 1, []), (801, 1, []), (802, 2, [])]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len({x[0] for x in got}) > 5


@pytest.mark.parametrize("scale", [1e6, 3e15])
def test_large_components_are_scored_exactly(spark, scale):
    """Scores near 64 bits, and rows whose scores are beyond."""
    r = np.random.default_rng(1)
    rows = [(i, int(r.choice([0, 0, 1, 2, 9])), (r.normal(size=8) * (scale if scale < 1e9 or i % 40 == 3 else 1)).astype(np.float32).astype(float).tolist()) for i in range(300)]
    if scale > 1e9:
        rows += [(i, i % 3, [x] * 8) for i, x in ((401, 3.4e38), (402, -3.4e38), (403, 1e30), (450, -1e30))]
    near = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    wanted = [(*x[:4], near(x[4]), near(x[5])) for x in plain_negatives(rows)]
    assert mined(spark, rows) == wanted and len(wanted) > 50


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0])]) == [] and mined(spark, [(50, 1, [1.0]), (51, 1, [1.0])]) == []
    lone = [(50, 1, [1.0]), (51, 1, [1.0]), (52, 2, [0.9]), (53, 2, [1.0])]
    assert mined(spark, lone) == [(50, 51, 1, 52, 65536, 256 * 230)]


def test_an_anchor_stops_early():
    r = np.random.default_rng(3)
    block = negatives.Block(np.arange(20_000), np.zeros(20_000, np.int64), r.integers(-9999, 9999, (20_000, 2)))
    scored = []
    plain = block.scores
    block.scores = lambda rows, anchor: scored.append(len(rows)) or plain(rows, anchor)
    anchor = np.array([7, -3])
    rows, score = block.best(anchor, np.ones(20_000, bool), [(None, None)], 5)[0]
    assert sum(scored) < 2_000 and score.tolist() == sorted((block.vectors @ anchor).tolist(), reverse=True)[:5]
    big = negatives.Block(np.arange(3), np.zeros(3, np.int64), np.array([[1 << 55], [(1 << 55) + 1], [5]]))
    assert big.best(np.array([3]), np.ones(3, bool), [(None, None)], 1)[0][1].tolist() == [3 * ((1 << 55) + 1)]


@pytest.mark.parametrize("name", ["op11_tree_concatenation_bpe", "op12_roaring_fill_in_middle", "op13_threshold_hard_negatives"])
def test_queries_and_their_sql(spark, name):
    status, n, _, note = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.CHECKS.get(name))
    assert status in ("ok", "rows") and n > 0, note


def test_tree_query_equals_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op11_tree_concatenation_bpe"](spark, SF).collect():
        ids = library_ids(docs[r["doc_id"]])
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_no_group_is_whole(spark):
    """Blocks of a frequent label are many, and none grows with it."""
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i).cast("float") for i in range(4)]).alias("embedding"), F.lit(1).alias("label"))
    rows = negatives.prepared(df, "vec_id", "embedding", "label", 256, None)
    sizes = rows.repartitionByRange(5, "dim", "label", F.xxhash64("vec_id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(s["count"] for s in sizes) < 2 * 20_000 / 5
