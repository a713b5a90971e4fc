"""Operators over the whole corpus, against brute force, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rxweave.llm import decontamination, neardup, pii, quality, queries, suffixes, toxicity
from rxweave.llm.wordhash import Words
from tests.compare import compare, connect
from tests.llm.rows import by_id, frame, prose, texts

SF = "/root/testdata/sf0.001"


def plain_removed(rows):
    """Per row of (id, text), in order of id: removed bytes, spans and what stays."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mask = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                mask[s:s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, m in zip(data, mask) if not m)
        out[i] = len(data), sum(mask), sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask)), hashlib.sha256(kept).hexdigest()
    return out


def check_removed(spark, rows):
    got = by_id(suffixes.repeated_strings(frame(spark, rows)))
    assert {i: tuple(r[0])[1:] for i, r in got.items()} == plain_removed(rows)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 900)
    r = random.Random(seed)
    passages = ["".join(r.choice("abcé ") for _ in range(r.choice([90, 99, 100, 101, 130, 300]))) for _ in range(6)]
    rows = [(i, "".join(r.choice([r.choice(passages), "".join(r.choice("xyz") for _ in range(r.randint(0, 120)))]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, "ab" * 150), (62, "ab" * 150), (63, "q" * 400), (64, rows[3][1])]
    check_removed(spark, rows)


def test_repeats_with_repeated_and_null_ids(spark):
    got = by_id(suffixes.repeated_strings(frame(spark)))
    assert sum(map(len, got.values())) == len(texts())
    assert got[3][0]["n_removed"] == got[3][0]["n_bytes"] and got[1][0]["n_removed"] == 0 and got[12][0] == got[12][1] and got[5][0]["n_bytes"] == 0
    assert got[None][0]["n_removed"] == 0 and got[10][0]["n_removed"] == 59999
    assert suffixes.repeated_strings(frame(spark, [])).count() == 0


def test_signatures_agree_as_often_as_the_weighted_similarity():
    r = np.random.default_rng(5)
    for n, shared in ((3, 2), (50, 40), (2000, 1500)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], r.integers(0, 1 << 63, n - shared).astype(np.uint64)])
        wa = r.integers(1, 4, n).astype(float)
        wb = np.where(np.arange(n) < shared // 2, wa + 0.5, wa)
        agree = np.mean([(lambda s: (s[0] == s[1]).mean())(neardup.signatures(np.repeat([0, 1], n), np.concatenate([a, b]) ^ np.uint64(t * 7919), np.concatenate([wa, wb]), 2)) for t in range(30)])
        both = np.minimum(wa, wb)[:shared].sum()
        assert abs(agree - both / (wa.sum() + wb.sum() - both)) < 0.03


def plain_shingles(text):
    words = decontamination.words_of(text)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def plain_classes(rows):
    """The least id of each row's class, by all pairs that share a shingle."""
    sets, index, root = {}, defaultdict(list), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for i, t in sorted(rows):
        if t is None:
            continue
        sets[i] = plain_shingles(t)
        shared = Counter(j for s in sets[i] for j in index[s])
        near = [j for j, n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)] + [first.setdefault(t, i)]
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t.replace("the", "teh", 1) if t else t) for i, t in rows[:40]] + [(20_000, None), (20_001, ""), (20_002, "")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def family(n, pairs, size=500, changes=8, common=3):
    """Texts some 0.75 to each other, from one template; the first ``pairs`` of them have a partner some 0.82 to them."""
    r = random.Random(n)
    template = [f"w{i}" for i in range(size)]
    out = []
    for i in range(n):
        at = r.sample(range(2, size - 2, 5), 2 * changes - common)
        for k, places in enumerate([at[:changes], at[changes - common:]][:1 + (i < pairs)]):
            words = list(template)
            for x in places:
                words[x] = f"t{i}x{x}" if x in at[changes - common:changes] else f"t{i}y{x}k{k}"
            out.append(" ".join(words))
    r.shuffle(out)
    return list(enumerate(out))


def test_near_pairs_within_a_family_of_texts_below_the_limit(spark, monkeypatch):
    """The centres are made to miss all pairs: what they leave must be found without them."""
    monkeypatch.setattr(neardup, "ALL_MET", 1)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 8)
    centres = neardup._candidates
    monkeypatch.setattr(neardup, "_candidates", lambda members: centres(members).where("false"))
    rows = family(60, 40)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    sets = [plain_shingles(t) for _, t in rows]
    want = list(range(len(rows)))
    for i in want[:]:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    want = dict(enumerate(want))
    assert 55 < len(set(want.values())) <= 60 and got == want


def test_near_duplicates_with_awkward_rows(spark):
    got = by_id(neardup.near_duplicates(frame(spark)))
    assert got[2][0]["class_id"] == got[3][0]["class_id"] == 1 and got[1][0]["class_size"] == 3
    assert got[12][0]["class_size"] == 2 and got[5][0]["class_size"] == 1 and sum(map(len, got.values())) == len(texts())
    kept = neardup.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 10, None, 12, 13, 13, 15, 16, 17]))
    assert neardup.near_duplicates(frame(spark, [])).count() == 0 == neardup.keep_one(frame(spark, [])).count()
    assert neardup.near_duplicates(frame(spark), counted=True).count() == len(texts())


def test_components_of_long_paths(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in [*range(0, 40), *range(60, 75)]]
    got = {r["node"][0]: r["root"][0] for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 60 for i in range(60, 76)}


def test_toxicity_learns_words_from_positives_only(spark):
    r = random.Random(2)
    rows = [(i, prose(i, 60) + (" " + r.choice(["vile", "nasty", "rotten"]) + " " + prose(i + 7, 20)) * (i % 5 == 0)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(0, 900)] + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    got = toxicity.score_documents(frame(spark, rows + [(5000, None), (5001, ""), (None, "vile")]), labels)
    held = got.where("held_out").toPandas()
    assert (held["predicted"] == (held["doc_id"] % 5 == 0)).mean() > 0.95
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0 and got.count() == 903
    none = toxicity.score_documents(frame(spark), labels.where("false"))
    assert none.count() == len(texts()) and none.where("predicted = 1").count() == 0
    assert toxicity.score_documents(frame(spark, []), labels).count() == 0


def test_word_hashes():
    words = Words(["One two, TWO\n", None, "", "two é" + "x" * 3000, "é" + "x" * 2999])
    assert words.document.tolist() == [0, 0, 0, 3, 3, 4]
    assert words.hash[1] == words.hash[2] == words.hash[3] and len(set(words.hash.tolist())) == 4
    assert words.prefix(2)[4] == words.prefix(2)[5]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, con, name):
    status, n, _, note = compare(spark, con, SF, name, queries.QUERIES[name], queries.CHECKS.get(name))
    assert status in ("ok", "rows") and n >= 25, note


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        assert docs.columns == columns or name == "tokens"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    judged = quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()
    good = {r["doc_id"]: rows[r["doc_id"]] for r in judged}
    assert {r["doc_id"]: r["text"] for r in seen["quality"].collect()} == good
    distinct = {i for i, c in plain_classes(list(good.items())).items() if i == c}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == distinct
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 13]) for _, t in bench for w in [decontamination.words_of(t)] for i in range(max(len(w) - 12, 1))}

    def dirty(text):
        words = decontamination.words_of(text)
        hit = {i + k for i in range(len(words)) for n in {len(w) for w in windows} if tuple(words[i:i + n]) in windows for k in range(n)}
        return bool(hit) and 20 * len(hit) >= len(words)

    clean = {i for i in distinct if not dirty(good[i])}
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == clean
    for r in seen["personal_data"].collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert bool(pii.base_spans(good[r["doc_id"]])) <= (r["text"] != good[r["doc_id"]])
    final = {r["doc_id"]: r["decoded_sha256"] for r in seen["tokens"].collect()}
    assert final == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in seen["personal_data"].collect()}
