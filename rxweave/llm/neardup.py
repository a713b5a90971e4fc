"""Near duplicates by DartMinHash signatures, banded joins and exact checks.

A text is the weighted set of its five-word shingles. Darts fall on the plane of
weight and time; those below an element's weight and before a time limit that
depends on the text's total weight hit one of the signature's coordinates each,
and the earliest dart per coordinate stays. Two texts agree in a coordinate with
the probability of their weighted Jaccard similarity, and the work grows with the
shingles plus the darts, not with their product.

Equal texts are one node. Nodes that share the hash of a band of coordinates are
candidates. Pairs are sifted by a sketch of one byte per coordinate and decided
on the exact similarity of the texts. Classes are connected components. There
are two rounds:

1. Each node meets one centre of each of its buckets: the node with the most
   company, which of an original and its edited copies is the original. That
   connects most of what is near, with about one pair a node.
2. Buckets that still hold several components are cut into blocks of bounded
   size. A task compares two blocks and returns only the links that join
   components it has not yet joined, so at most one row a node. The nodes of a
   bucket's largest component meet the others, not each other, and a pair is
   compared in the first band that it shares only.

So every pair that shares a bucket is checked, or in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.llm.common import field, map_texts, pieces, quoted
from rxweave.llm.wordhash import Words, mixed
from rxweave.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8

#: 125 of the 128 coordinates make 25 bands of 5; a pair at 0.8 shares none with a probability of 5e-5.
COORDINATES = 128
ROWS = 5
BANDS = COORDINATES // ROWS

#: Pairs whose sketches agree less than this are not read; six standard errors below the threshold.
SKETCH_LEAST = 0.58

#: Nodes and bytes of text of a block in the second round; a task holds two blocks.
BLOCK_NODES = 256
BLOCK_BYTES = 32 << 20

#: In a bucket of at most so many nodes the centre has met all others.
ALL_MET = 2

#: Bytes of text hashed at once.
HASHED_BYTES = 2 << 20

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = mixed(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, by text. A text of one to four words is one shingle."""
    words = Words(texts)
    n = len(words.hash)
    totals = np.bincount(words.document, minlength=len(texts))
    ends = np.cumsum(totals)
    left = ends[words.document] - np.arange(n)  # words of the text from here on
    value = np.zeros(n, np.uint64)
    for t in range(min(SHINGLE, n)):
        value[:n - t] += np.where(left[:n - t] > t, words.hash[t:] * ODD[t], np.uint64(0))
    starts = (left >= SHINGLE) | ((totals[words.document] < SHINGLE) & (left == totals[words.document]))
    document, value = words.document[starts], mixed(value[starts])
    order = np.lexsort((value, document))
    document, value = document[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    return document[first], value[first], np.diff(np.append(first, len(value)))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def thrown(document: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate cell (text number times k plus coordinate), time and name of every dart below the weights and before each text's limit.

    Per unit of weight of an element the times are those of a Poisson process,
    made from the hash of the element and the unit, so that equal regions get
    equal darts in every text.
    """
    units = np.ceil(weight).astype(np.int64)
    which = np.repeat(np.arange(len(element)), units)
    unit = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
    seed = mixed(element[which] + mixed(unit.astype(np.uint64) + np.uint64(1)))
    room, text, until = weight[which] - unit, document[which], limit[document[which]]
    time, turn, found = np.zeros(len(which)), 0, []
    while len(seed):
        turn += 1
        name = mixed(seed + np.uint64(turn * int(GOLDEN) % (1 << 64)))
        time = time - np.log(uniform(name))
        early = time < until
        seed, room, text, until, time, name = (x[early] for x in (seed, room, text, until, time, name))
        inside = uniform(mixed(name ^ GOLDEN)) < room
        found.append((text[inside] * k + (name[inside] % np.uint64(k)).astype(np.int64), time[inside], name[inside]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def signatures(document: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart per text and coordinate; rows of texts without elements stay zero.

    The limit lets about k (ln k + 2) darts fall on a text; it is doubled for
    texts with a coordinate that none has hit.
    """
    out = np.zeros((n_texts, k), np.uint64)
    total = np.bincount(document, weight, n_texts)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n_texts), where=total > 0)
    while len(document):
        cell, time, name = thrown(document, element, weight, limit, k)
        late_first = np.argsort(-time, kind="stable")
        out.reshape(-1)[cell[late_first]] = name[late_first]  # the last one written stays: the earliest
        touched = np.zeros(n_texts * k, bool)
        touched[cell] = True
        hit = touched.reshape(n_texts, k).sum(1)
        again = hit[document] < k
        document, element, weight = document[again], element[again], weight[again]
        limit = limit * 2
    return out


def _sketched(counted: bool):
    def make():
        def compute(texts):
            document, element, count = shingles(texts)
            weight = count.astype(float) if counted else np.ones(len(count))
            sign = signatures(document, element, weight, len(texts))
            some = np.bincount(document, minlength=len(texts)) > 0
            grouped = sign[:, :ROWS * BANDS].reshape(len(texts), BANDS, ROWS)
            value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS))
            for r in range(ROWS):
                value = mixed(value + grouped[:, :, r])
            bands = value.view(np.int64)
            sketch = (sign >> np.uint64(56)).astype(np.uint8)
            return [[b.tolist() if s else None for b, s in zip(bands, some)], [k.tobytes() if s else None for k, s in zip(sketch, some)]]

        return compute

    return make


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists with counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(a[1].sum() + b[1].sum() - both, 1)


def _checked(counted: bool):
    """From two texts per row to whether they are similar enough, in whole."""
    def sets(texts):
        document, value, count = shingles(texts)
        cuts = np.searchsorted(document, np.arange(len(texts) + 1))
        count = count if counted else np.ones_like(count)
        return [(value[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 2, HASHED_BYTES):
                left, right = piece.column(2).to_pylist(), piece.column(3).to_pylist()
                once = list(dict.fromkeys(left + right))  # a text meets many others
                held = dict(zip(once, sets(once)))
                near = [similarity(held[x], held[y]) >= SIMILARITY for x, y in zip(left, right)]
                yield piece.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for all ends of ``links`` (a, b), by alternating stars.

    Every pass hangs a node's neighbours on the least one it knows; passes grow
    with the logarithm of a component's width. Each is written to the shared
    folder. At the end all edges lead from a node with one parent to a node with none.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")).where("u > v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"))
        edges = cut_lineage(links.sparkSession, hung.distinct(), "stars")
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        if parents.where("n > 1").isEmpty() and edges.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's nodes with one of them, that with the most company over all its buckets.

    Of an original and its edited copies, which may be near to the original
    only, it is the original.
    """
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "node").select("bucket", F.struct("company", "node").alias("most"))
    centres = ranked.groupBy("bucket").agg(F.max("most").alias("first")).select("bucket", F.col("first.node").alias("centre"))
    pairs = members.join(centres, "bucket").where("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _comparisons(members: DataFrame, classes: DataFrame, signs: DataFrame) -> DataFrame | None:
    """Rows of the second round: the nodes of all buckets with several components, once for each pair of blocks they are in; none if there are no such buckets.

    A pair of blocks is named by ``bucket``, ``kind`` (0: one of the largest
    component with one of the others, 1: two of the others), ``i`` and ``j``;
    ``side`` is the block that the node is of.
    """
    spark = members.sparkSession
    placed = members.where(F.col("size") > ALL_MET).select("node", "bucket").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    placed = cut_lineage(spark, placed.join(several, "bucket").join(signs.select("node", "bytes"), "node"), "open")
    if placed.isEmpty():
        return None
    per_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_BYTES)).cast("int")
    main = F.max(F.struct("n", "bytes", "root"))
    sizes = per_root.groupBy("bucket").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select(
        "bucket", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("n_main"),
        blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("n_rest"))
    both = placed.join(sizes, "bucket").withColumn("is_main", F.col("root") == F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    both = both.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    named = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own, first, second = F.col("block"), F.lit(0), F.lit(1)
    for_main = F.transform(upto("n_rest"), lambda k: named(0, own, k, first))
    for_rest = F.concat(F.transform(upto("n_main"), lambda k: named(0, k, own, second)),
                        F.transform(upto("n_rest"), lambda k: named(1, F.least(k, own), F.greatest(k, own), F.when(own <= k, 0).otherwise(1))))
    return both.select("node", "bucket", "root", F.explode(F.when(F.col("is_main"), for_main).otherwise(for_rest)).alias("t")).select("node", "bucket", "root", "t.*")


class _Sets:
    """Shingles of a group's texts, computed when they are first needed."""

    def __init__(self, texts: list[str], counted: bool):
        self.texts, self.counted, self.held = texts, counted, {}

    def near(self, x: int, y: int) -> bool:
        for i in (x, y):
            if i not in self.held:
                _, value, count = shingles([self.texts[i]])
                self.held[i] = value, count if self.counted else np.ones_like(count)
        return similarity(self.held[x], self.held[y]) >= SIMILARITY


def _spanning(bucket: int, kind: int, same: bool, side: np.ndarray, roots: list[bytes], bands: np.ndarray, sketch: np.ndarray, texts: list[str], counted: bool) -> list[tuple[int, int]]:
    """Links between rows of two blocks that join components, one for each join."""
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    component = np.array([number[r] for r in roots])
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    sets, out = _Sets(texts, counted), []
    left, right = (np.arange(len(roots)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for x in left:
        others = right[right > x] if same else right
        others = others[component[others] != component[x]]
        if not len(others):
            continue
        others = others[(sketch[others] == sketch[x]).mean(1) >= SKETCH_LEAST]
        others = others[(bands[others] == bands[x]).argmax(1) == band]  # else an earlier bucket compares them
        for y in others:
            if component[x] != component[y] and sets.near(x, y):
                out.append((int(x), int(y)))
                component[component == component[y]] = component[x]
    return out


def _compared(counted: bool):
    """From rows ordered by their pair of blocks to the links that join components."""
    names = ["bucket", "kind", "i", "j"]

    def links(group: pa.Table) -> pa.RecordBatch:
        bucket, kind, i, j = (group.column(n)[0].as_py() for n in names)
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        found = _spanning(bucket, kind, kind == 1 and i == j, group.column("side").to_numpy(), group.column("root").to_pylist(), bands, sketch, group.column("text").to_pylist(), counted)
        nodes = group.column("node").to_pylist()
        ends = [[nodes[pair[k]] for pair in found] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], names=["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(n).to_numpy() for n in names], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                mine = tuple(marks[a].tolist())
                if held and mine != key:
                    yield links(pa.Table.from_batches(held))
                    held = []
                key = mine
                held.append(batch.slice(a, b - a))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def near_classes(nodes: DataFrame, texts: DataFrame, counted: bool = False) -> DataFrame:
    """``node`` and ``root`` of all nodes that are near to another one.

    ``nodes``: node, bands, sketch, bytes, one row per node. ``texts``: node, text, any number of equal rows per node.
    """
    spark = nodes.sparkSession
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(spark, members.join(shared, "bucket"), "buckets")
    signs = cut_lineage(spark, nodes.select("node", "bands", "sketch", "bytes").join(members.select("node").distinct(), "node", "left_semi"), "sketches")
    half = lambda end: signs.select(F.col("node").alias(end), F.col("sketch").alias(f"s{end}"))
    close = _candidates(members).join(half("a"), "a").join(half("b"), "b").select("a", "b", "sa", "sb")
    close = cut_lineage(spark, close.mapInArrow(_sifted, "a binary, b binary"), "pairs")
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.where(F.col("size") > ALL_MET).select("node")).distinct()
    # the one shuffle of all texts; the same join at every size
    read = cut_lineage(spark, texts.hint("merge").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    full = close.join(read.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(read.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = cut_lineage(spark, full.select("a", "b", "ta", "tb").mapInArrow(_checked(counted), "a binary, b binary"), "links")
    classes = components(links)
    rows = _comparisons(members, classes, signs)
    if rows is None:
        return classes
    keys = ["bucket", "kind", "i", "j"]
    rows = rows.join(signs.select("node", "bands", "sketch"), "node").join(read, "node").repartition(*keys).sortWithinPartitions(*keys)
    more = cut_lineage(spark, rows.mapInArrow(_compared(counted), "a binary, b binary"), "more")
    if more.isEmpty():
        return classes
    return components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more))


def _sifted(batches):
    """The pairs whose sketches agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
        yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= SKETCH_LEAST))


def _digest(text: str):
    return F.unhex(F.md5(F.col(quoted(text)).cast("string").cast("binary")))


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, node (the text's digest) and root (the least node of its class); both null for a null text."""
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), _digest(text).alias("node"), F.col(quoted(text)).cast("string").alias("text"))
    fields = [T.StructField("bands", T.ArrayType(T.LongType())), field("sketch", "binary")]
    sized = rows.withColumn("bytes", F.octet_length("text").cast("long"))
    signed = cut_lineage(docs.sparkSession, map_texts(sized, ["doc_id", "node", "bytes"], "text", fields, _sketched(counted), HASHED_BYTES), "signatures")
    nodes = signed.where("bands IS NOT NULL").select("node", "bands", "sketch", "bytes").dropDuplicates(["node"])
    classes = near_classes(nodes, rows.select("node", "text"), counted)
    return signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id`` (the least id in its class) and ``class_size`` (rows).

    Equal texts, empty ones included, are one class; a text without words is
    near to equal texts only; a null text is a class of its own. Repeated rows
    count as copies. ``counted`` weighs a shingle by its count instead of 1.
    """
    rows = cut_lineage(docs.sparkSession, rooted(docs, doc_id, text, counted), "rooted")
    sizes = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = rows.join(sizes, "root").select("doc_id", "class_id", "class_size")
    return out.unionByName(rows.where("root IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: bool = False) -> DataFrame:
    """One row of each class with all its columns: the least id (null last), then the least digest; one of rows equal in both. Null texts stay."""
    rows = rooted(docs, doc_id, text, counted).where("root IS NOT NULL")
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("least"))
    best = cut_lineage(docs.sparkSession, least.select(F.col("least.doc_id").alias("__id"), F.col("least.node").alias("__at")), "kept")
    marked = docs.withColumn("__node", _digest(text))
    kept = marked.join(best, (F.col("__node") == F.col("__at")) & F.col(quoted(doc_id)).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["__node", doc_id])
    return kept.drop("__node").unionByName(docs.where(F.col(quoted(text)).isNull()))
