"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is trained from confirmed toxic texts and unlabelled
ones. With the class prior p, the risk of calling unlabelled text toxic is
counted on the unlabelled sample and corrected by what its hidden toxic share
would add; an estimate below zero counts as zero, which keeps the classifier
from memorising the positives. The weights are the mean of the later steps.

Features are the distinct words of a text and their first bytes, hashed. Both
samples are bounded; whole texts are read; scoring is one scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import field, map_texts, quoted
from rxweave.llm.wordhash import Words

#: Bounds of the two training samples, in texts.
POSITIVES = 4_000
UNLABELLED = 8_000

#: Hashed feature space.
DIMENSIONS = 1 << 20

#: Features of a word: itself and its first bytes.
PREFIXES = (4, 5, 6)

#: A feature must occur in so many sample texts of the positives to be used.
LEAST_TEXTS = 5

STEPS = 200
RATE = 0.05
RIDGE = 2e-3
SCALE = 20.0

#: Bytes of text hashed at once.
HASHED_BYTES = 2 << 20


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text, one after another, and how many each has."""
    words = Words(texts)
    keys = [words.hash] + [words.prefix(n)[words.size > n] for n in PREFIXES]
    documents = [words.document] + [words.document[words.size > n] for n in PREFIXES]
    kinds = np.repeat(np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), [len(k) for k in keys])
    feature = (np.concatenate(keys) + kinds) % np.uint64(DIMENSIONS)
    both = np.unique(np.concatenate(documents).astype(np.uint64) * np.uint64(DIMENSIONS) + feature)
    counts = np.bincount((both // np.uint64(DIMENSIONS)).astype(np.int64), minlength=len(texts))
    return (both % np.uint64(DIMENSIONS)).astype(np.uint32), counts


def summed(weights: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of a text's feature weights, scaled down by the root of their number."""
    total = np.concatenate([[0.0], np.cumsum(weights[feature], dtype=np.float64)])
    ends = np.cumsum(counts)
    return SCALE * (total[ends] - total[ends - counts]) / np.sqrt(np.maximum(counts, 1))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and offset that lower the non-negative risk, by Adam steps on the whole sample with the logistic loss."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return np.zeros(DIMENSIONS, np.float32), float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6))))
    rows = positive + unlabelled
    feature, counts = np.concatenate(rows), np.array([len(r) for r in rows])
    seen = np.bincount(np.concatenate(positive), minlength=DIMENSIONS) >= LEAST_TEXTS
    number = np.cumsum(seen) - 1
    used = seen[feature]
    text = np.repeat(np.arange(len(rows)), counts)[used]
    column = number[feature[used]]
    scale = SCALE / np.sqrt(np.maximum(counts, 1))
    n, first, m = len(positive), np.arange(len(rows)) < len(positive), int(seen.sum())
    weights = np.zeros(m + 1)  # the last one is the offset
    weights[m] = np.log(prior / (1 - prior))
    slow, square, mean = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(text, weights[column], len(rows)) * scale + weights[m]
        chance = 1 / (1 + np.exp(-score))
        loss_negative = np.logaddexp(0, score)
        negative = loss_negative[~first].mean() - prior * loss_negative[first].mean()
        slope = np.where(first, -prior * (1 - chance) / n, 0)  # of the risk on the positives
        if negative >= 0:
            slope = slope + np.where(first, -prior * chance / n, chance / (len(rows) - n))
        grown = np.append(np.bincount(column, (slope * scale)[text], m), slope.sum())
        grown[:m] += RIDGE * weights[:m]
        slow += 0.1 * (grown - slow)
        square += 0.001 * (grown * grown - square)
        weights -= RATE / (1 + step / 50) * (slow / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        if step > STEPS // 2:
            mean += weights / (STEPS - STEPS // 2)
    out = np.zeros(DIMENSIONS, np.float32)
    out[seen] = mean[:m]
    return out, float(mean[m])


def held_out(doc_id: str):
    """Whether crc32 of the id as text leaves no remainder by 5; false for null."""
    return F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(texts: DataFrame) -> list[np.ndarray]:
    """The feature vectors of a bounded sample, in the order of its keys."""
    def make():
        def packed(batch):
            feature, counts = features(batch)
            ends = np.cumsum(counts)
            return [[feature[a:b].tobytes() for a, b in zip(ends - counts, ends)]]

        return packed

    rows = map_texts(texts, ["key"], "text", [field("features", "binary")], make).collect()
    return [np.frombuffer(r["features"], np.uint32) for r in sorted(rows, key=lambda r: (r["key"], r["features"]))]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Weights from the rows that are not held out.

    The positives are those with the smallest hashes of their ids, the
    unlabelled texts (whatever their label) the distinct ones with the smallest
    hashes. The prior is the toxic share of the labelled rows. A document with
    several labels is toxic if one of them is.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("y")).where(~held_out("id") & F.col("id").isNotNull() & F.col("y").isNotNull())
             .groupBy("id").agg(F.max("y").alias("y")))
    share = known.agg(F.avg(F.col("y").cast("double"))).collect()[0][0] or 0.0
    chosen = [r["id"] for r in known.where("y = 1").select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(positives).collect()]
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).cast("string").alias("text")).where(~held_out("id") & F.col("text").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("text"))
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "id " + known.schema["id"].dataType.simpleString()))
    toxic = rows.join(ids, "id", "left_semi")
    keys = [r["key"] for r in rows.select("key").distinct().orderBy("key").limit(unlabelled).collect()]
    plain = rows.join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "key long")), "key", "left_semi").dropDuplicates(["key"])
    return train(_vectors(toxic.dropDuplicates(["key"]).select("key", "text")), _vectors(plain.select("key", "text")), float(share))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out``, ``score`` and ``predicted``.

    A null or empty text has no features and gets the score of the offset; with
    no positive example every score is the prior. Only the text enters a score.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))

    def make():
        weights, offset = shipped.value

        def scores(texts):
            return [(1 / (1 + np.exp(-np.clip(summed(weights, *features(texts)) + offset, -700, 700)))).tolist()]

        return scores

    out = map_texts(docs, [doc_id], text, [field("score", "double")], make, HASHED_BYTES)
    return out.select(F.col(quoted(doc_id)), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
