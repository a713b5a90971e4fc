"""Host-level quality rules with rates shrunk by an empirical beta prior.

Each document is measured in one scan. Rule failures are summed per host, so
only hosts x rules rows are left; a beta prior fitted to all hosts by moments
pulls the rate of a host with few documents towards the common rate. A host
whose shrunk rate of a rule lies above the pooled rate by more than its posterior
error allows is condemned for that rule, and the verdict goes back to its
documents: those that fail the rule themselves are rejected. A document that
fails no rule is kept, whatever its host. With a fixed ``limit`` a host is
condemned if the shrunk rate of any rule reaches it, and loses its documents
that fail any rule.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import field, map_texts, quoted
from rxweave.session import cut_lineage

WORD_SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Without a fixed limit: posterior standard errors by which a host's shrunk rate must exceed the pooled rate.
HOST_ERRORS = 2.0

#: The prior counts as at least this many documents, so that a host's first one does not decide alone.
LEAST_STRENGTH = 5.0

#: A host list of at most this many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_HOSTS = 100_000

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rule name and the condition of failing it, over the measures, in whole numbers.
RULES = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}


def repeated_words(words: list) -> int:
    """Words inside windows of five that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i:i + n] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """The MEASURES of one text; zeros for null and empty ones."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(WORD_SPACE)]
    spaces = len(data) - len(data.translate(None, WORD_SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measures():
    return lambda texts: list(zip(*map(measure, texts))) if texts else [[] for _ in MEASURES]


def measure_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document with the ``keep`` columns and its measures and failed rules."""
    out = map_texts(docs, keep, text, [field(m, "long") for m in MEASURES], _measures)
    return out.withColumns({f"{r}_failed": F.expr(condition) for r, condition in RULES.items()})


def host_verdicts(measured: DataFrame, host: str = "source", limit: float | None = None) -> DataFrame:
    """Per host (null is a host of its own): documents, and per rule failures, shrunk rate and whether it is ``bad``, and ``condemned``.

    Prior of a rule: with the pooled rate m over all documents and the
    document-weighted variance v of host rates, less what chance alone gives,
    the strength is m(1-m)/v - 1, kept between LEAST_STRENGTH and 1e6.
    """
    per_host = measured.groupBy(F.col(quoted(host)).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_failures") for r in RULES])
    totals = per_host.agg(
        F.sum("n_docs").alias("docs"), F.count("*").alias("hosts"), *[F.sum(f"{r}_failures").alias(f"{r}_k") for r in RULES],
        *[F.sum(F.col(f"{r}_failures") * F.col(f"{r}_failures") / F.col("n_docs")).alias(f"{r}_kk") for r in RULES]).collect()[0]
    shrunk, bad = [], []
    for rule in RULES:
        docs = totals["docs"] or 1
        mean = (totals[f"{rule}_k"] or 0) / docs
        spread = (totals[f"{rule}_kk"] or 0) / docs - mean * mean - mean * (1 - mean) * totals["hosts"] / docs
        strength = min(max(mean * (1 - mean) / spread - 1, LEAST_STRENGTH), 1e6) if spread > 0 else 1e6
        shrunk.append(((F.col(f"{rule}_failures") + mean * strength) / (F.col("n_docs") + strength)).alias(f"{rule}_rate"))
        rate = F.col(f"{rule}_rate")
        error = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + strength + 1))
        bad.append((rate - HOST_ERRORS * error > mean if limit is None else rate >= limit).alias(f"{rule}_bad"))
    rated = per_host.select("*", *shrunk).select("*", *bad)
    return rated.withColumn("condemned", F.expr(" OR ".join(f"{r}_bad" for r in RULES)))


def _judged(measured: DataFrame, hosts: DataFrame, host: str, limit: float | None) -> DataFrame:
    """Adds ``kept``. The list of condemned hosts is broadcast only within its bound."""
    verdicts = [F.col(f"{r}_bad").alias(f"__{r}") for r in RULES]
    bad = cut_lineage(hosts.sparkSession, hosts.where("condemned").select(F.col("host").alias("__host"), *verdicts), "hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = measured.join(bad.withColumn("__bad", F.lit(True)), F.col(quoted(host)).eqNullSafe(F.col("__host")), "left")
    if limit is None:
        rejected = " OR ".join(f"(coalesce(__{r}, false) AND {r}_failed)" for r in RULES)
    else:
        rejected = f"coalesce(__bad, false) AND ({' OR '.join(f'{r}_failed' for r in RULES)})"
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND NOT ({rejected})")).drop("__host", "__bad", *[f"__{r}" for r in RULES])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float | None = None) -> DataFrame:
    """One row per document: id, host, measures, failed rules and ``kept``.

    Null and empty texts have no words and fail the base rule; repeated rows
    give one row each; an empty table gives no rows; other columns are ignored.
    """
    chosen = docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(host)).alias("__at"), F.col(quoted(text)).alias("__in"))
    measured = cut_lineage(docs.sparkSession, measure_documents(chosen, ["__id", "__at"], "__in"), "measures")
    out = _judged(measured, host_verdicts(measured, "__at", limit), "__at", limit)
    return out.withColumnsRenamed({"__id": "doc_id", "__at": "host"})


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns and no shuffle of texts while the list of condemned hosts is within its bound."""
    packed = docs.select(F.struct("*").alias("__row"), F.col(quoted(host)).alias("__at"), F.col(quoted(text)).alias("__in"))
    hosts = host_verdicts(measure_documents(packed, ["__at"], "__in"), "__at", limit)
    judged = _judged(measure_documents(packed, ["__row", "__at"], "__in"), hosts, "__at", limit)
    return judged.where("kept").select("__row.*")
