"""Personal data: base patterns, and a skip-chain conditional random field over tokens.

Nodes of a document's graph are its tokens with a digit or an at sign; no other
token can carry a label. Chain edges join neighbouring nodes. Skip edges join
all tokens of a document that are equal or similar, or similar to the same token
(same letters and digits, same last digits, same address, same mailbox name),
through one node without a token, their hub, so any two of m repeats are two
edges apart and there are m edges. A number written in groups of digits is as a whole similar to another
form of it: each of its tokens is joined with that. A hub has the label that most
base spans among its tokens give. Otherwise (no base span, or two kinds level) it
is free, and agreement with it weighs the same for every label, so that repeats
alone make no token personal. Loopy message passing makes the labels of linked tokens consistent: a
number written in full once is found again wherever it is shortened.

Weights are learned by pseudo-likelihood on a bounded sample. Targets are the
tokens whose labels the base patterns decide; a token outside the base spans that
is similar to one inside is hidden, and no target. Skip weights are learned from
base spans whose label is hidden: each is shortened so that no pattern finds it, once linked
to the full form (label: its kind) and once by itself (label: other). All
documents of a piece of text are one graph of separate parts, so message passing
is a few array operations.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.llm.common import field, map_texts, quoted, replace_texts, sha256_hex

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

#: Bounds of the training sample.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_TOKENS = 40_000

#: Rounds with half steps that a component has besides two per node. Then steps shrink, so that messages that swing settle too.
ROUNDS = 100
SHRINK = 0.9

#: A component is done when none of its messages moves by more; its result does not depend on what else is in the graph.
SETTLED = 1e-8

#: What skip weights of kinds without a base span in the sample stay at, and how weakly the others are drawn to it.
SKIP_PRIOR = 4.0
SKIP_RIDGE = 1e-4

#: Score of a label that a base span gives.
GIVEN = 30.0

#: Marginal probability from which a token outside the base spans is reported.
CERTAIN = 0.6

MAILBOX = re.compile(r"[A-Za-z0-9._%+-]*$")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[._-][0-9]{1,3}){3}(?![0-9])")
GROUP = re.compile(r"[0-9+().,-]+")
NODE_CHARACTER = re.compile("[0-9@]").search
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, found from the at signs so that a long run of letters costs no more than its length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        start = at
        while domain and start > free and text[start - 1] in LOCAL:
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple]:
    found = [("email", *s) for s in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


# The graph ------------------------------------------------------------------------------------------------------------

FEATURES = ("always", "at", "at_dot", "dots3", "plus", "bracket", "dash", "letters", "symbols", "digits1_3", "digits4_6", "digits7_8", "digits9_12",
            "digits13_19", "digits20", "luhn", "after_plus", "after_bracket", "quads", "percent", "slash_or_colon")


def features_of(token: str, before: str) -> list[bool]:
    digits = re.sub("[^0-9]", "", token)
    n = len(digits)
    return [True, "@" in token, "@" in token and "." in token.rpartition("@")[2].rstrip("."), token.rstrip(".,").count(".") == 3, token.startswith("+"), "(" in token or ")" in token,
            "-" in token, any(c.isalpha() for c in token), any(c in "#$&*|=_" for c in token), 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12,
            13 <= n <= 19, n >= 20, 13 <= n <= 19 and luhn(digits), before.startswith("+"), before.startswith("("), len(token) == 4 == n, "%" in token,
            "/" in token or ":" in token]


def keys_of(token: str) -> list[tuple]:
    """What makes tokens equal or similar; tokens with little in them have no key."""
    plain = re.sub(r"[\W_]", "", token).lower()
    digits = re.sub("[^0-9]", "", token)
    keys = [("same", plain)] if len(plain) >= 6 else []
    if len(digits) >= 7:
        keys.append(("digits", digits[-7:]))
    address = ADDRESS.search(token)
    if address:
        keys.append(("ip", re.sub("[_-]", ".", address.group())))
    if "@" in token:
        name = MAILBOX.search(token[:token.index("@")]).group().lower()
        if len(name) >= 4:
            keys.append(("mailbox", name))
    return keys


def grouped_keys(text: str, nodes: list[tuple[int, int]], base: list[tuple]) -> list[list[tuple]]:
    """Per node the keys of the numbers that it is a part of: base spans and runs of neighbouring tokens of digits, each with its number."""
    out: list[list[tuple]] = [[] for _ in nodes]
    groups, starts = [], [a for a, _ in nodes]
    for kind, start, end in base:
        if kind in ("card", "phone"):
            first = bisect.bisect_right(starts, start) - 1
            groups.append((max(first, 0), bisect.bisect_left(starts, end), text[start:end]))
    first = 0
    plain = [bool(GROUP.fullmatch(text, a, b)) for a, b in nodes]
    for i in range(1, len(nodes) + 1):
        if i == len(nodes) or not plain[i] or not plain[i - 1] or nodes[i][0] - nodes[i - 1][1] > 2 or not text[nodes[i - 1][1]:nodes[i][0]].isspace():
            if i - first > 1:
                groups.append((first, i, text[nodes[first][0]:nodes[i - 1][1]]))
            first = i
    for number, (first, end, part) in enumerate(groups):
        digits = re.sub("[^0-9]", "", part)
        if end - first > 1 and 7 <= len(digits) <= 19:  # no phone or card is longer
            for i in range(first, end):
                out[i].append((number, ("digits", digits[-7:])))
    return out


def shortened(kind: str, span: str) -> str:
    """A base span in a form that its pattern does not find, as one token."""
    if kind == "email":
        name, _, domain = span.partition("@")
        return f"{name}@{domain.partition('.')[0]}"
    if kind == "ip":
        return span.replace(".", "-")
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        return ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"


class Graph:
    """Tokens, features, hubs and edges of some texts; ``base`` are their base spans, found here if not given.

    Nodes are the tokens and then ``n_hubs`` hubs. A skip edge goes from a token to a hub.
    """

    def __init__(self, texts: list[str], base: list[list[tuple]] | None = None):
        self.spans, self.document, self.n_hubs = [], [], 0
        rows, chain, skip = [], [], []
        for d, text in enumerate(texts):
            if not NODE_CHARACTER(text):
                continue
            last, first, above, numbers = None, {}, {}, {}

            def top(x: int) -> int:
                while above[x] != x:
                    above[x] = x = above[above[x]]
                return x

            nodes = [m.span() for m in NODE.finditer(text)]
            grouped = grouped_keys(text, nodes, base_spans(text) if base is None else base[d])
            for (start, end), groups in zip(nodes, grouped):
                node, token = len(self.spans), text[start:end]
                near = last is not None and text[last:start].isspace() and start - last <= 2
                rows.append(features_of(token, text[self.spans[-1][0]:last] if near else ""))
                if near:
                    chain.append((node - 1, node, 0))
                above[node] = node
                for key in [*keys_of(token), *(key for _, key in groups)]:
                    above[top(node)] = top(first.setdefault(key, node))
                numbers[node] = groups[0][0] if groups else None
                self.spans.append((start, end))
                self.document.append(d)
                last = end
            members: dict[int, list] = {}
            for node in above:
                members.setdefault(top(node), []).append(node)
            for held in members.values():
                # the tokens of one number are one occurrence
                if len({(node, None) if numbers[node] is None else (None, numbers[node]) for node in held}) > 1:
                    skip += [(node, self.n_hubs) for node in held]
                    self.n_hubs += 1
        self.features = np.array(rows, float).reshape(-1, len(FEATURES))
        self.edges = np.array(chain + [(node, len(self.spans) + hub, 1) for node, hub in skip], np.int64).reshape(-1, 3)

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Per node the number of its component, and the nodes in each."""
        above = list(range(len(self.spans) + self.n_hubs))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for a, b, _ in self.edges.tolist():
            above[top(b)] = top(a)
        _, component, sizes = np.unique([top(x) for x in range(len(above))], return_inverse=True, return_counts=True)
        return component, sizes

    def labels(self, spans: list[list[tuple]]) -> np.ndarray:
        """The kind of the base span that covers most of a token, the first such kind, or other.

        Spans of one kind don't overlap, so one pass per kind over tokens and spans finds all that meet.
        """
        out, most = np.zeros(len(self.spans), np.int64), [0] * len(self.spans)
        for label, kind in enumerate(KINDS, 1):
            found = [(d, a, b) for d, own in enumerate(spans) for a, b in sorted((a, b) for k, a, b in own if k == kind)]
            at = 0
            for i, ((start, end), d) in enumerate(zip(self.spans, self.document)):
                while at < len(found) and (found[at][0], found[at][2]) <= (d, start):
                    at += 1
                j = at
                while j < len(found) and found[j][0] == d and found[j][1] < end:
                    cover = min(end, found[j][2]) - max(start, found[j][1])
                    if cover > most[i]:
                        out[i], most[i] = label, cover
                    j += 1
        return out

    def hub_counts(self, labels: np.ndarray) -> np.ndarray:
        """Per hub, how many of its tokens have each label."""
        counts = np.zeros((self.n_hubs, len(LABELS)))
        skip = self.edges[self.edges[:, 2] == 1]
        np.add.at(counts, (skip[:, 1] - len(self.spans), labels[skip[:, 0]]), 1)
        return counts

    def neighbours(self, labels: np.ndarray) -> np.ndarray:
        """Per token, how many neighbours of each sort (chain before, chain after, hub) have each label; a hub's label is that of its other tokens."""
        sorts, n = 3, len(LABELS)
        out = np.zeros((len(labels), sorts * n))
        a, b, _ = self.edges[self.edges[:, 2] == 0].T
        np.add.at(out, (b, labels[a]), 1)
        np.add.at(out, (a, n + labels[b]), 1)
        token, hub, _ = self.edges[self.edges[:, 2] == 1].T
        others = self.hub_counts(labels)[hub - len(self.spans)]
        others[np.arange(len(token)), labels[token]] -= 1
        np.add.at(out, (token, 2 * n + majority(others)), 1)
        return out


def majority(counts: np.ndarray) -> np.ndarray:
    """The most frequent kind of each row; 0 if there is none or two are level."""
    kinds = counts[:, 1:]
    most = kinds.max(1, initial=0)
    clear = (most > 0) & ((kinds == most[:, None]).sum(1) == 1)
    return np.where(clear, kinds.argmax(1) + 1, 0)


def marginals(graph: Graph, weights: dict[str, np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of all tokens by sum-product message passing with damping; labels above zero in ``known`` are given, and so are those of their hubs."""
    n, tokens = len(LABELS), len(graph.spans)
    unary = np.concatenate([graph.features @ weights["unary"], np.zeros((graph.n_hubs, n))])
    free = np.ones(len(unary), bool)
    if known is not None:
        known = np.concatenate([known, majority(graph.hub_counts(known))])
        free = known == 0
        given = np.flatnonzero(known)
        unary[given] = np.where(np.arange(n) == known[given, None], GIVEN, 0.0)
    if len(graph.edges):
        a, b, skip = graph.edges.T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        same, level = np.diag(weights["skip"]), np.eye(n) * weights["skip"][0]
        forward = np.where(skip[:, None, None] == 0, weights["chain"], np.where(free[b, None, None], level, same))
        pair = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), n))
        component, sizes = graph.components()
        of = component[source]
        active, turn = np.arange(len(source)), 0
        while len(active):
            total = unary.copy()
            np.add.at(total, target[active], message[active])
            # what is given is not moved by any number of neighbours
            own = np.where(free[source[active], None], total[source[active]] - message[back[active]], unary[source[active]])
            out = own[:, :, None] + pair[active]
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None]).sum(1))
            step = 0.5 * SHRINK ** np.maximum(turn - ROUNDS - 2 * sizes[of[active]], 0)
            move = step[:, None] * (out - out.max(1, keepdims=True) - message[active])
            message[active] += move
            moving = np.zeros(len(sizes), bool)
            moving[of[active][np.abs(move).max(1) > SETTLED]] = True
            active, turn = active[moving[of[active]]], turn + 1
        np.add.at(unary, target, message)
    odds = np.exp(unary[:tokens] - unary[:tokens].max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def train(features: np.ndarray, neighbours: np.ndarray, labels: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights that make each label likely given its token and its neighbours' labels (pseudo-likelihood, Adam steps).

    A chain weight is shared by both directions; a skip weight is one number
    per label for agreement and is kept at least zero.
    """
    k, n = len(LABELS), len(labels)
    unary, chain, skip = np.zeros((len(FEATURES), k)), np.zeros((k, k)), np.full(k, SKIP_PRIOR)
    if not n:
        unary[0, 0] = 5.0
        return {"unary": unary, "chain": chain, "skip": skip}
    before, after, linked = neighbours[:, :k], neighbours[:, k:2 * k], neighbours[:, 2 * k:]
    truth = np.eye(k)[labels]
    parts = [unary, chain, skip]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        score = features @ unary + before @ chain + after @ chain.T + linked * skip
        p = np.exp(score - score.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) / n
        slopes = [features.T @ error, before.T @ error + error.T @ after, (linked * error).sum(0) + SKIP_RIDGE * (skip - SKIP_PRIOR)]
        for part, slope, m, v in zip(parts, slopes, first, second):
            slope = slope + ridge * part if part is not skip else slope
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            part -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        np.maximum(skip, 0, out=skip)
    return {"unary": unary, "chain": chain, "skip": skip}


def fit(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS, tokens: int = SAMPLE_TOKENS) -> dict[str, np.ndarray]:
    """Weights from at most ``documents`` texts with a node, the distinct ones with the smallest hashes, and ``tokens`` of their tokens."""
    rows = docs.select(F.col(quoted(text)).cast("string").alias("text")).where("text RLIKE '[0-9@]'").withColumn("order", F.xxhash64("text"))
    keys = [(r["order"],) for r in rows.select("order").distinct().orderBy("order").limit(documents).collect()]
    sample = rows.join(F.broadcast(docs.sparkSession.createDataFrame(keys, "order long")), "order", "left_semi").dropDuplicates(["order"])
    names = ["order", "features", "neighbours", "label"]
    tagged = sample.select("text").mapInPandas(_training_rows, "order string, features string, neighbours array<long>, label int")
    held = tagged.orderBy(*names).limit(tokens).collect()
    features = np.array([[c == "1" for c in r["features"]] for r in held], float).reshape(-1, len(FEATURES))
    neighbours = np.array([r["neighbours"] for r in held], float).reshape(-1, 3 * len(LABELS))
    return train(features, neighbours, np.array([r["label"] for r in held], np.int64))


def _training_rows(frames):
    import pandas as pd

    for frame in frames:
        texts = frame["text"].tolist()
        base = [base_spans(t) for t in texts]
        graph = Graph(texts, base)
        labels = graph.labels(base)
        near = graph.neighbours(labels).astype(int)
        hidden = (labels == 0) & (near[:, 2 * len(LABELS) + 1:].sum(1) > 0)
        rows = [(texts[d][a:b], graph.features[i], near[i].tolist(), labels[i]) for i, ((a, b), d) in enumerate(zip(graph.spans, graph.document)) if not hidden[i]]
        for text, spans in zip(texts, base):
            for kind, start, end in spans:
                short, label = shortened(kind, text[start:end]), LABELS.index(kind)
                features, alone = features_of(short, ""), [0] * (3 * len(LABELS))
                linked = [*alone[:2 * len(LABELS)], *(int(k == kind) for k in LABELS)]
                rows += [(short, features, linked, label), (short, features, alone, 0)]
        yield pd.DataFrame({"order": [sha256_hex(r[0]) for r in rows], "features": ["".join(str(int(x)) for x in r[1]) for r in rows],
                            "neighbours": [r[2] for r in rows], "label": np.array([r[3] for r in rows], np.int32)})


# Scanning -------------------------------------------------------------------------------------------------------------

FIELDS = [*(field(f"n_{k}", "long") for k in KINDS), field("base_sha256", "string"), field("spans", "string"), field("n_added", "long")]


def written(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A token's span without marks at its ends that are no part of a number or address."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def find_spans(texts: list[str], weights: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """The base spans and the added spans of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    graph = Graph(texts, base)
    if graph.spans:
        taken = graph.labels(base)
        chances = marginals(graph, weights, taken)
        label = chances.argmax(1)
        for i in np.flatnonzero((label > 0) & (chances.max(1) >= CERTAIN) & (taken == 0)):
            d = graph.document[i]
            start, end = trimmed(texts[d], *graph.spans[i])
            if start < end:
                added[d].append((LABELS[label[i]], start, end))
    return list(zip(base, added))


def find_personal_data(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, counts, digest and spans.

    Null and empty texts have none; repeated rows give one row each; an empty
    table gives no rows; other columns are ignored. One scan besides the sample
    for the weights, no shuffle.
    """
    weights = fit(docs, text) if weights is None else weights

    def make():
        def scan(texts):
            out = []
            for base, added in find_spans([t or "" for t in texts], weights):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*counts, sha256_hex(written(base)), written(base + added), len(added)))
            return list(zip(*out))

        return scan

    return map_texts(docs, [doc_id], text, FIELDS, make)


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span, or union of spans that meet, as the name of its first kind in brackets."""
    out, done, name = [], 0, ""
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start < done:
            done = max(done, end)
            continue
        out += [name, text[done:start]]
        name, done = f"[{kind.upper()}]", end
    return "".join([*out, name, text[done:]])


def mask_personal_data(docs: DataFrame, weights: dict | None = None, text: str = "text") -> DataFrame:
    """All rows and columns with personal data in the texts replaced; nulls stay."""
    weights = fit(docs, text) if weights is None else weights

    def make():
        def replace(texts):
            spans = find_spans([t or "" for t in texts], weights)
            return [t if t is None else masked(t, base + added) for t, (base, added) in zip(texts, spans)]

        return replace

    return replace_texts(docs, text, make)
