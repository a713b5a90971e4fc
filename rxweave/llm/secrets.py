"""Secret scan: base patterns, and guess costs of values in credential contexts.

The cost of a value is the cheapest way to put it together from known parts,
found by dynamic programming over its positions: common words, words of the
same text, dates, repeats, keyboard walks and sequences, and brute-force spans.
A value whose cost reaches the limit can't be guessed and is reported as a
secret; ``password = changeme2024`` is cheap and is not.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from rxweave.llm.common import field, map_texts, sha256_hex

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of 32 and more; shorter runs would be dropped anyway.
HEX = re.compile(r"[0-9a-f]{32,}")

#: A value of six characters or more after a credential word; quoted values may hold spaces.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|credentials?|auth)["']?\x20*(?:[:=]|=>)\x20*"""
    r"""(?:"(?P<double>[^"\n]{6,})"|'(?P<single>[^'\n]{6,})'|(?P<bare>[^\s"'<>]{6,}))""", re.I | re.A)

#: Guesses, as a power of ten, from which a value counts as a secret.
COST_LIMIT = 10.0

#: What every further part adds: a guesser must also find where parts meet.
PART_COST = 0.3

#: Brute force, as a power of ten per character, by kind of character.
CHARACTER_COST = {"lower": 0.7, "other": 1.0}

#: Common words of passwords, most usual first; a word's place is its guess rank.
COMMON_WORDS = """password secret admin test user login welcome changeme default example sample token root letmein dragon monkey master
hello shadow qwerty iloveyou sunshine princess football baseball superman batman trustno freedom whatever computer internet service
server database public private demo dummy placeholder insert replace your this value here none null true false temp guest access key
pass word summer winter spring autumn january february march april june july august september october november december monday tuesday
wednesday thursday friday saturday sunday love money company office google apple""".split()

KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
KEYS = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}

DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,16}?)\1+", re.S)
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_WORD = 24


def word_ranks(text: str) -> dict[str, int]:
    """Common words first, then the lower-case words of the text itself, one rank for all of them."""
    own = {w for w in text.split() if w.isalpha() and w.islower() and 3 <= len(w) <= LONGEST_WORD}
    ranks = dict.fromkeys(own, len(COMMON_WORDS) + len(own))
    return ranks | {w: i + 1 for i, w in enumerate(COMMON_WORDS)}


def walks(value: str):
    """Maximal runs of three and more neighbours on the keyboard or in character order: start, end, turns."""
    start, step, turns = 0, None, 0
    low = value.lower()
    for i in range(1, len(low) + 1):
        now = None
        if i < len(low):
            a, b = low[i - 1], low[i]
            if a in KEYS and b in KEYS and a != b:
                (r, c), (s, d) = KEYS[a], KEYS[b]
                now = ("key", s - r, d - c) if abs(s - r) <= 1 and abs(d - c) <= 1 else None
            if now is None and a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
                now = ("order", ord(b) - ord(a), 0)
        if now is None:
            if i - start >= 3:
                yield start, i, turns
            start, step, turns = i, None, 0
        else:
            turns += step is not None and now != step
            step = now


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """The cheapest segmentation of a value, as a power of ten of guesses."""
    ranks = word_ranks("") if ranks is None else ranks
    n, low = len(value), value.lower()
    ending: list[list] = [[] for _ in range(n + 1)]  # parts by their end: start, cost
    for m in DATE.finditer(value):
        ending[m.end()].append((m.start(), math.log10(365 * 120)))
    for m in YEAR.finditer(value):
        ending[m.end()].append((m.start(), math.log10(120)))
    for a, b, turns in walks(value):
        ending[b].append((a, math.log10(40 * (b - a)) + turns * math.log10(6)))
    for m in REPEAT.finditer(value):
        block = m.group(1)
        ending[m.end()].append((m.start(), brute_cost(block) + math.log10((m.end() - m.start()) // len(block))))
    for m in LETTERS.finditer(value):
        for i in range(m.start(), m.end()):
            for j in range(i + 3, min(m.end(), i + LONGEST_WORD) + 1):
                rank = ranks.get(low[i:j])
                if rank:
                    cased = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i + 1:j] == low[i + 1:j] or value[i:j].isupper() else 1.0
                    ending[j].append((i, math.log10(rank + 1) + cased))
    best = [0.0] * (n + 1)
    brute = [0.0] + [math.inf] * n  # the cheapest way whose last part is a brute-force span
    for j in range(1, n + 1):
        each = CHARACTER_COST["lower" if "a" <= value[j - 1] <= "z" else "other"]
        brute[j] = min(brute[j - 1] + each if j > 1 else math.inf, best[j - 1] + each + PART_COST)
        best[j] = min([brute[j], *(best[i] + cost + PART_COST for i, cost in ending[j])])
    return best[n]


def brute_cost(block: str) -> float:
    return sum(CHARACTER_COST["lower" if "a" <= c <= "z" else "other"] for c in block)


def base_spans(text: str) -> list[tuple]:
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def costly_values(text: str, limit: float = COST_LIMIT) -> list[tuple]:
    """Start, end and cost of the values in credential contexts that can't be guessed."""
    found, values = [], list(CONTEXT.finditer(text))
    # a value is no word of the text: else it would be guessed from itself
    ends = [0, *(x for m in values for x in m.span(m.lastgroup)), len(text)]
    ranks = word_ranks(" ".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))) if values else None
    for m in values:
        start, end = m.span(m.lastgroup)
        cost = guess_cost(text[start:end], ranks)
        if cost >= limit:
            found.append((start, end, cost))
    return found


KINDS = ("assign", "access", "hex", "guess")
FIELDS = [field("n_assign", "long"), field("n_access", "long"), field("n_hex", "long"), field("base_sha256", "string"), field("spans", "string"),
          field("n_guess", "long"), field("max_cost", "double")]


def written(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan_text(text: str | None, limit: float = COST_LIMIT) -> tuple:
    base = base_spans(text) if text else []
    costly = costly_values(text, limit) if text else []
    counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    return *counts, sha256_hex(written(base)), written(base + [("guess", a, b) for a, b, _ in costly]), len(costly), max((c for *_, c in costly), default=0.0)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = COST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: its id, counts, digest and spans of secrets.

    Null and empty texts have none; repeated rows give one row each; an empty
    table gives no rows; other columns are ignored. One scan, no shuffle.
    """
    return map_texts(docs, [doc_id], text, FIELDS, lambda: lambda texts: list(zip(*(scan_text(t, limit) for t in texts))))
