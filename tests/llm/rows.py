"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows and ids, columns with clashing names."""

import random

WORDS = "the of river stone light over under green house morning water paper seven road winter small garden window letter music".split()

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, score double, label int, "
          "key long, tie long, bands string, node string, root string, kept boolean, host string, n_tokens long")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("" if r.random() < 0.8 else r.choice([",", ".", "\n", "ß"])) for _ in range(n))


def texts() -> list:
    one = prose(1, 120)
    words = one.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [(1, one), (2, near), (3, one), (4, prose(4, 200)), (5, None), (6, ""), (7, " \n "), (8, "short text"), (9, prose(9, 4000)), (10, "x" * 60000), (None, prose(11, 50)),
            (12, prose(12, 80)), (12, prose(12, 80)), (13, prose(13, 80)), (13, prose(14, 80)), (15, "der " * 300), (16, "é ü 中 😀 " * 20), (17, "a@b.co +1 (017) 555-7713 token = abcdefgh12345678")]


def frame(spark, rows=None):
    data = [(i, t, "en", f"s{(i or 0) % 3}", None, 7, "no", 0.5, 1, 3, 4, "b", "n", "r", False, "h", 9) for i, t in (texts() if rows is None else rows)]
    return spark.createDataFrame(data, SCHEMA)


def by_id(df) -> dict:
    """Rows by id; several under one id in order."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
