"""Small tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"
WORDS = "the of and a to in is it that was he for on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, path, rows, extra="component_id"):
    """documents.parquet from (doc_id, text[, lang, source]), with an extra column of a clashing name."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None, "x") for r in rows]
    spark.createDataFrame(full, SCHEMA.format(extra=extra)).write.parquet(f"{path}/documents.parquet")
    return str(path)


def some_rows(seed=1, n=60):
    """Prose with exact and near copies, a repeated passage, null, empty and long texts and a repeated row."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(n)]
    passage = prose(rng, 90)
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    rows += [(200 + i, rows[10][1] + " " + prose(rng, 1)) for i in range(12)]
    rows += [(300 + i, prose(rng, rng.randint(0, 30)) + " " + passage + " " + prose(rng, rng.randint(0, 30))) for i in range(15)]
    rows += [(400, None), (401, None), (402, ""), (403, "   \n"), (404, prose(rng, 20_000)), (405, "a" * 900), (406, "é🙂 ß " * 120), (407, "é🙂 ß " * 70), (0, rows[0][1])]
    return rows
