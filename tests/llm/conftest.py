"""Documents with all that a corpus can hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest

#: Columns that operators use names like.
CLASH = ["row", "key", "id", "n", "text_", "line", "at", "words", "spans", "piece", "lang_pred", "digest", "bits", "maybe", "draw", "kind", "name"]


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id unique, but for the last two rows, which repeat others."""
    rng = random.Random(7)
    vocabulary = ["der", "the", "und", "and", "maison", "house", "Haus", "été", "ß", "x1", "2024", "naïve", "don't", "end.", "co-op", "ΣΑΣ", "日本語"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(8)]
    rows = []
    for k in range(160):
        ws = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 30])):
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        lines = [" ".join(ws[i : i + 12]) for i in range(0, len(ws), 12)]
        text = "\n".join(lines)
        text = {3: None, 5: "", 7: "   ", 11: "1234 5678", 13: "one", 17: "a" * 3000, 19: "\n\n"}.get(k, text)
        rows.append((k, text, rng.choice(["en", "de", "fr", None]), f"src{k % 3}", None if text is None else len(text)))
    rows.append((1000, "lang " * 30_000, "en", "src0", 150_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    again = spark.createDataFrame([rows[20], rows[3]], schema)
    texts = {r[0]: r[1] for r in rows}
    clashing = df
    for c in CLASH:
        from pyspark.sql import functions as F

        clashing = clashing.withColumn(c, F.lit("own"))
    return SimpleNamespace(df=df.repartition(5), rows=rows, texts=texts, repeated=df.unionByName(again).repartition(3), clashing=clashing, empty=df.limit(0))
