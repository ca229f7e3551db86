"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("row", "id", "hash", "key", "matches", "kept")]  # names that operators use inside
)


def sentences(rng, n, words=("the", "of", "Ünd", "grün", "été", "corpus", "line", "and", "q7", "naïve", "zu", "b")):
    return " ".join(rng.choice(words) + (rng.choice(["", "", ".", ","])) for _ in range(n))


def texts(seed=5, n=40):
    """Texts with copies, near copies, shared passages, repeats inside, odd white space."""
    rng = random.Random(seed)
    passage = sentences(rng, 70)
    lines = "\n".join(sentences(rng, 20) for _ in range(4))
    out = ["", "   \n\t ", "one", "two words", None, "é" * 300, "ab" * 400, "x\x0by\x1cz w"]
    for i in range(n):
        text = "\n".join(sentences(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6)))
        kind = i % 8
        if kind == 1:
            text = rng.choice([t for t in out if t])
        elif kind == 2:
            text = text + "\n" + passage + "\n" + text[:150]
        elif kind == 3:
            text = rng.choice([t for t in out if t]) + " changed"
        elif kind == 4:
            text = sentences(rng, 3) + "\n" + lines + "\n\n" + text
        elif kind == 5:
            text = text + "\n" + text
        out.append(text)
    return out


def documents(spark, rows):
    """``rows`` of (doc_id, text[, source]) with extra columns of clashing names."""
    return spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else "s", *"abcdef") for r in rows], DOCS)


def awkward(seed=5, n=40):
    rows = [(i * 3, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts(seed, n))]
    rows += [rows[12], rows[12], (None, rows[9][1], None), (None, None, "s1"), (rows[15][0], rows[20][1], "s2")]
    return rows
