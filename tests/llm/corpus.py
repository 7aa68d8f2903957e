"""Small corpora with the awkward cases of every operator."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside: they must not clash.
        T.StructField("score", T.StringType()),
        T.StructField("held_out", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("rep", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprst"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(CONSONANTS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else word(rng)
        out.append(w.capitalize() + ("." if rng.random() < 0.5 else "") if rng.random() < 0.1 else w)
    return " ".join(out) + "."


def frame(spark, texts, **columns):
    """A documents table; ``texts`` are (doc_id, text) pairs."""
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), "s", None if t is None else len(t), "x", 7, "k", None, "w") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty, very long and repeated texts, near copies, shared passages and odd white space."""
    rng = random.Random(seed)
    base, passage = prose(rng, 200), prose(rng, 60)
    near = base.split(" ")
    near[50:53] = ["xx", "yy", "zz"]
    far = [w if i % 5 else word(rng) for i, w in enumerate(base.split(" "))]
    out = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "one two"),
        (6, "One  two"),
        (7, base),
        (8, base),
        (9, " ".join(near)),
        (10, " ".join(far)),
        (11, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)),
        (12, prose(rng, 25) + " " + passage + " " + prose(rng, 45)),
        (13, " ".join(["again"] * 120)),
        (14, prose(rng, 9000)),
        (15, "x" * 30000),
        (16, "Ünïcödé    naïve\x0bvertical\x0cfeed\r\nline 漢字 😀 end."),
        (17, "| home | about | news | contact | more |\nREAD!! MORE!! NOW!! HERE!!"),
        (18, "1234 5678 -- 9"),
        (None, base),
        (None, None),
        (7, base),
    ]
    return out + [(100 + i, prose(rng, rng.randint(12, 90))) for i in range(60)]
