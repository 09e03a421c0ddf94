"""Texts that are hard on operators, and helpers of these tests."""

import random

from pyspark.sql import types as T

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "ta", "vo", "zu") for b in ("n", "rt", "st", "x", "lim", "dor", "pek", "bas")]
#: Extra columns whose names an operator might use itself.
CLASHING = ["id", "size", "block", "bucket", "label", "u", "v", "h", "n", "grp", "weight", "text_key", "_row", "_range", "_text", "root", "node", "key", "k1", "k2", "name", "rest", "bare", "doc", "place", "stays", "tox_score", "_text_key", "_of", "_key", "demand"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tricky_texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows, near copies, passages in common, control strings."""
    long = prose(1, 6000)
    passage = prose(2, 90)
    near = prose(3, 200).split()
    changed = near[:100] + ["changed"] + near[101:]
    return [
        (1, prose(4, 60), "a"), (2, prose(4, 60), "a"), (2, prose(4, 60), "a"), (2, prose(5, 40), "b"), (None, prose(6, 50), "b"),
        (None, prose(6, 50), None), (3, None, "a"), (4, "", "a"), (5, " \t\n ", None), (6, long, "a"), (7, long + " tail", "c"),
        (8, " ".join(near), "c"), (9, " ".join(changed), "c"), (10, f"{prose(7, 30)} {passage} {prose(8, 20)}", "a"), (11, f"{prose(9, 10)}\n{passage}\n{prose(10, 25)}", None),
        (12, "<|endoftext|> naïve café – 漢字 🙂 ٣ e\u0301 <|im_end|>", "d"), (13, "one two", "d"), (14, "one two", "d"), (15, "x" * 3000, "d"),
        (16, f"{passage} {passage}", "e"), (17, "write to a.b@c.example.org or +1 (555) 010-0199, 4111 1111 1111 1111, 192.168.0.1 and 999.1.1.1", "e"), (-5, prose(11, 35), "\u00e9"), (2**40, prose(12, 36), "z"),
    ]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["clash"] * len(CLASHING)) for i, t, s in rows], SCHEMA)


def same(left, right) -> None:
    """Equal as bags of rows, nulls included."""
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    assert sorted(map(key, left)) == sorted(map(key, right))
