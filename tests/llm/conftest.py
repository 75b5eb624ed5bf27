from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, score double"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, near copies,
    and columns whose names clash with those the operators use."""
    rng = random.Random(5)
    base = words(rng, 60)
    near = [*base[:30], "changed", *base[31:]]
    far = words(rng, 60)
    texts = [
        None, "", " \t\n ", "one", "One  two\nthree", "one two three", " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far), " ".join(far), "\x0b".join(far),
        "x" * 30_000, " ".join(words(rng, 6000)), "é ü ß 漢字 🙂 " * 9, "mail a.b@c.example.com or +1 (209) 555-1594\nReleased under the MIT License.", " ".join(base[:20]), "a b c d", "a b c d e", "A B C D E",
    ]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"src{i % 3}", len(t) if t else None, 7, 1, 0.1) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows += [(None, " ".join(base), "en", "src0", 1, 1, 1, None), (None, None, None, None, None, None, None, None), (-5, " ".join(far), "en", "é", 1, 1, 1, 1.0)]
    return rows


# names alike but for case, and names that operators use inside
MORE = "TEXT Doc_ID SOURCE Source _source _times _part _seed _copy _gone _first _key _text _row _id c0 c1 key words row id kept gone copy times part seed gid found band sketch run length at".split()


def with_more(df):
    """The frame with many more columns: a map, which has no order, and names that clash."""
    return df.select("*", F.create_map(F.lit("k"), F.lit(1)).alias("m"), *(F.lit(i).alias(name) for i, name in enumerate(MORE)))


@pytest.fixture(scope="session")
def edges(spark):
    return with_more(spark.createDataFrame(edge_rows(), SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return with_more(spark.createDataFrame([], SCHEMA))
