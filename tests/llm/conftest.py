"""Tables with the awkward cases that every operator must take."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n):
    return " ".join(rng.choice(["ant", "bee", "cow", "dog", "élan", "fox", "gnu", "hen"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(4)
    base = _words(rng, 60)
    near = base.split(" ")
    near[30] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(near), "en", "b", None),
        (3, " ".join(near), "en", "b", None),
        (4, _words(rng, 50), None, None, 5),
        (4, _words(rng, 40), None, "é", 5),
        (5, None, "en", "a", 0),
        (6, "", "en", "b", 0),
        (7, " \n\t ", "en", "a", 4),
        (8, "one", "en", "a", 3),
        (None, _words(rng, 30), "en", "a", 3),
        (None, None, None, None, None),
        (9, _words(rng, 30_000), "en", "a", 3),
        (10, "x\n" * 40, "en", "b", 3),
        (11, _words(rng, 12) + " &amp; <s> [END] " + base, "en", "c", 3),
    ]
    return rows + [(100 + i, _words(rng, rng.randint(5, 60)), "en", "a" if i % 3 else "d", 1) for i in range(40)]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns named like those that operators make."""
    names = ["key", "tid", "h", "n", "size", "start", "bucket", "score", "kept", "row", "copy", "whole",
             "position", "hit", "items", "crc", "cold", "n_words", "toxic_score", "nth", "band", "target"]
    return awkward.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
