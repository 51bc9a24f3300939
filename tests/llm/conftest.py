from __future__ import annotations

import random

import pytest

#: Columns that are named as operators name their own, or differ from wanted ones in case only.
CLASH = ["Text", "DOC_ID", "id", "fp", "th", "key", "__tw0", "__id", "n_tokens", "cost"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, lang), with clashing columns."""

    def make(rows, clash: bool = True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "web", None if r[1] is None else len(r[1]), *(["x"] * len(CLASH) if clash else [])) for r in rows]
        shape = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASH if clash)
        return spark.createDataFrame(full, shape)

    return make


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeinorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


SAME = prose(1, 80)
#: Null ids, null, empty and blank texts, a very long one, repeated rows, a shared id, and text beyond ASCII.
EDGE = [
    (None, prose(2, 60)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, prose(3, 40_000)), (5, SAME), (5, SAME), (6, SAME),
    (7, prose(4, 70)), (7, prose(5, 70)), (8, "é漢字 ﬀ   𝒳 " + prose(6, 55)), (9, "word"), (10, "word"),
]


@pytest.fixture(scope="session")
def edge(documents):
    return documents(EDGE).cache()


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
