import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, spans int, tree string, listed int, gone int, of int, v int"
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing extra columns from (id, text) rows."""

    def f(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", 1, "t", 2, 3, 4, 5) for i, t in rows], SCHEMA)

    return f


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeats, ties and one long text."""
    same = prose(1, 120)
    return [(None, same), (1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (6, prose(2, 60)), (7, prose(3, 30_000)), (8, "x"), (None, None)]
