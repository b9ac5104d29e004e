import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, a column named like an operator's own."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    base = [word() for _ in range(120)]
    rows = [(None, "lost words here", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "One", "en", "b"), (5, "one", "en", "b")]
    rows += [(10, " ".join(base), "en", "a"), (11, " ".join(base), "en", "a"), (12, " ".join(base[:-2] + ["x", "y"]), "de", "b"), (12, " ".join(base[:-2] + ["x", "y"]), "de", "b")]
    rows += [(20 + k, " ".join(word() for _ in range(60 + k)), "de", "bc"[k % 2]) for k in range(20)]
    rows += [(50, " ".join(["again and again"] * 200), "en", "c"), (51, " ".join(word() for _ in range(5000)), "en", "c")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
