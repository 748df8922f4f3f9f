import random

import pytest

#: White space, capitals, accents, wide characters, ties, repeats, nulls and empty texts.
WORDS = "alpha beta Gamma delta epsilon zeta Éta thêta iota kappa 漢字 mu nu xi o pi rho".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def prose():
    """A function that makes n words from a seed, with mixed white space."""
    def make(n, seed):
        r = random.Random(seed)
        out = []
        for _ in range(n):
            out.append(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.7 else ""))
            out.append(r.choice([" ", " ", " ", "\n", "\t", "  "]))
        return "".join(out)
    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Documents with every awkward case: nulls, empties, copies, repeated rows, extra columns."""
    base = prose(120, 1)
    rows = [
        (1, base, "en", "a", 0.5), (2, base, "en", "a", 0.5), (2, base, "en", "a", 0.5), (3, None, None, None, None),
        (4, "", "de", "", 1.0), (5, " \n\t ", "de", "b", 1.0), (6, "one", "de", "b", 1.0), (7, "one two", "fr", "b", 1.0),
        (None, prose(60, 2), "fr", "c", 2.0), (None, prose(60, 2), "fr", "c", 2.0),
        (8, base + " tail", "en", "a", 3.0), (9, prose(5000, 3), "en", None, 3.0), (10, prose(90, 4) + base, None, "a", 0.0),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, row double"
    ).withColumnRenamed("row", "n")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n double")
