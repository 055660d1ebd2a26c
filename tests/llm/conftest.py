import random

import pytest

WORDS = "der die das und the of in le la les el los y casa haus house maison rot red rouge rojo".split()


@pytest.fixture(scope="session")
def texts():
    """Small corpus with copies, near copies, short, empty, null and one long text."""
    r = random.Random(7)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120))) for _ in range(60)]
    out = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        out.append("  ".join(w).upper())
    out += base[5:12] + ["", None, " \t\n", "one", "one two", "One  TWO", "a b c", " ".join(base)]
    return out


@pytest.fixture()
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
