import random

import pytest

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge maple north oasis pearl quartz ridge spruce tundra umber vale willow xenon yarrow zephyr".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rn string, score double, lang_pred string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with nulls, emptiness, length, ties and repeats."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(40)]
    out = [None, "", "   \n\t ", "one", "Ünïcode ñandú 日本語 😀 " + base[0], base[1], base[1], base[1], base[2] + " tail " + base[3][:250], base[4][:260] + base[2], prose(rng, 6000), "a" * 5000, "x y z w", "no\x00nul\x0b!", "12345 678"]
    for t in base[5:20]:
        w = t.split()
        out.append(t)
        for _ in range(2):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out + base[20:]


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    """A table with extra columns whose names clash with results, a null id and rows that repeat."""
    rows = [(k, t, ["en", "de", None][k % 3], ["s0", "s1", None][k % 3 if k % 5 else 0], None if t is None else len(t), "x", 9.0, "zz") for k, t in enumerate(odd_texts)]
    rows.append((None, "row without an id " + odd_texts[5], None, None, None, None, None, None))
    rows.append(rows[5])
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
