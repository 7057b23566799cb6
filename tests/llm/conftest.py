import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, ids int, removed_lines string, sig string"


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 120)), f"s{i % 12}") for i in range(60)]
    base = words(rng, 150)
    rows += [(100 + i, base, f"s{i}") for i in range(10)]
    for i in range(12):
        edited = base.split()
        for _ in range(rng.randint(1, 6)):
            edited[rng.randrange(len(edited))] = "edit" + str(i)
        rows.append((130 + i, " ".join(edited), f"s{i}"))
    boiler = "all rights are kept by us"
    rows += [(200 + i, f"{words(rng, 30)}\n  {boiler} \n{words(rng, 12)}", f"s{i}") for i in range(11)]
    rows += [(300, None, "s1"), (301, "", "s1"), (302, " \n\t ", None), (303, words(rng, 30_000), "s2"), (304, "x" * 200_000, "s2"),
             (305, "Été ÉTÉ été ümlaut \U0001f600 ###", "s3"), (None, words(rng, 40), "s4"), (5, rows[5][1], "s5"), (5, rows[5][1], "s5"),
             (306, "one", "s3"), (307, "one two", "s3"), (308, "ONE two", "s3")]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """Those rows with further columns, some named like results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "no", 1, "x", None) for i, t, s in messy_rows], SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
