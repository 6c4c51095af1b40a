import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, part int, line string, core long, component string, kept boolean, shard int"


def prose(seed, n, syllables="er on the an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows():
    a, b = prose(1, 120), prose(2, 90)
    shared = prose(3, 70)
    rows = [
        (None, prose(4, 60)),
        (1, None),
        (2, ""),
        (3, " \t\n \x0b "),
        (4, "One two"),
        (5, a),
        (5, a),  # the row repeats
        (6, a),
        (6, b),  # the id repeats
        (7, a.upper() + " more words at the end"),
        (8, prose(5, 30) + "\n" + shared + "\n" + prose(6, 30)),
        (9, prose(7, 40) + " " + shared),
        (10, ("ab cd " * 300).strip()),
        (11, "é日 本語 \U0001f600 " * 80),
        (12, prose(8, 40_000)),
        (13, "12 34 .. !! " * 20),
        (None, None),
        (-7, b),
        (14, "before <|endoftext|> after\n<|endoftext|><|endoftext|>"),
    ]
    return [(i, t, None if k % 5 == 0 else "ab"[k % 2], None if k % 7 == 0 else f"s{k % 9}", None, k, k, "x", k, "y", True, k) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns whose names clash."""
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)

