import random

import pytest

DOC_COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # extra columns that bear the names operators use inside
    "n_tokens string, kept string, piece string, seed string, text_hash string, row_id string, bands string, n string, start string, label string"
)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "in", "on", "le", "ché", "st", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and ids, odd characters."""
    a, b = prose(1, 90), prose(2, 70)
    common = prose(3, 40)
    return [
        (0, a),
        (1, b + " " + common),
        (2, common + "\n" + b),
        (3, a.replace(" ", "  ", 3)),
        (4, a.replace(" ", "\t", 1)),
        (5, None),
        (6, ""),
        (7, " \t\n\x0b\x0c\r "),
        (8, "one"),
        (9, "One"),
        (10, "one two"),
        (11, a),
        (11, a),
        (12, b),
        (12, a + " " + b),
        (None, a),
        (None, prose(4, 60)),
        (None, None),
        (13, "it's <|endoftext|> and <|startoftext|>it 'll  do so   x"),
        (14, "漢字仮名交じり文 " * 60),
        (15, "é ́x İstanbul ΣΑΣ ﬁn 😀😀 \x1c\x85y"),
        (16, "word " * 300),
        (17, prose(5, 30_000)),
        (18, "x" * 70_000),
        (19, "  \n " * 9000 + "end"),
        (20, a.replace(a.split()[40], "changed")),
        (21, a[:-1] + "!"),
        (22, common * 3),
        (23, "AB cd"),
        (24, "ab CD"),
    ]


def documents(spark, rows):
    filler = ("x",) * 10
    data = [(i, t, None if n % 7 == 3 else "en", None if n % 5 == 4 else f"src{n % 3}", None if n % 6 == 5 else len(t or ""), *filler) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOC_COLUMNS)


@pytest.fixture(scope="session")
def edge_docs(spark):
    return documents(spark, edge_rows())


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])


def same_rows(got, want):
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    assert order(map(tuple, got)) == order(map(tuple, want))
