import pytest

#: Texts with every awkward case: null, empty, blank only, one word, equal texts, near copies, long, other scripts.
BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strong potion near the old mill pond tonight"
TEXTS = [
    (1, BASE + "\nA second line stands here with words of its own and nothing else to say"),
    (2, BASE + "\nA second line stands here with words of its own and nothing else to say"),
    (3, None),
    (4, ""),
    (5, " \t\n \n"),
    (6, "word"),
    (7, BASE.replace("seven", "eight") + "\n\n" + BASE),
    (8, "Ünïcödé  日本語 naïve 🙂 " * 30),
    (9, "again and again " * 300),
    (10, "\n".join(f"line number {i} says something rather different about topic {i * 7919 % 101} today" for i in range(60))),
    (11, "<|endoftext|> <s> ▁ special \x00 strings's inside"),
    (12, "x" * 3000 + " " + "y" * 500),
    (13, BASE + " and then a tail that differs from all the other documents by quite a few words"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """The texts with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", None, 1, "x", i) for i, t in TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint, k int, tag string, fp bigint")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null keys, repeated rows, one key on two texts."""
    rows = [(None, BASE), (None, None), (1, BASE), (1, BASE), (1, BASE + " more"), (2, "short"), (2, "short"), (9_000_000_000_000_000_000, BASE)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
