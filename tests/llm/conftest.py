import pytest

LONG = "word " * 40_000 + "end"

#: nulls, empty and very long texts, ties, repeated rows; further columns with names that
#: operators use inside
EDGE = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (1, None, "en"),
    (2, "", None),
    (2, "", None),
    (None, "a text without an id but with enough words to be a shingle set", "en"),
    (3, LONG, "en"),
    (4, "a", "en"),
    (5, "!!! ... 123", None),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (7, "\n\t  \x0b", "de"),
    (8, "é ü 中文 <|endoftext|> x", "fr"),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, sid binary, part int, place long, "
          "row long, tid string, found string, given string, n long, m long, learn boolean, class_id long, late int, chosen long, rows long")


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, lang, None, None, b"x", 1, 2, 3, "t", "f", "g", 4, 5, True, 6, 7, 8, 9) for i, t, lang in EDGE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("1 = 0")


@pytest.fixture(scope="session")
def path():
    from sparkfeat.llm.common import tokenizer_path
    return tokenizer_path()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
