"""Small documents with the cases that every operator must handle."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, recipe string"
PROSE = ("the river runs past a quiet mill where seven old boats wait for spring and nobody knows who painted their "
         "names or why each one carries a small lamp made of green glass that the wind has never managed to put out "
         "while children count them every evening before supper and write the number on a wall")


def variant(k: int) -> str:
    """PROSE with its k-th word replaced."""
    words = PROSE.split()
    words[k % len(words)] = f"word{k}"
    return " ".join(words)


def rows():
    texts = {
        1: PROSE, 2: PROSE.upper(), 3: variant(5), 4: variant(30), 5: None, 6: "", 7: " \n\t ", 8: "Two words",
        9: "one", 10: "ONE", 11: 'x password = "abcdEFGH1234" AKIA' + "Q" * 16 + " é " + "0123456789abcdef" * 2,
        12: "Släpp under the MIT License.\nLicensed under the Apache License, Version 2.0\nAll rights reserved",
        13: " ".join(f"w{i}" for i in range(30_000)), 14: "a b c " * 60, 15: "\U0001f600 日本語 ünï ßtraße " * 20,
        16: "### $$$ | <x> " * 40, 17: "tab\tand  two spaces \n\n new line ", 18: "same line\nsame line\n\nother",
    }
    out = [(i, t, ["en", "fr", None][i % 3], "s", None, 1, "clash") for i, t in texts.items()]
    return out + [out[0], (None, "no id here at all", None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text or '') of every row."""
    return [(r[0], r[1] or "") for r in rows()]
