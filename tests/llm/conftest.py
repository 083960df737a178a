import hashlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone cloud paper green winter engine window garden letter bridge copper silver market forest signal".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that depends on the seed, so that texts of different seeds share no long passage."""
    out = []
    for k in range(n):
        h = hashlib.md5(f"{seed}:{k}".encode()).digest()
        out.append(f"{WORDS[h[0] % 16]}{h[1] % 40}" if h[2] % 3 else WORDS[h[0] % 16])
    return " ".join(out)


PASSAGE = prose(77, 90)
LINES = "\n".join(prose(500 + k, 12) + "." for k in range(4))

#: Nulls, empty and blank texts, repeated rows, copies, shared passages and lines, a long text, one word said very often.
TEXTS = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \t\n ", "en", None),
    (4, prose(4, 150), "en", "a"),
    (5, prose(4, 150), "en", "a"),
    (6, prose(4, 150) + " one more", "en", "b"),
    (7, prose(7, 60) + " " + PASSAGE + " " + prose(8, 50), "de", "b"),
    (8, prose(9, 40) + " " + PASSAGE, "de", "b"),
    (9, PASSAGE + "\n" + PASSAGE, "fr", "c"),
    (10, prose(10, 30) + "\n" + LINES + "\n" + prose(11, 30), "en", "a"),
    (11, LINES + "\n\n" + prose(12, 30) + "\n" + LINES, "en", "a"),
    (12, LINES, "en", "a"),
    (13, "word " * 4000, "en", "a"),
    (14, prose(14, 12_000), "en", "a"),
    (15, "three words only", "en", "a"),
    (16, "three words only", "en", "a"),
    (17, "Three  WORDS\tonly", "en", "a"),
    (18, "ünïcödé é 中文 😀 " * 30, "zz", "a"),
    (19, "x" * 3000, "en", "a"),
    (20, prose(20, 80), "en", "a"),
    (20, prose(20, 80), "en", "a"),
]


@pytest.fixture(scope="session")
def rows():
    return [(i, t) for i, t, _, _ in TEXTS]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """More columns, of names that the operators might use themselves, in other letters too."""
    names = "bucket node rank th pos runs kept spans bands component n_words _q _x _lang _row _text _own _lines _runs _words _fold sha first last DOC_KEY".split()
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
