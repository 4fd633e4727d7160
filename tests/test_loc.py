import random

import pytest
from pyspark.sql import functions as F

from codehist.functions.loc import source_loc


def counted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    rows = df.select("i", source_loc(F.col("text")).alias("n")).collect()
    return [r.n for r in sorted(rows)]


# text, and how many of its lines hold source
TABLE = [
    # blank lines, line comments
    ("", 0),
    (" \t\n\n  ", 0),
    ("x = 1;", 1),
    ("  x = 1;  \n\t\ny = 2;", 2),
    ("// nothing", 0),
    ("x = 1; // and why", 1),
    ("  // a\n//b\nx();\n// c", 1),
    ("{\n}", 2),
    # ends of lines
    ("p\r\nq\rr\ns", 4),
    ("p\r\r\nq", 2),
    # comments on one line
    ("/* why */", 0),
    ("/* why */ x();", 1),
    ("x(); /* why */", 1),
    ("/* a *//* b */", 0),
    ("/* a */ // b", 0),
    ("/* a */ /* b */ x();", 1),
    ("x(/* a */ 1, /* b */ 2);", 1),
    # comments over several lines
    ("/*\n * text\n */", 0),
    ("/**\n * text\n */\nvoid f() {", 1),
    ("x(); /* from here\nto\nhere */", 1),
    ("x(); /* from here\nto here */ y();", 2),
    ("/* one\n*/ /* two */ y();", 1),
    ("/* one\n*/ // two\ny();", 1),
    ("/* one\n// two\nx();\n*/", 0),
    # a line that closes one comment and opens the next is still inside
    ("/* one\n*/ x(); /*\nhidden();\n*/ y();", 1),
    ("x(); /* a */ /* b\nhidden();\n*/", 1),
    ("/* never\nclosed\nx();", 0),
    # marks inside of strings
    ('s = "/*";\nx();', 2),
    ('s = "/* " + t; /* a\nhidden();\n*/', 1),
    ('s = "http://a.b";', 1),
    ('s = "*/";\nx();', 2),
]


@pytest.fixture(scope="module")
def counts(spark):
    return counted(spark, [text for text, _ in TABLE])


@pytest.mark.parametrize("k", range(len(TABLE)), ids=lambda k: repr(TABLE[k][0])[:40])
def test_table(counts, k):
    assert counts[k] == TABLE[k][1]


def test_missing_text(spark):
    assert counted(spark, [None]) == [0]


# texts in which every comment is closed, from whole pieces; each piece with its source lines
PIECES = [("x();", 1), ("/* a */", 0), ("// a", 0), ("", 0), ("/* a\nb\n*/", 0), ("x(); /* a\nb */ y();", 2), ('s = "t";', 1), (" \t", 0), ("}", 1)]


def test_pieces_add_up(spark):
    rnd = random.Random(3)
    picked = [[rnd.choice(PIECES) for _ in range(rnd.randrange(1, 12))] for _ in range(500)]
    texts = ["\n".join(p[0] for p in pieces) for pieces in picked]
    assert counted(spark, texts) == [sum(p[1] for p in pieces) for pieces in picked]


def test_blanks_and_line_comments_between_lines_change_nothing(spark):
    rnd = random.Random(4)
    picked = [[rnd.choice(PIECES)[0] for _ in range(6)] for _ in range(200)]
    spaced = ["\n \n// note\n".join(pieces) for pieces in picked]
    assert counted(spark, spaced) == counted(spark, ["\n".join(pieces) for pieces in picked])


def test_without_marks_every_line_with_text_counts(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" ab\n\t\"\\*") for _ in range(40)) for _ in range(500)]
    assert counted(spark, texts) == [sum(bool(x.strip()) for x in t.split("\n")) for t in texts]


def test_long_lines(spark):
    texts = ["/* " + "a" * 200_000 + " */ x", "y " * 100_000 + "/* open\nz", "/* a */" * 2000 + " x"]
    assert counted(spark, texts) == [1, 1, 1]
