"""Counting source lines: lines that are neither blank nor comment.

The flags of a line do not depend on its neighbours; only whether a block
comment is open does, and that is folded over the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\x00-\x20]"
# text up to the first comment start, without a quote before it
_LEAD = r'(?:(?!/\*)[^"])*+'
_BODY = r"(?:(?!\*/).)*+"
# closed comments followed by more than a line comment or nothing
_CLOSED = rf"(?s)^(?:{_LEAD}/\*{_BODY}\*/{_WS}*+(?!//|\z))*+{_LEAD}"
_OPENS = rf"{_CLOSED}/\*{_BODY}\z"
_QUOTED = rf'{_CLOSED}"'


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WS}+|{_WS}+\z", "")


def _is_blank(line: Column) -> Column:
    return (line == "") | line.startswith("//")


def _begins(line: Column) -> Column:
    """A block comment starts in the line and does not end in it.

    With a quote before the first comment start, only the text after the last
    quote is looked at.
    """
    rest = F.substring_index(line, '"', -1)
    deep = F.when(line.rlike(_OPENS), True).when(line.rlike(_QUOTED), rest.rlike(_OPENS)).otherwise(False)
    return F.when(~line.contains("/*"), False).otherwise(deep)


def _is_source(line: Column) -> Column:
    """Something is left once the comments at the front are gone."""
    left = F.when(
        line.startswith("/*"),
        F.regexp_replace(line, rf"(?s)^(?:/\*{_BODY}\*/{_WS}*+)++", ""),
    ).otherwise(line)
    return ~_is_blank(left) & ~left.startswith("/*")


def _after_close(line: Column) -> Column:
    return _trim(F.regexp_replace(line, r"(?s)^.*?\*/", ""))


def source_loc(text: Column) -> Column:
    """Number of source lines; 0 for a missing text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), _trim)
    lines = F.filter(lines, lambda t: ~_is_blank(t))
    # inside a comment only the text after its end matters
    flags = F.transform(
        lines,
        lambda t: F.struct(
            _is_source(t).alias("source"),
            _begins(t).alias("begins"),
            F.when(t.contains("*/"), _after_close(t)).alias("rest"),
        ),
    )
    flags = F.transform(
        flags,
        lambda f: F.struct(
            f["source"].cast("int").alias("source"),
            f["begins"].alias("begins"),
            # the comment goes on when nothing closes it or the rest opens another
            F.when(f["rest"].isNull(), True)
            .otherwise(~_is_blank(f["rest"]) & _begins(f["rest"]))
            .alias("stays"),
            F.when(f["rest"].isNull(), 0)
            .otherwise((~_is_blank(f["rest"]) & _is_source(f["rest"])).cast("int"))
            .alias("tail"),
        ),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    end = F.reduce(
        flags,
        start,
        lambda a, f: F.struct(
            (a["n"] + F.when(~a["inside"], f["source"]).when(f["stays"], 0).otherwise(f["tail"])).alias("n"),
            F.when(a["inside"], f["stays"]).otherwise(f["begins"]).alias("inside"),
        ),
    )
    return end["n"]
