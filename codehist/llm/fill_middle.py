"""Fill-in-the-middle texts: a counted regular expression cuts each text into prefix, middle and suffix, and its replacement puts them in their new order.

``regexp_count`` gives n, the number of units of a text (code points, words or lines). Two cuts a <= b are drawn from a digest of the document's id, so reruns agree, and a pattern of the row's own,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``, matches the whole text once: its quantifiers are exact and possessive, so nothing is tried twice. The replacement text names the groups in the
order of the form, so one match both captures and rearranges. Everything stays in the JVM and in one stage; a row needs memory for its own text only.

A marker holds its first and its last character once, so in an output the first place at which a marker is found is where it was put, whatever stands beside it; that is why texts with
a marker of their own stay plain, and why ``restored`` gives back each text from its output and form.

Defined results: a null text is empty; empty texts stay plain; a null doc_id draws its cuts as an empty id would; rows that repeat a doc_id have the same draws, each over its own length; other
columns are kept, and those whose names clash with added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import table

#: Units that tile any text; (?s) lets a dot match line ends.
CHARACTERS = r"(?s)."
WORDS = r"\s*+\S++|\s++"
LINES = r"[^\n]*+\n|[^\n]++"
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of texts that are changed, and of those the percent with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Units counted at once, so that a long text is not held as one entry per unit.
STRIDE = 1024


def count_of(text: Column, unit: str = CHARACTERS, stride: int = STRIDE) -> Column:
    """Number of units: whole strides first, then what is left of the text behind them."""
    strides = F.regexp_count(text, F.lit(f"(?:{unit}){{{stride}}}+")).cast("long")
    rest = F.when(strides == 0, text).otherwise(F.regexp_replace(text, F.concat(F.lit(rf"\A(?:(?:{unit}){{{stride}}}+){{"), strides.cast("string"), F.lit("}+")), F.lit("")))
    return strides * stride + F.regexp_count(rest, F.lit(unit))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32, from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _quoted(marker: str) -> str:
    """The marker as a regular expression of its own."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in marker)


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    for m in markers:
        if len(m) < 2 or any(m.count(m[0]) != 1 or other.count(m[-1]) != 1 or m[0] in other[1:] for other in markers) or "$" in m or "\\" in m:
            raise ValueError(f"marker {m!r} must begin and end with characters that stand nowhere else in a marker")
    if len(set(markers)) != 3:
        raise ValueError("markers must differ")
    return markers


def fill_in_middle(docs: DataFrame, unit: str = CHARACTERS, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS, seed: int = 1) -> DataFrame:
    """``docs`` with n (units), form, prefix_units and middle_units (null if plain), and output, the text in its new order."""
    pre, suf, mid = _checked(markers)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    # three steps, so that the count and the draws are worked out once for a row
    counted = docs.withColumns({"n": count_of(text, unit), "_d": F.array(h1, h2, h3, h4)})
    has_marker = F.contains(text, F.lit(pre)) | F.contains(text, F.lit(suf)) | F.contains(text, F.lit(mid))
    cut1, cut2 = (F.col("_d")[k] % (F.col("n") + 1) for k in (0, 1))
    form = F.when((F.col("n") == 0) | has_marker | (F.col("_d")[2] % 100 >= changed), "plain").when(F.col("_d")[3] % 100 < suffix_first, "spm").otherwise("psm")
    cut = counted.withColumns({"form": form, "_a": F.least(cut1, cut2), "_b": F.greatest(cut1, cut2)})
    plain = F.col("form") == "plain"
    group = F.lit(f"((?:{unit}){{")
    pattern = F.concat(F.lit(r"\A"), group, F.col("_a").cast("string"), F.lit("}+)"), group, (F.col("_b") - F.col("_a")).cast("string"), F.lit(r"}+)((?s).*+)\z"))
    order = F.when(F.col("form") == "spm", f"{suf}$3{pre}$1{mid}$2").otherwise(f"{pre}$1{suf}$3{mid}$2")
    out = cut.withColumns({
        "prefix_units": F.when(~plain, F.col("_a")),
        "middle_units": F.when(~plain, F.col("_b") - F.col("_a")),
        "output": F.when(plain, text).otherwise(F.regexp_replace(text, pattern, order)),
    })
    return out.drop("_d", "_a", "_b")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    pre, suf, mid = map(_quoted, _checked(markers))
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{pre}(.*?){suf}(.*?){mid}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{suf}(.*?){pre}(.*?){mid}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_fill_middle(spark, sf_dir) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        _sha256(F.col("output")).alias("output_sha256"), _sha256(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), h AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
