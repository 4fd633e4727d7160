"""Quality rules on documents, and verdicts on the hosts they come from.

Each text gets counts (one pass, numpy inside Arrow batches) and two rules decide on it alone. A host (here: the source) is judged by the share of its
documents that fail. Shares of small hosts are noise, so they are shrunk towards the shares of all hosts: a beta prior is fitted to the hosts by the
method of moments, and the mean of the posterior is compared with two limits. Documents of a host beyond the absolute limit go as well. A host that merely fails more often than
others (SUSPECT times the mean of the prior) is suspect: most of what it has is still good, so its documents have to pass the same rules with stricter limits.

Defined results: a null or empty text has no words and fails; a null source is no host, its documents are judged alone; repeated rows are judged one by
one; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codehist.llm.tables import staged
from codehist.llm.vectors import CHAR_IN_WORD, flat, mixed, per_text, pieces, span_hashes, words

LEAST_WORDS = 50
MOST_REPEATED = 50
#: A host goes when more than this share of its documents is expected to fail.
HOST_LIMIT = 0.8
#: A host is suspect when its share is more than so many times the mean; limits for its documents.
SUSPECT = 1.2
STRICT_WORDS, STRICT_REPEATED = 100, 25
SYMBOLS = b"#*$%&|<>"

IS_SYMBOL = np.zeros(256, np.uint8)
IS_SYMBOL[list(SYMBOLS)] = 1
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
K = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F)]


def after_first(keys: np.ndarray) -> np.ndarray:
    """Marks every key that an earlier place has as well."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def found_twice(keys: np.ndarray) -> np.ndarray:
    """Marks every key that another place has as well."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    both = np.zeros(len(keys), bool)
    both[order[1:]] = equal
    both[order[:-1]] |= equal
    return both


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    data, at = flat(column)
    n = len(at) - 1
    begins, ends, n_words = words(data, at)
    row = np.repeat(np.arange(n), n_words)
    h = mixed(span_hashes(data, begins, ends))

    repeated = np.zeros(len(h) + 2, bool)
    if len(h) > 2:
        inside = np.flatnonzero(row[2:] == row[:-2])
        three = h[inside] * K[0] + h[inside + 1] * K[1] + h[inside + 2] * K[2]
        twice = inside[found_twice(mixed(three) + row[inside].astype(np.uint64) * K[0])]
        for k in range(3):
            repeated[twice + k] = True

    new = np.union1d(np.flatnonzero(data == 10) + 1, at[:-1])
    new = new[new < len(data)]
    stop = np.append(new[1:], len(data))[: len(new)]
    stop -= data[stop - 1] == 10
    written = np.searchsorted(begins, stop) > np.searchsorted(begins, new)
    new, stop = new[written], stop[written]
    line_row = np.searchsorted(at, new, "right") - 1
    lines = mixed(span_hashes(data, new, stop)) + line_row.astype(np.uint64) * K[0]
    return {
        "n_words": n_words,
        "word_chars": per_text(CHAR_IN_WORD[data], at),
        "n_symbols": per_text(IS_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_row[after_first(lines)], minlength=n),
        "n_repeat_words": np.bincount(row[repeated[: len(row)]], minlength=n),
    }


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep and the counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stats = text_stats(batch.column("text"))
            columns = [batch.column(k) for k in keep] + [pa.array(stats[s].astype(np.int64)) for s in STATS]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *STATS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{s} long" for s in STATS])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def failed_alone(least: int = LEAST_WORDS, most: int = MOST_REPEATED) -> Column:
    few = F.col("n_words") < least
    return few | (100 * F.col("n_repeat_words") > most * F.col("n_words"))


def failed_strictly() -> Column:
    return failed_alone(STRICT_WORDS, STRICT_REPEATED)


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failed ones, shrunk share, verdicts (rejected, suspect).

    With shares p of mean m and variance v over the hosts, the prior is beta(m s, (1 - m) s) with s = m (1 - m) / v - 1. Hosts that differ more than any
    beta prior allows are not shrunk (s = 0); hosts that are all alike (v = 0) all get the mean of the prior.
    """
    hosts = judged.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    share = F.col("bad") / F.col("n")
    m, v = hosts.agg(F.avg(share), F.var_pop(share)).first()
    if v is None or v <= 1e-12:
        rate = F.lit(m).cast("double")
    else:
        size = max(0.0, m * (1 - m) / v - 1)
        rate = (F.col("bad") + F.lit(m * size)) / (F.col("n") + F.lit(size))
    return hosts.withColumn("rate", rate).withColumns({"host_rejected": F.col("rate") > limit, "host_suspect": F.col("rate") > F.lit(SUSPECT) * F.lit(m).cast("double")})


def quality_rules(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, source, the counts, base_failed, the host's shrunk rate and kept, one row per row of ``docs``."""
    judged = staged(with_stats(docs, ["doc_id", "source"]).withColumn("base_failed", failed_alone()))
    hosts = host_verdicts(judged, host_limit).select("source", "rate", "host_rejected", "host_suspect")
    gone = F.coalesce(F.col("host_rejected") | (F.col("host_suspect") & failed_strictly()), F.lit(False))
    return judged.join(hosts, "source", "left").withColumn("kept", ~F.col("base_failed") & ~gone)


def kept_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept.

    The verdicts on a document alone need its text only and are worked out where the text is; texts are not shuffled. Hosts are judged in a pass before
    that writes counts only, and the list of rejected and suspect hosts is joined to the documents.
    """
    judged = staged(with_stats(docs, ["doc_id", "source"]).select("source", failed_alone().alias("base_failed")))
    verdicts = host_verdicts(judged, host_limit).where("host_rejected or host_suspect").select(F.col("source").alias("host"), "host_rejected")
    names = docs.columns
    row = T.StructType([T.StructField("row", docs.schema), T.StructField("host", T.StringType()), T.StructField("strictly", T.BooleanType())])
    passed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text", F.col("source").alias("host")).mapInArrow(_passing, row)
    joined = passed.join(verdicts, "host", "left")
    return joined.where("host_rejected is null or (not host_rejected and strictly)").select("row.*")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that pass alone, and whether they pass the stricter limits."""
    for batch in pieces(batches):
        stats = text_stats(batch.column("text"))
        n, repeated = stats["n_words"], 100 * stats["n_repeat_words"]
        good = (n >= LEAST_WORDS) & (repeated <= MOST_REPEATED * n)
        strictly = (n >= STRICT_WORDS) & (repeated <= STRICT_REPEATED * n)
        out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(strictly)], names=["row", "host", "strictly"])
        yield out.filter(pa.array(good))


def op6_quality_rules(spark, sf_dir) -> DataFrame:
    from codehist.llm.tables import table

    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *STATS, "base_failed", "kept")


OP6_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w0 as (select r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, string_split(t, chr(10)) as ls,
              length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols from d),
w as (select r, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, n_symbols from w0),
words as (select r, generate_subscripts(ws, 1) as i, unnest(ws) as x from w0),
win as (select r, i, x as a, lead(x) over p as b, lead(x, 2) over p as c from words window p as (partition by r order by i)),
twice as (select r, i, count(*) over (partition by r, a, b, c) as k from win where b is not null and c is not null),
rep as (select r, count(distinct i + o) as n from twice, (values (0), (1), (2)) offs(o) where k > 1 group by r),
lines as (select r, unnest(ls) as x from w0),
dup as (select r, count(*) - count(distinct x) as n from lines where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by r),
j as (select d.doc_id, d.source, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
             cast(n_symbols as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines,
             cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from d join w using (r) left join dup using (r) left join rep using (r)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from j),
h as (select source, count(*) as n, sum(cast(base_failed as int)) as bad from f where source is not null group by source),
p as (select avg(bad / n) as m, var_pop(bad / n) as v from h),
q as (select source, case when v <= 1e-12 then m
                     else (bad + m * greatest(0.0, m * (1 - m) / v - 1)) / (n + greatest(0.0, m * (1 - m) / v - 1)) end as rate, m from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(rate > {HOST_LIMIT} or (rate > {SUSPECT} * m and (n_words < {STRICT_WORDS} or 100 * n_repeat_words > {STRICT_REPEATED} * n_words)), false) as kept
from f left join q using (source)
"""
