"""Quality of a text by a sparse ensemble of rules.

Boosted trees of small depth are grown on statistics of labelled texts; every path from a root becomes a rule, a conjunction of comparisons. A logistic model
with an L1 penalty gives weights to rules, most of them zero. What is left is compiled into one Spark column over the statistics.

The fit sees a bounded sample of labelled rows (``SAMPLE``) on the driver; statistics are worked out for every text.

Defined results: null and empty texts have statistics of zero and a score like any other; labels that are null, or lie in a fold that must not be learned from, are
not read; a document with several labels has their rounded mean; without labels, or with one kind only, the score is their smoothed share, 0.5 at first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codehist.llm.quality_rules import STATS, text_stats
from codehist.llm.tables import fold, table
from codehist.llm.vectors import flat, mixed, per_text, pieces, span_hashes, words

#: Labelled rows that the fit sees at most.
SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 20
PENALTY, ROUNDS = 0.002, 400

EXTRA = ("n_bytes", "n_lines", "n_digits", "n_upper", "n_points", "n_distinct", "n_again")
DIGIT, UPPER, POINT = (np.zeros(256, np.uint8) for _ in range(3))
DIGIT[48:58] = UPPER[65:91] = 1
POINT[list(b".,;:!?")] = 1


def more_stats(column: pa.Array) -> dict[str, np.ndarray]:
    data, at = flat(column)
    begins, ends, n_words = words(data, at)
    row = np.repeat(np.arange(len(at) - 1), n_words)
    key = mixed(span_hashes(data, begins, ends)) + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[order[1:]] = key[order[1:]] != key[order[:-1]]
    n = len(at) - 1
    return {
        "n_bytes": np.diff(at), "n_lines": per_text((data == 10).view(np.uint8), at) + (np.diff(at) > 0), "n_digits": per_text(DIGIT[data], at),
        "n_upper": per_text(UPPER[data], at), "n_points": per_text(POINT[data], at), "n_distinct": np.bincount(row[new], minlength=n), "n_again": np.bincount(row[again], minlength=n),
    }


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            stats = text_stats(batch.column("text")) | more_stats(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(stats[s].astype(np.int64)) for s in (*STATS, *EXTRA))], names=[*keep, *STATS, *EXTRA])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{s} long" for s in (*STATS, *EXTRA)])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))




def features() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"),
        "word_size": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "digits": share("n_digits", "n_bytes"),
        "upper": share("n_upper", "n_bytes"),
        "points": share("n_points", "n_bytes"),
        "distinct": share("n_distinct", "n_words"),
        "again": share("n_again", "n_words"),
        "line_words": share("n_words", "n_lines"),
        "char_size": share("n_bytes", "word_chars"),
    }


#: A condition: feature, whether it must be above the cut, cut. A rule is a set of them.
Rule = frozenset[tuple[str, bool, float]]


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """Probability of label 1, over the columns of ``features()``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(all_of(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def all_of(rule: Rule) -> Column:
    parts = [F.col(name) > cut if above else F.col(name) <= cut for name, above, cut in sorted(rule)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def holds(rule: Rule, names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        v = x[:, names.index(name)]
        out &= v > cut if above else v <= cut
    return out


def grow(cuts: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, names: list[str], rows: np.ndarray, path: Rule, depth: int, out: dict[Rule, None]) -> None:
    """Add the paths of a tree on these rows, in which each split has the largest gain of a Newton step, to ``out``."""
    if path:
        out[path] = None
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    best, f_best, k_best = 1e-6, -1, -1
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    for f in range(binned.shape[1]):
        b, n_bins = binned[rows, f], len(cuts[f]) + 1
        g = np.cumsum(np.bincount(b, grad[rows], n_bins))[:-1]
        h = np.cumsum(np.bincount(b, hess[rows], n_bins))[:-1]
        n = np.cumsum(np.bincount(b, minlength=n_bins))[:-1]
        gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = 0
        if len(gain) and gain.max() > best:
            best, f_best, k_best = float(gain.max()), f, int(gain.argmax())
    if f_best < 0:
        return
    above = binned[rows, f_best] > k_best
    for side in (False, True):
        grow(cuts, binned, grad, hess, names, rows[above == side], path | {(names[f_best], side, float(cuts[f_best][k_best]))}, depth - 1, out)


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 5) -> list[Rule]:
    """Paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    total = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    out: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        rows = np.sort(rng.permutation(len(y))[: (len(y) + 1) // 2])
        own: dict[Rule, None] = {}
        grow(cuts, binned, grad, hess, names, rows, frozenset(), DEPTH, own)
        out |= own
        leaves = [r for r in own if not any(r < s for s in own)]
        for rule in leaves:
            there = holds(rule, names, x)
            total[there] -= RATE * grad[there].sum() / (hess[there].sum() + 1.0)
    return list(out)


def lasso(m: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty on standardised columns, by accelerated proximal gradients; weights are for the columns as they are."""
    mean, std = m.mean(0), np.maximum(m.std(0), 1e-3)
    z = ((m - mean) / std).astype(np.float32)
    step = 4 * len(y) / np.linalg.norm(z, 2) ** 2
    w = v = np.zeros(z.shape[1])
    b, t = float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        b -= 2.0 * float((p - y).mean())
        new = v - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_next * (new - w), new, t_next
    w = w / std
    return w, b - float(w @ mean)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(p / (1 - p))))
    columns: dict[bytes, Rule] = {}
    for rule in sorted(tree_rules(x, y, names), key=lambda r: (len(r), sorted(r))):
        there = holds(rule, names, x)
        if there.any() and not there.all():
            columns.setdefault(np.packbits(there).tobytes(), rule)
    rules = list(columns.values())
    if not rules:
        return RuleModel([], float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso(np.column_stack([holds(r, names, x) for r in rules]).astype(np.float32), y)
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9], bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows, chosen by a hash of doc_id; the same rows in every run."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).alias("y"))
    n = known.count()
    key = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    chosen = known.withColumn("key", key).where(F.col("key") < F.lit(int((1 << 30) * min(1.0, 1.1 * most / max(n, 1))))).orderBy("key", "doc_id").limit(most)
    # at most ``most`` rows of three numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    wanted = features()
    got = with_stats(rows, ["doc_id", "y"]).select("doc_id", "y", *(c.alias(k) for k, c in wanted.items())).limit(2 * most).collect()
    got.sort()
    return np.array([r[2:] for r in got], float).reshape(len(got), len(wanted)), np.array([r.y for r in got], float)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``."""
    stats = with_stats(docs, ["doc_id"]).select("doc_id", *(c.alias(k) for k, c in features().items()))
    return stats.select("doc_id", model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_model(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    x, y = labelled_sample(docs, labels.where(fold("doc_id", 3) != 1), "quality")
    scored = score(docs, fit_rules(x, y, list(features())))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
