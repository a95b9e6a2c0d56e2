"""Quality classification by a sparse ensemble of rules.

Statistics of each whole text feed small boosted trees; every path from a root to a node is a rule, a
conjunction of bounds on statistics. A lasso logistic regression weighs the rules, most to zero, and
the rest is compiled into one Spark column expression over the statistics' columns.

Fitting takes labelled rows up to the bound ``most_rows``; which ones, a hash of the identifier draws.
The statistics cover every row and whole texts.

Cases: a null text is empty; an empty text has statistics of zero and is scored like others; labels
that repeat are averaged and count as 1 from a half on; null labels are left out; without labels of
both kinds the score is the labels' mean, or 0.5 without any; equal texts have equal scores, and repeated
rows are scored each; a row without an identifier has no label to learn from, and is scored like
others; a very long text is measured whole; an empty table gives no rows; other columns are
kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import bounded, fresh, text_buffer
from .byte_cnn import held_out

STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper_share", "digit_share", "space_share", "mark_share", "odd_mark_share",
    "letter_share", "other_share", "distinct_words", "top_word", "marked_words", "upper_words", "repeat_next", "log_lines", "mean_line",
    "distinct_lines", "ended_lines", "pipe_share", "byte_entropy",
)
CLASS = np.zeros(256, np.int8)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 odd mark, 7 beyond ASCII
CLASS[list(range(97, 123))], CLASS[list(range(65, 91))], CLASS[list(range(48, 58))], CLASS[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
CLASS[list(b".,;:?!'\"()-")], CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")], CLASS[128:] = 5, 6, 7


def statistics(text: str, counts: np.ndarray) -> tuple[float, ...]:
    """The statistics of one text whose bytes have these counts."""
    size = int(counts.sum())
    if not size:
        return (0.0,) * len(STATISTICS)
    kinds = np.bincount(CLASS, counts, minlength=8) / size
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    n_lines = max(1, len(lines))
    share = counts[counts > 0] / size
    lengths = [*map(len, words)] or [0]
    return (
        math.log1p(len(text)), math.log1p(len(words)), sum(lengths) / n, float(max(lengths)), kinds[2], kinds[3], kinds[4], kinds[5], kinds[6],
        kinds[1] + kinds[2] + kinds[7], kinds[0], len(seen) / n, max(seen.values(), default=0) / n,
        sum(not w.isalnum() for w in words) / n, sum(map(str.isupper, words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, math.log1p(len(lines)), sum(map(len, lines)) / n_lines,
        len(set(lines)) / n_lines, sum(x[-1] in ".!?\"" for x in lines) / n_lines, counts[124] / n, float(-(share * np.log2(share)).sum()),
    )


def with_statistics(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column, the array of the statistics of each whole text."""
    names = docs.columns
    at = names.index(text_col)
    table = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in rows for i in range(0, len(b), 500)):
            column = batch.column(at)
            data, offsets = text_buffer(column)
            found = [statistics(t or "", np.bincount(data[a:b], minlength=256)) for t, a, b in zip(column.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            values = pa.array(np.array(found, np.float64).reshape(-1).round(6))
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, values)], names=[*names, name])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields]
    return table.mapInArrow(run, ", ".join([*types, f"`{name}` array<double>"]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above the bound, bound), all of which must hold


@dataclass
class Ensemble:
    """Weighed rules; the score is the logistic of their sum."""

    intercept: float
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def column(self, statistics: str) -> Column:
        """The score, from the column that has the array of statistics."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, (F.col(statistics)[s] > b if above else F.col(statistics)[s] <= b for s, above, b in rule))

        total = F.lit(self.intercept)
        for i in range(0, len(self.rules), 16):
            total = total + reduce(lambda a, b: a + b, (F.when(holds(r), w).otherwise(0.0) for w, r in self.rules[i : i + 16]))
        return 1.0 / (1.0 + F.exp(-total))


def bounds(x: np.ndarray, most: int = 24) -> list[np.ndarray]:
    """Candidate bounds of each statistic: midpoints between its quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, most + 2), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def grow(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, chosen: np.ndarray, path: Rule, rules: list[Rule], least: int) -> list[tuple[np.ndarray, float]]:
    """Split rows where the slopes' gain is largest; gathers the paths and returns leaves' rows and values."""
    g, h = slope[rows].sum(), weight[rows].sum()
    leaf = [(rows, g / (h + 1.0))]
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best = (1e-6, -1, -1)
    for s in chosen.tolist():
        n = len(cuts[s]) + 1
        if n < 2:
            continue
        b = bins[rows, s]
        gl = np.cumsum(np.bincount(b, slope[rows], minlength=n))[:-1]
        hl = np.cumsum(np.bincount(b, weight[rows], minlength=n))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=n))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        if gain.size and gain.max() > best[0]:
            best = (float(gain.max()), s, int(gain.argmax()))
    _, s, k = best
    if s < 0:
        return leaf
    low = bins[rows, s] <= k
    out = []
    for side, mine in ((False, rows[low]), (True, rows[~low])):
        longer = (*path, (s, side, float(cuts[s][k])))
        rules.append(longer)
        out += grow(bins, cuts, slope, weight, mine, depth - 1, chosen, longer, rules, least)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[Rule]:
    """Paths of boosted trees, each over some of the statistics."""
    cuts = bounds(x)
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    draw, rules, margin = np.random.default_rng(seed), [], np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        chosen = draw.choice(x.shape[1], max(4, x.shape[1] // 2), replace=False)
        for rows, value in grow(bins, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, chosen, (), rules, max(5, len(y) // 500)):
            margin[rows] += 0.5 * value
    return list(dict.fromkeys(rules))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    for j, rule in enumerate(rules):
        for s, above, b in rule:
            out[:, j] *= x[:, s] > b if above else x[:, s] <= b
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept is not penalised."""
    n, k = a.shape
    full = np.hstack([np.ones((n, 1)), a])
    step = 4 * n / (np.linalg.norm(full, 2) ** 2)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        new = z - step * (full.T @ (1 / (1 + np.exp(-(full @ z))) - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, penalty: float = 5e-4, most_rules: int = 64, seed: int = 5) -> Ensemble:
    """Rules and weights from statistics x and labels y of 0 and 1."""
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Ensemble(math.log(mean / (1 - mean)))
    rules = tree_rules(x, y, trees, depth, seed)
    if not rules:
        return Ensemble(math.log(y.mean() / (1 - y.mean())))
    a = holds(rules, x)
    _, first = a.shape, np.unique(a, axis=1, return_index=True)[1]  # rules that hold for the same rows are one
    rules, a = [rules[j] for j in np.sort(first)], a[:, np.sort(first)]
    _, w = lasso_logistic(a, y, penalty)
    kept = np.argsort(-np.abs(w), kind="stable")[:most_rules]
    kept = np.sort(kept[w[kept] != 0])
    intercept, w = lasso_logistic(a[:, kept], y, penalty / 4)
    return Ensemble(intercept, [(float(v), rules[j]) for v, j in zip(w, kept, strict=True) if v])


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> Ensemble:
    """Fit to the rows of docs that have a label, outside the held-out fold.

    Identifiers are drawn first, so that only the texts of the sample are read by Python.
    """
    named = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where("y is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out())
    ids = texts.select("doc_id").distinct().join(named, F.col("doc_id") == F.col("id")).select("id", "y", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("turn"))
    share = most_rows / max(1, ids.count())  # so that no task or driver holds more than the sample
    drawn = ids.where(F.col("turn") < int(min(1.0, share) * (1 << 30))).orderBy("turn", "id").limit(most_rows)  # bounded by the parameter, 24 bytes a row
    sample = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).withColumn("key", F.xxhash64("text"))
    rows = with_statistics(sample.select("turn", "key", "y", "text"), "st").select("turn", "key", "y", "st").orderBy("turn", "key", "st").limit(most_rows).collect()
    x = np.array([r.st for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r.y for r in rows], np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    bounded(docs.sparkSession)
    model = fit(docs, labels, most_rows=most_rows)
    stats = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "st").drop("text")
    scored = stats.select("doc_id", held_out().alias("held_out"), model.column("st").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, most_rows: int = 20_000) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    bounded(docs.sparkSession)
    model, name = fit(docs, labels, most_rows=most_rows), fresh(docs.columns, "__statistics")
    return with_statistics(docs, name).where(model.column(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
