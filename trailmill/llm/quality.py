"""Operator 3: a quality classifier that is a sparse ensemble of rules.

Statistics of a text (shares of characters and words; no label, language, source
or id) are Spark columns. On a bounded sample of labelled rows, boosted trees of
small depth are grown; every path from a root is a rule, a conjunction of
conditions on statistics. A logistic regression with a lasso penalty over all
rules leaves few of them. Those are compiled into one Spark column, so scoring
is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000  # labelled rows that a model is fitted on, at most
TREES, DEPTH, BINS, LEAST = 24, 3, 24, 12
LASSO = 0.002
STEPS = 400


def _bind(values: dict[str, Column], then) -> Column:
    """`then` of the values, each computed once however often it is used; where the optimizer puts the result does not matter."""
    one = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.element_at(F.transform(one, lambda s: then({n: s[n] for n in values})), 1)


def statistics(text: Column, then) -> Column:
    """`then` of the statistics of a text by name; all are 0 for null and empty texts, none is null."""
    text = F.coalesce(text, F.lit(""))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def shares(v: dict[str, Column]) -> Column:
        t, chars, n_words = v["text"], v["chars"], v["n_words"]
        kept = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
        without = lambda some: F.length(F.translate(t, some, ""))
        stats = {
            "log_chars": F.log1p(chars.cast("double")),
            "upper": over(chars - kept(r"[A-ZÀ-ÖØ-Þ]+"), chars),
            "marks": over(chars - kept(r"[^\p{L}\p{N}\s.,;:'\"()?-]+"), chars),
            "stops": over(chars - without(".,;:?"), chars),
            "digits": over(chars - without("0123456789"), chars),
            "lines": over(chars - without("\n"), n_words),
            "word_length": over(chars, n_words),
            "distinct": over(v["n_distinct"], n_words),
            "distinct_root": over(v["n_distinct"], F.sqrt(n_words)),
        }
        return _bind(stats, then)

    words = F.split(F.trim(F.regexp_replace(text, r"[\x09-\x0D]", " ")), " +")
    count = lambda v: _bind({"text": v["text"], "chars": F.length(v["text"]), "n_words": F.size(v["words"]), "n_distinct": F.size(F.array_distinct(v["words"]))}, shares)
    return _bind({"text": text, "words": words}, count)


NAMES = tuple(["log_chars", "upper", "marks", "stops", "digits", "lines", "word_length", "distinct", "distinct_root"])
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """A bias and weighted rules; a rule is conditions (statistic, over, bound), all of which must hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as one column expression."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = None
            for stat, over, bound in rule:
                one = stats[NAMES[stat]] > bound if over else stats[NAMES[stat]] <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Rules of all nodes of one tree of second-order boosting, and the tree's output for each row."""
    rules: list[Rule] = []
    output = np.zeros(len(gradient))

    def grow(rows: np.ndarray, rule: Rule) -> None:
        g, h = gradient[rows], hessian[rows]
        total_g, total_h = g.sum(), h.sum()
        if rule:
            rules.append(rule)
        best = (1e-6, -1, -1)
        if len(rule) < DEPTH and len(rows) >= 2 * LEAST:
            for s in range(bins.shape[1]):
                b = bins[rows, s]
                n = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
                gl = np.cumsum(np.bincount(b, g, BINS + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, BINS + 1))[:-1]
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] and k < len(edges[s]):
                    best = (float(gain[k]), s, k)
        if best[1] < 0:
            output[rows] = -total_g / (total_h + 1)
            return
        _, s, k = best
        low = bins[rows, s] <= k
        grow(rows[low], (*rule, (s, False, float(edges[s][k]))))
        grow(rows[~low], (*rule, (s, True, float(edges[s][k]))))

    grow(np.arange(len(gradient)), ())
    return rules, output


def _simple(rule: Rule) -> Rule:
    """The rule without conditions that others of it imply, in one order."""
    tight: dict[tuple[int, bool], float] = {}
    for stat, over, bound in rule:
        old = tight.get((stat, over))
        tight[(stat, over)] = bound if old is None else max(old, bound) if over else min(old, bound)
    return tuple((s, o, b) for (s, o), b in sorted(tight.items()))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, over, bound in rule:
        out &= (x[:, stat] > bound) == over
    return out


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble of labelled statistics. One label only, or no rows, gives the share of label 1 (no rows: one half)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(x[:, s], np.arange(1, BINS) / BINS, method="lower")) for s in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, s], side="left") for s, e in enumerate(edges)], 1)
    rules: dict[Rule, None] = {}
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, output = _tree(bins, edges, p - y, p * (1 - p))
        margin += 0.3 * output
        rules |= dict.fromkeys(map(_simple, found))
    names = list(rules)
    held = np.stack([_holds(x, r) for r in names], 1).astype(np.float32) if names else np.zeros((len(y), 0), np.float32)
    _, first = np.unique(held, axis=1, return_index=True)
    names, held = [names[i] for i in sorted(first)], held[:, sorted(first)]
    # Lasso: proximal gradient with momentum on the logistic loss; the bias is free.
    step = 4 / (held.shape[1] * float((held**2).mean()) + 1) if held.size else 1.0
    w = v = np.zeros(held.shape[1])
    bias = vb = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(held @ v.astype(np.float32) + vb))) - y
        new = v - step * (error.astype(np.float32) @ held) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_bias = vb - step * error.mean()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(bias), tuple((names[i], float(w[i])) for i in kept))


def held_out(id_column: Column) -> Column:
    """True for the rows that labels are never learnt from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE_ROWS) -> RuleEnsemble:
    """The ensemble fitted on at most `most` labelled rows that are not held out.

    They are the ones of smallest hash of their id, so the sample does not depend
    on the order of rows. Rows without label, with another label than 0 or 1 or
    without a document don't count; an id that is labelled twice counts once (as 1
    if the labels differ), and so does a document that stands there twice (with the
    smallest of its statistics).
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_column))).groupBy(F.col(id_column).alias("__id")).agg(F.max(label).alias("__label"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(most)  # `most` rows: safe to broadcast
    stats = statistics(F.col(f"`{text}`"), lambda v: F.struct(*[v[n].alias(n) for n in NAMES]))
    rows = docs.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`")).join(F.broadcast(chosen), "__id").select("__id", "__label", stats.alias("s")).groupBy("__id").agg(F.first("__label").alias("__label"), F.min("s").alias("s")).select("__id", "__label", "s.*")
    data = np.array([tuple(r) for r in sorted(rows.collect(), key=tuple)], float).reshape(-1, 2 + len(NAMES))
    return fit_rules(data[:, 2:], data[:, 1])


def with_score(docs: DataFrame, model: RuleEnsemble, text: str = "text", column: str = "score") -> DataFrame:
    """The frame with the model's score of each whole text; a column named like `column` is replaced. Null and empty texts are scored as empty, repeated rows each, equal texts alike; a very long text is one row's work. An empty table stays empty."""
    # A column that can't be null needs no second evaluation to test for it in a filter.
    return docs.withColumn(column, F.coalesce(statistics(F.col(f"`{text}`"), model.score), F.lit(0.0)))
