"""Quality classifier: a sparse ensemble of rules.

Shallow regression trees are boosted on statistics of the labelled texts; every
path from a root is a conjunctive rule.  A logistic model over the rules is
fitted with a lasso penalty, which leaves a few, and these are compiled into
one Spark column expression over native statistics of the text.

Labels are learnt from at most MAX_ROWS labelled documents, chosen by hash of
their id among those outside the held-out fold.

Defined cases: a null or blank text has statistics of 0 and is scored like any
other; labels other than 0 and 1 are passed over; a document labelled twice
counts with the rounded mean; without labels of both kinds the score is the
labels' mean, or 0.5; a document without an id is held out and learns nothing;
repeated rows are scored each; texts may be of any length; columns of other
names are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import rules
from lexmill.llm.common import held, table

MAX_ROWS = 12_000
FOLDS, CUTOFF = 5, 0.3
TREES, DEPTH, BINS, LEAST_LEAF, RATE = 24, 3, 32, 12, 0.3
PENALTY, STEPS = 2e-4, 400

STATISTICS = ("words", "chars_per_word", "symbols_per_word", "dup_lines", "repeats", "stutters", "words_per_line", "bangs", "capitals", "digits", "stops", "distinct")


def fold(id_col: Column) -> Column:
    """A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_x`` of the STATISTICS, as doubles."""
    q = rules.measured(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, chars, lines = (F.greatest(F.col(f"_q.{c}"), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    values = {
        "words": F.log1p("_q.n_words"),
        "chars_per_word": F.col("_q.word_chars") / words,
        "symbols_per_word": F.col("_q.n_symbols") / words,
        "dup_lines": F.col("_q.n_dup_lines") / lines,
        "repeats": F.col("_q.n_repeat_words") / words,
        "stutters": F.col("_q.n_stutters") / words,
        "words_per_line": F.col("_q.n_words") / lines,
        "bangs": F.regexp_count(text, F.lit("[!?]")) / words,
        "capitals": F.regexp_count(text, F.lit("\\p{Lu}")) / chars,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "stops": F.regexp_count(text, F.lit("[.,;:]")) / words,
        "distinct": F.size(F.array_distinct(F.split(F.lower(text), f"{rules.SPACE}+"))) / words,
    }
    return q.withColumn("_x", F.struct(*(values[s].cast("double").alias(s) for s in STATISTICS))).select(*(F.col(f"`{c}`") for c in docs.columns), "_q", "_x")


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) each


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, x: str = "_x") -> Column:
        """The score as a column expression."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for s, above, t in rule:
                value = F.col(f"{x}.{STATISTICS[s]}")
                holds = holds & ((value > t) if above else (value <= t))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + holding([r for r, _ in self.rules], x) @ np.array([w for _, w in self.rules])))) if self.rules else np.full(len(x), 1 / (1 + np.exp(-self.bias)))


def holding(found: list[Rule], x: np.ndarray) -> np.ndarray:
    """Rows x rules: 1 where a rule holds."""
    out = np.ones((len(x), len(found)), np.float32)
    for k, rule in enumerate(found):
        for s, above, t in rule:
            out[:, k] *= (x[:, s] > t) if above else (x[:, s] <= t)
    return out


def grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A regression tree: the rules of all its nodes but the root, and its predictions."""
    out, value = [], np.zeros(len(x))
    work: list[tuple[np.ndarray, Rule]] = [(np.arange(len(x)), ())]
    while work:
        rows, rule = work.pop()
        if rule:
            out.append(rule)
        mean = target[rows].mean()
        value[rows] = mean
        if len(rule) == DEPTH or rows.size < 2 * LEAST_LEAF:
            continue
        best = (1e-9, -1, 0)
        for s, edges in enumerate(cuts):
            if not edges.size:
                continue
            n = np.cumsum(np.bincount(bins[rows, s], minlength=edges.size + 1))[:-1]
            total = np.cumsum(np.bincount(bins[rows, s], weights=target[rows] - mean, minlength=edges.size + 1))[:-1]
            good = (n >= LEAST_LEAF) & (rows.size - n >= LEAST_LEAF)
            gain = np.where(good, total**2 * (1 / np.maximum(n, 1) + 1 / np.maximum(rows.size - n, 1)), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), s, k)
        if best[1] < 0:
            continue
        _, s, k = best
        above = bins[rows, s] > k
        work += [(rows[above], (*rule, (s, True, float(cuts[s][k])))), (rows[~above], (*rule, (s, False, float(cuts[s][k]))))]
    return out, value


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Boosted trees for the rules, then a logistic lasso over them by accelerated proximal steps."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        return Ensemble(float(np.log(share / (1 - share))), ())
    cuts = []
    for s in range(x.shape[1]):
        # Halfway between neighbours, so that no threshold is a value itself.
        values = np.unique(x[:, s])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(np.unique(middles[np.linspace(0, middles.size - 1, min(BINS, middles.size)).astype(int)]) if middles.size <= BINS else np.unique(middles[np.searchsorted(values[1:], np.quantile(x[:, s], np.linspace(0.01, 0.99, BINS))).clip(0, middles.size - 1)]))
    bins = np.stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)], axis=1)
    log_odds, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-log_odds))
        more, value = grow(x, bins, cuts, (y - p) / np.maximum(p * (1 - p), 0.05))
        log_odds = log_odds + RATE * np.clip(value, -4, 4)
        found |= dict.fromkeys(tuple(sorted(r)) for r in more)
    rule_list = list(found)
    h = holding(rule_list, x)
    h, mean = h - h.mean(0), h.mean(0)
    scale = np.maximum(np.sqrt((h**2).mean(0)), 1e-3)
    h = h / scale
    rate = 4 * len(y) / max(1e-9, float(np.linalg.norm(h.T @ h, 2)))
    w, b = np.zeros(h.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(b + h @ v)))
        new = v - rate * (h.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
        b -= float((p - y).mean() * 2)
    keep = np.flatnonzero(w)
    weights = w / scale
    return Ensemble(b - float((weights * mean).sum()), tuple((rule_list[k], float(weights[k])) for k in keep.tolist()))


def training(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample; at most ``most`` ids are sent out and come back."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0))
    chosen = chosen.groupBy("_id").agg(F.round(F.avg("_y")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most MAX_ROWS ids
    rows = statistics(rows.select("_doc", "_y", "_text"), "_text").dropDuplicates(["_doc"]).select("_y", *(f"_x.{s}" for s in STATISTICS)).toPandas()
    return rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float)


def score(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_score``."""
    out = statistics(held(docs, _text=text_col), "_text")
    return out.withColumn("_score", model.column()).select("_row.*", "_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*training(docs, table(spark, sf_dir, "labels")))
    scored = score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


