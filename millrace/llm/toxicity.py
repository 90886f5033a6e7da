"""Toxicity: a cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(threshold_k - score) with increasing thresholds and one weight for each
feature, shared by all thresholds. The expected severity is the sum of P(grade >= k).

Features are words (letters only, in lower case) and their beginnings of 5, 6 and 7 letters; a
feature's value in a text is its count in 100 words (of texts under 50 words: in 50). Labels only
tell toxic from not toxic. Grade 0 is not toxic; toxic texts get grade 1 to 3 by thirds of the
weight of features that are significantly more frequent in toxic texts.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of the id. Feature
statistics of the sample are aggregated by Spark; the driver gets the ``FEATURES`` best ones and
the sample's values for those. All documents are scored, each over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import blocks, numbered, split_words, text_of

SAMPLE = 20_000
FEATURES = 3_000
PREFIXES = (5, 6, 7)
GRADES = 3
SIGNIFICANT = 3.0                   # standard errors; features below are left out
LEAST_WORDS = 50
STEPS, RATE, PENALTY = 500, 0.1, 1e-5


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]         # increasing, one for each grade above 0


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of all words, the different words, and each text's bounds."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    flat, bounds = split_words(letters)
    numbers, different = numbered(flat)
    return numbers, different, bounds


def features_of(word: str) -> list[str]:
    """A word as itself, and its beginnings marked by a hyphen."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def _values(docs: DataFrame) -> DataFrame:
    """``doc_id, feature, value`` of every feature that occurs in a text."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, part in blocks(text_of(batch), 2 << 20):
                numbers, different, bounds = _words(part)
                names = [features_of(w) for w in different.to_pylist()]
                rows: tuple[list, list, list] = ([], [], [])
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    found: dict[str, int] = {}
                    for word, n in zip(*np.unique(numbers[a:b], return_counts=True)):
                        for f in names[word]:
                            found[f] = found.get(f, 0) + int(n)
                    rows[0].extend([ids[first + k]] * len(found))
                    rows[1].extend(found)
                    rows[2].extend(100 * n / max(b - a, LEAST_WORDS) for n in found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                     pa.array(rows[2], pa.float64())], names=["doc_id", "feature", "value"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, feature string, value double")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray,
                n_columns: int, n_grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log likelihood, by Adam.

    The matrix is given by its entries. Thresholds are a first one and positive steps, so they
    stay increasing. Grades that do not occur are allowed.
    """
    n = len(grades)
    w = np.zeros(n_columns)
    share = [max(0.5, (grades < k).sum()) / (n + 1) for k in range(1, n_grades + 1)]
    start = np.log(np.array(share) / (1 - np.array(share)))
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    p = np.concatenate([w, t])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, t = p[:n_columns], p[n_columns:]
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        score = np.bincount(rows, values * w[columns], minlength=n)
        upper = np.where(grades < n_grades, theta[np.minimum(grades, n_grades - 1)], np.inf)
        lower = np.where(grades > 0, theta[np.maximum(grades - 1, 0)], -np.inf)
        up = np.where(np.isinf(upper), 1.0, _sigmoid(np.where(np.isinf(upper), 0, upper) - score))
        low = np.where(np.isinf(lower), 0.0, _sigmoid(np.where(np.isinf(lower), 0, lower) - score))
        chance = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        d_score = (d_up - d_low) / n                # of the negative log likelihood
        g_w = np.bincount(columns, values * d_score[rows], minlength=n_columns) + PENALTY * w
        g_theta = np.array([(-d_up[grades == k].sum() + d_low[grades == k + 1].sum()) / n
                            for k in range(n_grades)])
        tail = np.cumsum(g_theta[::-1])[::-1]       # a step moves all thresholds after it
        g_t = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
        g = np.concatenate([g_w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    t = p[n_columns:]
    return p[:n_columns], np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from ``labels`` (``doc_id, toxic``; rows with a null are left out).

    Of several labels of one id the largest counts. Without both toxic and other texts nothing
    can be learned: the model then has no features and finds nothing toxic.
    """
    rated = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    sample = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")   # SAMPLE ids
    values = _values(sample).join(F.broadcast(rated), "doc_id")
    counts = {bool(r["toxic"]): r["n"] for r in
              rated.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic or not n_other:                  # nothing to tell apart
        return Model({}, [1.0, 2.0, 3.0])
    p, q = F.col("toxic_docs") / n_toxic, F.col("other_docs") / n_other
    pooled = (F.col("toxic_docs") + F.col("other_docs") + 1) / (n_toxic + n_other + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_other))
    best = (values.groupBy("feature").agg(
        F.count_if(F.col("toxic") > 0).alias("toxic_docs"),
        F.count_if(F.col("toxic") <= 0).alias("other_docs"))
        .where("toxic_docs + other_docs >= 3").withColumn("z", z)
        .where(F.abs("z") >= SIGNIFICANT)
        .orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect())
    index = {r["feature"]: k for k, r in enumerate(best)}
    names = values.sparkSession.createDataFrame([(f,) for f in index], "feature string")
    table = values.join(F.broadcast(names), "feature").select(
        "doc_id", "feature", "value").toArrow()
    toxic = {r["doc_id"]: r["toxic"] > 0 for r in rated.collect()}
    row_of = {d: k for k, d in enumerate(sorted(toxic))}
    rows = np.fromiter((row_of[d] for d in table["doc_id"].to_pylist()), np.int64, len(table))
    columns = np.fromiter((index[f] for f in table["feature"].to_pylist()), np.int64, len(table))
    x = table["value"].to_numpy()
    order = np.lexsort((columns, rows))             # the same sums however rows arrive
    rows, columns, x = rows[order], columns[order], x[order]
    strong = np.array([max(0.0, r["z"]) for r in best])
    evidence = np.bincount(rows, x * strong[columns], minlength=len(row_of))
    is_toxic = np.array([toxic[d] for d in sorted(toxic)])
    cuts = np.quantile(evidence[is_toxic], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(is_toxic, 1 + np.searchsorted(cuts, evidence), 0)
    weights, thresholds = fit_ordinal(rows, columns, x, grades, len(best))
    return Model({f: float(weights[k]) for f, k in index.items()}, thresholds.tolist())


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The linear score of each text; 0 without words."""
    numbers, different, bounds = _words(texts)
    each = np.array([sum(model.weights.get(f, 0.0) for f in features_of(w))
                     for w in different.to_pylist()] or [0.0])
    totals = np.concatenate([[0.0], np.cumsum(each[numbers])]) if len(numbers) else np.zeros(1)
    return 100 * (totals[bounds[1:]] - totals[bounds[:-1]]) / np.maximum(np.diff(bounds), LEAST_WORDS)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, P(grade >= 1..3), expected severity, most likely grade and ``toxic``.

    One row for each row; null texts have no words and get the model's base rates. ``toxic`` is
    P(grade >= 1) >= 0.5. Only ``doc_id`` and ``text`` are used.
    """
    theta = np.array(model.thresholds)

    def run(batches):
        for batch in batches:
            s = np.concatenate([scores(part, model) for _, part in blocks(text_of(batch), 4 << 20)]
                               or [np.zeros(0)])
            at_least = _sigmoid(s[:, None] - theta)
            each = -np.diff(np.column_stack([np.ones(len(s)), at_least, np.zeros(len(s))]), axis=1)
            columns = [*at_least.T, at_least.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.round(9)) for c in columns),
                 pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(at_least[:, 0] >= 0.5)],
                names=["doc_id", "p1", "p2", "p3", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, p1 double, p2 double, p3 double, severity double, grade int, "
             "toxic boolean")
