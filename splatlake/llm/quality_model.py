"""Document quality by Bradley-Terry pairwise ranking.

A text's strength is linear in features of its whole text. Of a preference pair (a text labelled 1 and one labelled 0)
the first wins with probability sigmoid(strength difference); the weights minimise the logistic loss on feature
differences, with a small ridge. The threshold is the quantile of the strengths of all labelled texts that may be learned
from that leaves their share of zeros below it. score = sigmoid(strength - threshold), so that score >= 0.5 is the prediction 1.

The fit uses a Bernoulli sample of labelled rows, ``SAMPLE`` on average, and ``PAIRS`` pairs among them. Features are
computed once for all rows and written to the shared checkpoint folder; scoring is a plain expression over them.

Defined results: null texts are like empty ones (all features 0) and get a score; without labels of both kinds every
score is 0.5. Rows labelled both 0 and 1, null labels and null ids teach nothing. Repeated rows get equal scores; other
columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import nth
from .quality_rules import Stats
from .shared import cut, slices

#: Labelled rows that the weights are fitted on, on average, and preference pairs among them.
SAMPLE = 6000
PAIRS = 40_000
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
FEATURES = ("log_words", "word_length", "symbols", "upper", "cries", "stutter", "repeated", "repeated_lines", "letters", "punctuation", "digits", "distinct", "line_words")


def features(texts: pa.Array) -> np.ndarray:
    """Texts x FEATURES, all finite."""
    s, w = Stats(texts), None
    w = s.w
    n = np.maximum(s.get("n_words"), 1)
    chars = np.maximum(s.get("word_chars"), 1)
    lines = 1 + w.per_text(w.data == 10)
    # distinct words of each text
    key = np.lexsort((w.hash, w.doc))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (w.hash[key][1:] != w.hash[key][:-1]) | (w.doc[key][1:] != w.doc[key][:-1])
    distinct = np.bincount(w.doc[key][fresh], minlength=w.n)
    out = np.stack(
        [
            np.log1p(s.get("n_words")),
            s.get("word_chars") / n,
            s.get("n_symbols") / n,
            s.get("n_upper") / chars,
            s.get("n_cries") / n,
            s.get("n_stutters") / n,
            s.get("n_repeat_words") / n,
            s.get("n_dup_lines") / lines,
            s.get("n_letters") / chars,
            w.per_text(_PUNCTUATION[w.data]) / n,
            w.per_text(_DIGIT[w.data]) / chars,
            distinct / n,
            np.log1p(n / lines),
        ],
        1,
    ).astype(np.float64)
    out[s.get("n_words") == 0] = 0
    return out


def featurize(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(1)):
                x = features(batch.column(1).slice(i, j - i))
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=[id_column, "features"])

    return docs.select(id_column, "text").mapInArrow(run, f"{id_column} {kind}, features array<double>")


def bradley_terry(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton steps on the mean logistic loss of feature differences."""
    rng = np.random.default_rng(7)
    d = good[rng.integers(len(good), size=pairs)] - poor[rng.integers(len(poor), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = -(d * p[:, None]).mean(0) + ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    return mean, scale, bradley_terry(z[y == 1], z[y == 0])


def score(docs: DataFrame, labels: DataFrame, learns: Column, id_column: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``id_column``, score and predicted; ``learns`` marks the label rows that may be learned from."""
    known = labels.where(learns & F.col(id_column).isNotNull() & F.col("quality").isNotNull()).groupBy(id_column).agg(F.min("quality").alias("y"), F.max("quality").alias("__most")).where("y = __most").drop("__most")
    known = known.withColumn("draw", F.pmod(F.xxhash64(id_column, F.lit("quality sample")), F.lit(1_000_003)))
    n = known.count()
    table = cut(featurize(docs, id_column))
    # texts that share an id teach once
    taught = cut(table.join(known, id_column).groupBy(id_column, "y", "draw").agg(F.min("features").alias("features")))
    rows = taught.where(F.col("draw") < 1_000_003.0 * sample / max(n, 1)).orderBy(id_column).select("features", "y").toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy()
    if not ((y == 1).any() and (y == 0).any()):
        return table.select(id_column, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, scale, w = fit(x, y)
    strength = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = (F.col("features")[i] - float(mean[i])) / float(scale[i])
        strength = strength + F.lit(float(w[i])) * F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))
    # the threshold is of all labels that may be learned from
    strengths = cut(taught.select(strength.alias("strength"), "y"))
    zeros, all_ = (strengths.where(c).count() for c in ("y = 0", "true"))
    below, above = nth(strengths, "strength", [max(zeros - 1, 0), min(zeros, all_ - 1)])
    gap = strength - (below + above) / 2
    out = 1 / (1 + F.exp(-F.greatest(F.least(gap, F.lit(30.0)), F.lit(-30.0))))
    return table.select(id_column, out.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
