"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a dozen transformed statistics, computed in Arrow batches
and stored once (about a hundred bytes a document). The fit needs only counts,
sums and cross products of each class, which Spark adds up over every labelled
row; class covariances are shrunk towards their pool and the pool towards a
multiple of the identity. Two Cholesky factors then score every document by
the difference of Mahalanobis log densities.

Defined results: rows without doc_id are left out; null text counts as empty,
and an empty text is scored like any other; documents whose labels contradict
each other or are not 0 or 1 are not fitted on; equal labels count once; with
one class only, or none, the score is the share of label 1, or 0.5; columns
beyond doc_id and text (doc_id and quality) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import materialize

TO_CLASS, TO_SPHERE = 0.15, 0.02
SYMBOLS = "%#*$&@~^<>{}[]\\"
STATS = ("words", "word_length", "upper", "bangs", "bars", "symbols", "digits", "repeats", "distinct", "short", "stops", "worst")
SEGMENT = 50


def _junk(words: list[str]) -> float:
    """Share of words that are bare marks, carry marks of excitement or repeat the one before."""
    odd = sum(w == "|" or w[-1] in "!%#*$&" for w in words)
    return (odd + sum(a == b for a, b in zip(words, words[1:]))) / len(words)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = int(((codes >= 65) & (codes <= 90)).sum() + ((codes >= 192) & (codes <= 222)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    small = lambda x: float(np.log(x + 0.005))  # noqa: E731  shares near 0 differ by ratio
    eased = lambda count, of, usual, weight: small((count + usual * weight) / (of + weight))  # noqa: E731  a few words say little
    return [
        float(np.log1p(n)), float(np.log((chars - n + 1) / n)), eased(upper, chars, 0.03, 50), small(text.count("!") / n), small(text.count("|") / n),
        small(sum(map(text.count, SYMBOLS)) / n), small(digits / (chars + 50)), small(sum(a == b for a, b in zip(words, words[1:])) / n),
        float(np.log(len(set(words)) / n) / np.log(n + 2)), eased(sum(len(w) <= 3 for w in words), n, 0.35, 10), eased(text.count(".") + text.count(","), n, 0.2, 10),
        small(max(_junk(words[i : i + SEGMENT]) for i in range(0, n, SEGMENT))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics...) of every document, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([statistics(t) for t in b["text"]], columns=list(STATS), dtype="float64")
            rows.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield rows

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
    return materialize(docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, schema), "statistics")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def class_moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each class over all fitted rows: two rows reach the driver."""
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    d = len(STATS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(s) for s in STATS] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])) for i, j in pairs]
    found = {}
    for row in stats.where(~held_out(F.col("doc_id"))).join(told, "doc_id").groupBy("quality").agg(F.count("*"), *sums).collect():
        n = float(row[1])
        mean = np.array(row[2 : 2 + d]) / n
        cross = np.zeros((d, d))
        for (i, j), v in zip(pairs, row[2 + d :]):
            cross[i, j] = cross[j, i] = v / n
        found[int(row[0])] = (n, mean, cross - np.outer(mean, mean))
    return found


def discriminant(moments: dict, to_class: float = TO_CLASS, to_sphere: float = TO_SPHERE):
    """(log prior, mean, inverse Cholesky factor, log determinant) of each class, from shrunk covariances."""
    total = sum(m[0] for m in moments.values())
    pool = sum(m[0] / total * m[2] for m in moments.values())
    model = {}
    for k, (n, mean, cov) in moments.items():
        mixed = (1 - to_class) * cov + to_class * pool
        d = len(mean)
        mixed = (1 - to_sphere) * mixed + np.eye(d) * max(to_sphere * np.trace(mixed) / d, 1e-6)
        factor = np.linalg.cholesky(mixed)
        model[k] = (np.log(n / total), mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op4: (doc_id, held_out, score, predicted) of every document."""
    stats = document_statistics(docs)
    moments = class_moments(stats, labels)
    if len(moments) < 2:
        share = F.lit(float(next(iter(moments), 0.5)))
        scored = stats.select("doc_id", share.alias("score"))
    else:
        model = discriminant(moments)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = b[list(STATS)].to_numpy()
                log = {k: p - det - 0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1) for k, (p, mean, inv, det) in model.items()}
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))})

        scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
