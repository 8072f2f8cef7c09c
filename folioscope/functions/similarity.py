"""Scoring models as column arithmetic.

Each takes the columns ``tf, dl, df, cf, n_docs, avgdl, sum_dl`` of a matched
term and returns its score.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """The statistics of one matched term."""

    tf: Column
    dl: Column
    df: Column
    cf: Column
    n: Column
    avgdl: Column
    sum_dl: Column

    @staticmethod
    def columns() -> Term:
        return Term(*[F.col(c).cast("double") for c in ("tf", "dl", "df", "cf", "n_docs", "avgdl", "sum_dl")])


Similarity = Callable[[Term], Column]


def idf(t: Term) -> Column:
    return F.log(1 + (t.n - t.df + 0.5) / (t.df + 0.5))


def _saturated(t: Term, k1: float, b: float) -> Column:
    return t.tf * (k1 + 1) / (t.tf + k1 * (1 - b + b * t.dl / t.avgdl))


def _classic_idf(t: Term) -> Column:
    return 1 + F.log(t.n / (t.df + 1))


def bm25(k1: float = 1.2, b: float = 0.75) -> Similarity:
    return lambda t: idf(t) * _saturated(t, k1, b)


def bm25_plus(k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> Similarity:
    return lambda t: idf(t) * (_saturated(t, k1, b) + delta)


def bm25_l(k1: float = 1.2, b: float = 0.75, delta: float = 0.5) -> Similarity:
    return lambda t: idf(t) * (_saturated(t, k1, b) + delta * t.tf / (1 + t.tf))


def tf_idf() -> Similarity:
    return lambda t: F.sqrt(t.tf) * _classic_idf(t) / F.sqrt(t.dl)


def tf_idf_augmented(k: float = 0.5) -> Similarity:
    return lambda t: (k + (1 - k) * t.tf / (t.tf + k)) * _classic_idf(t) / F.sqrt(t.dl)


def tf_idf_double_norm(k: float = 0.5, s: float = 0.2) -> Similarity:
    return lambda t: (k + (1 - k) * t.tf / (t.tf + k)) * _classic_idf(t) / ((1 - s) + s * t.dl / t.avgdl)


def tf_idf_pivoted(s: float = 0.2) -> Similarity:
    return lambda t: F.sqrt(t.tf) * _classic_idf(t) / ((1 - s) + s * t.dl / t.avgdl)


def lm_dirichlet(mu: float = 2000.0) -> Similarity:
    return lambda t: F.log((t.tf + mu * t.cf / t.sum_dl) / (t.dl + mu))


def lm_jelinek_mercer(weight: float = 0.1) -> Similarity:
    return lambda t: F.log((1 - weight) * t.tf / t.dl + weight * t.cf / t.sum_dl)


def lm_absolute_discount(delta: float = 0.7) -> Similarity:
    return lambda t: F.log((F.greatest(t.tf - delta, F.lit(0.0)) + delta * t.dl * t.cf / t.sum_dl) / t.dl)


SIMILARITIES: dict[str, Callable[[], Similarity]] = {
    "bm25": bm25, "bm25_plus": bm25_plus, "bm25_l": bm25_l, "tf_idf": tf_idf, "tf_idf_augmented": tf_idf_augmented,
    "tf_idf_double_norm": tf_idf_double_norm, "tf_idf_pivoted": tf_idf_pivoted, "lm_dirichlet": lm_dirichlet,
    "lm_jelinek_mercer": lm_jelinek_mercer, "lm_absolute_discount": lm_absolute_discount,
}
