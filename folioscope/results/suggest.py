"""Completions and corrections from the terms of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete(term_stats: DataFrame, field: str, prefix: str, n: int = 5) -> DataFrame:
    """``(term, df)``: terms with a prefix, most frequent first."""
    own = term_stats.where((F.col("field") == field) & F.col("term").startswith(prefix))
    return own.select("term", "df").orderBy(F.col("df").desc(), "term").limit(n)


def _trigrams(c):
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3)))))


def correct(term_stats: DataFrame, field: str, words: DataFrame, edits: int = 2, n: int = 5) -> DataFrame:
    """``(word, term, distance, df, score)``: corrections of many words at once.

    A term comes into question when it shares enough trigrams with the word:
    each edit destroys at most three.  Words too short for trigrams, or so
    short that no shared one is needed, are compared by their lengths.  The
    score is df / (1 + distance); a word is no correction of itself.
    """
    words = words.select("word").where("word is not null and word <> ''").distinct()
    own = term_stats.where(F.col("field") == field).select("term", "df")
    grams = _trigrams(F.col("word"))
    asked = words.withColumn("_g", grams).withColumn("_need", F.greatest(F.lit(1), F.size("_g") - 3 * edits))
    long = asked.where(F.length("word") >= 3)
    short = asked.where(F.length("word") < 3).select("word")
    left = long.select("word", "_need", F.explode("_g").alias("g"))
    right = own.where(F.length("term") >= 3).select("term", "df", F.explode(_trigrams(F.col("term"))).alias("g"))
    met = left.join(right, "g").where(F.abs(F.length("term") - F.length("word")) <= edits).groupBy("word", "term", "df", "_need").agg(
        F.count(F.lit(1)).alias("_n")
    )
    pairs = met.where(F.col("_n") >= F.col("_need")).select("word", "term", "df")
    sizes = short.withColumn("_l", F.explode(F.sequence(F.greatest(F.length("word") - edits, F.lit(1)), F.length("word") + edits)))
    brief = sizes.join(own.withColumn("_l", F.length("term")), "_l").select("word", "term", "df")
    scored = (
        pairs.unionByName(brief).where("term <> word")
        .withColumn("distance", F.levenshtein("word", "term", edits)).where("distance >= 0")
        .withColumn("score", F.col("df") / (1 + F.col("distance")))
    )
    order = Window.partitionBy("word").orderBy(F.col("score").desc(), "distance", "term")
    return scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select("word", "term", "distance", "df", "score")
