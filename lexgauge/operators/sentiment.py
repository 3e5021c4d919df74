"""Sentiment by words that were weighed from labelled documents.

A word's weight is the log-odds ratio of its use in documents of either label,
smoothed by a Dirichlet prior that is the corpus itself: words are expected as
often as they are everywhere, so rare words weigh little until they have shown
a side.  Its z-score tells how sure the weight is, and only sure words count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.operators.classification import known_labels
from lexgauge.operators.content import split_of, terms_of
from lexgauge.session import materialize

#: Words that the prior is worth.
PRIOR = 10_000
#: Standard deviations from which on a word is sure.
SURE = 1.96


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for every word of every document."""
    return docs.select(*keep, F.explode(terms_of(docs["text"])).alias("word"))


def word_weights(docs: DataFrame, labels: DataFrame, label: str = "quality", prior: int = PRIOR) -> DataFrame:
    """Per word of labelled documents of the training split: word, n_1, n_0, weight and z.

    ``n_1`` and ``n_0`` count its occurrences in documents of label 1 and 0;
    weight is above 0 for words of label 1.  Without labelled documents there
    are no words.
    """
    known = known_labels(labels, label).where(split_of(F.col("doc_id")) == "train")
    rows = _words(docs.select("doc_id", "text").join(known, "doc_id"), "label")
    # Counts combine in the tasks, so a frequent word is no burden.
    counted = materialize(
        rows.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("n_1"), F.count_if(F.col("label") == 0).alias("n_0"))
    )
    all_1, all_0 = (counted.agg(F.sum(n)).scalar() for n in ("n_1", "n_0"))
    share = (F.col("n_1") + F.col("n_0")) / (F.col("all_1") + F.col("all_0"))
    totals = counted.withColumn("all_1", all_1).withColumn("all_0", all_0).withColumn("a", prior * share)

    def odds(n: str, total: str) -> Column:
        return F.log((F.col(n) + F.col("a")) / (F.col(total) + prior - F.col(n) - F.col("a")))

    deviation = F.sqrt(1 / (F.col("n_1") + F.col("a")) + 1 / (F.col("n_0") + F.col("a")))
    weighed = totals.withColumn("weight", odds("n_1", "all_1") - odds("n_0", "all_0"))
    return weighed.select(
        "word", "n_1", "n_0", F.round("weight", 6).alias("weight"), F.round(F.col("weight") / deviation, 6).alias("z")
    )


def score(docs: DataFrame, weights: DataFrame, sure: float = SURE) -> DataFrame:
    """Per row: doc_id, hits (occurrences of sure words) and score, their mean weight; 0 without any.

    The sure words are written first: with their size known, a short list is
    broadcast and no text's words are shuffled.  ``doc_id`` should be unique;
    rows that repeat one get the sum of both.
    """
    chosen = materialize(weights.where(F.abs("z") >= sure).select("word", "weight"))
    # Weights have six places: their sum is exact, whatever the order.
    exact = F.sum(F.col("weight").cast("decimal(18,6)")).cast("double")
    hits = _words(docs, "doc_id").join(chosen, "word").groupBy("doc_id").agg(F.count("*").alias("hits"), (exact / F.count("*")).alias("mean"))
    found = hits.withColumnRenamed("doc_id", "_id")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")), "left").select(
        docs["doc_id"], F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("mean", F.lit(0.0)).alias("score")
    )
