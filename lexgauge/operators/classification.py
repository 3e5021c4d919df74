"""Document classes by a trained model over hashed words.

The library's only estimator: hashed term frequencies, their inverse document
frequencies and a logistic regression, fitted by Spark over all labelled
documents but for the fold that is held out.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.operators.content import terms_of
from lexgauge.session import materialize

#: Buckets of the hashed words: the model has one coefficient for each, whatever the corpus.
FEATURES = 1 << 16
#: One fold of so many is never fitted on.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that a fit does not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """One label 0 or 1 per doc_id: what most of its rows say, 1 where they are even."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return given.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES) -> PipelineModel:
    """Fit on the labelled documents of the other folds; they need both labels among them.

    Neither source, language nor doc_id is an input of the model.
    """
    known = materialize(known_labels(labels, label).where(~held_out(F.col("doc_id"))))
    rows = docs.select(docs["doc_id"], docs["text"]).join(known, "doc_id").select(terms_of(F.col("text")).alias("terms"), "label")
    hashing = HashingTF(inputCol="terms", outputCol="counts", numFeatures=features)
    # Written, as both fits pass over these rows, the second one many times.
    counted = materialize(hashing.transform(rows).select("counts", "label"))
    # A word of a single document tells nothing of others.
    rarity = IDF(inputCol="counts", outputCol="features", minDocFreq=2).fit(counted)
    regression = LogisticRegression(maxIter=30, regParam=0.02, aggregationDepth=3)
    return PipelineModel([hashing, rarity, regression.fit(rarity.transform(counted))])


def classify(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """Each row's doc_id, held_out, score (of label 1, from 0 to 1) and predicted (1 from one half on).

    Null and empty texts have no words and get the score of none.
    """
    rows = docs.select(docs["doc_id"], terms_of(docs["text"]).alias("terms"))
    score = vector_to_array("probability")[1]
    return model.transform(rows).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def fit_and_write(docs: DataFrame, labels: DataFrame, path: str, label: str = "quality") -> PipelineModel:
    """Fit, write the model under ``path`` and return what is read back from there."""
    fit(docs, labels, label).write().overwrite().save(path)
    return PipelineModel.load(path)


def accuracy(classified: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """On labelled documents, per held_out: documents, share predicted rightly, share of the more frequent label, recall of both labels."""
    rows = classified.join(known_labels(labels, label), "doc_id")
    right = F.col("predicted") == F.col("label")

    def recall(value: int) -> Column:
        return F.count_if(right & (F.col("label") == value)) / F.nullif(F.count_if(F.col("label") == value), F.lit(0))

    return rows.groupBy("held_out").agg(
        F.count("*").alias("documents"),
        (F.count_if(right) / F.count("*")).alias("accuracy"),
        F.greatest(F.avg("label"), 1 - F.avg("label")).alias("majority"),
        recall(1).alias("recall_1"),
        recall(0).alias("recall_0"),
    )
