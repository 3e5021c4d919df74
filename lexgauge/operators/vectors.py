"""Text as sparse TF-IDF vectors, and the nearest labelled centroid of each.

A term is one of ``dims`` buckets by its hash, so a vector has a bounded space
and no dictionary travels.  The fitted weights of the buckets are one array of
``dims`` numbers, whatever the corpus, which every row looks its buckets up in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.operators.content import terms_of
from lexgauge.session import materialize

#: Buckets of the vectors' space; a fitted model holds so many weights.
DIMS = 1 << 18
#: Labels that vectors are held against at a time.
LABELS = 8


def bucket_of(term: Column, dims: int = DIMS) -> Column:
    """The term's bucket: the first 32 bits of its MD5 modulo ``dims``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dims).cast("int")


def term_frequencies(docs: DataFrame, dims: int = DIMS, *keep: str) -> DataFrame:
    """Per document (doc_id, text) its buckets in order with their counts: doc_id, terms array<struct<bucket, n>>, ``keep``.

    Counted inside the row, by the places where the sorted buckets change, so
    that no term is shuffled.  Null, empty and blank texts have no terms.
    """
    # sort_array compares whole numbers itself; array_sort would call a lambda for every comparison.
    ordered = F.sort_array(F.transform(terms_of(docs["text"]), lambda t: bucket_of(t, dims)))
    hashed = docs.select(docs["doc_id"], *(docs[c] for c in keep), ordered.alias("sorted"))
    size = F.size("sorted")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1)))
    rows = hashed.select("doc_id", *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)), "sorted", starts.alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("sorted")))
    counts = F.zip_with("starts", F.slice(ends, F.lit(1), F.size("starts")), lambda a, b: b - a)
    # Zipped from arrays of numbers, as a struct made in a lambda costs more than all the rest.
    counted = rows.withColumn("bucket", F.array_distinct("sorted")).withColumn("n", counts)
    return counted.select("doc_id", F.arrays_zip("bucket", "n").alias("terms"), *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)))


def fit_idf(frequencies: DataFrame) -> DataFrame:
    """Per bucket that occurs: documents that hold it and idf = ln((N + 1) / (documents + 1)).

    Written, as it is the fitted model: at most ``dims`` rows.
    """
    held = frequencies.select(F.explode("terms.bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("documents"))
    total = frequencies.agg(F.count("*")).scalar()
    return materialize(held.withColumn("idf", F.log((total + 1) / (F.col("documents") + 1))))


def _weights(idf: DataFrame, dims: int) -> Column:
    """The weights of all buckets in order, as one value; buckets the fit never saw have the weight 0."""
    every = idf.sparkSession.range(dims).withColumnRenamed("id", "bucket").join(idf, "bucket", "left")
    entry = F.struct("bucket", F.coalesce("idf", F.lit(0.0)).alias("idf"))
    return every.agg(F.sort_array(F.collect_list(entry))["idf"].alias("weights")).scalar()


def vectorize(frequencies: DataFrame, idf: DataFrame, dims: int = DIMS, *keep: str) -> DataFrame:
    """One vector per row: doc_id, terms array<struct<bucket, n, weight>>, ``keep`` and the vector's norm."""
    rows = frequencies.select(
        "doc_id",
        *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)),
        F.col("terms.bucket").alias("bucket"),
        F.col("terms.n").alias("n"),
        _weights(idf, dims).alias("_weights"),
    )
    weighed = rows.withColumn("weight", F.zip_with("bucket", "n", lambda bucket, n: n * F.get("_weights", bucket)))
    squares = F.aggregate("weight", F.lit(0.0), lambda sum_, w: sum_ + w * w)
    return weighed.select(
        "doc_id",
        F.arrays_zip("bucket", "n", "weight").alias("terms"),
        *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)),
        F.sqrt(squares).alias("norm"),
    )


def text_vectors(docs: DataFrame, dims: int = DIMS, *keep: str) -> DataFrame:
    """Vectors of all documents under weights fitted on all of them; the counted terms are written once."""
    frequencies = materialize(term_frequencies(docs, dims, *keep))
    return vectorize(frequencies, fit_idf(frequencies), dims, *keep)


def labelled_vectors(docs: DataFrame, label: str, dims: int = DIMS) -> DataFrame:
    """The vectors joined with (doc_id, label) of the documents, written once.

    A row takes its own label along, so that no vector is shuffled; only the
    rows whose doc_id repeats meet the labels of all rows with that doc_id.
    Rows without doc_id meet none.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", F.col(label).alias("_other"))
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id")
    # Written, so that the planner knows how few they are.
    others = materialize(known.join(repeated, "doc_id", "left_semi").withColumn("_met", F.lit(True)))
    own = text_vectors(docs, dims, label).where("doc_id IS NOT NULL").join(others, "doc_id", "left")
    met = F.when(F.col("_met"), F.col("_other")).otherwise(F.col(label))
    return materialize(own.select("doc_id", "terms", "norm", met.alias(label)))


def _parts(vectors: DataFrame, *keep: str) -> DataFrame:
    """A row per vector and bucket with the weight at length one; vectors without length have none."""
    rows = vectors.where("norm > 0").select(*keep, "norm", F.explode("terms").alias("t"))
    return rows.select(*keep, "t.bucket", (F.col("t.weight") / F.col("norm")).alias("w"))


def label_centroids(vectors: DataFrame, label: str) -> DataFrame:
    """Mean direction of every label as (label, bucket, mean, vectors); rows without a label are left out.

    Sums combine in the tasks, so a label with most of the rows is no burden.
    """
    known = vectors.where(F.col(label).isNotNull() & (F.col("norm") > 0))
    sizes = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("vectors"))
    sums = _parts(known, label).groupBy(F.col(label).alias("label"), "bucket").agg(F.sum("w").alias("sum"))
    return sums.join(sizes, "label").select("label", "bucket", F.round(F.col("sum") / F.col("vectors"), 9).alias("mean"), "vectors")


def _directions(centroids: DataFrame, block: list[tuple]) -> DataFrame:
    """Per bucket the labels' mean directions at length one, a column for each (label, length); NULL where a label lacks the bucket."""
    held = centroids.where(F.col("label").isin([label for label, _ in block]))
    parts = (F.max(F.when(F.col("label") == F.lit(label), F.col("mean") / F.lit(length))) for label, length in block)
    return held.groupBy("bucket").agg(*(c.alias(f"_c{k}") for k, c in enumerate(parts)))


def _block_best(rows: DataFrame, centroids: DataFrame, block: list[tuple], kind: str, begin: int) -> DataFrame:
    """Per ``_row`` the best label of a block as ``best`` (cosine, order, label); NULL where the row meets none."""
    parts = rows.select("_row", "_key", "norm", F.explode_outer(F.when(F.col("norm") > 0, F.col("terms"))).alias("t"))
    parts = parts.select("_row", "_key", "t.bucket", (F.col("t.weight") / F.col("norm")).alias("w"))
    # A row per bucket of the space, whatever the corpus.
    met = parts.join(F.broadcast(_directions(centroids, block)), "bucket", "left")
    sums = met.groupBy("_row", "_key").agg(*(F.round(F.sum(F.col("w") * F.col(f"_c{k}")), 6).alias(f"_s{k}") for k in range(len(block))))
    found = (
        F.when(
            F.col(f"_s{k}").isNotNull(),
            F.struct(F.col(f"_s{k}").alias("cosine"), F.lit(-begin - k).alias("order"), F.lit(label).cast(kind).alias("label")),
        )
        for k, (label, _) in enumerate(block)
    )
    return sums.select("_row", "_key", F.array_max(F.array(*found)).alias("best"))


def nearest_label(vectors: DataFrame, centroids: DataFrame, dims: int = DIMS, key: str = "doc_id") -> DataFrame:
    """Per vector the label of smallest angle and the cosine; ties go to the smaller label.

    ``LABELS`` labels at a time are held against every vector: one row per
    bucket of the space goes to the tasks, a vector's terms are looked up in it
    and add up where they are, so one row per vector is shuffled and what a
    task receives does not grow with the corpus.  The names and lengths of the
    labels pass through the driver.  Vectors that share no bucket with any
    label, or have no length, have neither label nor cosine.
    """
    centroids = materialize(centroids)
    kind = dict(centroids.dtypes)["label"]
    squares = centroids.groupBy("label").agg(F.sum(F.col("mean") * F.col("mean")).alias("s")).where("s > 0")
    lengths = sorted(squares.select("label", F.sqrt("s")).collect())
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), "terms", "norm")
    if not lengths:
        none = F.lit(None)
        return rows.select(F.col("_key").alias(key), none.cast(kind).alias("nearest"), none.cast("double").alias("cosine"))
    if len(lengths) > LABELS:
        # Every block must number the rows alike.
        rows = materialize(rows)
    blocks = [
        _block_best(rows, centroids, [tuple(r) for r in lengths[begin : begin + LABELS]], kind, begin)
        for begin in range(0, len(lengths), LABELS)
    ]
    best = blocks[0]
    if len(blocks) > 1:
        best = reduce(DataFrame.unionByName, blocks).groupBy("_row", "_key").agg(F.max("best").alias("best"))
    return best.select(F.col("_key").alias(key), F.col("best.label").alias("nearest"), F.col("best.cosine").alias("cosine"))
