"""Mix sources to target weights by raking (iterative proportional fitting).

Every document belongs to a cell: its source, language and topic.  Raking
scales the cells' token counts until their sums over each of the three
dimensions meet target shares, changing nothing else about how the dimensions
go together.  A cell's weight over its tokens, times the size of the sample, is
the probability of its documents, at most 1, so none is repeated.  A document
is taken when its own hash is below the probability.

Built-in functions only.  The token counts combine inside the tasks, so that
each cell is one row; every category has a target of its own by default, however
many there are.  Raking sums the cells by groups and joins the sums back, so no
task sees all cells, nor all cells of a common language.
Null source, language or topic count as the empty string; a null text has no
tokens and stays with the probability of its cell; repeated rows share their
hash, rows without doc_id are told apart by their text; an empty table gives
an empty result.  Cells without tokens have probability 0.  Other columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.llm.common import packed, split_words, unit_hash
from lexgauge.session import materialize

DIMENSIONS = ("source", "lang", "topic")
#: The category of a target that stands for all values without a target of their own.
OTHER = "*"


def topic_of(text: Column) -> Column:
    """A form of text as a stand-in for a topic model: table, marked, spoken numbers or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike("[#*$%&]{3}"), "marked")
        .when(text.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``row``, the three dimensions and the number of words of each document."""
    rows = packed(docs)
    text = F.col("row.text")
    return rows.select(
        "row",
        F.coalesce("row.source", F.lit("")).alias("source"),
        F.coalesce("row.lang", F.lit("")).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        F.size(split_words(text)).cast("bigint").alias("tokens"),
    )


def tempered_targets(counts: DataFrame, temper: float = 0.7) -> DataFrame:
    """Targets (dimension, category, share) from the data itself: shares to the power ``temper``.

    A power under 1 moves weight from large categories to small ones.  Every
    category with tokens has its own target.
    """
    each = counts.select(
        "tokens", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in DIMENSIONS))).alias("x")
    ).select("x.*", "tokens")
    summed = each.groupBy("dimension", "category").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    powered = summed.select("dimension", "category", F.pow("tokens", F.lit(temper)).alias("power"))
    whole = powered.groupBy("dimension").agg(F.sum("power").alias("whole"))
    return powered.join(whole, "dimension").select("dimension", "category", (F.col("power") / F.col("whole")).alias("share"))


def _with_categories(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the category of each dimension: its own value where that has a target, else ``OTHER``."""
    for d in DIMENSIONS:
        own = targets.where(F.col("dimension") == d).select(F.col("category").alias(d), F.col("category").alias(f"k_{d}"))
        rows = rows.join(own, d, "left").withColumn(f"k_{d}", F.coalesce(f"k_{d}", F.lit(OTHER)))
    return rows


def raked(counts: DataFrame, targets: DataFrame, rounds: int = 20, budget: float | None = None) -> DataFrame:
    """Category cells (k_source, k_lang, k_topic) with tokens, raked weight and sampling probability.

    Each scaling sums the weights by category and joins the sums back; the
    cells are written after every round, so that plans stay short.  A dimension
    keeps the weights of a category without a target.
    """
    keys = [f"k_{d}" for d in DIMENSIONS]
    cells = _with_categories(counts, targets).groupBy(*keys).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    for d in DIMENSIONS:
        share = targets.where(F.col("dimension") == d).select(F.col("category").alias(f"k_{d}"), F.col("share").alias(f"share_{d}"))
        cells = cells.join(share, f"k_{d}", "left")
    cells = materialize(cells)
    total = cells.agg(F.sum("tokens")).first()[0]
    if total is None:
        return cells.select(*keys, "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("p"))
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for _ in range(rounds):
        for d in DIMENSIONS:
            reached = cells.groupBy(f"k_{d}").agg(F.sum("weight").alias("reached"))
            scaled = F.coalesce(F.col("weight") * F.col(f"share_{d}") / F.col("reached"), F.col("weight"))
            cells = cells.join(reached, f"k_{d}").withColumn("weight", scaled).drop("reached")
        cells = materialize(cells)
    rate = F.col("weight") / F.col("tokens")
    if budget is None:
        p = rate / F.lit(cells.agg(F.max(rate)).first()[0])
    else:
        p = F.least(F.lit(1.0), rate * F.lit(budget) * F.lit(total))
    return materialize(cells.select(*keys, "tokens", "weight", p.alias("p")))


def mix(
    docs: DataFrame,
    targets: DataFrame | None = None,
    topic: Column | None = None,
    rounds: int = 20,
    temper: float = 0.7,
    budget: float | None = 0.5,
    seed: int = 11,
) -> DataFrame:
    """Every row with its dimensions, tokens, probability and whether it is sampled.

    ``targets`` (dimension, category, share) may name any categories, with
    ``*`` for all others; by default the data's own tempered shares are taken.
    ``budget`` is the sample's size as a share of all tokens; cells with fewer
    tokens than their weight asks for are taken whole.  Without a budget the
    sample is the largest one that meets every cell's weight.
    """
    rows = with_cells(docs, topic)
    counts = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    targets = materialize(tempered_targets(counts, temper) if targets is None else targets)
    rates = raked(counts, targets, rounds, budget)
    keys = [f"k_{d}" for d in DIMENSIONS]
    # One row per source, language and topic of the data: a single join for the documents.
    own_cells = materialize(_with_categories(counts, targets).join(rates.select(*keys, "p"), keys).select(*DIMENSIONS, "p"))
    placed = rows.join(own_cells, list(DIMENSIONS), "left")
    own = F.coalesce(F.col("row.doc_id").cast("string"), F.col("row.text"))
    return placed.select(
        "row", *DIMENSIONS, "tokens", F.coalesce("p", F.lit(0.0)).alias("probability")
    ).withColumn("sampled", unit_hash(F.lit(seed), own) < F.col("probability"))


def sample(docs: DataFrame, **choices) -> DataFrame:
    """The sampled rows with their own columns only."""
    return mix(docs, **choices).where("sampled").select("row.*")
