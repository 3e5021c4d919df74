"""Quality rules: text statistics and distance to the language's usual distributions.

A document fails the base rules when it is short or repeats itself.  Otherwise
two histograms are held against references counted over all documents of its
language: the classes of its characters and its common words.  The measure is
the Jensen-Shannon distance (base 2, so 0 to 1), and documents under a minimum
length are not measured, because small samples are far from everything.

Built-in functions only.  Null text counts as empty (no words, base rule
fails); a null language is a language of its own; repeated rows are scored one
by one; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgauge.llm.common import SPACE_CLASS, packed, split_words, trimmed
from lexgauge.session import materialize

#: Character classes as regular expressions; white space and the rest complete them.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "digit": r"[0-9]+"}
CLASS_NAMES = [*CLASSES, "space", "rest"]
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    ``common`` words of at most ``word_length`` characters make up a
    language's word histogram.  Distances count from ``guard`` words on.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    guard: int = 50
    common: int = 40
    word_length: int = 6
    class_distance: float = 0.28
    word_distance: float = 0.42


def _with_classes(df: DataFrame) -> DataFrame:
    """Adds the counts of the character classes of ``t`` and of its symbols.

    The classes share no character, so each is taken out of what the ones
    before left, and all but the first see short remainders.  Symbols are rest.
    """
    df = df.withColumn("c_all", F.length("t").cast("bigint")).withColumn("_left", F.col("t"))
    # White space second: without the letters it stands in few long runs.
    for name in sorted(CLASS_NAMES[:-1], key=lambda n: (n != "lower", n != "space")):
        df = df.withColumn("_less", F.regexp_replace("_left", CLASSES.get(name, SPACE_CLASS + "+"), ""))
        df = df.withColumn(f"c_{name}", (F.length("_left") - F.length("_less")).cast("bigint"))
        df = df.drop("_left").withColumnRenamed("_less", "_left")
    symbols = F.length("_left") - F.length(F.regexp_replace("_left", r"[#*$%&|<>]+", ""))
    known = sum((F.col(f"c_{n}") for n in CLASS_NAMES[:-1]), F.lit(0))
    return df.withColumn("n_symbols", symbols.cast("bigint")).withColumn("c_rest", F.col("c_all") - known).drop("_left")


def _text(docs: DataFrame) -> DataFrame:
    return packed(docs).select("row", F.coalesce("row.text", F.lit("")).alias("t"), F.coalesce("row.lang", F.lit("")).alias("language"))


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language: class shares, its common words and their shares.

    Word counts combine inside the tasks before the shuffle, so a hot language
    or word reaches it once per task.  Ties between words fall to the smaller word.
    """
    source = _text(docs)
    classes = _with_classes(source.select("language", "t")).groupBy("language").agg(
        *(F.sum(f"c_{n}").alias(f"c_{n}") for n in CLASS_NAMES), F.sum("c_all").alias("c_all")
    )
    classes = classes.select(
        "language", *((F.col(f"c_{n}") / F.greatest("c_all", F.lit(1))).alias(f"q_{n}") for n in CLASS_NAMES)
    )
    words = source.select("language", F.explode(split_words(F.lower("t"))).alias("word"))
    short = F.when(F.length("word") <= rules.word_length, F.col("word")).alias("word")
    # Written, as the totals and the ranking both read it.
    counted = materialize(words.groupBy("language", short).agg(F.count("*").alias("n")))
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    best = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    # The rank limit runs inside each task first, so the window sees few rows of a language.
    common = (
        counted.where("word IS NOT NULL")
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= rules.common)
        .groupBy("language")
        .agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
        .join(totals, "language")
        .select(
            "language",
            F.col("top.word").alias("ref_words"),
            F.transform("top.n", lambda n: n / F.col("total")).alias("ref_shares"),
        )
    )
    return materialize(classes.join(common, "language", "left"))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words inside windows of eight that occur twice or more in the text.

    Only texts with an equal pair of four words get hashes of eight, and only
    those with an equal pair of eights are sorted to find where they stand.
    Places too near the end hash what is there; those of eights are cut off.
    """

    def repeats(name: str) -> Column:
        return F.size(F.array_distinct(name)) < F.size(name)

    df = df.withColumn("h4", F.transform("words", lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in (1, 2, 3)))))
    both = F.transform("h4", lambda h, i: F.xxhash64(h, F.get("h4", i + 4)))
    eights = F.slice(both, F.lit(1), F.greatest(F.size("h4") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("h8", F.when(repeats("h4"), eights).otherwise(F.array().cast("array<bigint>"))).drop("h4")
    placed = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("placed", F.when(repeats("h8"), placed).otherwise(none)).drop("h8")

    def again(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    df = df.withColumn("starts", F.sort_array(F.transform(F.filter("placed", again), lambda x: x["i"]))).drop("placed")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        "starts",
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", covered).drop("starts")


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` with language, word list, counts of the base rules and class counts."""
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    counts = ["n_symbols", "c_all", *(f"c_{n}" for n in CLASS_NAMES)]
    df = _with_classes(_text(docs))
    df = df.select("row", "language", "t", *counts, split_words(F.col("t")).alias("words"), lines.alias("lines"))
    df = df.select(
        "row",
        "language",
        "t",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        *counts,
    ).withColumn("word_chars", F.col("c_all") - F.col("c_space"))
    return _repeat_words(df)


def _js(pairs: Column) -> Column:
    """Jensen-Shannon distance of two distributions given as pairs (p, q)."""

    def part(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(F.lit(0.0))

    total = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda a, x: a + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2),
    )
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _wrapped(word: Column) -> Column:
    """A word, or words joined by \\t\\n, so that each stands between \\n and \\t, which no word holds."""
    return F.concat(F.lit("\n"), word, F.lit("\t"))


def _sizes(known: Column, words: Column) -> Column:
    """Bytes of ``known`` before and after each of ``words``, one after the other, is taken out of it."""

    def after(a: Column) -> Column:
        return F.concat(a["sizes"], F.array(F.octet_length(a["left"])))

    start = F.struct(known.alias("left"), F.array().cast("array<int>").alias("sizes"))
    return F.aggregate(
        words,
        start,
        lambda a, w: F.struct(F.replace(a["left"], _wrapped(w), F.lit("")).alias("left"), after(a).alias("sizes")),
        after,
    )


def _all_common(reference: DataFrame, most: int = 10_000) -> list[str] | None:
    """The common words of all languages, or None where they are too many for a condition."""
    words = reference.select(F.explode("ref_words").alias("word")).distinct().limit(most + 1).collect()
    return [r["word"] for r in words] if len(words) <= most else None


def quality(docs: DataFrame, rules: Rules = Rules(), reference: DataFrame | None = None) -> DataFrame:
    """Score all rows: ``row``, the counts, both distances, ``base_failed`` and ``kept``.

    ``reference`` may hold references of another corpus; by default they are
    counted over ``docs`` itself.  Documents of a language without a reference
    are judged by the base rules alone.
    """
    reference = references(docs, rules) if reference is None else reference
    df = statistics(docs).join(reference, "language", "left")
    common = _all_common(reference)

    # Long words are no common words; lowering a word makes it no shorter.
    def known(word: Column) -> Column:
        short = F.length(word) <= rules.word_length
        return short if common is None else short & F.lower(word).isin(common)

    # Where the words of all languages are too many, others stay in the string and count for nothing.
    left = F.lower(F.array_join(F.filter("words", known), "\t\n"))
    df = df.withColumn("sizes", _sizes(_wrapped(left), F.col("ref_words"))).drop("words", "t")
    share = F.transform(
        F.arrays_zip("ref_words", "ref_shares"),
        lambda r, k: F.struct(
            (
                (F.get("sizes", k) - F.get("sizes", k + 1))
                / F.octet_length(_wrapped(r["ref_words"]))
                / F.greatest("n_words", F.lit(1))
            ).alias("p"),
            r["ref_shares"].alias("q"),
        ),
    )
    df = df.withColumn("pairs", share).drop("sizes", "ref_words", "ref_shares")
    left = F.aggregate("pairs", F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("q")), lambda a, x: F.struct((a["p"] - x["p"]).alias("p"), (a["q"] - x["q"]).alias("q")))
    df = df.withColumn("pairs", F.concat("pairs", F.array(F.struct(F.greatest(left["p"], F.lit(0.0)).alias("p"), F.greatest(left["q"], F.lit(0.0)).alias("q")))))
    classes = F.array(
        *(F.struct((F.col(f"c_{n}") / F.greatest("c_all", F.lit(1))).alias("p"), F.col(f"q_{n}").alias("q")) for n in CLASS_NAMES)
    )
    measured = F.col("n_words") >= rules.guard
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    df = df.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(measured, F.round(_js(classes), 6)).alias("class_distance"),
        F.when(measured, F.round(_js(F.col("pairs")), 6)).alias("word_distance"),
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > rules.word_distance
    )
    return df.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with their own columns only."""
    scored = quality(docs, rules).select("row", "kept", F.monotonically_increasing_id().alias("place"))
    # The row's place keeps the filter above the scores; pushed below them it would repeat their expressions.
    return scored.where(F.col("kept") & (F.col("place") >= 0)).select("row.*")
