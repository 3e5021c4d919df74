"""Content steps: validate, index, extract, measure and split documents.

All are built-in expressions over whole tables; patterns stay within what
every regular-expression engine reads alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgauge.functions.checksums import table_digest, with_record_checksum

# Languages a document may name, words that mark a language,
# words that carry a feeling, and what is searched for in text.
LANGUAGES = ["de", "en", "es", "fr"]
STOP_WORDS = {
    "de": ["der", "die", "und", "in", "das", "den", "ist", "zu", "von", "mit"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
SENTIMENT = {
    "good": 1, "great": 1, "clear": 1, "useful": 1, "excellent": 2,
    "bad": -1, "poor": -1, "unclear": -1, "pathetic": -2, "worthless": -2,
}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]",
    "phone": r"[+]?[0-9]{0,3}[ -]?[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
}
NAMES = r"[A-Z][a-z]+( [A-Z][a-z]+)+"
MOST_CHARS = 1_000_000
SPLITS = [("train", 80), ("validation", 90), ("test", 100)]
_BLANK = r"[ \t\n\r\f]+"


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _terms(text: Column) -> Column:
    clean = F.btrim(text, F.lit(" \t\n\r\f"))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _BLANK))


def terms_of(text: Column) -> Column:
    """Words between white space, in lower case; none for null, empty or blank texts."""
    return _terms(F.lower(F.coalesce(text, F.lit(""))))


def validate_documents(docs: DataFrame, languages: Sequence[str] = LANGUAGES, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per broken rule: text given, not empty, not too long, length as stated, language known."""
    rules = {
        "text: required": F.col("text").isNull(),
        "text: empty": F.btrim("text") == "",
        "text: too long": F.length("text") > most_chars,
        "n_chars: differs": F.length("text") != F.col("n_chars"),
        "lang: required": F.col("lang").isNull(),
        "lang: unknown": ~F.col("lang").isin(list(languages)),
    }
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda v: v.isNotNull())
    return docs.select("doc_id", F.explode(broken).alias("violation"))


def text_checksums(docs: DataFrame) -> DataFrame:
    """Checksum of every text with how many documents share it, and the first of them.

    Copies combine in the tasks before the shuffle; the counts are one row per
    text, so a text with very many copies can be split when the two meet.
    """
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("checksum"))
    groups = hashed.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
    return hashed.join(groups.withColumnRenamed("checksum", "_checksum"), F.col("checksum").eqNullSafe(F.col("_checksum"))).drop(
        "_checksum"
    )


def metadata_index(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "lang").agg(
        F.count("*").alias("documents"),
        F.sum(F.length(_text())).alias("chars"),
        F.sum(F.octet_length(_text())).alias("bytes"),
        F.min("doc_id").alias("first_doc_id"),
        F.max("doc_id").alias("last_doc_id"),
    )


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; the usual entities resolved."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.btrim(F.regexp_replace(text, _BLANK, " "))


def page_text(pages: DataFrame) -> DataFrame:
    text = html_text(F.col("html"))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def term_counts(docs: DataFrame) -> DataFrame:
    """Per term: documents that hold it and occurrences.

    Terms are counted inside each document first, so a document reaches the
    shuffle with every term once.
    """
    terms = docs.select("doc_id", F.explode(_terms(F.lower(_text()))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(
        F.count("*").alias("documents"), F.sum("n").alias("occurrences")
    )


def text_metrics(docs: DataFrame) -> DataFrame:
    text = _text()
    measured = docs.select(
        "doc_id",
        F.length(text).cast("bigint").alias("chars"),
        F.size(_terms(text)).cast("bigint").alias("words"),
        F.size(F.split(text, "\n")).cast("bigint").alias("lines"),
        F.length(F.regexp_replace(text, _BLANK, "")).cast("bigint").alias("_letters"),
    )
    mean = F.round(F.col("_letters") / F.nullif(F.col("words"), F.lit(0)), 4)
    return measured.withColumn("mean_word_length", mean).drop("_letters")


def stop_word_language(docs: DataFrame) -> DataFrame:
    """The language with the largest share of its stop words; ties go to the first in order, none to NULL."""
    terms = docs.select("doc_id", "lang", _terms(F.lower(_text())).alias("terms"))

    def score(language: str) -> Column:
        hits = F.size(F.filter("terms", lambda term: term.isin(STOP_WORDS[language])))
        return F.struct(hits.alias("hits"), F.lit(language).alias("language"))

    scores = F.array(*map(score, sorted(STOP_WORDS)))
    best = F.aggregate(
        scores,
        F.struct(F.lit(0).alias("hits"), F.lit(None).cast("string").alias("language")),
        lambda a, x: F.when(x["hits"] > a["hits"], x).otherwise(a),
    )
    return terms.select("doc_id", "lang", best["language"].alias("detected"), best["hits"].cast("bigint").alias("hits"))


def entities(docs: DataFrame) -> DataFrame:
    """Per document: e-mail addresses, phone numbers and runs of capitalised words."""
    text = _text()

    def found(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")

    return docs.select(
        "doc_id",
        found(PATTERNS["email"]).alias("emails"),
        found(PATTERNS["phone"]).alias("phones"),
        found(NAMES).alias("names"),
    )


def sentiment(docs: DataFrame, lexicon: dict[str, int] = SENTIMENT) -> DataFrame:
    """Sum of the lexicon's scores over each document's words; 0 without any of them."""
    signs = F.create_map(*(x for word, score in lexicon.items() for x in (F.lit(word), F.lit(score))))
    words = F.filter(_terms(F.regexp_replace(F.lower(_text()), "[.,;:!?]", " ")), lambda w: w.isin(*lexicon))
    score = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.element_at(signs, w))
    return docs.select("doc_id", F.size(words).cast("bigint").alias("hits"), score.alias("score"))


def scan_pii(docs: DataFrame) -> DataFrame:
    """Matches per pattern, in the order in which they are masked, and the masked text."""
    rows = docs.select("doc_id", _text().alias("masked"))
    for name, pattern in PATTERNS.items():
        rows = rows.withColumn(name, F.regexp_count("masked", F.lit(pattern)).cast("bigint")).withColumn(
            "masked", F.regexp_replace("masked", pattern, f"[{name}]")
        )
    return rows


def split_of(key: Column) -> Column:
    """Train, validation or test by the key's hash, the same on every run."""
    point = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    choice = F.when(F.lit(False), F.lit(""))
    for name, below in SPLITS:
        choice = choice.when(point < below, F.lit(name))
    return choice


def dataset_split(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", split_of(F.col("doc_id")).alias("split"))


def dataset_manifest(docs: DataFrame, expected: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Per split: rows, characters, digest, and whether the columns are the expected ones.

    The digest covers every column, ``text`` by the SHA-256 of the whole text;
    ``columns`` narrows it to some.
    """
    found = dict(docs.dtypes)
    problems = [f"{n}: missing" for n in expected if n not in found]
    problems += [f"{n}: {found[n]} instead of {kind}" for n, kind in expected.items() if found.get(n, kind) != kind]
    problems += [f"{n}: unexpected" for n in found if n not in expected]
    members = {n: F.sha2(F.encode(n, "UTF-8"), 256) if n == "text" else F.col(n) for n in (docs.columns if columns is None else columns)}
    hashed = with_record_checksum(docs.withColumn("split", split_of(F.col("doc_id"))), members)
    result = None
    for name, _ in SPLITS:
        part = hashed.filter(F.col("split") == name)
        chars = F.length("text") if "text" in found else F.lit(0)
        characters = part.agg(F.coalesce(F.sum(chars.cast("bigint")), F.lit(0)).alias("characters")).scalar()
        row = table_digest(part, name).select("*", characters.alias("characters"), F.lit("; ".join(problems)).alias("schema_problems"))
        result = row if result is None else result.unionByName(row)
    return result


def _elements(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("place", "x"))


def embedding_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of every label, one row per label and place."""
    return _elements(vectors).groupBy("label", "place").agg(
        F.count("*").alias("vectors"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")
    )


def embedding_nearest(vectors: DataFrame) -> DataFrame:
    """The label whose centroid has the smallest angle to each vector; ties go to the smaller label.

    The centroids, one per label, are one value that all rows see; no rows are paired.
    """
    centroids = (
        embedding_centroids(vectors)
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("place", "mean")))["mean"].alias("mean"))
        .agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("all"))
    )

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).withColumn("all", centroids.scalar())
    scored = F.transform(
        "all",
        lambda c: F.struct(
            F.round(dot(F.col("v"), c["mean"]) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(c["mean"], c["mean"])), 6).alias("cosine"),
            (-c["label"]).alias("order"),
        ),
    )
    best = F.array_max(scored)
    return rows.select("vec_id", "label", best.alias("best")).select(
        "vec_id", "label", (-F.col("best.order")).alias("nearest"), F.col("best.cosine").alias("cosine")
    )
