"""Registered queries of the content steps with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexgauge.operators import classification, content, pii, sentiment, vectors
from lexgauge.plans.registry import query
from lexgauge.session import checkpoint_root, materialize
from lexgauge.sources.tables import read_table

_WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\r\f]+'), lambda w: w <> '')"
_TEXT = "coalesce(text, '')"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@query(
    "doc_validate",
    """
    SELECT doc_id, unnest(list_filter([
        CASE WHEN text IS NULL THEN 'text: required' END, CASE WHEN trim(text) = '' THEN 'text: empty' END,
        CASE WHEN length(text) > 5000 THEN 'text: too long' END,
        CASE WHEN length(text) <> n_chars THEN 'n_chars: differs' END,
        CASE WHEN lang IS NULL THEN 'lang: required' END,
        CASE WHEN lang NOT IN ('de', 'en', 'fr') THEN 'lang: unknown' END], lambda v: v IS NOT NULL)) AS violation
    FROM documents""",
)
def _(spark, sf_dir):
    return content.validate_documents(_docs(spark, sf_dir), ["de", "en", "fr"], 5000)


@query(
    "doc_checksums",
    """
    SELECT doc_id, sha256(text) AS checksum, count(*) OVER (PARTITION BY text) AS copies,
           min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents""",
)
def _(spark, sf_dir):
    return content.text_checksums(_docs(spark, sf_dir))


@query(
    "doc_metadata_index",
    f"""
    SELECT source, lang, count(*) AS documents, CAST(sum(length({_TEXT})) AS BIGINT) AS chars,
           CAST(sum(strlen({_TEXT})) AS BIGINT) AS bytes, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id
    FROM documents GROUP BY ALL""",
)
def _(spark, sf_dir):
    return content.metadata_index(_docs(spark, sf_dir))


@query(
    "page_text",
    r"""
    WITH bare AS (
        SELECT page_id, url, regexp_replace(regexp_replace(html,
            '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t
        FROM pages),
    resolved AS (
        SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text
        FROM bare)
    SELECT page_id, url, text, length(text) AS n_chars FROM resolved""",
)
def _(spark, sf_dir):
    return content.page_text(read_table(spark, sf_dir, "pages"))


@query(
    "doc_tokens",
    f"""
    SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
    FROM (SELECT doc_id, unnest({_WORDS.format(f"lower({_TEXT})")}) AS term FROM documents) GROUP BY term""",
)
def _(spark, sf_dir):
    return content.term_counts(_docs(spark, sf_dir))


@query(
    "doc_metrics",
    rf"""
    SELECT doc_id, length({_TEXT}) AS chars, CAST(len(words) AS BIGINT) AS words,
           CAST(len(string_split({_TEXT}, chr(10))) AS BIGINT) AS lines,
           round(length(regexp_replace({_TEXT}, '[ \t\n\r\f]+', '', 'g')) / nullif(len(words), 0), 4) AS mean_word_length
    FROM (SELECT *, {_WORDS.format(_TEXT)} AS words FROM documents)""",
)
def _(spark, sf_dir):
    return content.text_metrics(_docs(spark, sf_dir))


@query(
    "doc_language",
    f"""
    WITH stop AS (
        SELECT 'de' AS language, unnest(['der','die','und','in','das','den','ist','zu','von','mit']) AS word
        UNION ALL SELECT 'en', unnest(['the','of','and','to','in','is','that','for','with','was'])
        UNION ALL SELECT 'es', unnest(['de','la','que','el','en','y','los','se','del','las'])
        UNION ALL SELECT 'fr', unnest(['de','la','le','et','les','des','en','un','du','une'])),
    hits AS (
        SELECT doc_id, language, count(*) AS hits
        FROM (SELECT doc_id, unnest({_WORDS.format(f"lower({_TEXT})")}) AS word FROM documents) JOIN stop USING (word)
        GROUP BY ALL),
    best AS (FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, language) = 1)
    SELECT doc_id, lang, language AS detected, coalesce(hits, 0) AS hits FROM documents LEFT JOIN best USING (doc_id)""",
)
def _(spark, sf_dir):
    return content.stop_word_language(_docs(spark, sf_dir))


@query(
    "doc_entities",
    f"""
    SELECT doc_id,
        len(regexp_extract_all({_TEXT}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]')) AS emails,
        len(regexp_extract_all({_TEXT}, '[+]?[0-9]{{0,3}}[ -]?[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}')) AS phones,
        len(regexp_extract_all({_TEXT}, '[A-Z][a-z]+( [A-Z][a-z]+)+')) AS names
    FROM documents""",
)
def _(spark, sf_dir):
    return content.entities(_docs(spark, sf_dir))


@query(
    "doc_sentiment",
    f"""
    WITH lexicon AS (FROM (VALUES ('good', 1), ('great', 1), ('clear', 1), ('useful', 1), ('excellent', 2), ('bad', -1),
        ('poor', -1), ('unclear', -1), ('pathetic', -2), ('worthless', -2)) v(word, score)),
    hits AS (
        SELECT doc_id, count(*) AS hits, CAST(sum(score) AS BIGINT) AS score
        FROM (SELECT doc_id, unnest({_WORDS.format(f"regexp_replace(lower({_TEXT}), '[.,;:!?]', ' ', 'g')")}) AS word FROM documents)
        JOIN lexicon USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(score, 0) AS score FROM documents LEFT JOIN hits USING (doc_id)""",
)
def _(spark, sf_dir):
    return content.sentiment(_docs(spark, sf_dir))


@query(
    "pii_scan",
    f"""
    WITH a AS (SELECT doc_id, {_TEXT} AS t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]' AS p FROM documents),
    b AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]')) AS email,
        regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]', '[email]', 'g') AS t FROM a),
    c AS (SELECT doc_id, email,
        len(regexp_extract_all(t, '[+]?[0-9]{{0,3}}[ -]?[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}')) AS phone,
        regexp_replace(t, '[+]?[0-9]{{0,3}}[ -]?[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}', '[phone]', 'g') AS t FROM b),
    d AS (SELECT doc_id, email, phone, len(regexp_extract_all(t, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')) AS ssn,
        regexp_replace(t, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}', '[ssn]', 'g') AS t FROM c)
    SELECT doc_id, email, phone, ssn,
        len(regexp_extract_all(t, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}')) AS ip,
        regexp_replace(t, '[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}', '[ip]', 'g') AS masked
    FROM d""",
)
def _(spark, sf_dir):
    return content.scan_pii(_docs(spark, sf_dir))


_KEY = "a key for the queries"


def _hmac_sql(message: str) -> str:
    secret = _KEY.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ pad:02x}" for b in secret) for pad in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message})))), 1, 16)"


_DIGITS = "list_transform(range(1, length(v) + 1), lambda k: CAST(v[length(v) + 1 - k] AS INTEGER) * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END))"
_MOVED = "(substr(v, 5) || substr(v, 1, 4))"
_STEPS = f"list_concat([CAST(0 AS BIGINT)], list_transform(range(1, length(v) + 1), lambda k: CAST(ascii({_MOVED}[k]) AS BIGINT)))"
_PROOFS = {
    "email": "true",
    "card": f"list_sum(list_transform({_DIGITS}, lambda d: CASE WHEN d > 9 THEN d - 9 ELSE d END)) % 10 = 0",
    "iban": f"list_reduce({_STEPS}, lambda r, c: CASE WHEN c >= 65 THEN r * 100 + c - 55 ELSE r * 10 + c - 48 END % 97) = 1",
    "ssn": "CAST(substr(v, 1, 3) AS INTEGER) BETWEEN 1 AND 899 AND substr(v, 1, 3) <> '666' AND substr(v, 5, 2) <> '00' AND substr(v, 8) <> '0000'",
    "ip": "len(list_filter(string_split(v, '.'), lambda o: length(o) > 3 OR CAST(o AS BIGINT) > 255 OR o <> '0' AND o[1] = '0')) = 0",
}


def _pii_sql() -> str:
    parts = []
    for kind in pii.KINDS:
        bare = "rtrim(raw, '.-')" if kind.name == "email" else f"translate(raw, '{kind.strip}', '')" if kind.strip else "raw"
        parts.append(
            f"SELECT doc_id, '{kind.name}' AS kind, v FROM (SELECT doc_id, {bare} AS v FROM "
            f"(SELECT doc_id, unnest(regexp_extract_all({_TEXT}, '{kind.run}')) AS raw FROM documents)) "
            f"WHERE CASE WHEN regexp_matches(v, '{kind.form}') THEN {_PROOFS[kind.name]} ELSE false END"
        )
    return (
        f"SELECT doc_id, kind, {_hmac_sql("kind || ':' || v")} AS pseudonym, count(*) AS n FROM ({' UNION ALL '.join(parts)}) "
        "GROUP BY ALL"
    )


@query("pii_findings", _pii_sql())
def _(spark, sf_dir):
    return pii.find(_docs(spark, sf_dir), _KEY)


_SPLIT = """
    split_rows AS (
        SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS point FROM documents),
    placed AS (
        SELECT *, CASE WHEN point < 80 THEN 'train' WHEN point < 90 THEN 'validation' ELSE 'test' END AS split FROM split_rows)"""


@query("dataset_split", f"WITH {_SPLIT} SELECT doc_id, split FROM placed")
def _(spark, sf_dir):
    return content.dataset_split(_docs(spark, sf_dir))


def _manifest_twin() -> str:
    lanes = ", ':', ".join(
        f"sum(CAST('0x' || substr(checksum, {7 * i + 1}, 7) AS BIGINT))" for i in range(8)
    )
    return f"""
    WITH {_SPLIT},
    hashed AS (
        SELECT split, sha256(concat('{{"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars,
            ',"source":"', source, '"}}')) AS checksum FROM placed),
    buckets AS (
        SELECT split, substr(checksum, 63, 2) AS bucket, count(*) AS n, md5(concat(count(*), ':', {lanes})) AS digest
        FROM hashed GROUP BY ALL)
    SELECT split AS table_name, CAST(sum(n) AS BIGINT) AS record_count,
           md5(string_agg(digest, '' ORDER BY bucket)) AS aggregate_checksum, 'text: unexpected' AS schema_problems
    FROM buckets GROUP BY split"""


@query("dataset_manifest", _manifest_twin())
def _(spark, sf_dir):
    expected = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint"}
    # The twin defines this digest, without text and characters.
    return content.dataset_manifest(_docs(spark, sf_dir), expected, list(expected)).drop("characters")


def _whole_manifest_twin() -> str:
    lanes = ", ':', ".join(
        f"sum(CAST('0x' || substr(checksum, {7 * i + 1}, 7) AS BIGINT))" for i in range(8)
    )
    return f"""
    WITH {_SPLIT},
    hashed AS (
        SELECT split, length(text) AS chars, sha256(concat('{{"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars,
            ',"source":"', source, '","text":"', sha256(text), '"}}')) AS checksum FROM placed),
    buckets AS (
        SELECT split, substr(checksum, 63, 2) AS bucket, count(*) AS n, sum(chars) AS chars,
            md5(concat(count(*), ':', {lanes})) AS digest
        FROM hashed GROUP BY ALL)
    SELECT split AS table_name, CAST(sum(n) AS BIGINT) AS record_count, CAST(sum(chars) AS BIGINT) AS characters,
           md5(string_agg(digest, '' ORDER BY bucket)) AS aggregate_checksum, '' AS schema_problems
    FROM buckets GROUP BY split"""


@query("dataset_manifest_whole", _whole_manifest_twin())
def _(spark, sf_dir):
    expected = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return content.dataset_manifest(_docs(spark, sf_dir), expected)


_CENTROIDS = """
    elements AS (
        SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings),
    centroids AS (
        SELECT label, CAST(place AS INTEGER) AS place, count(*) AS vectors, round(avg(CAST(x AS DOUBLE)), 6) AS mean
        FROM elements GROUP BY ALL)"""


@query("embedding_centroids", f"WITH {_CENTROIDS} FROM centroids")
def _(spark, sf_dir):
    return content.embedding_centroids(read_table(spark, sf_dir, "embeddings"))


@query(
    "embedding_nearest",
    f"""
    WITH {_CENTROIDS},
    angles AS (
        SELECT e.vec_id, e.label, c.label AS nearest,
               round(sum(x * mean) / sqrt(sum(CAST(x AS DOUBLE) * x) * sum(mean * mean)), 6) AS cosine
        FROM elements e JOIN centroids c USING (place) GROUP BY ALL)
    FROM angles QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, nearest) = 1""",
)
def _(spark, sf_dir):
    return content.embedding_nearest(read_table(spark, sf_dir, "embeddings"))


@query("doc_classify")
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    path = f"{checkpoint_root(spark)}/models/{uuid.uuid4().hex}"
    return classification.classify(docs, classification.fit_and_write(docs, read_table(spark, sf_dir, "labels"), path))


_VECTORS = f"""
    words AS (
        SELECT doc_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {vectors.DIMS} AS bucket
        FROM (SELECT doc_id, unnest({_WORDS.format(f"lower({_TEXT})")}) AS term FROM documents)),
    counted AS (SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, CAST(count(*) AS INTEGER) AS n FROM words GROUP BY ALL),
    fitted AS (
        SELECT bucket, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM counted GROUP BY bucket),
    weighed AS (
        SELECT doc_id, bucket, n, n * idf AS weight, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS norm
        FROM counted JOIN fitted USING (bucket))"""


@query(
    "doc_vectors",
    f"WITH {_VECTORS} SELECT doc_id, bucket, n, round(weight, 6) AS weight, round(norm, 6) AS norm FROM weighed",
)
def _(spark, sf_dir):
    rows = vectors.text_vectors(_docs(spark, sf_dir)).select("doc_id", "norm", F.explode("terms").alias("t"))
    return rows.select("doc_id", "t.bucket", "t.n", F.round("t.weight", 6).alias("weight"), F.round("norm", 6).alias("norm"))


@query(
    "doc_vector_nearest",
    f"""
    WITH {_VECTORS},
    unit AS (SELECT doc_id, lang, bucket, weight / norm AS w FROM weighed JOIN documents USING (doc_id) WHERE norm > 0),
    means AS (
        SELECT lang, bucket, round(sum(w) / any_value(size), 9) AS mean
        FROM unit JOIN (SELECT lang, count(DISTINCT doc_id) AS size FROM unit WHERE lang IS NOT NULL GROUP BY lang) USING (lang)
        GROUP BY lang, bucket),
    centroids AS (SELECT lang AS nearest, bucket, mean / sqrt(sum(mean * mean) OVER (PARTITION BY lang)) AS c FROM means),
    cosines AS (SELECT doc_id, nearest, round(sum(w * c), 6) AS cosine FROM unit JOIN centroids USING (bucket) GROUP BY ALL),
    best AS (FROM cosines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, nearest) = 1)
    SELECT doc_id, nearest, cosine FROM documents LEFT JOIN best USING (doc_id)""",
)
def _(spark, sf_dir):
    found = vectors.labelled_vectors(_docs(spark, sf_dir), "lang")
    return vectors.nearest_label(found, vectors.label_centroids(found, "lang"))


_WEIGHTS = f"""
    {_SPLIT.strip()},
    votes AS (
        SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 1 ELSE 0 END AS label
        FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
    words AS (
        SELECT label, unnest({_WORDS.format(f"lower({_TEXT})")}) AS word
        FROM placed JOIN votes USING (doc_id) WHERE split = 'train'),
    counted AS (
        SELECT word, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (label = 0) AS n_0 FROM words GROUP BY word),
    totals AS (
        SELECT *, sum(n_1) OVER () AS all_1, sum(n_0) OVER () AS all_0,
               {sentiment.PRIOR} * (n_1 + n_0) / (sum(n_1) OVER () + sum(n_0) OVER ()) AS a FROM counted),
    odds AS (
        SELECT *, ln((n_1 + a) / (all_1 + {sentiment.PRIOR} - n_1 - a)) - ln((n_0 + a) / (all_0 + {sentiment.PRIOR} - n_0 - a)) AS w
        FROM totals),
    weights AS (
        SELECT word, n_1, n_0, round(w, 6) AS weight, round(w / sqrt(1 / (n_1 + a) + 1 / (n_0 + a)), 6) AS z FROM odds)"""


@query("sentiment_weights", f"WITH {_WEIGHTS} FROM weights")
def _(spark, sf_dir):
    return sentiment.word_weights(_docs(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query(
    "doc_sentiment_learned",
    f"""
    WITH {_WEIGHTS},
    met AS (
        SELECT doc_id, count(*) AS hits, CAST(sum(CAST(weight AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS score
        FROM (SELECT doc_id, unnest({_WORDS.format(f"lower({_TEXT})")}) AS word FROM documents)
        JOIN (FROM weights WHERE abs(z) >= {sentiment.SURE}) USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(score, 0) AS score FROM documents LEFT JOIN met USING (doc_id)""",
)
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return sentiment.score(docs, sentiment.word_weights(docs, read_table(spark, sf_dir, "labels")))
