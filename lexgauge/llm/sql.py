"""SQL twins of the operators that SQL can express (DuckDB)."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = (
    "list_filter(string_split_regex({0}, '" + _SPACE + "+'), lambda w: w <> '')"
)

QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS language FROM documents
), counted AS (
  SELECT doc_id, language, t, {_WORDS.format('t')} AS words, {_WORDS.format('lower(t)')} AS lowered,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')) AS c_lower,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS c_upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS c_digit,
    length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS c_space,
    length(t) AS c_all
  FROM base
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times
  FROM (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i,
          unnest(list_transform(range(1, len(words) - 6), lambda k: array_to_string(words[k:k+7], ' '))) AS w
        FROM counted WHERE len(words) >= 8)
), repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM windows WHERE times > 1) GROUP BY doc_id
), stats AS (
  SELECT c.*, len(words) AS n_words, c_all - c_space AS word_chars,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    c_all - c_lower - c_upper - c_digit - c_space AS c_rest
  FROM counted c LEFT JOIN repeats USING (doc_id)
), class_share AS (
  SELECT language, unnest(['lower', 'upper', 'digit', 'space', 'rest']) AS class,
    unnest([sum(c_lower), sum(c_upper), sum(c_digit), sum(c_space), sum(c_rest)]) / greatest(sum(c_all), 1) AS q
  FROM stats GROUP BY language
), vocabulary AS (
  SELECT language, word, count(*) AS n FROM (SELECT language, unnest(lowered) AS word FROM stats) GROUP BY ALL
), common AS (
  SELECT language, word, n / sum(n) OVER (PARTITION BY language) AS q, n FROM vocabulary
  QUALIFY row_number() OVER (PARTITION BY language ORDER BY length(word) > 6, n DESC, word) <= 40
), usual AS (
  SELECT language, word, q FROM common WHERE length(word) <= 6
), seen AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(lowered) AS word FROM stats) GROUP BY ALL
), pairs AS (
  SELECT doc_id, 'class' AS kind, p, q FROM (
    SELECT doc_id, language, unnest(['lower', 'upper', 'digit', 'space', 'rest']) AS class,
      unnest([c_lower, c_upper, c_digit, c_space, c_rest]) / greatest(c_all, 1) AS p FROM stats
  ) JOIN class_share USING (language, class)
  UNION ALL
  SELECT s.doc_id, 'word', coalesce(seen.n, 0) / greatest(s.n_words, 1), q
  FROM stats s JOIN usual USING (language) LEFT JOIN seen ON seen.doc_id = s.doc_id AND seen.word = usual.word
  UNION ALL
  SELECT s.doc_id, 'word', greatest(1 - sum(coalesce(seen.n, 0)) / greatest(any_value(s.n_words), 1), 0), greatest(1 - sum(q), 0)
  FROM stats s JOIN usual USING (language) LEFT JOIN seen ON seen.doc_id = s.doc_id AND seen.word = usual.word
  GROUP BY s.doc_id
), distances AS (
  SELECT doc_id, kind, round(sqrt(greatest(sum(
      CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END +
      CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS d
  FROM pairs GROUP BY doc_id, kind
), judged AS (
  SELECT s.*, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
    CASE WHEN n_words >= 50 THEN c.d END AS class_distance, CASE WHEN n_words >= 50 THEN w.d END AS word_distance
  FROM stats s LEFT JOIN distances c ON c.doc_id = s.doc_id AND c.kind = 'class'
  LEFT JOIN distances w ON w.doc_id = s.doc_id AND w.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= 0.28 AND coalesce(word_distance, 0) <= 0.42 AS kept,
  class_distance, word_distance
FROM judged
"""

LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(frequent.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE frequent.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
"""


def _mix(rounds: int = 20) -> str:
    """The raking rounds spelt out: one scaling per dimension and round."""
    steps, last = [], "cells"
    for number in range(rounds):
        for d in ("source", "lang", "topic"):
            name = f"r{number}_{d}"
            steps.append(
                f"{name} AS (SELECT source, lang, topic, tokens, weight * share / sum(weight) OVER (PARTITION BY {last}.{d}) AS weight "
                f"FROM {last} JOIN targets ON targets.dimension = '{d}' AND targets.category = {last}.{d})"
            )
            last = name
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents
), rows_ AS (
  SELECT doc_id, t, source, lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '[#*$%&]{{3}}') THEN 'marked'
      WHEN regexp_matches(t, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
    CAST(len({_WORDS.format('t')}) AS BIGINT) AS tokens
  FROM docs
), sums AS (
  SELECT unnest(['source', 'lang', 'topic']) AS dimension, unnest([source, lang, topic]) AS category, tokens FROM rows_
), targets AS (
  SELECT dimension, category, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) OVER (PARTITION BY dimension) AS share
  FROM sums GROUP BY dimension, category HAVING sum(tokens) > 0
), cells AS (
  SELECT source, lang, topic, sum(tokens) AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS weight
  FROM rows_ GROUP BY source, lang, topic HAVING sum(tokens) > 0
), {', '.join(steps)}, rates AS (
  SELECT source, lang, topic, least(1.0, weight / tokens * 0.5 * sum(tokens) OVER ()) AS p FROM {last}
)
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 0), 9) AS probability,
  CAST('0x' || substr(md5('11|' || coalesce(CAST(doc_id AS VARCHAR), t)), 1, 13) AS BIGINT) / pow(16, 13) < coalesce(p, 0) AS sampled
FROM rows_ LEFT JOIN rates USING (source, lang, topic)
"""


MIX = _mix()


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, as an unsigned number: one table step per byte."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    entries = f"[{', '.join(map(str, table))}]::UBIGINT[]"
    digits = f"hex(encode({text}))"
    start = "CAST(4294967295 AS UBIGINT)"
    octets = f"list_transform(range(1, length({digits}), 2), lambda k: CAST('0x' || substr({digits}, k, 2) AS UBIGINT))"
    step = f"lambda c, b: xor(({entries})[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)"
    return f"xor(list_reduce(list_concat([{start}], {octets}), {step}), {start})"


SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS (
  SELECT run, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words
), patterns AS (
  SELECT word, n, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS blanked, substr(word, 1, k - 1) || substr(word, k + 1) AS shortened
  FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM patterns a JOIN patterns b USING (blanked) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM patterns a JOIN words b ON a.shortened = b.word
  UNION SELECT b.word, a.word, a.n FROM patterns a JOIN words b ON a.shortened = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE form IS NOT NULL
), ends AS (
  SELECT walk.word, root FROM walk JOIN formed ON formed.word = walk.root WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

NEGATIVES = r"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
