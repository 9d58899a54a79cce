"""The registered queries of the training-data operators, and their SQL where SQL can say it.

Each query applies its operator with production parameters to the whole table and keeps the columns of
its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontam, extraction, lines, minhash, packing, quality, ranking, sharding, spans, tokens, urls, warc
from ._common import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", "n_words_removed", "first_doc_id", "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return clustering.cluster_vectors(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.ranked_search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_url_filters": op12_url_filters,
    "op13_ranked_search": op13_ranked_search,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
keyed AS (
  SELECT doc_id, words, CASE WHEN text IS NULL THEN NULL WHEN len(words) = 0 THEN 'text ' || text ELSE 'words ' || array_to_string(words, ' ') END AS key FROM d),
nodes AS (SELECT key, min(doc_id) AS node, any_value(words) AS words FROM keyed WHERE key IS NOT NULL GROUP BY key),
places AS (
  SELECT node, words, least({minhash.SHINGLE}, len(words)) AS n, unnest(range(1, greatest(len(words) - {minhash.SHINGLE - 1}, 1) + 1)) AS p FROM nodes WHERE len(words) > 0),
elements AS (SELECT node, array_to_string(words[p : p + n - 1], ' ') AS element, count(*) AS weight FROM places GROUP BY ALL),
totals AS (SELECT node, sum(weight) AS total FROM elements GROUP BY node),
common AS (
  SELECT x.node AS a, y.node AS b, sum(least(x.weight, y.weight)) AS both_have FROM elements x JOIN elements y ON x.element = y.element AND x.node < y.node GROUP BY x.node, y.node),
links AS (
  SELECT a, b FROM common JOIN totals s ON s.node = a JOIN totals t ON t.node = b WHERE both_have::DOUBLE / (s.total + t.total - both_have) >= {minhash.SIMILARITY}::DOUBLE),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT node, node AS label FROM nodes
  UNION SELECT b, label FROM reached JOIN edges ON a = node WHERE label < b),
labels AS (SELECT node, min(label) AS class_id FROM reached GROUP BY node),
classes AS (
  SELECT doc_id, CASE WHEN key IS NULL THEN doc_id ELSE class_id END AS class_id FROM keyed LEFT JOIN nodes USING (key) LEFT JOIN labels USING (node))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS is_kept FROM classes
"""

OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[p : p + n - 1], ' ') AS window_text
  FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS window_text
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, lengths WHERE len(words) >= n)),
occurrences AS (
  SELECT doc_id, item_id, p, d.n FROM doc_windows d JOIN item_windows USING (n, window_text)),
hits AS (
  SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word_at FROM occurrences) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list
  FROM (SELECT DISTINCT doc_id, item_id FROM occurrences) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, line_at, parts[line_at] AS line,
         translate(trim(parts[line_at], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line_at FROM s)),
k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_at) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP4_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS original FROM p WHERE n >= {warc.MIN_REVISIT} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN original IS NOT NULL AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""

OP7_SQL = rf"""
WITH e AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]["'')\]]*[ \t\r]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS whole FROM documents),
d AS (
  SELECT doc_id, list_filter(flatten(list_transform(whole, lambda x: CASE WHEN length(x) - length(replace(x, ' ', '')) >= {spans.LONG_SENTENCE}
    THEN string_split(regexp_replace(x, '([,;:]["'')\]]*[ \t\r]+)', '\1' || chr(1), 'g'), chr(1)) ELSE [x] END)), lambda x: x <> '') AS parts FROM e),
s AS (
  SELECT doc_id, k, parts[k] AS sentence, regexp_extract_all(translate(parts[k], '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)),
o AS (
  SELECT doc_id, k, words, row_number() OVER w AS i, sum(len(words)) OVER w AS upto FROM s WHERE len(words) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
a AS (
  SELECT doc_id, list(k ORDER BY i) AS ks, list(upto ORDER BY i) AS uptos, flatten(list(words ORDER BY i)) AS all_words FROM o GROUP BY doc_id),
r AS (
  SELECT doc_id, k, ks, uptos, all_words, upto - len(words) AS before,
         greatest(i + {spans.MIN_SENTENCES} - 1, list_position(list_transform(uptos, lambda x: x >= upto - len(words) + {spans.MIN_WORDS}), true)) AS last
  FROM o JOIN a USING (doc_id)
  WHERE uptos[len(uptos)] >= upto - len(words) + {spans.MIN_WORDS} AND i + {spans.MIN_SENTENCES} - 1 <= len(ks)),
b AS (
  SELECT doc_id, k, ks, uptos, all_words, upto, least(i - {spans.MIN_SENTENCES} + 1, 1 + len(list_filter(uptos, lambda x: x <= upto - {spans.MIN_WORDS}))) AS first
  FROM o JOIN a USING (doc_id) WHERE upto >= {spans.MIN_WORDS} AND i >= {spans.MIN_SENTENCES}),
runs AS (
  SELECT doc_id, k AS first_k, ks[last] AS last_k, array_to_string(all_words[before + 1 : uptos[last]], ' ') AS words FROM r
  UNION SELECT doc_id, ks[first], k, array_to_string(all_words[coalesce(uptos[first - 1], 0) + 1 : upto], ' ') FROM b),
ranked AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS source FROM runs WINDOW w AS (PARTITION BY words ORDER BY doc_id, first_k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(first_k, last_k + 1)) AS k FROM ranked WHERE nth > 1),
sources AS (SELECT doc_id, min(source) AS first_doc_id FROM ranked WHERE nth > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(count(s.k) AS BIGINT) AS n_sentences, CAST(count(gone.k) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(len(s.words)) FILTER (WHERE gone.k IS NOT NULL), 0) AS BIGINT) AS n_words_removed, any_value(first_doc_id) AS first_doc_id,
       sha256(coalesce(string_agg(s.sentence, '' ORDER BY s.k) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.k = s.k LEFT JOIN sources ON sources.doc_id = d.doc_id
GROUP BY d.doc_id
"""

_CLASSES = ["[0-9]+", "[A-Z]+", r"""[.,;:!?'"()\-]+""", r"[\x00-\x1F#$%&*+/<=>@\[\\\]^_`{|}~\x7F]+"]
_QUOTED_CLASSES = ["'" + c.replace("'", "''") + "'" for c in _CLASSES]
_COUNTED = lambda listed: "[" + ", ".join(f"len(list_filter(words, lambda x: x = '{x}'))" for x in listed) + "]"
_COUNTS = " ".join(f"WHEN '{code}' THEN {_COUNTED(listed)}" for code, listed in quality.COMMON_WORDS.items()) + f" ELSE {_COUNTED(quality.WORDS)}"

OP9_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT *, array_to_string(words, '') AS packed, len(words) AS n FROM w),
c AS (
  SELECT *, [{", ".join(f"length(packed) - length(regexp_replace(packed, {c}, '', 'g'))" for c in _QUOTED_CLASSES)}, octet_length(encode(packed)) - length(packed)] AS marks,
         CASE lang {_COUNTS} END AS common FROM p),
h AS (
  SELECT *, list_concat([length(t) - length(packed)], marks, [length(packed)]) AS classes, list_concat(common, [n - list_sum(common)]) AS wordy FROM c),
b AS (
  SELECT rid, lang, n, unnest(range(1, 7 + len(wordy) + 1)) AS i, unnest(list_concat(classes, wordy)) AS x FROM h),
f AS (SELECT lang, i, sum(x) AS y FROM b WHERE n >= {quality.JUDGED_WORDS} GROUP BY lang, i),
q AS (SELECT lang, i, i <= 7 AS is_class, y / sum(y) OVER (PARTITION BY lang, i <= 7) AS y FROM f),
s AS (SELECT rid, lang, i, x / nullif(sum(x) OVER (PARTITION BY rid, i <= 7), 0) AS x FROM b),
j AS (
  SELECT rid, sum(CASE WHEN is_class THEN v END) / 2 AS class_divergence, sum(CASE WHEN NOT is_class THEN v END) / 2 AS word_divergence
  FROM (SELECT rid, is_class, CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END AS v FROM s JOIN q USING (lang, i))
  GROUP BY rid),
win AS (SELECT rid, k, array_to_string(words[k : k + 4], ' ') AS win FROM (SELECT rid, words, unnest(range(1, n - 3)) AS k FROM p WHERE n >= 5)),
twice AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, win) AS m FROM win) WHERE m > 1),
rep AS (SELECT rid, count(DISTINCT at_word) AS n_repeat FROM (SELECT rid, unnest(range(k, k + 5)) AS at_word FROM twice) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM p),
o AS (
  SELECT doc_id, n AS n_words, length(packed) AS word_chars, length(packed) - length(regexp_replace(packed, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, class_divergence, word_divergence
  FROM p JOIN l USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN j USING (rid)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {quality.JUDGED_WORDS} AND word_chars >= {quality.JUDGED_CHARS}
         AND (coalesce(class_divergence, 0) > {quality.MAX_CLASS_DIVERGENCE} OR coalesce(word_divergence, 0) > {quality.MAX_WORD_DIVERGENCE} + {quality.WORD_ALLOWANCE} / n_words)) AS kept
FROM v
"""



def _op11_round(k: int) -> str:
    """Assignment to the centroids ``c{k}``, and the centroids after it."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"a{k} AS MATERIALIZED (SELECT rid, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS o FROM v, c{k} c GROUP BY rid)"
    floor = "CAST((sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    means = f"m{k} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT o.c AS c, i, {floor} AS m FROM a{k} JOIN v USING (rid), range(1, {clustering.DIMENSIONS + 1}) r(i) GROUP BY ALL) GROUP BY c)"
    return f"{near}, {means}, c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (c))"


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, sha256('{clustering.SEED}:' || vec_id) AS h, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM v ORDER BY h, x LIMIT {clustering.CLUSTERS}),
{", ".join(_op11_round(k) for k in range(clustering.ROUNDS + 1))}
SELECT vec_id, CAST(o.c AS INTEGER) AS cluster, o.d AS distance, CAST(sum(o.d) OVER (PARTITION BY o.c) AS BIGINT) AS cluster_inertia, CAST(sum(o.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{clustering.ROUNDS} USING (rid) JOIN c{clustering.ROUNDS} c ON c.c = o.c
"""

_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, said) for said, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))]


def _op12_order(k: int) -> str:
    """Smoothed likelihoods of both models with k characters of context at most."""
    size, mixed = urls._BITS ** (k + 1), []
    for n in ("allowed", "blocked"):
        low = f"p{k - 1}.{n}_below" if k else f"1.0::DOUBLE / {urls.ALPHABET}"
        mixed.append(f"CASE WHEN {n}_seen >= {urls.MIN_SEEN} THEN ({n} + {n}_kinds * {low}) / ({n}_seen + {n}_kinds) ELSE {low} END AS {n}_below")
    return f"""
g{k} AS (SELECT gram % {size} AS gram, gram % {size} // {urls._BITS} AS context, sum(allowed)::DOUBLE AS allowed, sum(blocked)::DOUBLE AS blocked FROM counts GROUP BY ALL),
x{k} AS (SELECT context, sum(allowed) AS allowed_seen, sum(blocked) AS blocked_seen, count(*) FILTER (WHERE allowed > 0) AS allowed_kinds, count(*) FILTER (WHERE blocked > 0) AS blocked_kinds FROM g{k} GROUP BY context),
p{k} AS (SELECT g{k}.gram, {", ".join(mixed)} FROM g{k} JOIN x{k} USING (context){f" JOIN p{k - 1} ON p{k - 1}.gram = g{k}.gram % {urls._BITS**k}" if k else ""})"""


OP12_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (
  SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{said}'" for fits, _, said in _FITS)} END AS said,
         substr(md5(url), 1, 1) IN ({", ".join(f"'{c}'" for c in urls.HELD_OUT)}) AS held,
         regexp_replace(regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./_%:~-]', '?', 'g') AS t FROM u),
s AS (SELECT *, repeat(chr(1), {urls.ORDER}) || t || chr(2) AS padded FROM r),
e AS (
  SELECT rid, said, held, {" + ".join(f"ascii(substr(padded, i + {k}, 1)) * {urls._BITS ** (urls.ORDER - k)}" for k in range(urls.ORDER + 1))} AS gram
  FROM (SELECT rid, said, held, padded, unnest(range(1, length(t) + 2)) AS i FROM s)),
counts AS MATERIALIZED (
  SELECT gram, count(*) FILTER (WHERE said = 'allow' AND NOT held) AS allowed, count(*) FILTER (WHERE said = 'block' AND NOT held) AS blocked FROM e GROUP BY gram),
{", ".join(_op12_order(k) for k in range(urls.ORDER + 1))},
scores AS (SELECT gram, CAST(floor(1000 * (ln(allowed_below) - ln(blocked_below))) AS BIGINT) AS score FROM p{urls.ORDER}),
means AS MATERIALIZED (SELECT rid, any_value(said) AS said, any_value(held) AS held, CAST(floor(sum(score)::DOUBLE / count(*)) AS BIGINT) AS mean FROM e JOIN scores USING (gram) GROUP BY rid),
bins AS (
  SELECT greatest(least(mean, {urls.MOST_SCORE}), -{urls.MOST_SCORE}) AS at_score, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b
  FROM means WHERE held AND said IS NOT NULL GROUP BY 1),
sums AS (SELECT CASE WHEN at_score <= 0 THEN at_score ELSE greatest(coalesce(lead(at_score) OVER w + 1, 0), 0) END AS at_score, sum(a) OVER w AS a_from, sum(b) OVER w AS b_from, sum(a) OVER () AS a, sum(b) OVER () AS b FROM bins WINDOW w AS (ORDER BY at_score DESC)),
best AS (SELECT coalesce((SELECT at_score FROM sums WHERE a > 0 AND b > 0 ORDER BY a_from * b + (b - b_from) * a DESC, abs(at_score), at_score LIMIT 1), 0) AS least_score)
SELECT page_id, host, path, rule, coalesce(r.said, CASE WHEN mean >= least_score THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN means USING (rid), best
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
whole AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
held AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
m AS (SELECT rid, doc_id, 100 - 50 + (50 * len(words) * n_docs) // n_terms AS m FROM d, whole WHERE len(words) > 0),
scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN held USING (term) JOIN weights USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {ranking.TOP}
"""

SQL: dict[str, str] = {
    "op2_minhash_dedup": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
