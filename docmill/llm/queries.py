"""Queries of the numbered operators over their whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are; None: beside the installed ``public_tokenizers``.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors by inner product for each vector whose id is divisible by 50."""
    from docmill.llm import search

    rows = table(spark, sf_dir, "embeddings")
    return search.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each document loses to an earlier copy, or from 32 characters on to an earlier line within one edit."""
    from docmill.llm import line_dedup

    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the digests of ids and of what they decode to."""
    import public_tokenizers

    from docmill.llm import bpe

    tokenizer = bpe.tokenizer_of_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of about equal bytes."""
    from docmill.llm import sharding

    placed = sharding.assign(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    from docmill.llm import language_id

    docs = table(spark, sf_dir, "documents")
    counts = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, counts)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's URL."""
    from docmill.llm import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the base spans and the tokens that only few owners hold in few documents."""
    from docmill.llm import secrets

    rows = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["nth"] < len(secrets.BASE))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.nth = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)]
    n_live = F.size(F.filter("spans", lambda s: F.array_contains(F.col("live"), s["hash"]))).cast("long")
    return rows.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), n_live.alias("n_live"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, with the verdict of its host."""
    from docmill.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a similarity of 0.8 or more."""
    from docmill.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from docmill.llm import bpe, packing

    return packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_of_file(vocabulary("byte_bpe_50k.json")), 2048, 0)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how like they are."""
    from docmill.llm import fingerprints

    return fingerprints.beside_next(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors and their errors."""
    from docmill.llm import vector_codes
    from docmill.llm.common import materialize

    rows = materialize(vector_codes.integers(table(spark, sf_dir, "embeddings"), keep=("label",)), "integers")
    books = vector_codes.fit(rows)
    coded = vector_codes.with_group_error(vector_codes.encode(rows, books), "label")
    return coded.select(F.col("id").alias("vec_id"), vector_codes.hex_code().alias("code"), "error", F.col("group_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, by source."""
    from docmill.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k_search": op1_top_k_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dup": op9_near_dup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}

#: Lines within one edit share the first or the last half of the shorter one's length.
OP2_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), part AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t-\\r]')),
firsts AS (
  SELECT line, length(line) AS chars, min((doc_id, line_no)) AS first FROM part GROUP BY line
), halves AS (
  SELECT line, chars, first, least, 0 AS side, left(line, (least // 2)::INT) AS half FROM (SELECT *, unnest([chars, chars - 1]) AS least FROM firsts WHERE chars >= 32)
  UNION ALL
  SELECT line, chars, first, least, 1, right(line, (least // 2)::INT) FROM (SELECT *, unnest([chars, chars - 1]) AS least FROM firsts WHERE chars >= 32)
), near AS (
  SELECT DISTINCT b.line FROM halves a JOIN halves b
  ON a.side = b.side AND a.half = b.half AND a.least = b.least AND a.first < b.first AND levenshtein(a.line, b.line) = 1
), dropped AS (
  SELECT p.doc_id, p.line_no, CASE WHEN (p.doc_id, p.line_no) <> f.first THEN 'exact' ELSE 'near' END AS kind
  FROM part p JOIN firsts f USING (line) LEFT JOIN near n USING (line)
  WHERE (p.doc_id, p.line_no) <> f.first OR n.line IS NOT NULL
), by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'exact') AS n_exact, count(*) FILTER (kind = 'near') AS n_near, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS dropped
  FROM dropped GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(dropped, '') AS dropped
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

OP7_SQL = r"""
WITH hits AS (
  SELECT doc_id, source, 'assign' AS kind, 0 AS nth, string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS found,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
  UNION ALL SELECT doc_id, source, 'access', 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM (SELECT *, coalesce(text, '') AS t FROM documents)
  UNION ALL SELECT doc_id, source, 'hex', 2, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) FROM (SELECT *, coalesce(text, '') AS t FROM documents)
  UNION ALL SELECT doc_id, source, 'token', 3, string_split_regex(t, '[A-Za-z0-9+/_-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}', 0), regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}', 0) FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), each AS (
  SELECT doc_id, source, kind, nth, unnest(found) AS m, unnest(vals) AS v, unnest(gaps[:len(found)]) AS gap, unnest(range(1, len(found) + 1)) AS i FROM hits WHERE len(found) > 0
), placed AS (
  SELECT doc_id, source, kind, nth, v, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, nth ORDER BY i))::BIGINT AS e, length(m) AS n FROM each
), spans AS (
  SELECT doc_id, source, kind, nth, v, e - n AS s, e FROM placed
  WHERE length(v) >= 6 AND CASE kind WHEN 'access' THEN n >= 20 WHEN 'hex' THEN n >= 24
    WHEN 'token' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND NOT starts_with(v, 'AKIA') ELSE true END
), owned AS (SELECT v, count(DISTINCT source) <= 2 AND count(DISTINCT doc_id) <= 5 AS live FROM spans GROUP BY v),
reported AS (SELECT * FROM spans JOIN owned USING (v) WHERE nth < 3 OR live),
by_doc AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans, count(*) FILTER (live) AS n_live
  FROM reported GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS terms FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.terms::DOUBLE[], c.terms::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule,
    lower(host || path) AS place FROM parts
), patterns(pattern, regex) AS (VALUES
  ('-pills.', '-pills\.'), ('/sponsored/*/redirect|', '(?s)/sponsored/.*/redirect$'), ('@@||casino-museum.', '^([^/]*\.)?casino-museum\.'), ('||ads-track.', '^([^/]*\.)?ads-track\.'),
  ('||ads.', '^([^/]*\.)?ads\.'), ('||casino-*.', '(?s)^([^/]*\.)?casino-.*\.'), ('||free-bets.', '^([^/]*\.)?free-bets\.'), ('||spam-*.example.', '(?s)^([^/]*\.)?spam-.*\.example\.')
), hits AS (
  SELECT page_id, arg_min(pattern, (NOT starts_with(pattern, '@@'), pattern)) AS pattern FROM (SELECT DISTINCT page_id, place FROM ruled WHERE rule IS NULL) JOIN patterns ON regexp_matches(place, regex) GROUP BY page_id
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') OR starts_with(pattern, '@@') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM ruled LEFT JOIN hits USING (page_id)
"""

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, unnest([0, 1, 2]) AS s(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines OR coalesce(word_chars / nullif(n_words, 0) NOT BETWEEN 3.0 AND 10.0, false) AS soft_failed FROM m
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM judged GROUP BY source
), moments AS (
  SELECT least(greatest(sum(bad) / sum(n), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS mean, sum(n * (bad / n) * (bad / n)) / sum(n) AS square, count(*) / sum(n) AS hosts FROM hosts
), prior AS (
  SELECT mean, CASE WHEN square - mean * mean - mean * (1 - mean) * hosts > 0 THEN least(greatest(mean * (1 - mean) / (square - mean * mean - mean * (1 - mean) * hosts) - 1, 2.0::DOUBLE), 1000.0::DOUBLE) ELSE 10.0::DOUBLE END AS strength FROM moments
), rates AS (SELECT source, (bad + mean * strength) / (n + strength) AS host_rate, 3.0::DOUBLE * mean / (1 - mean + 3.0::DOUBLE * mean) AS bound FROM hosts, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT (host_rate > bound AND soft_failed) AS kept, round(host_rate, 9) AS host_rate
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.node = l.x),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: One round of assignments and means after the other; sums and products stay below 2 ** 53, so doubles are exact.
OP12_SQL = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, part, v[(part * len(v) // 4 + 1)::INT:((part + 1) * len(v) // 4)::INT] AS x FROM k, range(4) AS r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256),
"""
    + "".join(
        f"""a{i} AS (
  SELECT vec_id, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), entry)) AS best FROM p JOIN c{i} USING (part) GROUP BY vec_id, part
), m{i} AS (
  SELECT part, best[2] AS entry, i, floor(sum(x[i]) / count(*)) AS mean FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL
), c{i + 1} AS (SELECT c{i}.part, c{i}.entry, coalesce(means, c) AS c FROM c{i} LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS means FROM m{i} GROUP BY part, entry) USING (part, entry)),
"""
        for i in range(4)
    )
    + """a AS (
  SELECT vec_id, part, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), entry)) AS best FROM p JOIN c4 USING (part) GROUP BY vec_id, part
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), books
"""
)

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)
), f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier FROM orders, range(1, 6) AS s(step)
), counts AS (
  SELECT part, filter_order, step, bit, count(*) FILTER (mask & (bit | earlier) = 0) AS kept, count(*) FILTER (mask & bit > 0 AND mask & earlier = 0) AS removed,
    count(*) FILTER (mask & bit > 0 AND mask & earlier > 0) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
    count(*) FILTER (mask & bit > 0 AND mask & earlier = 0 AND good = 1) AS good_lost, count(*) FILTER (mask & bit > 0 AND mask & earlier = 0 AND toxic = 1) AS toxic_lost
  FROM m, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts
"""

#: Tokenizers, sampled splitters and learnt models have no SQL; tests hold these queries against brute force.
ORACLE: dict[str, str] = {
    "op1_top_k_search": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_secret_scan": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_near_dup": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
