"""Queries over documents, pages and vectors."""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docmill.functions import hashing, html, terms, text
from docmill.operators import dedup, reports, validate
from docmill.plans.base import query, spread, table

FLAGS = r"""
WITH h AS (SELECT doc_id, source, text, length(text) AS n, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents),
f AS (SELECT *, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS content_hash, length(trim(text)) < 50 AS short FROM h),
g AS (SELECT *, CASE WHEN short THEN doc_id ELSE min(doc_id) FILTER (NOT short) OVER (PARTITION BY content_hash) END AS original_id FROM f)
"""


@query(FLAGS + "SELECT doc_id, content_hash, original_id, doc_id <> original_id AS is_duplicate FROM g")
def dedup_exact_flags(spark, sf_dir):
    return dedup.flag_duplicates(spread(table(spark, sf_dir, "documents")))


@query(FLAGS + "SELECT doc_id, source, n AS n_chars FROM g WHERE doc_id = original_id")
def dedup_exact_keep_first(spark, sf_dir):
    return dedup.keep_first(spread(table(spark, sf_dir, "documents"))).select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))


@query(r"""
WITH h AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT CASE WHEN t = '' THEN '' ELSE sha256(t) END AS content_hash, min(doc_id) AS representative, count(*) AS document_count, sum(length(t))::BIGINT AS total_length, avg(length(t)) AS avg_length
FROM h GROUP BY t HAVING count(*) > 1
""")
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(spread(table(spark, sf_dir, "documents")))


@query(FLAGS + """SELECT source, count(*) AS total, count(*) FILTER (doc_id <> original_id) AS duplicates, count(*) FILTER (doc_id = original_id) AS unique_docs,
  count(*) FILTER (doc_id <> original_id) / count(*) AS duplicate_rate FROM g GROUP BY source""")
def dedup_stats_by_source(spark, sf_dir):
    return dedup.duplicate_stats(spread(table(spark, sf_dir, "documents")), "source")


@query("""
WITH h AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, source FROM h WHERE t NOT IN (SELECT t FROM h WHERE source = 'src0')
""")
def dedup_against_seen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = docs.where("source = 'src0'").select(hashing.content_hash("text").alias("content_hash"))
    return dedup.not_seen(docs, seen).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN t = '' THEN '' ELSE md5(t) END AS md5_hash, CASE WHEN t = '' THEN '' ELSE sha1(t) END AS sha1_hash, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS sha256_hash FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents)")
def content_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hashes = (hashing.content_hash("text", a).alias(f"{a}_hash") for a in ("md5", "sha1", "sha256"))
    return docs.select("doc_id", *hashes)


@query("SELECT doc_id, sha256(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))) AS content_hash FROM documents")
def joined_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.joined_hash("source", "lang", "text").alias("content_hash"))


@query()
def simhash_of_documents(spark, sf_dir):
    return hashing.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'the and')")
def search_substring(spark, sf_dir):
    return reports.search(table(spark, sf_dir, "documents"), "The And", "source", "lang", "text").select("doc_id", "source")


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY doc_id DESC LIMIT 100 OFFSET 5")
def page_of_documents(spark, sf_dir):
    docs = reports.where_all(table(spark, sf_dir, "documents"), lang="en", source="src3", text=None)
    return reports.page(docs.select("doc_id", "source", "lang"), [F.desc("doc_id")], 100, 5)


@query("SELECT source, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def docs_by_source_latest(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))
    return reports.page(out, [F.desc("n"), F.col("source")], 10)


@query("SELECT d.source, count(*) AS raw_documents, count(l.doc_id) AS processed, avg(l.quality) AS avg_quality, max(l.doc_id) AS latest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def left_join_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    both = docs.join(labels, docs["doc_id"] == labels["label_id"], "left")
    return both.groupBy("source").agg(F.count("*").alias("raw_documents"), F.count("label_id").alias("processed"), F.avg("quality").alias("avg_quality"), F.max("label_id").alias("latest"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_documents(spark, sf_dir):
    return reports.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")), "doc_id", "label_id")


@query(r"SELECT doc_id, regexp_extract_all(text, 'https?://[^\s<>\"]+|www\.[^\s<>\"]+').list_aggregate('string_agg', ' ') AS urls, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b').list_aggregate('string_agg', ' ') AS emails FROM documents WHERE regexp_matches(text, 'https?://|www\.|@')")
def extract_addresses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"https?://|www\.|@"))
    joined = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    return docs.select("doc_id", joined(text.extract_urls("text")).alias("urls"), joined(text.extract_emails("text")).alias("emails"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, 'https?://[^\s<>\"]+|www\.[^\s<>\"]+', '[URL]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL]', 'g')) AS masked FROM documents")
def mask_addresses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.mask_addresses("text"), 256).alias("masked"))


@query(r"""
WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0) AS r FROM documents)
SELECT doc_id, CASE WHEN r > 0.3 THEN 'chinese' WHEN r < 0.05 THEN 'english' WHEN r IS NULL THEN 'unknown' ELSE 'mixed' END AS script FROM c
""")
def script_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script_of("text").alias("script"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 2 AND word NOT IN ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with') GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= 10
""")
def keywords_top10(spark, sf_dir):
    return terms.top_terms(table(spark, sf_dir, "documents"), "doc_id", "text", 10, lambda w: (F.length(w) > 2) & ~w.isin(*text.STOP_WORDS))


#: Every finding as field:rule:level. The title is the first line, so it opens the content: their sequence ratio is twice its length over both.
FOUND = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS content, CASE WHEN source = 'src0' THEN NULL ELSE source END AS author FROM documents),
v AS (SELECT doc_id, unnest([
  CASE WHEN trim(title) = '' THEN 'title:title_required:error' WHEN length(title) < 5 OR length(title) > 200 THEN 'title:title_length:error' END,
  CASE WHEN trim(title) <> '' AND regexp_matches(title, '[<>]') THEN 'title:title_format:error' END,
  CASE WHEN trim(regexp_replace(content, '\s+', ' ', 'g')) = '' THEN 'content:content_required:error' WHEN length(content) < 50 THEN 'content:content_min_length:error' END,
  CASE WHEN length(content) > 100000 THEN 'content:content_max_length:warning' END,
  CASE WHEN length(author) > 100 THEN 'author:author_length:warning' END,
  CASE WHEN regexp_matches(content, '<[^>]+>') THEN 'content:html_left:warning' END,
  CASE WHEN 1 - len(list_distinct(string_split(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), ' '))) / len(string_split(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), ' ')) > 0.5 THEN 'content:repetition:warning' END,
  CASE WHEN regexp_matches(content, 'Ã©|Ã¨|Ãª|Ã«|â€') THEN 'content:encoding:warning' END,
  CASE WHEN title <> '' AND content <> '' THEN 'content:starts_with_title:info' END,
  CASE WHEN title <> '' AND content <> '' AND 2 * length(title) > 0.8 * (length(title) + length(content)) THEN 'title:title_like_content:warning' END
]) AS finding FROM t),
f AS (SELECT doc_id, split_part(finding, ':', 1) AS field, split_part(finding, ':', 2) AS rule, split_part(finding, ':', 3) AS level FROM v WHERE finding IS NOT NULL)
"""
FINDINGS = FOUND + "SELECT doc_id, field || ':' || rule AS finding FROM f"


@query(FINDINGS)
def validation_findings(spark, sf_dir):
    out = validate.validate(_titled(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f"))
    return out.select("doc_id", F.concat_ws(":", "f.field", "f.rule").alias("finding"))


@query(FINDINGS.replace("field || ':' || rule AS finding", "'[' || upper(level) || '] ' || field || ': ' || replace(rule, '_', ' ') AS finding"))
def validation_findings_of_all_rules(spark, sf_dir):
    """The findings as messages."""
    out = validate.validate(_titled(spark, sf_dir)).select("doc_id", F.explode("findings").alias("f"))
    return out.select("doc_id", validate.message(F.col("f")).alias("finding"))


def _titled(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.when(F.col("source") != "src0", F.col("source")).alias("author"))


@query(
    FOUND
    + """, d AS (SELECT doc_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w, count(*) FILTER (level = 'info') AS i FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id)
SELECT count(*) AS total, count(*) FILTER (e = 0) AS valid, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, sum(i)::BIGINT AS infos, count(*) FILTER (e = 0) / count(*) AS validity_rate, sum(e) / count(*) AS errors_per_document,
  (SELECT string_agg(field, ',' ORDER BY n DESC, field) FROM (SELECT field, count(*) AS n FROM f GROUP BY field ORDER BY n DESC, field LIMIT 5)) AS top_fields FROM d"""
)
def validation_summary(spark, sf_dir):
    return validate.validation_summary(validate.validate(_titled(spark, sf_dir)))


@query()
def normalize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(text.normalize("text"), 256).alias("normalized"))


@query(r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS description, sha256(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]+>', '', 'g'))) AS cleaned, length(t) <= 200 AS is_short
FROM documents JOIN s USING (doc_id)
""")
def descriptions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate("text").alias("description"), F.sha2(text.clean_content("text"), 256).alias("cleaned"), (F.length(text.squeeze("text")) <= 200).alias("is_short"))


@query()
def standard_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = F.split("text", "\n")[0]
    return docs.select("doc_id", text.standard_title(first).alias("title"), F.sha2(text.summary("text"), 256).alias("summary"), F.array_join(text.standard_tags(F.split(first, " ")), ",").alias("tags"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain FROM pages")
def page_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain("url").alias("domain"))


@query()
def html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", html.extracted("html", "url").alias("p"))
    return pages.select("page_id", "p.title", F.sha2("p.content", 256).alias("content_sha256"), F.length("p.content").alias("content_chars"), "p.author", "p.publish_date", F.array_join("p.tags", ",").alias("tags"), F.size("p.images").alias("n_images"), F.col("p.metadata")["language"].alias("language"))


@query()
def html_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(html.extracted("html", "url")["links"]).alias("l"))
    return pages.select("page_id", "l.href", F.col("l.text").alias("anchor"))


@query("SELECT page_id, CASE WHEN strlen(html) < 1024 THEN printf('%.1f B', strlen(html)::DOUBLE) WHEN strlen(html) < 1048576 THEN printf('%.1f KB', strlen(html) / 1024.0) ELSE printf('%.1f MB', strlen(html) / 1048576.0) END AS size FROM pages")
def page_sizes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("n"))
    return pages.select("page_id", text.human_size("n").alias("size"))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score >= 0.1)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return dedup.similar_vectors(rows, rows.where("vec_id % 20 = 0"), 5, 0.1).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("""
WITH f AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h, length(text) AS n, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM documents),
p AS (SELECT doc_id, min(doc_id) OVER g AS other, h, w, arg_min(h, doc_id) OVER g AS oh, arg_min(w, doc_id) OVER g AS ow FROM f WINDOW g AS (PARTITION BY n))
SELECT doc_id, other, round(0.4 * (1 - len(list_filter(range(1, 33), lambda i: h[i] <> oh[i])) / 128.0) + 0.2 * (least(w, ow) / greatest(w, ow)) + 0.4, 6) AS score FROM p
""")
def composite_score(spark, sf_dir):
    """The weighted score of each document against the first one of its length."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", hashing.content_hash("text", "md5").alias("h"), F.length("text").alias("n"), F.size(F.split(text.squeeze("text"), " ")).alias("w")
    )
    first = docs.groupBy("n").agg(F.min(F.struct("doc_id", "h", "w", "n")).alias("o"))
    of = hashing.structure_class
    score = hashing.composite_similarity(hashing.hex_similarity("h", "o.h"), hashing.ratio(F.col("n"), F.col("o.n")), hashing.ratio(F.col("w"), F.col("o.w")), hashing.structure_similarity(of(F.col("n")), of(F.col("o.n"))))
    return docs.join(first, "n").select("doc_id", F.col("o.doc_id").alias("other"), F.round(score, 6).alias("score"))


#: The sequence ratio of the MD5 digits of classes M and L; texts long enough to be compared have one of the two.
M_L = SequenceMatcher(None, *(hashlib.md5(c.encode()).hexdigest() for c in "ML")).ratio()
SCORES = f"""
WITH f AS (SELECT doc_id, sha256(t) AS h, length(t) AS n, len(string_split(t, ' ')) AS w, CASE WHEN length(t) <= 100 THEN 'M' ELSE 'L' END AS s
  FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents WHERE length(trim(text)) >= 50)),
p AS (SELECT a.doc_id, b.doc_id AS other, a.h, b.h AS oh, 0.2::DOUBLE * (least(a.n, b.n) / greatest(a.n, b.n)) AS l, 0.2::DOUBLE * (least(a.w, b.w) / greatest(a.w, b.w)) AS w, 0.2::DOUBLE * CASE WHEN a.s = b.s THEN 1 ELSE {M_L}::DOUBLE END AS s FROM f a JOIN f b ON b.doc_id < a.doc_id),
d AS (SELECT doc_id, bool_or(h = oh) AS same, bool_or(l + w + s >= 0.5499 OR l + w + s >= 0.4499 AND round(0.4::DOUBLE * (1 - len(list_filter(range(1, 65), lambda i: h[i] <> oh[i])) / 256.0) + l + w + s, 9) >= 0.85) AS near FROM p WHERE l + w + s >= 0.4499 GROUP BY doc_id)
"""


@query(SCORES + "SELECT doc_id, coalesce(near, false) AS is_similar FROM documents LEFT JOIN d USING (doc_id)")
def similar_flags(spark, sf_dir):
    """Documents with an earlier one of a weighted score of 0.85 or more."""
    return dedup.similar_flags(spread(table(spark, sf_dir, "documents")))


@query(SCORES + "SELECT doc_id, coalesce(same OR near, false) AS is_duplicate, CASE WHEN same THEN 'content' WHEN near THEN 'similar' END AS method FROM documents LEFT JOIN d USING (doc_id)")
def duplicate_check(spark, sf_dir):
    return dedup.is_duplicate(spread(table(spark, sf_dir, "documents")))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def document_by_id(spark, sf_dir):
    return reports.by_id(table(spark, sf_dir, "documents"), "doc_id", 7).select("doc_id", "source", "lang")


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS content_hash, NULL::VARCHAR AS title_hash, length(t)::INT AS content_length, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::INT AS word_count FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS t FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def signature_table(spark, sf_dir):
    """Signatures of all documents but those that were removed again."""
    known = dedup.signatures(table(spark, sf_dir, "documents"))
    return dedup.remove_signatures(known, table(spark, sf_dir, "labels").where("toxic = 1"))


@query("SELECT doc_id, 'warning' AS level, unnest(['doc_id', 'lang', 'n_chars']) AS field, 'unknown_field' AS rule FROM documents UNION ALL SELECT doc_id, 'error', unnest(['title', 'content']), 'missing_field' FROM documents")
def schema_findings(spark, sf_dir):
    """``documents`` against the fields that a document has to have; text isn't one of them either."""
    docs = table(spark, sf_dir, "documents").drop("text")
    found = validate.schema_findings(docs).select("doc_id", F.explode("schema_findings").alias("f"))
    return found.select("doc_id", "f.level", "f.field", "f.rule")
