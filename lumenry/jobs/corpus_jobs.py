"""Corpus preparation over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.jobs.registry import query, read
from lumenry.operators import chunking
from lumenry.sources import html as H

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

CHUNKS = rf"""
windows AS (
  SELECT lang AS domain, doc_id, t, unnest(CASE WHEN length(t) <= 1800 THEN [0] ELSE range(0, length(t), 1600) END) AS s
  FROM (SELECT lang, doc_id, {STRIP.format("text")} AS t FROM documents WHERE text IS NOT NULL)),
chunks AS (
  SELECT domain, doc_id, s // 1600 AS k, concat(domain, ':', doc_id, ':na:', s // 1600) AS chunk_id, w AS text, length(w) AS char_count
  FROM (SELECT domain, doc_id, s, {STRIP.format("substr(t, CAST(s AS INT) + 1, 1800)")} AS w FROM windows)
  WHERE length(w) >= 20 OR regexp_matches(lower(w), '^(chapter|section|article|part)\s+[0-9ivx]+'))
"""


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query(f"WITH {CHUNKS} SELECT domain, doc_id, CAST(k AS BIGINT) AS k, chunk_id, md5(text) AS text_md5, CAST(char_count AS BIGINT) AS char_count FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunking.chunks(documents(spark, sf_dir)).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query(f"WITH {CHUNKS} SELECT chunk_id, 'char_count' AS broken FROM chunks WHERE char_count <> length(text)")
def chunk_constraints(spark, sf_dir):
    return chunking.constraints(chunking.chunks(documents(spark, sf_dir)))


@query(f"""WITH {CHUNKS}, sized AS (SELECT *, CASE WHEN char_count > 1000 THEN 'long' ELSE 'short' END AS kind FROM chunks)
SELECT domain, kind, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, CAST(sum(char_count) AS BIGINT) AS n_chars
FROM sized GROUP BY GROUPING SETS ((domain), (kind), ())""")
def parse_report(spark, sf_dir):
    return chunking.parse_report(chunking.chunks(documents(spark, sf_dir)))


@query(rf"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(max(length(w)) AS BIGINT) AS longest
FROM (SELECT doc_id, substr(t, CAST(s AS INT) + 1, 500) AS w FROM (
  SELECT doc_id, t, unnest(CASE WHEN length(t) <= 500 THEN [0] ELSE range(0, length(t), 400) END) AS s
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id""")
def segment_windows(spark, sf_dir):
    """Windows of 500 characters every 400 over text with white space collapsed."""
    flat = documents(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    cut = flat.select("doc_id", F.explode(F.transform(chunking.windows(F.col("t"), 500, 400), lambda s: F.col("t").substr(s + 1, F.lit(500)))).alias("w"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.max(F.length("w")).cast("bigint").alias("longest"))


@query("SELECT doc_id, md5(substr(text, 1, 3000)) AS head, CAST(length(text) AS BIGINT) AS n FROM documents")
def prefix_baseline(spark, sf_dir):
    """The first 3,000 characters: a baseline of the reference, not a way to look at less."""
    return documents(spark, sf_dir).select("doc_id", F.md5(F.substring("text", 1, 3000)).alias("head"), F.length("text").cast("bigint").alias("n"))


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


@query(rf"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(regexp_extract_all({NORM.format("text")}, '[a-zA-Z][a-zA-Z0-9.\-]+|\d{{3,}}')) AS term FROM documents) GROUP BY term""")
def ascii_terms(spark, sf_dir):
    """Corpus-wide counts of Latin terms: per-document counts first, so that the exchange has a row a term and document."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.ascii_terms(T.normalize(F.col("text")))).alias("term"))
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(rf"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT term) AS BIGINT) AS n_distinct, min(term) AS first_term FROM (
  SELECT doc_id, unnest(regexp_extract_all({NORM.format("text")}, '(?:19|20)\d{{2}}|\d+(?:\.\d+)?%')) AS term FROM documents) GROUP BY doc_id""")
def numeric_terms(spark, sf_dir):
    """Numeric terms of texts without CJK characters: years and percentages are all that can occur."""
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.numeric_terms(T.normalize(F.col("text")))).alias("term"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("term").alias("n_distinct"), F.min("term").alias("first_term"))


@query(r"""WITH rows AS (
  SELECT doc_id, pos, line, length(line) <= 24 AS is_heading FROM (
    SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
  WHERE trim(line) <> ''),
numbered AS (SELECT doc_id, sum(is_heading::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section, line FROM rows)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM numbered GROUP BY doc_id, section""")
def text_sections(spark, sf_dir):
    """Lines and characters of each section; short lines open one."""
    rows = chunking.sections(documents(spark, sf_dir))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(r"""WITH cut AS (SELECT doc_id, text, list_filter(string_split(replace(text, ' ', chr(10)), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 0 AND len(list_filter(l, lambda x: length(trim(x)) <= 3)) > 0.6 * len(l) THEN md5(array_to_string(list_transform(l, lambda x: trim(x)), ''))
 ELSE md5(replace(text, ' ', chr(10))) END AS repaired FROM cut""")
def charline_repair(spark, sf_dir):
    """Documents with one word a line: those of mostly very short lines are joined."""
    return documents(spark, sf_dir).select("doc_id", F.md5(chunking.repair_character_lines(F.replace(F.col("text"), F.lit(" "), F.lit("\n")))).alias("repaired"))


@query(r"""SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
 CAST(length(html) AS BIGINT) AS n_chars, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM pages""")
def html_titles(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"<title[^>]*>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.length("html").cast("bigint").alias("n_chars"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"),
    )


@query()
def html_blocks(spark, sf_dir):
    """Blocks of every page with their sections, packed to chunks of one section."""
    return H.packed_blocks(read(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, CAST(instr(lower(html), 'href') AS BIGINT) AS pos,
 md5(substr(html, CAST(greatest(instr(lower(html), 'href') - 120, 1) AS INT), CAST(240 + 4 AS INT))) AS context FROM pages WHERE instr(lower(html), 'href') > 0""")
def keyword_context(spark, sf_dir):
    """The first place of a keyword with 120 characters around it."""
    pages = read(spark, sf_dir, "pages").withColumn("pos", F.instr(F.lower("html"), "href")).where("pos > 0")
    return pages.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.md5(F.col("html").substr(F.greatest(F.col("pos") - 120, F.lit(1)), F.lit(244))).alias("context"))
