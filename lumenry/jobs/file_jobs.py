"""Files derived from the given tables: which file a document is, how its bytes are read, what fails, what is cached, and questions in file order."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from lumenry.jobs.corpus_jobs import documents
from lumenry.jobs.registry import query, read
from lumenry.operators import chunking
from lumenry.sources import files, raw
from lumenry.sources.shared import shared_dir

RULES = [
    ("contracts", r".*", "raw/contracts", ".pdf", "exact"),
    ("reports", r".*", "raw/reports", ".pdf", "any_case"),
    ("rules", r"^csrc_\d+_att\d+$", "raw/rules/attachments", ".pdf", "exact"),
    ("rules", r"^csrc_\d+$", "raw/rules/html", ".html", "exact"),
    ("rules", r"^(strict_v3_\d+)_", "raw/rules/txt", ".txt", "prefix"),
]

WANTED = """
wanted AS (SELECT doc_id AS i, CASE doc_id % 6 WHEN 0 THEN 'contracts' WHEN 1 THEN 'reports' WHEN 5 THEN 'mail' ELSE 'rules' END AS domain,
  CASE doc_id % 6 WHEN 2 THEN 'csrc_' || doc_id || '_att1' WHEN 3 THEN 'csrc_' || doc_id WHEN 4 THEN 'strict_v3_' || doc_id || '_' || coalesce(lang, '') ELSE 'd' || doc_id END AS name FROM documents WHERE doc_id IS NOT NULL),
files AS (
  SELECT 'raw/contracts/d' || i || CASE WHEN i % 5 = 0 THEN '.PDF' ELSE '.pdf' END AS path FROM wanted WHERE i % 6 = 0 AND i % 7 <> 0 UNION ALL
  SELECT 'raw/reports/d' || i || CASE WHEN i % 5 = 0 THEN '.PDF' ELSE '.pdf' END FROM wanted WHERE i % 6 = 1 AND i % 7 <> 0 UNION ALL
  SELECT 'raw/reports/d' || i || '.Pdf' FROM wanted WHERE i % 6 = 1 AND i % 4 = 0 OR i % 6 = 1 AND i % 11 = 0 UNION ALL
  SELECT 'raw/rules/attachments/' || name || '.pdf' FROM wanted WHERE i % 6 = 2 AND i % 7 <> 0 UNION ALL
  SELECT 'raw/rules/html/' || name || '.html' FROM wanted WHERE i % 6 = 3 AND i % 7 <> 0 UNION ALL
  SELECT 'raw/rules/txt/strict_v3_' || i || '_a_title.txt' FROM wanted WHERE i % 6 = 4 AND i % 7 <> 0 UNION ALL
  SELECT 'raw/rules/txt/strict_v3_' || i || '_b.txt' FROM wanted WHERE i % 6 = 4 AND i % 11 = 0 UNION ALL
  SELECT 'raw/rules/txt/strict_v3_' || i || '0_longer.txt' FROM wanted WHERE i % 6 = 4)"""


def _wanted(spark, sf_dir):
    d = documents(spark, sf_dir).where("doc_id is not null")
    i, n = F.col("doc_id"), F.col("doc_id").cast("string")
    k = i % 6
    domain = F.when(k == 0, "contracts").when(k == 1, "reports").when(k == 5, "mail").otherwise("rules")
    name = F.when(k == 2, F.concat(F.lit("csrc_"), n, F.lit("_att1"))).when(k == 3, F.concat(F.lit("csrc_"), n)).when(k == 4, F.concat(F.lit("strict_v3_"), n, F.lit("_"), F.coalesce("lang", F.lit("")))).otherwise(F.concat(F.lit("d"), n))
    own = d.select(i.alias("i"), domain.alias("domain"), name.alias("doc_id"))
    s = F.col("i").cast("string")
    case = F.when(F.col("i") % 5 == 0, ".PDF").otherwise(".pdf")
    kind = lambda x: F.col("i") % 6 == x
    there = F.col("i") % 7 != 0
    every = F.array(
        F.when(kind(0) & there, F.concat(F.lit("raw/contracts/d"), s, case)),
        F.when(kind(1) & there, F.concat(F.lit("raw/reports/d"), s, case)),
        F.when(kind(1) & ((F.col("i") % 4 == 0) | (F.col("i") % 11 == 0)), F.concat(F.lit("raw/reports/d"), s, F.lit(".Pdf"))),
        F.when(kind(2) & there, F.concat(F.lit("raw/rules/attachments/"), F.col("doc_id"), F.lit(".pdf"))),
        F.when(kind(3) & there, F.concat(F.lit("raw/rules/html/"), F.col("doc_id"), F.lit(".html"))),
        F.when(kind(4) & there, F.concat(F.lit("raw/rules/txt/strict_v3_"), s, F.lit("_a_title.txt"))),
        F.when(kind(4) & (F.col("i") % 11 == 0), F.concat(F.lit("raw/rules/txt/strict_v3_"), s, F.lit("_b.txt"))),
        F.when(kind(4), F.concat(F.lit("raw/rules/txt/strict_v3_"), s, F.lit("0_longer.txt"))),
    )
    return own.select("domain", "doc_id"), own.select(F.explode(F.filter(every, lambda p: p.isNotNull())).alias("path"))


@query(f"""WITH {WANTED}, hits AS (SELECT domain, name, path FROM wanted JOIN files ON CASE
  WHEN domain = 'contracts' THEN path = 'raw/contracts/' || name || '.pdf'
  WHEN domain = 'reports' THEN starts_with(path, 'raw/reports/' || name || '.') AND lower(path) = 'raw/reports/' || name || '.pdf'
  WHEN name LIKE 'csrc%att1' THEN path = 'raw/rules/attachments/' || name || '.pdf' WHEN name LIKE 'csrc%' THEN path = 'raw/rules/html/' || name || '.html'
  ELSE starts_with(path, 'raw/rules/txt/strict_v3_' || i || '_') AND suffix(path, '.txt') END WHERE domain <> 'mail')
SELECT domain, name AS doc_id, CASE WHEN count(path) = 1 THEN min(path) END AS path, count(path) AS n_hits,
  CASE WHEN domain = 'mail' THEN 'unknown_domain' WHEN count(path) = 0 THEN 'not_found' WHEN count(path) > 1 THEN 'ambiguous' END AS error
FROM (SELECT DISTINCT domain, name FROM wanted) LEFT JOIN hits USING (domain, name) GROUP BY domain, name""")
def file_resolution(spark, sf_dir):
    """The one file of every document: by its name, its name with the suffix in any case, or a beginning of the name; none and several are errors."""
    wanted, listed = _wanted(spark, sf_dir)
    return raw.resolve(wanted, listed, RULES)


def _encode(text, i):
    """A file's bytes: UTF-8, with a byte-order mark, GB18030, with other line ends, or broken."""

    def run(texts: pd.Series, ids: pd.Series) -> pd.Series:
        def one(t, k):
            forms = (lambda: t.encode(), lambda: b"\xef\xbb\xbf" + t.encode(), lambda: t.encode("gb18030"), lambda: t.replace("\n", "\r\n").encode(), lambda: t.encode() + b" \xff")
            return None if t is None else forms[k % 5]()

        return pd.Series([one(t, k) for t, k in zip(texts, ids, strict=True)])

    return F.pandas_udf(run, "binary")(text, i)


def _bytes(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", _encode("text", F.coalesce("doc_id", F.lit(0))).alias("content"))


_ASCII = r"regexp_full_match(text, '[\x00-\x7F]*')"


@query(rf"""SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 5 = 4 THEN NULL ELSE md5(regexp_replace(text, '\r\n?', chr(10), 'g')) END AS text_md5,
  CASE WHEN text IS NULL OR doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 2 AND NOT {_ASCII} THEN 'gb18030' ELSE 'utf-8' END AS encoding FROM documents""")
def decoded_texts(spark, sf_dir):
    """Every document's bytes in one of several encodings, read by the first that fits; broken ones have no text."""
    return raw.decoded(_bytes(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), "encoding")


def _raw_documents(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("txt", "paged", "odt"))), F.when(F.col("doc_id") % 10 == 9, 3).when(F.col("doc_id") % 2 == 0, 1).otherwise(2))
    # a paged document has a page for every part between blank lines; its last page has the document's broken end
    own = documents(spark, sf_dir).where("doc_id is not null").select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.regexp_replace("text", r"\n\n", "\f")).otherwise(F.col("text")).alias("text"))
    return own.select("doc_id", kind.alias("kind"), _encode("text", "doc_id").alias("content"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN replace(text, chr(10) || chr(10), chr(12)) ELSE text END AS text, CASE WHEN doc_id % 10 = 9 THEN 'odt' WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'paged' END AS kind, doc_id % 5 = 4 AS broken FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, 'document' AS stage, CASE WHEN kind = 'odt' THEN 'kind' WHEN text IS NULL THEN 'content' ELSE 'encoding' END AS error FROM d WHERE kind = 'odt' OR text IS NULL OR kind = 'txt' AND broken
UNION ALL SELECT doc_id, 'page_' || len(string_split(text, chr(12))), 'encoding' FROM d WHERE kind = 'paged' AND broken""")
def parse_failures(spark, sf_dir):
    """What fails while all documents are parsed: a row a failure, of a document or a page; the others go on."""
    return raw.parse(_raw_documents(spark, sf_dir)).select("doc_id", F.explode("failures").alias("f")).select("doc_id", "f.stage", "f.error")


@query("""WITH d AS (SELECT doc_id, doc_id % 10 = 9 AS odt, doc_id % 2 = 0 AS txt, doc_id % 5 = 4 AS broken, text IS NULL AS empty FROM documents WHERE doc_id IS NOT NULL),
runs AS (SELECT 1 AS run, * FROM d WHERE doc_id % 4 <> 0 UNION ALL SELECT 3, * FROM d WHERE doc_id % 4 = 0 UNION ALL SELECT 4, * FROM d WHERE doc_id % 50 = 0 UNION ALL SELECT 5, * FROM d),
n AS (SELECT run, count(*) AS documents, count(*) FILTER (odt OR empty OR txt AND broken) AS failed_documents, count(*) FILTER (NOT odt AND NOT empty AND NOT txt AND broken) AS failed_pages FROM runs GROUP BY run)
SELECT CAST(k AS BIGINT) AS run, CAST(coalesce(documents, 0) AS BIGINT) AS documents, CAST(coalesce(failed_documents, 0) AS BIGINT) AS failed_documents, CAST(coalesce(failed_pages, 0) AS BIGINT) AS failed_pages FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k) LEFT JOIN n ON k = run""")
def parse_cache_runs(spark, sf_dir):
    """Five runs over one cache: three quarters of the documents, the same again, all, a refresh of some, and a refresh of all; what each parses is counted while it writes."""
    docs = _raw_documents(spark, sf_dir)
    cache = raw.ParseCache(spark, f"{shared_dir(spark).rstrip('/')}/lumenry-{uuid.uuid4().hex}")
    most = docs.where("doc_id % 4 <> 0")
    runs = [cache.update(most), cache.update(most), cache.update(docs), cache.update(docs, docs.select("doc_id").where("doc_id % 50 = 0")), cache.update(docs, "all")]
    return spark.createDataFrame([(k, r["documents"], r["failed_documents"], r["failed_pages"]) for k, r in enumerate(runs, 1)], "run bigint, documents bigint, failed_documents bigint, failed_pages bigint")


@query(r"""WITH q AS (SELECT p_partkey, 'f' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS f, p_brand AS domain, row_number() OVER (ORDER BY 'f' || lpad(CAST(p_size AS VARCHAR), 3, '0'), p_partkey) - 1 AS ordinal FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS qid, domain, CAST(ordinal AS BIGINT) AS ordinal, CAST(row_number() OVER (PARTITION BY domain ORDER BY ordinal) - 1 AS BIGINT) AS in_domain FROM q""")
def question_ordinals(spark, sf_dir):
    """Questions of many files in file order: each one's place over all files and within its domain."""
    rows = read(spark, sf_dir, "part").select(F.format_string("f%03d", "p_size").alias("file"), "p_partkey", F.col("p_partkey").cast("string").alias("qid"), F.col("p_brand").alias("domain"), F.col("p_name").alias("question"))
    found = files.scan_question_files(spark, files.write_question_files(rows, "file", "p_partkey"))
    return files.ordinals(found, ["ordinal"], ["domain"], "in_domain").select("qid", "domain", "ordinal", "in_domain")


_LINED = r"regexp_replace(text, '(...)', '\1' || chr(10), 'g')"


@query(rf"""WITH lined AS (SELECT doc_id, {_LINED} AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM lined),
merged AS (SELECT doc_id, t, l, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(l, ''), '\s+([，。；：、,.!?！？）】》])', '\1', 'g'), '([（【《])\s+', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'), '([。！？；])', '\1' || chr(10), 'g') AS m FROM cut)
SELECT doc_id, CASE WHEN len(l) > 0 AND len(list_filter(l, lambda x: length(regexp_replace(x, '\s+', '', 'g')) <= 3 AND NOT regexp_matches(x, '[A-Za-z]{{2}}'))) > 0.6 * len(l) THEN md5(regexp_replace(m, '^\s+|\s+$', '', 'g')) ELSE md5(t) END AS merged FROM merged""")
def charline_merge(spark, sf_dir):
    """Texts broken after every third character: those of lines without two Latin letters in a row are joined, with their marks tidied."""
    lined = documents(spark, sf_dir).where("text is not null").select("doc_id", F.regexp_replace("text", "(...)", "$1\n").alias("t"))
    return lined.select("doc_id", F.md5(chunking.merge_character_lines(F.col("t"))).alias("merged"))
