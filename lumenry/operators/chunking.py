"""Documents to chunks: sliding windows, constraints, sections, repairs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import text as T

WIDTH, STEP, SHORTEST = 1800, 1600, 20
HEADING = r"^(?:第[一二三四五六七八九十百千0-9]+[章节条款编]|(?:chapter|section|article|part)\s+[0-9ivx]+)"

LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# Marks without a blank before them, without one after them, and at the end of a sentence.
CLOSING, OPENING, SENTENCE_END = "，。；：、,.!?！？）】》", "（【《", "。！？；"


def windows(text: Column, width: int = WIDTH, step: int = STEP) -> Column:
    """Start offsets: one window for a text of up to ``width`` characters, else one every ``step``."""
    n = F.length(text)
    return F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)))


def chunks(docs: DataFrame, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """(domain, doc_id, k, chunk_id, text, char_count). Null texts have none; blank and very short windows are dropped.

    One narrow pass: no exchange, the scan reads three columns."""
    stripped = docs.select(F.col("lang").alias("domain"), "doc_id", T.strip(F.col("text")).alias("t"))
    cut = stripped.select("domain", "doc_id", "t", F.posexplode(windows(F.col("t"), width, step)).alias("k", "s"))
    own = cut.select("domain", "doc_id", "k", T.strip(F.col("t").substr(F.col("s") + 1, F.lit(width))).alias("text"))
    return own.where((F.length("text") >= SHORTEST) | F.lower("text").rlike(HEADING)).select(
        "domain",
        "doc_id",
        F.col("k").cast("bigint").alias("k"),
        F.concat_ws(":", "domain", F.col("doc_id").cast("string"), F.lit("na"), F.col("k").cast("string")).alias("chunk_id"),
        "text",
        F.length("text").cast("bigint").alias("char_count"),
    )


def constraints(chunked: DataFrame) -> DataFrame:
    """Rows that break a constraint of a chunk, with the name of the first one broken."""
    reason = (
        F.when(F.col("domain").isNull() | (F.col("domain") == ""), "domain")
        .when(F.col("doc_id").isNull(), "doc_id")
        .when(F.trim("text") == "", "text")
        .when(F.col("char_count") != F.length("text"), "char_count")
        .when(~F.col("chunk_id").rlike(r"^[^:]+:[^:]+:(?:na|[0-9]+):[0-9]+$"), "chunk_id")
    )
    return chunked.select("chunk_id", reason.alias("broken")).where("broken is not null")


def parse_report(chunked: DataFrame) -> DataFrame:
    """Documents and chunks in all, by domain, and by length class, in one grouping-sets aggregation."""
    sized = chunked.withColumn("kind", F.when(F.col("char_count") > 1000, "long").otherwise("short"))
    return (
        sized.groupingSets([["domain"], ["kind"], []], "domain", "kind")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.sum("char_count").alias("n_chars"))
        .select("domain", "kind", "n_docs", "n_chunks", "n_chars")
    )


def sections(docs: DataFrame, heading: Column | None = None) -> DataFrame:
    """Text lines with the number of the section they belong to: a running count of heading lines in a document."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    rows = rows.withColumn("is_heading", (F.length("line") <= 24) if heading is None else heading)
    running = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(F.col("is_heading").cast("bigint")).over(running))


def repair_character_lines(text: Column) -> Column:
    """Where over 60 % of the lines that aren't empty have up to 3 characters, joins all lines."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(rows, lambda x: F.length(F.trim(x)) <= 3))
    return F.when((F.size(rows) > 0) & (short > 0.6 * F.size(rows)), F.array_join(F.transform(rows, lambda x: F.trim(x)), "")).otherwise(text)


def merge_character_lines(text: Column) -> Column:
    """Where over 60 % of the lines that aren't blank hold one to three characters and no two Latin letters in a row, joins all lines: blanks before closing marks and after
    opening ones go, runs of blanks shrink, and a line ends after each mark that ends a sentence. Other texts stay."""
    rows = F.filter(F.transform(F.split(text, LINE_END), T.strip), lambda x: x != "")
    few = lambda x: (F.length(F.regexp_replace(x, r"\s+", "")) <= 3) & ~x.rlike("[A-Za-z]{2}")
    merged = F.array_join(rows, "")
    for pattern, by in ((rf"\s+([{CLOSING}])", "$1"), (rf"([{OPENING}])\s+", "$1"), (r"[ \t]{2,}", " "), (rf"([{SENTENCE_END}])", "$1\n")):
        merged = F.regexp_replace(merged, pattern, by)
    return F.when((F.size(rows) > 0) & (F.size(F.filter(rows, few)) > 0.6 * F.size(rows)), T.strip(merged)).otherwise(text)
