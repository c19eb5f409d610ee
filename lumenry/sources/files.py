"""Questions, answer files and logs as files in the shared folder: JSON and CSV with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenry.sources.shared import shared_dir, table

ANSWER_SCHEMA = "qid string, answer string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
QUESTION_FIELDS = "qid: string, domain: string, question: string, answer_format: string, options: map<string,string>, doc_ids: array<string>"
QUESTION_SCHEMA = "qid string, domain string, question string, answer_format string, options map<string,string>, doc_ids array<string>"


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lumenry-{uuid.uuid4().hex}"


def write_json(rows: DataFrame) -> str:
    path = _path(rows.sparkSession)
    rows.write.json(path)
    return path


def scan_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of all JSON files under a path, with empty doc_ids where they name none and the file they come from; none at all is an error."""
    rows = spark.read.schema(QUESTION_SCHEMA).json(path).withColumn("_source_file", F.input_file_name())
    if not rows.head(1):
        raise ValueError(f"no question under {path}")
    return rows.withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))


def scope(questions: DataFrame, domain: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` questions of every domain, with their ordinal."""
    return questions.withColumn("ordinal", (F.row_number().over(Window.partitionBy(domain).orderBy(order)) - 1).cast("bigint")).where(F.col("ordinal") < limit)


def write_answers(rows: DataFrame) -> str:
    """The answer file: a summary row with the totals, and a row a question."""
    own = rows.select("qid", "answer", *(F.col(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))
    total = own.agg(F.lit("summary").alias("qid"), F.lit("").alias("answer"), *(F.sum(c).alias(c) for c in own.columns[2:]))
    path = _path(rows.sparkSession)
    total.unionByName(own).write.option("header", True).csv(path)
    return path


def read_answers(spark: SparkSession, path: str, summary: bool = False) -> DataFrame:
    """Rows of an answer file; short rows have an empty answer, the summary row is left out unless asked for."""
    rows = spark.read.schema(ANSWER_SCHEMA).option("header", True).csv(path).withColumn("answer", F.coalesce("answer", F.lit("")))
    return rows if summary else rows.where("qid <> 'summary'")


def total(rows: DataFrame) -> DataFrame:
    """(total_tokens, taken_from): the summary row's total if there is one, else the sum of the rows."""
    is_summary = F.col("qid") == "summary"
    one = rows.agg(F.max(F.when(is_summary, F.col("total_tokens"))).alias("s"), F.sum(F.when(~is_summary, F.col("total_tokens"))).alias("t"))
    return one.select(F.coalesce("s", "t").alias("total_tokens"), F.when(F.col("s").isNull(), "rows").otherwise("summary").alias("taken_from"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log, blank lines skipped; ``broken`` tells lines that are no object."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("x"), F.json_object_keys("value").isNull().alias("broken")).select("x.*", "broken")


def ordinals(rows: DataFrame, order: list[str], within: list[str] = (), name: str = "ordinal") -> DataFrame:
    """The rows with their place from 0 in an order without ties, over the whole table or within a key.

    Rows are dealt by ranges of the order and sorted within tasks; a row's place is its number in its task and the rows of the tasks before it. Only these counts, one a task, are
    added up in one place, so no task holds the table or a key."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *within, *order).sortWithinPartitions(*within, *order)
    numbered = table(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [(p, sum(n for _, n in counts[:i])) for i, (p, n) in enumerate(counts)]
    at = spark.createDataFrame(starts, "_part bigint, _start bigint")
    placed = numbered.join(F.broadcast(at), part == F.col("_part")).withColumn(name, F.col("_start") + place).drop("_id", "_part", "_start")
    if not within:
        return placed
    first = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in within)).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return placed.join(first, on).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *(f"_{c}" for c in within))


def write_question_files(rows: DataFrame, file: str, place: str) -> str:
    """Questions as JSON lists, one file for each value of ``file``, in the order of ``place``."""
    fields = [c for c in rows.columns if c not in (file, place)]
    listed = F.array_sort(F.collect_list(F.struct(place, F.struct(*fields).alias("q"))))
    lists = rows.groupBy(file).agg(F.to_json(F.transform(listed, lambda x: x["q"])).alias("value"))
    path = _path(rows.sparkSession)
    lists.write.partitionBy(file).text(path)
    return path


def scan_question_files(spark: SparkSession, path: str) -> DataFrame:
    """Questions of all files below a path, each file one JSON list: ordered by file name and place, numbered over all; empty doc_ids where a question names none.
    A file that is no list is an error that names it, and so is a path without a question."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("_source_file", F.input_file_name())
    parsed = files.select("_source_file", F.ltrim("value").startswith("[").alias("list"), F.from_json("value", f"array<struct<{QUESTION_FIELDS}>>").alias("rows"))
    parsed = table(parsed)
    broken = parsed.where("not list or rows is null").select("_source_file").head(1)
    if broken:
        raise ValueError(f"{broken[0][0]} is no list of questions")
    rows = parsed.select("_source_file", F.posexplode("rows").alias("_place", "q")).select("_source_file", "_place", "q.*")
    if not rows.head(1):
        raise ValueError(f"no question under {path}")
    placed = ordinals(rows, ["_source_file", "_place"])
    return placed.withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>"))).drop("_place")


def find_question(questions: DataFrame, qid: str) -> DataFrame:
    """The question of this id; an unknown one is an error that shows some ids there are."""
    found = questions.where(F.col("qid") == qid)
    if not found.head(1):
        some = [r[0] for r in questions.orderBy("ordinal").select("qid").limit(5).collect()]
        raise KeyError(f"no question {qid}; there are {', '.join(some)} and others, {questions.count()} in all")
    return found


def select_scope(questions: DataFrame, qid: str | None = None, domain: str | None = None, limit: int | None = None) -> tuple[DataFrame, str]:
    """The questions of a scope, and its name: one id, else a domain's, else all; the first ``limit`` of them in file order."""
    if qid is not None:
        return find_question(questions, qid), f"single_question:{qid}"
    own, name = (questions, "all") if domain is None else (questions.where(F.col("domain") == domain), f"domain:{domain}")
    if domain is not None and not own.head(1):
        raise ValueError(f"no question of domain {domain}")
    if limit is None:
        return own, name
    if domain is not None:
        own = ordinals(own, ["ordinal"], name="_at").where(F.col("_at") < limit).drop("_at")
    else:
        own = own.where(F.col("ordinal") < limit)
    return own, f"{name} limit={limit}"
