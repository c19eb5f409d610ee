"""What a run leaves: its evidence records, its manifest, and the chunks that later runs read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenry.operators.parsing import JUDGMENTS

EVIDENCE = "array<struct<chunk_id:string,score:double,text:string>>"
JUDGED = "map<string,struct<judgment:string,rationale:string,evidence_refs:array<int>>>"
#: Fields of a record in order, their types, and what stands where a result has none (null: nothing does).
FIELDS: dict[str, tuple[str, str | None]] = {
    "qid": ("string", None), "domain": ("string", None), "question": ("string", None), "options": ("map<string,string>", "map()"), "answer_format": ("string", None), "doc_ids": ("array<string>", "array()"), "answer": ("string", None), "evidence": (EVIDENCE, "array()"),
    "retrieval": (f"map<string,{EVIDENCE}>", "map()"), "option_judgments": (JUDGED, "map()"), "warnings": ("array<string>", "array()"), "low_confidence": ("boolean", "false"), "prompt_tokens": ("bigint", None), "completion_tokens": ("bigint", None),
    "total_tokens": ("bigint", None), "mode": ("string", None), "model": ("string", "''"), "pipeline_version": ("string", "'v0'"), "tf_judgment": ("struct<verdict:string,rationale:string>", None), "answer_derivation": ("map<string,string>", "map()"),
    "trace_run_id": ("string", None), "source_kind": ("string", "'fresh'"), "source_pipeline_version": ("string", "coalesce(pipeline_version, 'v0')"), "source_run_id": ("string", "''"),
}
RECORD = ", ".join(f"{n} {t}" for n, (t, _) in FIELDS.items())


def records(results: DataFrame) -> DataFrame:
    """Results as records: all fields in order, defaults where a result has none, other columns left out."""
    own = {c: F.col(c).cast(FIELDS[c][0]) if c in results.columns else F.lit(None).cast(FIELDS[c][0]) for c in FIELDS}
    rows = results.select(*(v.alias(c) for c, v in own.items()))
    return rows.select(*(F.coalesce(c, F.expr(d).cast(t)).alias(c) if d else F.col(c) for c, (t, d) in FIELDS.items()))


def _counters() -> dict[str, Column]:
    said = F.transform(F.map_values("option_judgments"), lambda j: j["judgment"])
    count = lambda v: F.coalesce(F.sum(F.size(F.filter(said, lambda j: j == v))), F.lit(0))
    judged = {f"judgments_{v}": count(v) for v in (*JUDGMENTS, "error")}
    totals = {f"total_{c}" if not c.startswith("total") else c: F.coalesce(F.sum(c), F.lit(0)) for c in ("prompt_tokens", "completion_tokens", "total_tokens")}
    return {"success_count": F.count("*"), "low_confidence_count": F.count_if("low_confidence"), "reused_count": F.count_if(F.col("source_kind") != "fresh")} | judged | totals


def write_run(results: DataFrame, folder: str, about: dict[str, str], failures: int = 0) -> dict:
    """Write the evidence records and the manifest of a run below a folder; its manifest.

    The manifest's counts are taken while the records are written, in the same pass."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    rows = records(results).observe(seen, *(c.alias(k) for k, c in _counters().items()))
    rows.write.option("ignoreNullFields", False).json(f"{folder}/evidence")
    got = {k: int(v) for k, v in seen.get.items()}
    average = round(got["total_tokens"] / got["success_count"], 2) if got["success_count"] else 0.0
    manifest = about | got | {"failure_count": failures, "average_total_tokens": average}
    kinds = {str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in manifest.items())
    results.sparkSession.createDataFrame([tuple(manifest.values())], schema).coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def read_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECORD).json(f"{folder}/evidence")


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks of JSON lines, blank lines skipped; none at all is an error."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema).alias("c")).select("c.*")
    if not rows.head(1):
        raise ValueError(f"no chunk in {path}")
    return rows


def dry_run(questions: DataFrame) -> DataFrame:
    """Results without a call, for questions (qid, domain, question, options, answer_format, doc_ids): every option insufficient, no token used, and plainly marked as no answer."""
    options = F.map_from_entries(F.transform(F.array_sort(F.map_keys("options")), lambda k: F.struct(k, F.struct(F.lit("insufficient").alias("judgment"), F.lit("dry-run 占位").alias("rationale"), F.array().cast("array<int>").alias("evidence_refs")))))
    first = F.coalesce(F.array_min(F.map_keys("options")), F.lit("A"))
    zero = F.lit(0).cast("bigint")
    return questions.select(
        "*", options.alias("option_judgments"), F.when(F.col("answer_format") == "tf", "A").otherwise(first).alias("answer"), F.lit(True).alias("low_confidence"),
        zero.alias("prompt_tokens"), zero.alias("completion_tokens"), zero.alias("total_tokens"), F.lit("dry_run_mock").alias("mode"), F.lit("none").alias("model"),
    )
