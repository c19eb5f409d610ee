"""Validation of answer bundles: the answer file, the evidence records and the manifest of each, against one table of rules.

Rules are data: a name and the condition that breaks it, in SQL over the columns that ``row_view`` and ``bundle_view`` give. Every broken rule is a row; none stops the others.

answers: (bundle, place, qid, answer, prompt_tokens, completion_tokens, total_tokens), all but place as the file's texts, place 0 the first data row, which has to be the summary.
evidence: (bundle, place, record) and manifests: (bundle, manifest) with JSON texts. official: (scope, place, qid), the questions of each official scope in order. before: (bundle, side, qid, answer, prompt_tokens,
completion_tokens, total_tokens, record), the rows and records of the parent and the rerun (``side``) that a merged bundle was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions import answers as words
from lumenry.operators import checks, replies

MODE, MOCK, SCOPE = "qwen", "dry_run_mock", "official_group_a"
TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")
TOTALS = ("total_prompt_tokens", "total_completion_tokens", "total_tokens")
LINEAGE = ("parent_artifact_dir", "parent_artifact_sha256", "rerun_artifact_dir", "rerun_artifact_sha256", "experiment_id", "experiment_pipeline_version", "rerun_qids", "merge_tool_version", "per_record_lineage")
RECORD = "qid string, answer string, answer_format string, options map<string,string>, mode string, model string, " + ", ".join(f"{t} string" for t in TOKENS)
MANIFEST = (
    "mode string, model string, failure_count string, success_count string, submission_scope string, requested_scope string, pipeline_version string, experiment_pipeline_version string, parent_version string, "
    "qids array<string>, rerun_qids array<string>, per_record_lineage map<string, struct<source_kind:string, source_run_id:string, source_pipeline_version:string>>, " + ", ".join(f"{t} string" for t in TOTALS)
)

#: For each question of a bundle: rules on its row, its record and its lineage.
ROW_RULES = {
    "row_without_record": "has_row AND NOT has_record",
    "answer_differs": "paired AND answer IS DISTINCT FROM coalesce(e.answer, '')",
    "answer_not_letters": "paired AND NOT answer RLIKE '^[A-Z]+$'",
    "answer_unknown_letter": "paired AND answer RLIKE '^[A-Z]+$' AND size(array_except(letters, coalesce(map_keys(e.options), array()))) > 0",
    "answer_several_letters": "paired AND answer RLIKE '^[A-Z]{2,}$' AND e.answer_format IN ('mcq', 'tf')",
    "answer_repeated_letter": "paired AND answer RLIKE '^[A-Z]+$' AND e.answer_format = 'multi' AND size(array_distinct(letters)) < size(letters)",
    "answer_unsorted": "paired AND answer RLIKE '^[A-Z]+$' AND e.answer_format = 'multi' AND size(array_distinct(letters)) = size(letters) AND array_sort(letters) <> letters",
    "answer_unknown_format": "paired AND coalesce(e.answer_format, '') NOT IN ('mcq', 'tf', 'multi')",
    "row_tokens_no_integer": "paired AND row_bad",
    "record_tokens_no_integer": "paired AND record_bad",
    "row_token_sum": "paired AND rp + rc <> rt",
    "record_token_sum": "paired AND ep + ec <> et",
    "tokens_differ": "paired AND NOT (rp = ep AND rc = ec AND rt = et)",
    "tokens_not_positive": "paired AND (rp <= 0 OR rt <= 0)",
    "completion_negative": "paired AND rc < 0",
    "record_mode": f"paired AND e.mode IS DISTINCT FROM '{MODE}'",
    "record_mock": f"paired AND e.mode = '{MOCK}'",
    "record_placeholder": "paired AND placeholder",
    "lineage_kind": "merged AND has_row AND NOT (in_lineage AND l.source_kind <=> expected_kind)",
    "lineage_run_id": "merged AND has_row AND in_lineage AND l.source_kind <=> expected_kind AND coalesce(l.source_run_id, '') = ''",
    "lineage_rerun_version": "merged AND has_row AND in_lineage AND expected_kind = 'rerun' AND l.source_kind = 'rerun' AND l.source_pipeline_version IS DISTINCT FROM coalesce(m.experiment_pipeline_version, '')",
    "lineage_parent_version": "merged AND has_row AND in_lineage AND expected_kind = 'parent' AND l.source_kind = 'parent' AND coalesce(l.source_pipeline_version, '') = ''",
    "parent_row_differs": "merged AND has_row AND expected_kind = 'parent' AND NOT (own_row <=> parent_row)",
    "parent_record_differs": "merged AND has_row AND expected_kind = 'parent' AND NOT (own_record <=> parent_record)",
    "rerun_row_differs": "merged AND has_row AND expected_kind = 'rerun' AND NOT (own_row <=> rerun_row)",
    "rerun_record_differs": "merged AND has_row AND expected_kind = 'rerun' AND NOT (own_record <=> rerun_record)",
}
#: For each bundle: rules on its sums, sets and manifest.
BUNDLE_RULES = {
    "answers_without_rows": "n_file = 0",
    "summary_missing": "n_file > 0 AND s.qid IS DISTINCT FROM 'summary'",
    "summary_answer": "n_file > 0 AND coalesce(s.answer, '') <> ''",
    "manifest_not_an_object": "NOT manifest_ok",
    "manifest_mode": f"m.mode IS DISTINCT FROM '{MODE}'",
    "manifest_mock": f"m.mode = '{MOCK}'",
    "manifest_failures": "failure_count <> 0",
    "manifest_no_integer": "manifest_bad",
    "record_not_an_object": "n_no_object > 0",
    "record_without_qid": "n_no_qid > 0",
    "record_repeated": "n_records > n_record_ids",
    "row_repeated": "n_rows > n_row_ids",
    "row_count": "n_rows <> n_record_ids",
    "qid_sets": "n_only_one_side > 0",
    "manifest_qids_no_list": "qids_kind NOT IN ('', '[')",
    "manifest_qids": "n_manifest > 0 AND n_not_manifest > 0",
    "official_qids": "is_official AND n_not_official > 0",
    "official_order": "is_official AND (n_not_official > 0 OR n_row_ids < n_rows OR n_misplaced > 0)",
    "success_count": "success_count <> n_rows",
    "summary_token_sum": "n_file > 0 AND sp + sc <> st",
    "summary_totals": "n_file > 0 AND NOT (sp = sum_rp AND sc = sum_rc AND st = sum_rt)",
    "summary_not_positive": "n_file > 0 AND st <= 0",
    "summary_no_integer": "n_file > 0 AND summary_bad",
    "manifest_token_sum": "mp + mc <> mt",
    "manifest_totals": "n_file > 0 AND NOT (mp = sp AND mc = sc AND mt = st)",
    "model": "coalesce(m.model, '') NOT IN ('', 'mixed') AND size(models) > 0 AND NOT (size(models) = 1 AND models[0] = m.model)",
    "lineage_field_missing": "merged AND size(missing_fields) > 0",
    "lineage_qids": "merged AND n_not_lineage > 0",
    "pipeline_version": "merged AND NOT (m.pipeline_version <=> m.experiment_pipeline_version)",
}


def _number(text: Column) -> Column:
    """A whole number as text, else 0."""
    return F.coalesce(F.when(_whole(text), F.trim(text).try_cast("bigint")), F.lit(0))


def _whole(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def _record_text(record: Column) -> Column:
    """A record with its keys in order."""
    return F.to_json(F.try_parse_json(record))


def _manifests(manifests: DataFrame) -> DataFrame:
    m = F.from_json("manifest", MANIFEST)
    keys = F.coalesce(F.json_object_keys("manifest"), F.array().cast("array<string>"))
    return manifests.select("bundle", "manifest", m.alias("m"), keys.alias("keys")).withColumn("merged", F.array_contains("keys", "parent_version") & F.col("m.parent_version").isNotNull())


def _sides(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = answers.where("place > 0").select("bundle", F.coalesce("qid", F.lit("")).alias("qid"), "place", F.struct(F.coalesce("answer", F.lit("")).alias("answer"), *TOKENS).alias("c"))
    parsed = evidence.select("bundle", "place", "record", replies.is_object("record").alias("ok"), F.from_json("record", RECORD).alias("e"))
    records = parsed.where("ok and coalesce(e.qid, '') <> ''").groupBy("bundle", F.col("e.qid").alias("qid")).agg(F.max_by(F.struct("e", "record"), "place").alias("x")).select("bundle", "qid", "x.e", "x.record")
    return rows, records


def row_view(answers: DataFrame, evidence: DataFrame, manifests: DataFrame, before: DataFrame) -> DataFrame:
    """A row for each row of the answer file and each record without one: both sides, the manifest's words on it, and what it was before the merge."""
    rows, records = _sides(answers, evidence)
    side = lambda name: before.where(F.col("side") == name).groupBy("bundle", "qid").agg(
        F.first(F.struct(F.coalesce("answer", F.lit("")).alias("answer"), *TOKENS)).alias(f"{name}_row"), F.first(_record_text(F.col("record"))).alias(f"{name}_record")
    )
    joined = rows.join(records, ["bundle", "qid"], "full_outer").join(side("parent"), ["bundle", "qid"], "left").join(side("rerun"), ["bundle", "qid"], "left")
    m = _manifests(manifests).select("bundle", "m", "merged")
    view = joined.join(m, "bundle", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    number = lambda prefix, source: [_number(F.col(f"{source}.{t}")).alias(f"{prefix}{t[0]}") for t in TOKENS]
    whole = lambda source: ~(_whole(F.col(f"{source}.prompt_tokens")) & _whole(F.col(f"{source}.completion_tokens")) & _whole(F.col(f"{source}.total_tokens")))
    lineage = F.try_element_at("m.per_record_lineage", F.col("qid"))
    return view.select(
        "bundle", "qid", "place", "e", "m", "merged", F.col("c.answer").alias("answer"), F.col("c").isNotNull().alias("has_row"), F.col("e").isNotNull().alias("has_record"),
        (F.col("c").isNotNull() & F.col("e").isNotNull()).alias("paired"), F.filter(F.split("c.answer", ""), lambda x: x != "").alias("letters"),
        *number("r", "c"), *number("e", "e"), whole("c").alias("row_bad"), whole("e").alias("record_bad"), words.has_placeholder(F.coalesce(_record_text(F.col("record")), F.col("record"))).alias("placeholder"),
        lineage.alias("l"), lineage.isNotNull().alias("in_lineage"), F.when(F.coalesce(F.array_contains("m.rerun_qids", F.col("qid")), F.lit(False)), "rerun").otherwise("parent").alias("expected_kind"),
        F.col("c").alias("own_row"), _record_text(F.col("record")).alias("own_record"), "parent_row", "parent_record", "rerun_row", "rerun_record",
    )


def bundle_view(view: DataFrame, answers: DataFrame, evidence: DataFrame, manifests: DataFrame, official: DataFrame) -> DataFrame:
    """A row a bundle. Which sets an id belongs to is found in one grouping of all of them by (bundle, qid)."""
    told = _manifests(manifests)
    scope = F.when(F.col("m.requested_scope") == "all", SCOPE).when(F.startswith("m.submission_scope", F.lit("official_")), F.col("m.submission_scope"))
    scopes = told.select("bundle", scope.alias("scope")).where("scope is not null")
    asked = scopes.join(official.select("scope", "qid", F.col("place").alias("official_place")), "scope")
    names = ("row", "record", "manifest", "lineage", "official")
    member = lambda df, kind, place=None: df.select("bundle", "qid", F.lit(kind).alias("kind"), (F.lit(None) if place is None else place).cast("bigint").alias("at"))
    every = member(view.where("has_row"), "row", F.col("place") - 1).unionByName(member(view.where("has_record"), "record")).unionByName(member(asked, "official", F.col("official_place")))
    every = every.unionByName(member(told.select("bundle", F.explode("m.qids").alias("qid")), "manifest")).unionByName(member(told.select("bundle", F.explode(F.map_keys("m.per_record_lineage")).alias("qid")), "lineage"))
    place = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    flags = every.groupBy("bundle", "qid").agg(*(F.bool_or(F.col("kind") == n).alias(n) for n in names), place("row").alias("row_at"), place("official").alias("official_at"))
    apart = lambda a, b: F.count_if(F.col(a) != F.col(b))
    sets = flags.groupBy("bundle").agg(
        F.count_if("row").alias("n_row_ids"), F.count_if("record").alias("n_record_ids"), F.count_if("manifest").alias("n_manifest"), apart("row", "record").alias("n_only_one_side"), apart("row", "manifest").alias("n_not_manifest"),
        apart("row", "lineage").alias("n_not_lineage"), apart("row", "official").alias("n_not_official"), F.count_if(F.col("row_at") != F.col("official_at")).alias("n_misplaced"),
    )
    models = F.array_sort(F.collect_set(F.when(F.coalesce("e.model", F.lit("")) != "", F.col("e.model"))))
    sums = view.groupBy("bundle").agg(
        F.count_if("has_row").alias("n_rows"), models.alias("models"), *(F.coalesce(F.sum(F.when(F.col("paired"), F.col(f"r{t}"))), F.lit(0)).alias(f"sum_r{t}") for t in "pct")
    )
    is_object = replies.is_object(F.col("record"))
    texts = evidence.groupBy("bundle").agg(
        F.count_if(~F.coalesce(is_object, F.lit(False))).alias("n_no_object"),
        F.count_if(is_object & (F.coalesce(F.get_json_object("record", "$.qid"), F.lit("")) == "")).alias("n_no_qid"),
        F.count_if(is_object & (F.coalesce(F.get_json_object("record", "$.qid"), F.lit("")) != "")).alias("n_records"),
    )
    head = answers.groupBy("bundle").agg(F.count("*").alias("n_file"), F.min_by(F.struct("qid", "answer", *TOKENS), "place").alias("s"))
    out = told.join(head, "bundle", "full_outer").join(sums, "bundle", "left").join(sets, "bundle", "left").join(texts, "bundle", "left")
    counts = ["n_file", "n_rows", "n_row_ids", "n_record_ids", "n_manifest", "n_only_one_side", "n_not_manifest", "n_not_lineage", "n_not_official", "n_misplaced", "n_no_object", "n_no_qid", "n_records", "sum_rp", "sum_rc", "sum_rt"]
    out = out.fillna(0, counts).fillna(False, ["merged"])
    ok = F.coalesce(replies.is_object(F.col("manifest")), F.lit(False))
    has = lambda k: F.array_contains("keys", k)
    given = lambda k, other: F.when(has(k), _number(F.col(f"m.{k}"))).otherwise(other)
    bad = F.lit(False)
    for k in ("failure_count", "success_count", *TOTALS):
        bad = bad | (F.coalesce(has(k), F.lit(False)) & ~_whole(F.col(f"m.{k}")))
    return out.select(
        "*", ok.alias("manifest_ok"), given("failure_count", F.lit(0)).alias("failure_count"), given("success_count", F.col("n_rows")).alias("success_count"), bad.alias("manifest_bad"),
        F.coalesce(F.substring(F.ltrim(F.get_json_object("manifest", "$.qids")), 1, 1), F.when(has("qids"), "?").otherwise("")).alias("qids_kind"),
        *(_number(F.col(f"s.{t}")).alias(f"s{t[0]}") for t in TOKENS), *(_number(F.col(f"m.{t}")).alias(f"m{k}") for t, k in zip(TOTALS, "pct", strict=True)),
        (~(_whole(F.col("s.prompt_tokens")) & _whole(F.col("s.completion_tokens")) & _whole(F.col("s.total_tokens")))).alias("summary_bad"),
        F.array_except(F.array(*map(F.lit, LINEAGE)), F.col("keys")).alias("missing_fields"), scope.isNotNull().alias("is_official"),
    )


def validate(answers: DataFrame, evidence: DataFrame, manifests: DataFrame, official: DataFrame, before: DataFrame) -> DataFrame:
    """(bundle, qid, check): every rule that is broken, with the question where it is one of a question."""
    view = row_view(answers, evidence, manifests, before)
    rules = lambda table: {k: F.expr(v) for k, v in table.items()}
    rows = checks.failures(view, F.struct("bundle", "qid").alias("k"), rules(ROW_RULES)).select("k.bundle", "k.qid", "check")
    whole = checks.failures(bundle_view(view, answers, evidence, manifests, official), F.col("bundle"), rules(BUNDLE_RULES)).select("bundle", F.lit(None).cast("string").alias("qid"), "check")
    return rows.unionByName(whole)
