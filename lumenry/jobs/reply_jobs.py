"""Replies as models write them, made from the texts of ``conversations``: an object alone, in a code block, in prose, nested, cut off, or none."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.functions import answers as words
from lumenry.jobs.registry import query, read
from lumenry.operators import replies

# every ninth reply has the same form; {o} stands for the object
FORMS = (
    "{o}",
    "```json\n{o}\n```",
    'See {this} and "that": {o}; {"judgment": "refute"}',
    '{"broken": [1, {o} }',
    "[{o}]",
    "none",
    '{"note": "}{ \\" {", "judgment": " Refute", "rationale": "in {braces}", "evidence_refs": ["7", "x", 1.5], "verdict": "FALSE", "fact_checks": [{"claim": "c"}, 3]}{o}',
    '{ {"a": {"b": {o}}} }',
    'He said: "{o}',
)


def _sql_form(form: str) -> str:
    left, mark, right = form.partition("{o}")
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted(left) + (f" || o || {quoted(right)}" if mark else "")


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_JUDGMENT = _case("(conv_id + turn) % 4", ["'support'", "' Refute '", "'insufficient'", "'unsure'"])
_VERDICT = _case("(conv_id + turn) % 4", ["'true'", "' False '", "'uncertain'", "'yes'"])
_WORD = _case("(conv_id + turn) % 3", ["'支持'", "'不成立'", "''"])
REPLIES = f"""
objects AS (SELECT conv_id, turn, json_object('judgment', {_JUDGMENT}, 'rationale', {_WORD} || text, 'evidence_refs', [turn, -1], 'verdict', {_VERDICT},
  'fact_checks', [json_object('claim', text, 'verdict', 'True', 'evidence_refs', [conv_id])])::VARCHAR AS o FROM conversations),
replies AS (SELECT conv_id, turn, {_case("(conv_id * 7 + turn) % 9", map(_sql_form, FORMS))} AS r FROM objects),
bare AS (SELECT conv_id, turn, regexp_replace(regexp_replace(r, '^```(json)?\\s*', ''), '\\s*```$', '') AS r FROM replies),
places AS (SELECT *, list_filter(range(1, length(r) + 1), lambda i: substr(r, i, 1) = '{{') AS a, list_filter(range(1, length(r) + 1), lambda i: substr(r, i, 1) = '}}') AS z FROM bare),
pairs AS (SELECT conv_id, turn, r, i, unnest(z) AS j FROM (SELECT conv_id, turn, r, z, unnest(a) AS i FROM places WHERE NOT json_valid(r))),
parts AS (SELECT conv_id, turn, substr(r, CAST(i AS INT), CAST(j - i + 1 AS INT)) AS part, i, j FROM pairs WHERE j > i),
firsts AS (SELECT conv_id, turn, part FROM parts WHERE json_valid(part) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) = 1),
found AS (SELECT conv_id, turn, CASE WHEN json_valid(r) THEN CASE WHEN json_type(r) = 'OBJECT' THEN r END ELSE part END AS j FROM bare LEFT JOIN firsts USING (conv_id, turn))"""


def _replies(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), ((F.col("conv_id") + F.col("turn")) % n).cast("int") + 1)
    check = F.struct(F.col("text").alias("claim"), F.lit("True").alias("verdict"), F.array("conv_id").alias("evidence_refs"))
    o = F.to_json(
        F.struct(
            pick(4, "support", " Refute ", "insufficient", "unsure").alias("judgment"),
            F.concat(pick(3, "支持", "不成立", ""), "text").alias("rationale"),
            F.array("turn", F.lit(-1)).alias("evidence_refs"),
            pick(4, "true", " False ", "uncertain", "yes").alias("verdict"),
            F.array(check).alias("fact_checks"),
        )
    )
    form = F.element_at(F.array(*map(F.lit, FORMS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(FORMS)).cast("int") + 1)
    return c.select("conv_id", "turn", F.replace(form, F.lit("{o}"), o).alias("reply"))


@query(f"""WITH {REPLIES} SELECT conv_id, turn, j IS NOT NULL AS found, len(json_keys(j)) AS n_keys, json_extract_string(j, '$.judgment') AS judgment, md5(json_extract_string(j, '$.rationale')) AS rationale FROM found""")
def json_in_replies(spark, sf_dir):
    """The first JSON object of every reply."""
    got = replies.with_object(_replies(spark, sf_dir), "reply")
    at = lambda k: F.get_json_object("json", f"$.{k}")
    n = F.size(F.json_object_keys("json")).cast("bigint")
    return got.select("conv_id", "turn", F.col("json").isNotNull().alias("found"), F.when(F.col("json").isNotNull(), n).alias("n_keys"), at("judgment").alias("judgment"), F.md5(at("rationale")).alias("rationale"))


@query(f"""WITH {REPLIES}, said AS (SELECT conv_id, turn, j, lower(trim(coalesce(json_extract_string(j, '$.judgment'), ''))) AS w, coalesce(json_extract_string(j, '$.rationale'), '') AS why,
  list_transform(list_filter(coalesce(CAST(json_extract(j, '$.evidence_refs') AS JSON[]), []), lambda x: regexp_full_match(CAST(x AS VARCHAR), '"?[0-9]+"?')), lambda x: trim(CAST(x AS VARCHAR), '"')) AS refs FROM found)
SELECT conv_id, turn, CASE WHEN ok THEN w ELSE 'error' END AS judgment, md5(substr(why, 1, CASE WHEN ok THEN 200 ELSE 100 END)) AS rationale, CASE WHEN ok THEN array_to_string(refs, ',') ELSE '' END AS refs,
  CASE WHEN j IS NULL THEN 'not_json' WHEN NOT ok THEN 'judgment' END AS error FROM (SELECT *, j IS NOT NULL AND w IN ('support', 'refute', 'insufficient') AS ok FROM said)""")
def option_judgments(spark, sf_dir):
    """Judgments of options read from replies, with what is wrong with the others."""
    got = replies.with_object(_replies(spark, sf_dir), "reply").select("conv_id", "turn", replies.judgment(F.col("json")).alias("x"))
    return got.select("conv_id", "turn", "x.judgment", F.md5("x.rationale").alias("rationale"), F.array_join("x.refs", ",").alias("refs"), "x.error")


_HAS = lambda words_: " OR ".join(f"contains(cut, '{w}')" for w in words_)


@query(f"""WITH {REPLIES}, said AS (SELECT conv_id, turn, j, lower(trim(coalesce(json_extract_string(j, '$.verdict'), ''))) AS w, coalesce(json_extract_string(j, '$.rationale'), '') AS why, substr(coalesce(json_extract_string(j, '$.rationale'), ''), 1, 300) AS cut,
  list_filter(coalesce(CAST(json_extract(j, '$.fact_checks') AS JSON[]), []), lambda x: json_type(x) = 'OBJECT') AS c FROM found),
told AS (SELECT *, {_HAS(words.POSITIVE)} AS yes, {_HAS(words.NEGATIVE)} AS no FROM said),
rated AS (SELECT *, CASE WHEN j IS NULL THEN 'not_json' WHEN w NOT IN ('true', 'false', 'uncertain') THEN 'verdict' WHEN (w = 'true' AND no) OR (w = 'false' AND yes AND NOT no) THEN 'inconsistent' END AS error FROM told)
SELECT conv_id, turn, CASE WHEN error IS NULL THEN w ELSE 'error' END AS verdict, len(c) AS n_checks, md5(array_to_string(list_transform(c, lambda x: substr(coalesce(json_extract_string(x, '$.claim'), ''), 1, 200) || '|' || lower(coalesce(json_extract_string(x, '$.verdict'), ''))), chr(10))) AS checks,
  md5(substr(why, 1, CASE WHEN error = 'verdict' THEN 200 ELSE 300 END)) AS rationale, error FROM rated""")
def fact_check_judgments(spark, sf_dir):
    """Verdicts on statements with their fact checks; a rationale that contradicts its verdict is an error."""
    got = replies.with_object(_replies(spark, sf_dir), "reply").select("conv_id", "turn", replies.true_or_false(F.col("json")).alias("x"))
    checks = F.array_join(F.transform("x.checks", lambda c: F.concat_ws("|", c["claim"], c["verdict"])), "\n")
    return got.select("conv_id", "turn", "x.verdict", F.size("x.checks").cast("bigint").alias("n_checks"), F.md5(checks).alias("checks"), F.md5("x.rationale").alias("rationale"), "x.error")


_STRICT = ("{o}", "{o} .", "[{o}]", '{"option": "{k}", "judgment": "support"}', '{"option": "{k}", "judgment": "support", "rationale": 5}', '{"option": "{k}", "judgment": "Support", "rationale": "r"}', '{"option": 1, "judgment": "support", "rationale": "r"}')


@query(f"""WITH made AS (SELECT conv_id, turn, chr(CAST(65 + turn % 4 AS INT)) AS k, json_object('option', chr(CAST(65 + (turn + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS INT)), 'judgment', {_case("(conv_id + turn) % 3", ["'support'", "'refute'", "'insufficient'"])}, 'rationale', text)::VARCHAR AS o FROM conversations),
r AS (SELECT conv_id, turn, k, replace({_case(f"(conv_id * 5 + turn) % {len(_STRICT)}", map(_sql_form, _STRICT))}, '{{k}}', k) AS r FROM made),
x AS (SELECT *, CASE WHEN NOT json_valid(r) THEN 'not_json' WHEN json_type(r) <> 'OBJECT' THEN 'not_an_object' WHEN list_sort(json_keys(r)) <> ['judgment', 'option', 'rationale'] THEN 'keys'
  WHEN json_type(r, '$.option') <> 'VARCHAR' OR json_extract_string(r, '$.option') <> k THEN 'option' WHEN json_type(r, '$.judgment') <> 'VARCHAR' OR json_extract_string(r, '$.judgment') NOT IN ('support', 'refute', 'insufficient') THEN 'judgment'
  WHEN json_type(r, '$.rationale') <> 'VARCHAR' THEN 'rationale' END AS error FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN json_extract_string(r, '$.judgment') ELSE 'error' END AS judgment, md5(CASE WHEN error IS NULL THEN json_extract_string(r, '$.rationale') ELSE '' END) AS rationale FROM x""")
def strict_judgments(spark, sf_dir):
    """Replies that have to be one object of three fields for the option asked about: the first thing wrong with each."""
    letter = lambda x: F.chr(65 + (x % 4).cast("int"))
    shifted = F.col("turn") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)
    word = F.element_at(F.array(*map(F.lit, ("support", "refute", "insufficient"))), ((F.col("conv_id") + F.col("turn")) % 3).cast("int") + 1)
    o = F.to_json(F.struct(letter(shifted).alias("option"), word.alias("judgment"), F.col("text").alias("rationale")))
    form = F.element_at(F.array(*map(F.lit, _STRICT)), ((F.col("conv_id") * 5 + F.col("turn")) % len(_STRICT)).cast("int") + 1)
    made = read(spark, sf_dir, "conversations").select("conv_id", "turn", letter(F.col("turn")).alias("k"), form.alias("form"), o.alias("o"))
    reply = F.replace(F.replace("form", F.lit("{k}"), F.col("k")), F.lit("{o}"), F.col("o"))
    return made.select("conv_id", "turn", replies.strict(reply, F.col("k")).alias("x")).select("conv_id", "turn", "x.error", "x.judgment", F.md5("x.rationale").alias("rationale"))
