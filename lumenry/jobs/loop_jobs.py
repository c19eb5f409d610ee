"""Questions answered in rounds over ``conversations``: the last turn asks, the turns before it are the evidence, and the first of them is known at the start.

The model is a rule on what it is shown: it lacks the question's terms that no evidence has. Its replies are texts that have to be parsed, and some can't be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.jobs.corpus_jobs import NORM
from lumenry.jobs.registry import query, read
from lumenry.jobs.retrieval_jobs import _terms
from lumenry.operators import rounds
from lumenry.sources.shared import table

ANSWERS = ("A", "BA", "C", "DCB")
NEEDS, NAMED = 6, 3

ASKED = f"""
q AS (SELECT conv_id AS qid, arg_max(text, turn) AS last, arg_min(text, turn) AS first, max(turn) AS top FROM conversations GROUP BY conv_id),
pool AS (SELECT conv_id AS qid, turn, {NORM.format("text")} AS t FROM conversations JOIN q ON qid = conv_id WHERE turn < top),
s0 AS (SELECT qid, list_slice(list_sort(list_distinct({_terms("last")})), 1, {NEEDS}) AS needs, [{NORM.format("first")}] AS ev, 0 AS rounds, 1 AS calls, 1 AS shown FROM q)"""


def _sql_round(r: int, incremental: bool) -> str:
    """The state after one more round: those that were asked again, and the others as they were."""
    lacks = "list_filter(needs, lambda x: NOT list_bool_or(list_transform(ev, lambda e: contains(e, x))))"
    gaps = f"CASE WHEN qid % 10 = 7 THEN [] ELSE list_slice({lacks}, 1, {NAMED}) END" if not incremental or r == 1 else f"CASE WHEN qid % 10 = 7 THEN [] ELSE list_filter(missing, lambda x: NOT list_bool_or(list_transform(sup{r - 1}, lambda e: contains(e, x)))) END"
    was = f"s{r - 1}" if r == 1 else f"(SELECT * FROM s{r - 1} WHERE rounds = {r - 1})"
    seen = f", CAST(NULL AS VARCHAR[]) AS sup{r}" if incremental else ""
    call = 0 if incremental else 1
    return f"""
g{r} AS (SELECT * EXCLUDE ({"missing" if r > 1 else "rounds"}), {"" if r > 1 else "rounds,"} {gaps} AS missing FROM {was}),
o{r} AS (SELECT * FROM g{r} WHERE len(missing) > 0),
h{r} AS (SELECT qid, turn, length(t) AS size, term, (length(t) - length(replace(t, term, ''))) // length(term) AS tf FROM (SELECT qid, unnest(missing) AS term FROM o{r}) JOIN pool USING (qid) WHERE contains(t, term)),
d{r} AS (SELECT qid, term, count(*) AS df FROM h{r} GROUP BY qid, term),
n{r} AS (SELECT qid, count(*) AS n, avg(length(t)) AS mean FROM pool GROUP BY qid),
b{r} AS (SELECT qid, turn, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * size / mean))), 4) AS score FROM h{r} JOIN d{r} USING (qid, term) JOIN n{r} USING (qid) GROUP BY qid, turn),
t{r} AS (SELECT qid, list(t) AS sup FROM (SELECT qid, turn FROM b{r} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, turn) <= 3) JOIN pool USING (qid, turn) GROUP BY qid),
s{r} AS (SELECT qid, needs, list_distinct(ev || sup) AS ev, {r} AS rounds, calls + 1 + {call} AS calls, shown + {"len(sup)" if incremental else "len(ev) + len(list_distinct(ev || sup))"} AS shown, missing{", sup AS sup" + str(r) if incremental else ""} FROM o{r} JOIN t{r} USING (qid)
  UNION ALL SELECT qid, needs, ev, rounds, calls + {call}, shown + {0 if incremental else "len(ev)"}, missing{seen} FROM g{r} WHERE qid NOT IN (SELECT qid FROM t{r})
  {"UNION ALL SELECT qid, needs, ev, rounds, calls, shown, missing" + seen + f" FROM s{r - 1} WHERE rounds < {r - 1}" if r > 1 else ""})"""


def _loop_sql(incremental: bool) -> str:
    letters = "CASE (len(ev) + qid) % 4 WHEN 0 THEN 'A' WHEN 1 THEN CASE WHEN qid % 2 = 0 THEN 'AB' ELSE 'B' END WHEN 2 THEN 'C' ELSE CASE WHEN qid % 2 = 0 THEN 'BCD' ELSE 'D' END END"
    return f"""WITH {ASKED}, {_sql_round(1, incremental)}, {_sql_round(2, incremental)}
SELECT qid, {letters} AS answer, CAST(rounds AS BIGINT) AS rounds, CAST(calls AS BIGINT) AS n_calls, CAST(shown AS BIGINT) AS n_shown, CAST(len(ev) AS BIGINT) AS n_evidence FROM s2"""


def _asked(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    own = c.groupBy(F.col("conv_id").alias("qid")).agg(F.max_by("text", "turn").alias("last"), F.min_by("text", "turn").alias("first"), F.max("turn").alias("top"))
    needs = F.slice(F.array_sort(F.array_distinct(T.latin_terms(F.col("last")))), 1, NEEDS)
    questions = own.select("qid", (F.col("qid") % 2 == 0).alias("many"), F.array(T.normalize(F.col("first"))).alias("evidence"), needs.alias("needs"))
    before = c.join(own.select(F.col("qid").alias("conv_id"), "top"), "conv_id").where("turn < top")
    segments = table(before.select(F.col("conv_id").alias("qid"), F.col("turn").alias("segment_id"), T.normalize(F.col("text")).alias("text")))
    return table(questions), lambda gaps: rounds.supplement(gaps, segments)


def _letters():
    return F.element_at(F.array(*map(F.lit, ANSWERS)), ((F.size("evidence") + F.col("qid")) % len(ANSWERS)).cast("int") + 1)


def _lacking(needs, evidence):
    return F.filter(needs, lambda x: ~F.exists(evidence, lambda e: F.contains(e, x)))


@query(_loop_sql(False))
def answers_with_checks(spark, sf_dir):
    """Answer, check, look for what is missing, answer again on all evidence: up to two rounds, questions that lack nothing drop out."""
    questions, search = _asked(spark, sf_dir)
    answer = lambda rows: rows.withColumn("reply", F.concat(F.lit("final: "), _letters()))
    gaps = F.slice(_lacking("needs", "evidence"), 1, NAMED)
    said = F.to_json(F.struct((F.size(gaps) == 0).alias("ok"), gaps.alias("missing")))
    check = lambda rows: rows.withColumn("reply", F.when(F.col("qid") % 10 == 7, "all {fine}").otherwise(F.concat(F.lit("checked\n"), said, F.lit("\n."))))
    got = rounds.solve(questions, answer, search, check)
    return got.select("qid", "answer", "rounds", "n_calls", "n_shown", F.size("evidence").cast("bigint").alias("n_evidence"))


@query(_loop_sql(True))
def answers_by_increments(spark, sf_dir):
    """One call gives the answer and what it lacks; later calls are shown the last answer and the new evidence only."""
    questions, search = _asked(spark, sf_dir)

    def answer(rows):
        first = F.col("rounds") == 0
        gaps = F.when(first, F.slice(_lacking("needs", "shown"), 1, NAMED)).otherwise(_lacking("missing", "shown"))
        said = F.concat(F.lit("so: "), F.to_json(F.struct(_letters().alias("answer"), gaps.alias("missing"))))
        return rows.withColumn("reply", F.when(F.col("qid") % 10 == 7, F.concat(F.lit("it is "), _letters())).otherwise(said))

    got = rounds.solve(questions, answer, search)
    return got.select("qid", "answer", "rounds", "n_calls", "n_shown", F.size("evidence").cast("bigint").alias("n_evidence"))
