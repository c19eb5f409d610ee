"""Answer synthesis and evaluation at volume. ``lineitem`` stands in for judgments (order = question, line = option),
``labels`` and ``documents`` for gold and predicted values, ``conversations`` for rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenry.jobs.registry import query, read
from lumenry.operators import answers, evaluation

JUDGED = """judged AS (SELECT l_orderkey AS qid, ['multi', 'mcq', 'tf'][CAST(l_orderkey % 3 AS INT) + 1] AS answer_format, chr(CAST(64 + l_linenumber AS INT)) AS option,
 CASE WHEN l_discount > 0.095 THEN 'error' WHEN l_returnflag = 'A' THEN 'support' WHEN l_returnflag = 'N' THEN 'refute' ELSE 'insufficient' END AS judgment,
 CAST(l_quantity AS BIGINT) % 5 AS n_refs, CAST(l_quantity AS BIGINT) AS tokens, l_linestatus FROM lineitem)"""

ANSWERS = f"""{JUDGED},
grouped AS (SELECT qid, answer_format, array_to_string(list_sort(list_distinct(coalesce(list(option) FILTER (judgment = 'support'), []))), '') AS s, min(option) AS first,
  coalesce(arg_min(option, -n_refs * 100 + ascii(option)) FILTER (judgment = 'support'), min(option)) AS best, count(*) FILTER (judgment = 'error') AS n_errors FROM judged GROUP BY qid, answer_format),
answers AS (SELECT qid, answer_format, n_errors,
  CASE answer_format WHEN 'multi' THEN CASE WHEN s = '' THEN first ELSE s END WHEN 'mcq' THEN best ELSE CASE WHEN contains(s, 'B') AND NOT contains(s, 'A') THEN 'B' ELSE 'A' END END AS answer,
  (CASE answer_format WHEN 'multi' THEN s = '' WHEN 'mcq' THEN length(s) <> 1 ELSE contains(s, 'A') = contains(s, 'B') END) OR n_errors > 0 AS low_confidence FROM grouped)"""


def judgments(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_discount") > 0.095, "error").when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "N", "refute").otherwise("insufficient")
    fmt = F.element_at(F.array(F.lit("multi"), F.lit("mcq"), F.lit("tf")), (F.pmod("l_orderkey", F.lit(3)) + 1).cast("int"))
    q = F.col("l_quantity").cast("bigint")
    return rows.select(
        F.col("l_orderkey").alias("qid"), fmt.alias("answer_format"), F.char(F.lit(64) + F.col("l_linenumber")).alias("option"), flag.alias("judgment"), (q % 5).alias("n_refs"), q.alias("tokens"), "l_linestatus"
    )


@query(f"WITH {ANSWERS} SELECT qid, answer_format, answer, low_confidence, n_errors FROM answers")
def answer_synthesis(spark, sf_dir):
    return answers.synthesize(judgments(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT count(*) FILTER (judgment = 'support') AS support, count(*) FILTER (judgment = 'refute') AS refute, count(*) FILTER (judgment = 'insufficient') AS insufficient, count(*) FILTER (judgment = 'error') AS error FROM judged")
def judgment_distribution(spark, sf_dir):
    return answers.distribution(judgments(spark, sf_dir))


@query(f"""WITH {ANSWERS}, t AS (SELECT qid, CAST(sum(tokens) AS BIGINT) AS tokens FROM judged GROUP BY qid)
SELECT answer_format, count(*) AS n, count(*) FILTER (low_confidence) AS n_low, count(*) FILTER (n_errors = 0) AS n_success, round(avg(tokens), 2) AS mean_tokens FROM answers JOIN t USING (qid) GROUP BY answer_format""")
def run_counters(spark, sf_dir):
    j = judgments(spark, sf_dir)
    tokens = j.groupBy("qid").agg(F.sum("tokens").alias("tokens"))
    rows = answers.synthesize(j).join(tokens, "qid")
    return rows.groupBy("answer_format").agg(F.count("*").alias("n"), F.count_if("low_confidence").alias("n_low"), F.count_if(F.col("n_errors") == 0).alias("n_success"), F.round(F.avg("tokens"), 2).alias("mean_tokens"))


RAW = """raw AS (SELECT l_orderkey AS qid, ['multi', 'mcq', 'tf'][CAST(l_orderkey % 3 AS INT) + 1] AS f, string_agg(chr(CAST(64 + l_linenumber AS INT)), '' ORDER BY l_partkey, l_linenumber) AS answer FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {RAW}, own AS (SELECT *, string_split(answer, '') AS o FROM raw)
SELECT f AS answer_format, reason, count(*) AS n FROM (SELECT f, CASE WHEN len(list_filter(o, lambda x: x NOT IN ('A', 'B', 'C', 'D', 'E'))) > 0 THEN 'unknown_option' WHEN f IN ('mcq', 'tf') AND length(answer) <> 1 THEN 'not_one_letter'
 WHEN f = 'multi' AND len(list_distinct(o)) <> len(o) THEN 'repeated_letter' WHEN f = 'multi' AND array_to_string(list_sort(o), '') <> answer THEN 'not_sorted' ELSE 'ok' END AS reason FROM own) GROUP BY f, reason""")
def answer_format_errors(spark, sf_dir):
    """Letters of an order's lines in the order of their parts, validated as answers over options A to E."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("x"))
    answer = F.array_join(F.transform("x", lambda x: F.char(F.lit(64) + x["l_linenumber"])), "")
    fmt = F.element_at(F.array(F.lit("multi"), F.lit("mcq"), F.lit("tf")), (F.pmod("qid", F.lit(3)) + 1).cast("int"))
    rows = rows.select(fmt.alias("answer_format"), answer.alias("answer"))
    error = answers.format_error(F.col("answer"), F.col("answer_format"), F.array(*map(F.lit, "ABCDE")))
    return rows.groupBy("answer_format", F.coalesce(error, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS qid, arg_max(l_returnflag, l_shipdate::VARCHAR || l_returnflag) AS verdict, count(*) AS n_attempts, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_tokens FROM lineitem GROUP BY l_orderkey""")
def ask_again(spark, sf_dir):
    """The latest line's flag stands for the last attempt's verdict."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("verdict"), F.struct("l_shipdate", "l_returnflag").alias("attempt"), F.col("l_quantity").cast("bigint").alias("tokens"))
    return answers.ask_again(rows)


@query(f"""WITH {ANSWERS}, later AS (SELECT qid, array_to_string(list_sort(list_distinct(list(option))), '') AS new FROM judged WHERE l_linestatus = 'O' GROUP BY qid)
SELECT qid, CASE WHEN answer_format = 'multi' THEN array_to_string(list_sort(list_distinct(list_concat(string_split(answer, ''), coalesce(string_split(new, ''), [])))), '') ELSE coalesce(new, answer) END AS merged FROM answers LEFT JOIN later USING (qid)""")
def conservative_merge(spark, sf_dir):
    """Answers merged with a second round's: multi answers only gain letters."""
    j = judgments(spark, sf_dir)
    later = j.where("l_linestatus = 'O'").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("option")), "").alias("new"))
    rows = answers.synthesize(j).join(later, "qid", "left")
    return rows.select("qid", answers.add_only(F.col("answer"), F.col("new"), F.col("answer_format")).alias("merged"))


GOLD = """gold AS (SELECT doc_id, source, lang, quality, toxic, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN n_chars > 800 THEN 'A' ELSE 'B' END AS before,
 CASE WHEN n_chars > 800 AND toxic = 0 THEN 'A' WHEN n_chars > 300 THEN 'C' ELSE NULL END AS after, n_chars FROM labels JOIN documents USING (doc_id))"""


def graded(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").drop("text"), "doc_id")
    n = F.col("n_chars")
    return rows.select(
        "doc_id", "source", "lang", "quality", "toxic", "n_chars", F.when(F.col("quality") == 1, "A").otherwise("B").alias("gold"), F.when(n > 800, "A").otherwise("B").alias("before"),
        F.when((n > 800) & (F.col("toxic") == 0), "A").when(n > 300, "C").alias("after"),
    )


@query(f"WITH {GOLD} SELECT lang, source, count(*) AS n, count(*) FILTER (before = gold) AS \"right\", round(avg(CASE WHEN before = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM gold GROUP BY GROUPING SETS ((), (lang), (source))")
def accuracy_grouping_sets(spark, sf_dir):
    return evaluation.accuracy(graded(spark, sf_dir).withColumn("pred", F.col("before")), ["lang", "source"])


@query(f"""WITH {GOLD} SELECT count(*) FILTER (a AND NOT b) AS n_gained, count(*) FILTER (b AND NOT a) AS n_lost, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (NOT a AND NOT b) AS both_wrong, count(*) FILTER (before IS DISTINCT FROM after) AS churn
FROM (SELECT *, coalesce(before = gold, false) AS b, coalesce(after = gold, false) AS a FROM gold)""")
def paired_changes(spark, sf_dir):
    return evaluation.paired(graded(spark, sf_dir))


@query(f"WITH {GOLD} SELECT doc_id, gold, after FROM gold WHERE after IS DISTINCT FROM gold")
def disagreements(spark, sf_dir):
    return graded(spark, sf_dir).where(~F.col("after").eqNullSafe(F.col("gold"))).select("doc_id", "gold", "after")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.4 + 0.5) THEN 'holdout' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    return evaluation.stratified_split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"""WITH {GOLD}, s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM gold)
SELECT lang, round(100 * (avg(CASE WHEN before = gold THEN 1.0 ELSE 0.0 END) FILTER (r > floor(n * 0.4 + 0.5)) - avg(CASE WHEN before = gold THEN 1.0 ELSE 0.0 END) FILTER (r <= floor(n * 0.4 + 0.5))), 4) AS gap FROM s GROUP BY lang""")
def overfit_gap(spark, sf_dir):
    """Accuracy on the training part less that on the holdout, in points."""
    rows = evaluation.stratified_split(graded(spark, sf_dir), "lang", "doc_id")
    right = (F.col("before") == F.col("gold")).cast("double")
    return rows.groupBy("lang").agg(F.round(100 * (F.avg(F.when(F.col("part") == "train", right)) - F.avg(F.when(F.col("part") == "holdout", right))), 4).alias("gap"))


@query("""SELECT l_orderkey AS qid, CAST(round(100 * (count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*)) * (0.7 + 0.3 * CASE WHEN sum(l_extendedprice) <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (5000000 - sum(l_extendedprice)) / 5000000)) END), 3) AS DOUBLE) AS score FROM lineitem GROUP BY l_orderkey""")
def score_formula(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.avg((F.col("l_returnflag") == "A").cast("double")).alias("a"), F.sum("l_extendedprice").alias("t"))
    return rows.select("qid", F.round(evaluation.competition_score(F.col("a"), F.col("t")), 3).alias("score"))


@query("""WITH t AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (l_returnflag = 'A') AS tp, count(*) FILTER (l_returnflag <> 'A') AS fp, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS precision FROM t JOIN lineitem ON l_discount >= threshold GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "A").alias("truth"))
    return evaluation.threshold_sweep(rows, [0.0, 0.02, 0.04, 0.06, 0.08])


@query("""WITH c AS (SELECT round(l_quantity, 2) AS s, count(*) AS n, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS good FROM lineitem GROUP BY 1),
p AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, floor(sum(n) OVER () / 3) AS size FROM c),
e AS (SELECT *, greatest(least(first + n, CASE WHEN part = 2 THEN 4611686018427387904 ELSE part * size + size END) - greatest(first, part * size), 0) AS m FROM p, (SELECT unnest([0, 1, 2]) AS part))
SELECT CAST(part AS BIGINT) AS part, CAST(sum(m) AS BIGINT) AS n, round(sum(good * m / n) / sum(m), 6) AS accuracy FROM e WHERE m > 0 GROUP BY part""")
def tercile_accuracy(spark, sf_dir):
    """Share of accepted lines by thirds of quantity, the remainder in the last. No global sort of the rows."""
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "A").cast("bigint").alias("correct"))
    return evaluation.scored_parts(rows, "l_quantity", 3)


@query("""SELECT ['multi', 'mcq', 'tf'][CAST(l_orderkey % 3 AS INT) + 1] AS answer_format, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS right_mean, round(avg(l_quantity) FILTER (l_returnflag <> 'A'), 6) AS wrong_mean FROM lineitem GROUP BY 1""")
def mean_score_by_outcome(spark, sf_dir):
    fmt = F.element_at(F.array(F.lit("multi"), F.lit("mcq"), F.lit("tf")), (F.pmod("l_orderkey", F.lit(3)) + 1).cast("int"))
    right = F.col("l_returnflag") == "A"
    return read(spark, sf_dir, "lineitem").groupBy(fmt.alias("answer_format")).agg(F.round(F.avg(F.when(right, F.col("l_quantity"))), 6).alias("right_mean"), F.round(F.avg(F.when(~right, F.col("l_quantity"))), 6).alias("wrong_mean"))


CASES = """cases AS (SELECT l_orderkey, l_linenumber, l_discount > 0.01 AS in_source, l_discount > 0.02 AS in_chunks, CASE WHEN l_tax > 0.075 THEN NULL ELSE l_tax > 0.02 END AS in_retrieval, l_tax > 0.03 AS in_rendering,
 'A' AS gold, CASE WHEN l_quantity > 10 THEN 'A' ELSE 'B' END AS oracle, l_returnflag AS reasoning, CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'N' END AS final FROM lineitem),
layered AS (SELECT *, CASE WHEN in_retrieval IS NULL THEN NULL WHEN NOT in_source THEN 'data_or_question' WHEN NOT in_chunks THEN 'parsing' WHEN oracle <> gold THEN 'reasoning_or_prompt' WHEN final = gold THEN 'no_failure' WHEN NOT in_retrieval THEN 'retrieval'
 WHEN NOT in_rendering THEN 'evidence_organization' WHEN reasoning <> gold THEN 'reasoning_or_prompt' ELSE 'answer_synthesis' END AS layer FROM cases)"""


def cases(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem")
    return q.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") > 0.01).alias("in_source"), (F.col("l_discount") > 0.02).alias("in_chunks"), F.when(F.col("l_tax") > 0.075, None).otherwise(F.col("l_tax") > 0.02).alias("in_retrieval"),
        (F.col("l_tax") > 0.03).alias("in_rendering"), F.lit("A").alias("gold"), F.when(F.col("l_quantity") > 10, "A").otherwise("B").alias("oracle"), F.col("l_returnflag").alias("reasoning"),
        F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("N").alias("final"),
    )


@query(f"WITH {CASES} SELECT layer, count(l.layer2) AS n FROM (SELECT unnest(['data_or_question', 'parsing', 'retrieval', 'evidence_organization', 'reasoning_or_prompt', 'answer_synthesis', 'no_failure']) AS layer) LEFT JOIN (SELECT layer AS layer2 FROM layered) l ON layer = layer2 GROUP BY layer")
def failure_layers(spark, sf_dir):
    return evaluation.layer_counts(evaluation.failure_layer(cases(spark, sf_dir)))


@query(f"""WITH {CASES} SELECT CASE WHEN layer IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN NOT in_retrieval THEN 'retrieval' END, CASE WHEN NOT in_rendering THEN 'evidence_organization' END, CASE WHEN oracle <> gold THEN 'reasoning_or_prompt' END) END AS risk_flags, count(*) AS n FROM layered GROUP BY 1""")
def risk_flags(spark, sf_dir):
    return evaluation.failure_layer(cases(spark, sf_dir)).groupBy("risk_flags").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS transcript,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS answer_chars FROM conversations GROUP BY conv_id""")
def conversation_rounds(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("answer_chars"),
    )
    lines = F.transform("x", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.select("conv_id", "n_turns", "n_user", F.md5(F.array_join(lines, "\n")).alias("transcript"), "answer_chars")


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
n AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS a, coalesce(list_distinct(string_split(lower(before), ' ')), []) AS b FROM t)
SELECT conv_id, turn, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_new FROM n""")
def conversation_delta(spark, sf_dir):
    """Words of each turn that the turn before does not have: what a next round would be asked for."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    rows = rows.withColumn("before", before)
    new = F.array_except(words(F.col("text")), F.coalesce(words(F.col("before")), F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.size(new).cast("bigint").alias("n_new"))
