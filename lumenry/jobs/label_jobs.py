"""Replies, cards, verdicts and answers in text form; sources and sinks of questions, answers and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.functions import answers as A
from lumenry.functions import text as T
from lumenry.jobs.registry import query, read
from lumenry.operators import answers, checks, evaluation, parsing
from lumenry.sources import files


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem")


@query("""WITH c AS (SELECT c_custkey, '- 答案（多选）：' || lower(substr('ABCD', CAST(c_custkey % 4 AS INT) + 1, 1)) || ', ' || substr('ABCD', CAST(c_nationkey % 4 AS INT) + 1, 1) || chr(10) || '- 置信度：' || c_mktsegment || chr(10) || CASE WHEN c_custkey % 5 > 0 THEN '- 标定人: ' || c_name ELSE '' END AS card FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(string_split(upper(regexp_replace(regexp_extract(card, '- 答案(?:（.*?）)?[：:][ \t]*([^\r\n]*)', 1), '[\\s,]+', '', 'g')), ''))), '') AS answer,
 trim(regexp_extract(card, '- 置信度(?:（.*?）)?[：:][ \t]*([^\r\n]*)', 1)) AS confidence, trim(regexp_extract(card, '- 标定人[：:][ \t]*([^\r\n]*)', 1)) AS labeler FROM c""")
def label_card_fields(spark, sf_dir):
    """Label cards written as Markdown and read back by field."""
    c = read(spark, sf_dir, "customer")
    letter = lambda k: F.substring(F.lit("ABCD"), (F.col(k) % 4).cast("int") + 1, F.lit(1))
    card = F.concat(F.lit("- 答案（多选）："), F.lower(letter("c_custkey")), F.lit(", "), letter("c_nationkey"), F.lit("\n- 置信度："), "c_mktsegment", F.lit("\n"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("- 标定人: "), "c_name")).otherwise(""))
    c = c.select("c_custkey", card.alias("card"))
    return c.select("c_custkey", A.label_answer(A.card_field(F.col("card"), "answer")).alias("answer"), A.card_field(F.col("card"), "confidence").alias("confidence"), A.card_field(F.col("card"), "labeler").alias("labeler"))


@query("""WITH r AS (SELECT l_linenumber % 2 = 0 AS v, ['支持', '不支持', '为真', '矛盾', '说明'][CAST(l_partkey % 5 AS INT) + 1] || ['', '正确', '错误'][CAST(l_suppkey % 3 AS INT) + 1] AS t FROM lineitem), f AS (SELECT CASE WHEN v THEN 'true' ELSE 'false' END AS verdict, t,
 regexp_matches(t, '支持|为真|正确|成立|符合') AS yes, regexp_matches(t, '不支持|不正确|为假|错误|否定|矛盾|不成立') AS no FROM r)
SELECT verdict, t AS rationale, NOT ((verdict = 'true' AND no) OR (verdict = 'false' AND yes AND NOT no)) AS consistent, count(*) AS n FROM f GROUP BY ALL""")
def verdict_consistency(spark, sf_dir):
    """Verdicts whose rationale contradicts them."""
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.col(k) % len(words)).cast("int") + 1)
    r = _lines(spark, sf_dir).select(F.when(F.col("l_linenumber") % 2 == 0, "true").otherwise("false").alias("verdict"), F.concat(pick(("支持", "不支持", "为真", "矛盾", "说明"), "l_partkey"), pick(("", "正确", "错误"), "l_suppkey")).alias("rationale"))
    return r.groupBy("verdict", "rationale", A.consistent(F.col("verdict"), F.col("rationale")).alias("consistent")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN t LIKE '%支持%' THEN 'support' WHEN t LIKE '%否定%' THEN 'refute' ELSE 'insufficient' END AS verdict, count(*) AS n FROM (SELECT text || ['支持', '否定', '不确定', ' 否定,支持'][CAST(turn % 4 AS INT) + 1] AS t FROM conversations) GROUP BY 1""")
def word_judgments(spark, sf_dir):
    """One-word replies by containment of the verdict's word."""
    reply = F.concat("text", F.element_at(F.array(*map(F.lit, ("支持", "否定", "不确定", " 否定,支持"))), (F.col("turn") % 4).cast("int") + 1))
    return read(spark, sf_dir, "conversations").groupBy(A.word_judgment(reply).alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS segment, count(*) FILTER (c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS n_placeholders, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def placeholders(spark, sf_dir):
    """Records that hold a placeholder anywhere inside."""
    c = read(spark, sf_dir, "customer")
    inner = F.struct(F.array("c_name", F.when(F.col("c_custkey") % 7 == 0, "a DRY_RUN_MOCK").otherwise("b")).alias("xs"), F.struct(F.when(F.col("c_custkey") % 11 == 0, "Mock 占位").alias("y")).alias("deep"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(A.has_placeholder(F.to_json(inner))).alias("n_placeholders"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(upper(text), '[A-D]') AS x FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN array_to_string(list_sort(list_distinct(x)), '') ELSE coalesce(x[1], '') END AS letters FROM t""")
def reply_letters(spark, sf_dir):
    """Letters of a reply: all for multi questions, the first for others."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", A.letters(F.upper("text"), F.col("turn") % 2 == 0).alias("letters"))


@query("""SELECT a AS answer, CASE WHEN regexp_full_match(upper(trim(a)), '[ABCD]+') THEN array_to_string(list_sort(list_distinct(string_split(upper(trim(a)), ''))), '') ELSE upper(trim(a)) END AS canonical, count(*) AS n
FROM (SELECT ' ' || lower(substr('DBCAB', CAST(p_size % 5 AS INT) + 1, CAST(p_partkey % 3 AS INT) + 1)) || CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE '' END AS a FROM part) GROUP BY 1, 2""")
def canonical_answers(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    raw = F.concat(F.lit(" "), F.lower(F.substring(F.lit("DBCAB"), (F.col("p_size") % 5).cast("int") + 1, (F.col("p_partkey") % 3).cast("int") + 1)), F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(""))
    return p.groupBy(raw.alias("answer"), T.canonical_answer(raw).alias("canonical")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥春夏秋冬') AS run FROM customer)
SELECT run, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN length(run) BETWEEN 2 AND 6 THEN [run] ELSE [] END, flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(run) - n + 2), lambda i: substr(run, i, n))))))), ' ') AS terms FROM r""")
def cjk_grams(spark, sf_dir):
    """Terms of CJK runs: the run itself if it is short, then its grams of 2 to 4."""
    latin, cjk = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥春夏秋冬"
    runs = read(spark, sf_dir, "customer").select(F.translate("c_mktsegment", latin, cjk).alias("run")).distinct()
    return runs.select("run", F.array_join(F.array_sort(T.terms(F.col("run"))), " ").alias("terms"))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '\d+(?:\.\d+)?%|\d{4}'), regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9]{2,}'))) AS term FROM documents)
SELECT doc_id, count(*) AS n_terms, count(*) FILTER (regexp_matches(term, '\d')) AS n_numeric FROM t GROUP BY doc_id""")
def keyword_sets(spark, sf_dir):
    """The other pipeline's keyword set: numbers and Latin words of three characters or more, unordered."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?%|\d{4}"), F.lit(0)), F.regexp_extract_all("text", F.lit(r"[a-zA-Z][a-zA-Z0-9]{2,}"), F.lit(0)))
    d = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(found).alias("terms")).where("size(terms) > 0")
    return d.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.size(F.filter("terms", A.has_number)).cast("bigint").alias("n_numeric"))


@query("""SELECT CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS prompt, coalesce(k % 5, 0) AS completion, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 0 ELSE k END + k % 5 ELSE 2 * k END AS total, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k""")
def response_usage(spark, sf_dir):
    """Responses in JSON read back: content and usage; a missing total is the sum of the others."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = read(spark, sf_dir, "events").select(k.alias("k"))
    raw = F.to_json(F.struct(F.struct(F.when(F.col("k") % 3 != 0, F.col("k")).alias("prompt_tokens"), (F.col("k") % 5).alias("completion_tokens"), F.when(F.col("k") % 2 != 0, 2 * F.col("k")).alias("total_tokens")).alias("usage")))
    u = e.select("k", parsing.usage(raw).alias("u"))
    return u.groupBy("k", F.col("u.prompt").alias("prompt"), F.col("u.completion").alias("completion"), F.col("u.total").alias("total")).agg(F.count("*").alias("n")).drop("k")


@query("""WITH v AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'true' WHEN l_returnflag = 'N' THEN 'false' ELSE 'uncertain' END AS verdict FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, verdict, CASE WHEN verdict = 'false' THEN 'B' ELSE 'A' END AS answer, verdict = 'uncertain' AS low_confidence, CASE verdict WHEN 'true' THEN 'support,refute' WHEN 'false' THEN 'refute,support' ELSE 'insufficient,insufficient' END AS judgments FROM v""")
def verdict_answers(spark, sf_dir):
    """True-or-false answers by verdict, and the verdict spread over the two options."""
    v = _lines(spark, sf_dir).where("l_linenumber = 1").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "N", "false").otherwise("uncertain").alias("verdict"))
    return answers.by_verdict(v).select("l_orderkey", "verdict", "answer", "low_confidence", F.array_join(F.transform(answers.verdict_options(F.col("verdict")), lambda x: x["judgment"]), ",").alias("judgments"))


@query("""SELECT l_orderkey, coalesce(array_to_string(list_sort(list_distinct(list(l_shipmode) FILTER (l_shipmode IS NOT NULL))), ','), '') AS warnings, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS trace_id FROM (SELECT l_orderkey, l_suppkey, CASE WHEN l_discount > 0.08 THEN 'judgment_error' WHEN l_tax > 0.07 THEN 'no_support' END AS l_shipmode FROM lineitem) GROUP BY l_orderkey""")
def answer_warnings(spark, sf_dir):
    """Distinct warnings of a question, in order, and its trace id if there is one only."""
    w = F.when(F.col("l_discount") > 0.08, "judgment_error").when(F.col("l_tax") > 0.07, "no_support")
    g = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(w)), ",").alias("warnings"), F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("z"))
    return g.select("l_orderkey", "warnings", F.when(F.col("a") == F.col("z"), F.col("a")).alias("trace_id"))


@query("""SELECT conv_id, turn, CASE WHEN length(note) < 10 THEN text ELSE note END AS note FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN substr(text, 1, 5) ELSE substr(text, 1, 40) END AS note FROM conversations)""")
def note_fallback(spark, sf_dir):
    """A note of under ten characters is replaced by what it was made from."""
    note = F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 5)).otherwise(F.substring("text", 1, 40))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length(note) < 10, F.col("text")).otherwise(note).alias("note"))


@query("""SELECT CASE WHEN k % 4 = 0 THEN true ELSE k % 2 = 0 END AS ok, CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS n_missing, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2""")
def self_checks(spark, sf_dir):
    """Self-checks read from JSON: ok and what is missing; what can't be read counts as ok and asks for nothing."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = F.when(k % 4 == 0, "not json {").otherwise(F.to_json(F.struct((k % 2 == 0).alias("ok"), F.array(F.lit("a"), F.lit("b")).alias("missing"))))
    c = read(spark, sf_dir, "events").select(parsing.self_check(raw).alias("c"))
    return c.groupBy("c.ok", F.size("c.missing").alias("n_missing")).agg(F.count("*").alias("n"))


@query("""SELECT item_id, md5('system:Judge one option.' || chr(10) || 'user:' || string_agg('Document ' || r || ' = ' || doc_id, chr(10) ORDER BY r) || chr(10) || max(text)) AS messages FROM (SELECT item_id, b.text, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS r FROM benchmark b JOIN labels ON doc_id % 40 = item_id % 40) GROUP BY item_id""")
def prompt_messages(spark, sf_dir):
    """Two messages a question: the instruction, and its documents bound to ordinals in order with the question's text."""
    b = read(spark, sf_dir, "benchmark").withColumn("r", F.col("item_id") % 40)
    docs = read(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 40).alias("r"))
    g = b.join(docs, "r").groupBy("item_id").agg(F.max("text").alias("text"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    m = answers.messages("Judge one option.", F.col("ids"), F.col("text"))
    return g.select("item_id", F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")).alias("messages"))


@query("""WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A' END AS answer FROM customer) SELECT CASE WHEN answer <> '' THEN 'kept' ELSE 'redone' END AS action, count(*) AS n FROM a GROUP BY 1""")
def resume_answers(spark, sf_dir):
    """Answer rows written as CSV and read back: those with an answer are kept, others redone."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("A").alias("answer"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.lit(3).alias("total_tokens"))
    done = files.read_answers(spark, files.write_answers(c)).where("answer <> ''").select("qid", F.lit("kept").alias("action"))
    return c.select("qid").join(done, "qid", "left").groupBy(F.coalesce("action", F.lit("redone")).alias("action")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS p, count(*) AS c FROM lineitem GROUP BY l_orderkey) SELECT qid, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM c UNION ALL SELECT 'summary', CAST(sum(p) AS BIGINT), CAST(sum(c) AS BIGINT), CAST(sum(p + c) AS BIGINT) FROM c""")
def answer_file(spark, sf_dir):
    """The answer file with its summary row, written and read back."""
    g = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("qid")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("prompt_tokens"), F.count("*").alias("completion_tokens"))
    rows = g.select("qid", F.lit("A").alias("answer"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
    return files.read_answers(spark, files.write_answers(rows), summary=True).select("qid", *(F.col(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))


@query("""SELECT sum(l_quantity)::BIGINT AS total_tokens, 'summary' AS taken_from FROM lineitem""")
def token_total(spark, sf_dir):
    """An answer file's total: its summary row if there is one, else the sum of its rows."""
    g = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("qid")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total_tokens"))
    rows = g.select("qid", F.lit("A").alias("answer"), F.col("total_tokens").alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), "total_tokens")
    return files.total(files.read_answers(spark, files.write_answers(rows), summary=True))


@query("""SELECT CASE item_id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'mcq' ELSE 'tf' END AS answer_format, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM benchmark GROUP BY 1""")
def question_scan(spark, sf_dir):
    """Questions written as JSON files and scanned in stable order; an empty folder is an error."""
    b = read(spark, sf_dir, "benchmark")
    fmt = F.element_at(F.array(F.lit("multi"), F.lit("mcq"), F.lit("tf")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    rows = b.select(F.col("item_id").cast("string").alias("qid"), fmt.alias("domain"), F.col("text").alias("question"), fmt.alias("answer_format"))
    found = files.scan_questions(spark, files.write_json(rows))
    return found.groupBy("answer_format").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("n_chars"))


@query("""SELECT item_id, r AS ordinal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1 AS r FROM benchmark) WHERE r < 7""")
def question_scope(spark, sf_dir):
    """The first questions of every domain in their order: lookup, filter and scope are one selection."""
    b = read(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("domain"))
    return files.scope(b, "domain", "item_id", 7).select("item_id", "ordinal")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY user_id""")
def trace_log(spark, sf_dir):
    """Calls appended to a JSON-lines log and read back; a line that is no object is an error row."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    got = files.read_log(spark, files.write_json(e), "event_id bigint, user_id bigint, event_type string")
    return got.where("not broken").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"))


@query("""WITH s AS (SELECT l_orderkey, max(l_extendedprice) AS score, bool_or(l_returnflag = 'A') AS correct FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY score, l_orderkey) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT CASE WHEN i < n // 2 THEN 'lower' ELSE 'upper' END AS half, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM r GROUP BY 1""")
def half_accuracy(spark, sf_dir):
    """Accuracy of the lower and the upper half by score, exactly: ranks by counts of ranges, not by one sorted task."""
    s = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_returnflag") == "A").alias("correct"))
    return evaluation.by_parts(s, "score", "l_orderkey", 2, ("lower", "upper"), "half")


@query("""WITH s AS (SELECT l_orderkey, max(l_extendedprice) AS score, bool_or(l_returnflag = 'A') AS correct FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY score, l_orderkey) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT CASE WHEN i < n // 3 THEN 'low' WHEN i < 2 * (n // 3) THEN 'middle' ELSE 'high' END AS third, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM r GROUP BY 1""")
def third_accuracy(spark, sf_dir):
    """Accuracy by thirds of the score; the last third has the remainder."""
    s = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_returnflag") == "A").alias("correct"))
    return evaluation.by_parts(s, "score", "l_orderkey", 3, ("low", "middle", "high"), "third")


@query("""SELECT l_linenumber AS depth, count(*) FILTER (l_returnflag = 'A') AS n_hits, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY l_linenumber""")
def depth_grid(spark, sf_dir):
    """Matches and tokens by retrieval depth."""
    return _lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("depth")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n_hits"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))


@query("""WITH o AS (SELECT CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'better' WHEN l_returnflag = 'R' THEN 'worse' WHEN l_returnflag = 'N' THEN 'same' ELSE 'neutral' END AS outcome, l_extendedprice AS s FROM lineitem)
SELECT outcome, count(*) AS n, list_sort(list(s))[CAST(count(*) // 2 + 1 AS INT)] AS upper_median FROM o GROUP BY outcome""")
def outcome_medians(spark, sf_dir):
    """Outcomes of a change with the upper median of their scores."""
    o = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "better").when(F.col("l_returnflag") == "R", "worse").when(F.col("l_returnflag") == "N", "same").otherwise("neutral")
    return evaluation.upper_medians(_lines(spark, sf_dir).select(o.alias("outcome"), F.col("l_extendedprice").alias("s")), "outcome", "s")


@query("""WITH want AS (SELECT item_id, i AS place, (item_id * 7 + i) % 300 AS doc_id FROM benchmark, (SELECT unnest([1, 2, 3]) AS i)) SELECT item_id, string_agg(CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE CAST(l.quality AS VARCHAR) END, ',' ORDER BY place) AS evidence, count(*) FILTER (l.doc_id IS NULL) AS n_missing FROM want LEFT JOIN labels l USING (doc_id) GROUP BY item_id""")
def gold_evidence(spark, sf_dir):
    """Evidence looked up by id in the order of the gold list; what is missing is named."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.array(*((F.col("item_id") * 7 + i) % 300 for i in (1, 2, 3)))).alias("place", "doc_id"))
    j = b.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id", "left")
    x = F.array_sort(F.collect_list(F.struct("place", F.coalesce("q", F.lit("missing")).alias("q"))))
    return j.groupBy("item_id").agg(F.array_join(F.transform(x, lambda v: v["q"]), ",").alias("evidence"), F.count_if(F.col("q").isNull()).alias("n_missing"))


@query("""SELECT 'unsorted' AS problem, count(*) AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'overlap', count(*) FROM part JOIN supplier ON p_partkey = s_suppkey""")
def frozen_selection(spark, sf_dir):
    """A frozen selection: allowed values, unique ids, and no overlap of its two sides."""
    p = read(spark, sf_dir, "part")
    problem = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    twice = p.groupBy("p_name").count().where("count > 1")
    both = p.join(read(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left_semi")
    return problem("unsorted", p.where("p_size > 40")).unionByName(problem("duplicate_ids", twice)).unionByName(problem("overlap", both))


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS p, CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 5 AS t FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 14 <> 0
 UNION ALL SELECT -o_orderkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderkey % 22 = 0), a AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders WHERE o_orderkey % 2 = 0)
SELECT count(*) AS n, count(*) FILTER (a.t IS NULL) AS n_added, count(*) FILTER (b.t IS NULL) AS n_removed, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL AND a.s IS DISTINCT FROM b.s) AS n_answer_diff, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL AND a.p IS DISTINCT FROM b.p) AS n_metadata_diff,
 CAST(coalesce(sum(b.t), 0) - coalesce(sum(a.t), 0) AS BIGINT) AS cost FROM a FULL JOIN b USING (o_orderkey)""")
def candidate_audit(spark, sf_dir):
    """A candidate against its parent: what was added and removed, answers and metadata that differ, and what it cost. The candidate has other statuses, priorities and totals by id, lacks some orders and has some of its own."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("answer"), F.col("o_orderpriority").alias("metadata"), cents.alias("cost"))
    parent = o.where(k % 2 == 0)
    candidate = parent.where(k % 14 != 0).select("o_orderkey", F.when(k % 6 == 0, "X").otherwise(F.col("answer")).alias("answer"), F.when(k % 10 != 0, F.col("metadata")).alias("metadata"), (F.col("cost") + k % 5).alias("cost"))
    own = o.where(k % 22 == 0).select((-k).alias("o_orderkey"), "answer", "metadata", "cost")
    return checks.candidate_differences(parent, candidate.unionByName(own), "o_orderkey")


@query("""SELECT source AS domain, md5(string_agg('## ' || doc_id || chr(10) || '- Language: ' || coalesce(lang, '?'), chr(10) ORDER BY doc_id)) AS packet, count(*) AS n FROM documents GROUP BY source""")
def label_packets(spark, sf_dir):
    """Label cards of every domain rendered in order into one packet."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n- Language: "), F.coalesce("lang", F.lit("?"))).alias("card"))
    x = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "card"))), lambda v: v["card"]), "\n")
    return d.groupBy(F.col("source").alias("domain")).agg(F.md5(x).alias("packet"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 6 AS a, c_nationkey % 4 AS f FROM customer WHERE c_custkey % 9 <> 0) SELECT 'missing_card' AS error, count(*) AS n FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'answer', count(*) FROM c WHERE a > 3 UNION ALL SELECT 'confidence', count(*) FROM c WHERE f = 3""")
def label_batch(spark, sf_dir):
    """A batch of label cards: the set of cards, and each card's fields."""
    c = read(spark, sf_dir, "customer")
    cards = c.where("c_custkey % 9 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 6 <= 3, "A").alias("answer"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "sure"))), (F.col("c_nationkey") % 4).cast("int") + 1).alias("confidence"))
    j = c.select("c_custkey").join(cards.withColumn("has", F.lit(True)), "c_custkey", "left")
    has = F.col("has").isNotNull()
    errors = {"missing_card": ~has, "answer": has & F.col("answer").isNull(), "confidence": has & ~F.col("confidence").isin("high", "medium", "low")}
    return j.agg(*(F.count_if(v).alias(k) for k, v in errors.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("error"), F.col(k).alias("n")) for k in errors))).alias("x")).select("x.*")
