"""Questions answered in rounds: answer, see what is missing, look for it, answer again.

A model is a function from rows to rows with a ``reply``: a stored table of replies, an expression, or a call. Each round is one pass over the questions still open, written
once; those that lack nothing, or for whose gaps nothing is found, are done and don't come again, and the loop ends when none is open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions import answers as words
from lumenry.operators import replies, retrieval
from lumenry.sources.shared import table

ROUNDS, SUPPLEMENT = 2, 3
Model = Callable[[DataFrame], DataFrame]


def outer_object(reply: Column) -> Column:
    """What is between the first and the last brace, if that is a JSON object."""
    part = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(replies.is_object(part) & replies.is_json(part), part)


def _listed(json: Column) -> Column:
    """The texts of ``missing`` that aren't blank; null if it is there and no list."""
    raw = F.ltrim(F.get_json_object(json, "$.missing"))
    got = F.from_json(json, "missing array<string>")["missing"]
    there = F.array_contains(F.json_object_keys(json), "missing")
    none = F.array().cast("array<string>")
    return F.when(~there, none).when(raw.startswith("["), F.filter(F.coalesce(got, none), lambda m: F.trim(m) != ""))


def self_check(reply: Column) -> Column:
    """A struct (ok, missing); what can't be read is ok and lacks nothing, so that nothing is looked for by mistake."""
    json = outer_object(reply)
    missing = _listed(json)
    said = F.get_json_object(json, "$.ok")
    there = F.array_contains(F.json_object_keys(json), "ok")
    ok = F.when(~there, True).otherwise(~F.coalesce(said, F.lit("")).isin("", "false", "0", "0.0", "[]", "{}"))
    read = json.isNotNull() & missing.isNotNull()
    return F.struct(F.when(read, ok).otherwise(True).alias("ok"), F.when(read, missing).otherwise(F.array().cast("array<string>")).alias("missing"))


def answer_and_gaps(reply: Column, many: Column) -> Column:
    """A struct (answer, missing) of a reply that has both; of one that can't be read, the letters of the whole text, and nothing is missing."""
    json = outer_object(reply)
    missing = _listed(json)
    read = json.isNotNull() & missing.isNotNull()
    said = F.when(read, F.coalesce(F.get_json_object(json, "$.answer"), F.lit(""))).otherwise(reply)
    return F.struct(words.letters(said, many).alias("answer"), F.when(read, missing).otherwise(F.array().cast("array<string>")).alias("missing"))


def supplement(gaps: DataFrame, segments: DataFrame, k: int = SUPPLEMENT) -> DataFrame:
    """(qid, supplement): for each question the k best of its own segments by BM25 over its missing terms as substrings, best first. Questions without a hit have no row.

    gaps: (qid, missing); segments: (qid, segment_id, text), the text normalised."""
    asked = gaps.select(F.col("qid").alias("item_id"), F.explode(F.array_distinct("missing")).alias("term")).where("term <> ''").select("item_id", F.lower("term").alias("term")).distinct()
    own = segments.select(F.col("qid").alias("doc_id"), F.col("segment_id").alias("chunk_id"), "text")
    places = gaps.select(F.col("qid").alias("item_id"), F.col("qid").alias("doc_id"))
    hits = retrieval.term_hits(retrieval.candidate_chunks(own, places), asked)
    scored = hits.groupBy("item_id", "chunk_id").agg(F.round(F.sum(retrieval.score_part(F.lit(1.0))), 4).alias("score"))
    best = retrieval.top(scored, ["item_id"], k).join(segments.select(F.col("qid").alias("item_id"), F.col("segment_id").alias("chunk_id"), "text"), ["item_id", "chunk_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return best.groupBy(F.col("item_id").alias("qid")).agg(listed.alias("supplement"))


def solve(questions: DataFrame, answer: Model, search: Callable[[DataFrame], DataFrame], check: Model | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(qid, answer, evidence, rounds, n_calls, n_shown) of every question after up to ``rounds`` more rounds.

    questions: (qid, many, evidence, ...), one row a question. ``search`` gets (qid, missing, ...) and gives (qid, supplement). With ``check`` an answer is checked by a second call, and is given
    anew on all evidence (``shown``); without, a reply names its own gaps, and a new one is shown its previous answer and the supplement only. Evidence only grows: what is found is
    added once. n_shown counts the pieces of evidence that calls were shown."""
    extra = [c for c in questions.columns if c not in ("qid", "many", "evidence")]

    def asked(rows: DataFrame) -> DataFrame:
        told = answer(rows).withColumn("_n", F.size("shown"))
        if check is None:
            told = told.withColumn("_x", answer_and_gaps(F.col("reply"), F.col("many"))).withColumn("answer", F.col("_x.answer")).withColumn("missing", F.col("_x.missing"))
        else:
            told = told.withColumn("answer", words.letters(F.col("reply"), F.col("many"))).withColumn("missing", F.array().cast("array<string>"))
        return told.withColumn("n_calls", F.col("n_calls") + 1).withColumn("n_shown", F.col("n_shown") + F.col("_n")).select("qid", "many", *extra, "evidence", "answer", "missing", "rounds", "n_calls", "n_shown")

    zero = F.lit(0).cast("bigint")
    first = questions.select("qid", "many", *extra, "evidence", F.col("evidence").alias("shown"), F.lit("").alias("answer"), F.array().cast("array<string>").alias("missing"), zero.alias("rounds"), zero.alias("n_calls"), zero.alias("n_shown"))
    state, done = table(asked(first)), []
    for _ in range(rounds):
        if check is not None:
            told = check(state).withColumn("_x", self_check(F.col("reply")))
            gaps = F.when(F.col("_x.ok"), F.array().cast("array<string>")).otherwise(F.col("_x.missing"))
            counted = told.withColumn("missing", gaps).withColumn("n_calls", F.col("n_calls") + 1).withColumn("n_shown", F.col("n_shown") + F.size("evidence"))
            state = table(counted.select(*state.columns))
        open_ = state.where(F.size("missing") > 0)
        found = table(search(open_.select("qid", "missing", *extra)).where(F.size("supplement") > 0))
        done.append(state.join(found.select("qid"), "qid", "left_anti"))
        again = open_.join(found, "qid").withColumn("evidence", F.array_union("evidence", "supplement"))
        again = again.withColumn("shown", F.col("evidence") if check is not None else F.col("supplement")).withColumn("rounds", F.col("rounds") + 1)
        state = table(asked(again))
        if not state.head(1):
            break
    out = state
    for d in done:
        out = out.unionByName(d)
    return out.select("qid", "answer", "evidence", "rounds", "n_calls", "n_shown")
