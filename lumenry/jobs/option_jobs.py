"""Retrieval by option of a question, hidden candidate documents, routing, and the curves over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.jobs.corpus_jobs import documents
from lumenry.jobs.registry import query
from lumenry.jobs.retrieval_jobs import BASE, GOLD, NORM, OPTIONS, ROUTES, SCOPED, _candidate_titles, _candidates, _card_top, _chunks, _gold, _items, _options, _places, _scoped, _terms, route_decision
from lumenry.operators import cards, retrieval
from lumenry.sources.shared import table

OPTION_HITS = f"""{OPTIONS},
every AS (SELECT DISTINCT item_id, option, unnest({_terms("option_text")}) AS term, 2.0 AS s FROM options UNION ALL
  SELECT DISTINCT item_id, option, unnest({_terms("question")}) AS term, 1.0 AS s FROM options),
weights AS (SELECT item_id, option, term, CAST(round(max(s) * {BASE} * CASE WHEN count(*) = 2 THEN 1.5 ELSE 1.0 END, 6) AS DOUBLE) AS weight FROM every GROUP BY item_id, option, term),
ohits AS (SELECT item_id, doc_id, chunk_id, length(t) AS size, term, (length(t) - length(replace(t, term, ''))) // length(term) AS tf, coalesce(contains({NORM.format("title")}, term), false) AS in_section
  FROM own JOIN (SELECT DISTINCT item_id, term FROM weights) USING (item_id) LEFT JOIN titles USING (domain, doc_id) WHERE contains(t, term)),
odf AS (SELECT item_id, term, count(*) AS df FROM ohits GROUP BY item_id, term),
oparts AS (SELECT item_id, option, doc_id, chunk_id, term, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * size / mean)) * CASE WHEN in_section THEN 1.1 ELSE 1.0 END AS part
  FROM ohits JOIN odf USING (item_id, term) JOIN stats USING (item_id) JOIN weights USING (item_id, term)),
oscored AS (SELECT item_id, option, doc_id, chunk_id, round(sum(part), 4) AS score, array_to_string(list_slice(list(term ORDER BY length(term) DESC, term), 1, 20), ' ') AS matched FROM oparts GROUP BY item_id, option, doc_id, chunk_id),
oranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, option ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY item_id, option, doc_id ORDER BY score DESC, chunk_id) AS own_rank, count(*) OVER (PARTITION BY item_id, option, doc_id) AS n_own FROM oscored)"""


def _parts(spark, sf_dir):
    """(item_id, option, doc_id, chunk_id, term, part): every option's terms in its item's candidate chunks. A document's title is its chunks' section."""
    weights = retrieval.by_term(retrieval.option_weights(_options(_items(spark, sf_dir))))
    section = _candidate_titles(spark, sf_dir).select("domain", "doc_id", T.normalize(F.col("title")).alias("section"))
    hits = retrieval.candidate_hits(_candidates(spark, sf_dir), _places(spark, sf_dir), weights).join(section, ["domain", "doc_id"], "left")
    factor = F.when(F.coalesce(F.contains("section", "term"), F.lit(False)), 1.1).otherwise(1.0)
    every = hits.withColumn("factor", factor).select("*", F.explode("options").alias("o"))
    return every.select("item_id", "o.option", "doc_id", "chunk_id", "term", (retrieval.score_part(F.col("o.weight")) * F.col("factor")).alias("part"))


def _by_option(spark, sf_dir):
    """Scores of every option's chunks with their matched terms, the longest first, 20 at most."""
    matched = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))), 1, 20), lambda x: x["term"])
    return _parts(spark, sf_dir).groupBy("item_id", "option", "doc_id", "chunk_id").agg(F.round(F.sum("part"), 4).alias("score"), F.array_join(matched, " ").alias("matched"))


@query(f"WITH {SCOPED}, {OPTION_HITS} SELECT item_id, option, chunk_id, score, rank, matched FROM oranked WHERE rank <= 5")
def option_retrieval(spark, sf_dir):
    """The five best chunks of every option of every question, with the terms they matched."""
    return retrieval.top(_by_option(spark, sf_dir), ["item_id", "option"]).select("item_id", "option", "chunk_id", "score", "rank", "matched")


@query(f"WITH {SCOPED}, {OPTION_HITS} SELECT item_id, count(*) AS n_evidence, count(DISTINCT option) AS n_options, count(DISTINCT chunk_id) AS n_chunks, round(max(score), 3) AS best FROM oranked WHERE rank <= 5 GROUP BY item_id")
def question_retrieval(spark, sf_dir):
    """Each question's evidence over all its options."""
    best = retrieval.top(_by_option(spark, sf_dir), ["item_id", "option"])
    return best.groupBy("item_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("option").alias("n_options"), F.countDistinct("chunk_id").alias("n_chunks"), F.round(F.max("score"), 3).alias("best"))


@query(f"""WITH {SCOPED}, {OPTION_HITS}, alone AS (SELECT item_id, option, term, {BASE} AS base FROM (SELECT DISTINCT item_id, option, unnest({_terms("option_text")}) AS term FROM options)),
inside AS (SELECT item_id, doc_id, count(*) AS n FROM own GROUP BY item_id, doc_id),
ahits AS (SELECT item_id, doc_id, chunk_id, term, (length(t) - length(replace(t, term, ''))) // length(term) AS tf FROM own JOIN (SELECT DISTINCT item_id, term FROM alone) USING (item_id) WHERE contains(t, term)),
adf AS (SELECT item_id, doc_id, term, count(*) AS df FROM ahits GROUP BY item_id, doc_id, term),
ascored AS (SELECT item_id, option, chunk_id, round(sum(base * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 4) AS score FROM ahits JOIN adf USING (item_id, doc_id, term) JOIN inside USING (item_id, doc_id) JOIN alone USING (item_id, term) GROUP BY item_id, option, chunk_id),
best_alone AS (SELECT item_id, option, CAST(round(coalesce(max(score), 0), 3) AS DOUBLE) AS best, count(chunk_id) AS n_chunks FROM options LEFT JOIN ascored USING (item_id, option) GROUP BY item_id, option),
best_asked AS (SELECT item_id, option, max(score) AS best, count(*) AS n FROM oscored GROUP BY item_id, option)
SELECT item_id, option, a.best, n_chunks, CAST(coalesce(q.best, 0) AS DOUBLE) AS best_with_question, coalesce(n, 0) AS n_with_question FROM best_alone a LEFT JOIN best_asked q USING (item_id, option)""")
def option_max_score(spark, sf_dir):
    """The best score of an option's text alone, and that with its question's terms and its chunks' sections: low ones tell options without evidence."""
    options, chunked, places = _options(_items(spark, sf_dir)).select("item_id", "option", "option_text"), _candidates(spark, sf_dir), _places(spark, sf_dir)
    hits = retrieval.candidate_hits(chunked, places, retrieval.by_term(retrieval.option_terms(options)))
    best = retrieval.option_best_of(options, hits, chunked.select("doc_id").join(places, "doc_id").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")))
    asked = _by_option(spark, sf_dir).groupBy("item_id", "option").agg(F.max("score").alias("best_with_question"), F.count("*").alias("n_with_question"))
    alone = best.select("item_id", "option", F.round("best", 3).alias("best"), F.col("n_chunks").cast("bigint").alias("n_chunks"))
    return alone.join(asked, ["item_id", "option"], "left").fillna(0, ["best_with_question", "n_with_question"])


@query(f"""WITH {SCOPED}, {OPTION_HITS}, chosen AS (SELECT *, rank > 5 AS is_extra, count(*) OVER (PARTITION BY item_id, option) AS n FROM oranked WHERE rank <= 5 OR item_id % 3 = 0 AND own_rank <= 2)
SELECT item_id, option, chunk_id, score, rank, is_extra, CAST(greatest(200, CASE WHEN is_extra THEN least(1400, 7000 // n, 800) ELSE least(1400, 7000 // n) END) AS BIGINT) AS max_chars FROM chosen""")
def option_evidence(spark, sf_dir):
    """Every option's evidence: the five best chunks, two of each candidate document for questions with several answers, and each one's share of characters."""
    chosen = retrieval.option_evidence(_by_option(spark, sf_dir).drop("matched"), F.pmod("item_id", F.lit(3)) == 0)
    return chosen.select("item_id", "option", "chunk_id", "score", "rank", "is_extra", "max_chars")


@query(f"WITH {SCOPED} SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, count(DISTINCT domain) AS n_domains FROM own GROUP BY item_id")
def mode_b_candidates(spark, sf_dir):
    """Candidate chunks of questions that name no document: those of the twelve best cards."""
    own = _chunks(spark, sf_dir).join(_places(spark, sf_dir), "doc_id")
    return own.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.countDistinct("domain").alias("n_domains"))


@query(f"""WITH {SCOPED}, best AS (SELECT item_id, chunk_id, rank, text, length(text) AS n FROM ranked JOIN own USING (item_id, doc_id, chunk_id) WHERE rank <= 5),
found AS (SELECT item_id, chunk_id, min(instr({NORM.format("text")}, term)) AS pos FROM best JOIN item_terms USING (item_id) WHERE contains({NORM.format("text")}, term) GROUP BY item_id, chunk_id)
SELECT item_id, chunk_id, rank, md5(CASE WHEN n <= 1200 THEN text ELSE substr(text, CAST(greatest(coalesce(pos, 1) - 400, 1) AS INT), 1200) END) AS text_md5 FROM best LEFT JOIN found USING (item_id, chunk_id)""")
def control_retrieval(spark, sf_dir):
    """The control: five single chunks cut to 1,200 characters, without quota, neighbours or header."""
    terms = retrieval.query_terms(_items(spark, sf_dir)).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    rows = retrieval.top(_scoped(spark, sf_dir), ["item_id"]).join(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(terms, "item_id", "left")
    cut = retrieval.cut_around(F.col("text"), F.coalesce("terms", F.array().cast("array<string>")), F.lit(1200))
    return rows.select("item_id", "chunk_id", "rank", F.md5(cut).alias("text_md5"))


@query(f"WITH {SCOPED} SELECT item_id, chunk_id, score, rank, rank > 5 AS is_extra FROM ranked WHERE item_id % 3 = 2 AND (rank <= 5 OR doc_rank <= 2)")
def statement_retrieval(spark, sf_dir):
    """True-or-false questions: one search for the statement instead of the options, the quota over every document."""
    own = _scoped(spark, sf_dir).where("item_id % 3 = 2")
    return retrieval.quota(own, ["item_id"]).select("item_id", "chunk_id", "score", "rank", "is_extra")


DECIDED = """decided AS (SELECT item_id, option, CASE WHEN f = 'multi' AND n >= 2 AND missing = 0 AND l1 >= 4 AND s1 >= 12 AND s1::DOUBLE / greatest(s2, 1) >= 3 AND s1 - s2 >= 8 THEN d1 END AS target FROM one),
marked AS (SELECT o.*, coalesce(o.doc_id = target AND n_own >= 5, false) AS mine FROM oranked o LEFT JOIN decided USING (item_id, option)),
sel AS (SELECT *, bool_or(mine) OVER (PARTITION BY item_id, option) AS routed FROM marked),
picked AS (SELECT item_id, option, chunk_id, CASE WHEN routed THEN CASE WHEN mine THEN own_rank END ELSE rank END AS rank, routed FROM sel)"""
#: The routing SQL without the options that OPTION_HITS defines already.
_ROUTES = ROUTES.replace(OPTIONS + ",", "", 1).replace("hits AS", "rhits AS", 1).replace("FROM hits)", "FROM rhits)", 1)


def _selected(spark, sf_dir):
    return cards.routed(_by_option(spark, sf_dir).drop("matched"), route_decision(spark, sf_dir).select("item_id", "option", "doc_id"))


@query(f"WITH {SCOPED}, {OPTION_HITS}, {_ROUTES}, {DECIDED} SELECT item_id, option, chunk_id, rank, routed FROM picked WHERE rank <= 5")
def routed_selection(spark, sf_dir):
    """The five best chunks of an option's own document where it is routed and has five hits; else of all."""
    return _selected(spark, sf_dir)


@query(f"""WITH {SCOPED}, {OPTION_HITS}, {_ROUTES}, {DECIDED}, a AS (SELECT item_id, option, string_agg(chunk_id, ',' ORDER BY rank) AS control FROM oranked WHERE rank <= 5 GROUP BY item_id, option), b AS (SELECT item_id, option, bool_or(routed) AS routed, string_agg(chunk_id, ',' ORDER BY rank) AS selected FROM picked WHERE rank <= 5 GROUP BY item_id, option)
SELECT item_id, option, routed, control, selected, control <> selected AS changed FROM a JOIN b USING (item_id, option)""")
def route_diagnostics(spark, sf_dir):
    """Control and selected chunks of every option side by side."""
    listed = lambda df, name: df.groupBy("item_id", "option").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias(name), *([F.bool_or("routed").alias("routed")] if name == "selected" else []))
    a = listed(retrieval.top(_by_option(spark, sf_dir), ["item_id", "option"]), "control")
    j = a.join(listed(_selected(spark, sf_dir), "selected"), ["item_id", "option"])
    return j.select("item_id", "option", "routed", "control", "selected", (F.col("control") != F.col("selected")).alias("changed"))


CURVE = f"""{SCOPED}, {GOLD}, gd AS (SELECT item_id, doc_id, lang AS domain FROM gold JOIN documents USING (doc_id)),
per AS (SELECT k, domain, item_id, count(*) AS n, count(*) FILTER (coalesce(rank, 99) <= k) AS h FROM gd LEFT JOIN ctop USING (item_id, doc_id), (SELECT unnest(range(1, 13)) AS k) GROUP BY k, domain, item_id),
curve AS (SELECT CAST(k AS BIGINT) AS k, domain, round(avg(CASE WHEN h = n THEN 1.0 ELSE 0.0 END), 6) AS complete, round(sum(h)::DOUBLE / sum(n), 6) AS micro FROM per GROUP BY GROUPING SETS ((k, domain), (k)))"""


def _curve(spark, sf_dir):
    gold = _gold(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("lang").alias("domain")), "doc_id")
    return cards.recall_by_domain(_card_top(spark, sf_dir), gold, 12).withColumn("k", F.col("k").cast("bigint"))


@query(f"WITH {CURVE} SELECT k, domain, complete, micro FROM curve")
def recall_by_domain(spark, sf_dir):
    """Recall of hidden documents at every k, overall and by language."""
    return _curve(spark, sf_dir)


@query(f"""WITH {CURVE}, t AS (SELECT unnest([0.25, 0.5, 0.9])::DOUBLE AS threshold), reached AS (SELECT threshold, k, bool_or(domain IS NULL AND complete >= threshold) AS overall, bool_and(domain IS NULL OR complete >= threshold) AS each FROM curve, t GROUP BY threshold, k)
SELECT threshold, min(k) FILTER (overall) AS k_overall, min(k) FILTER (each) AS k_all_domains FROM reached GROUP BY threshold""")
def smallest_k(spark, sf_dir):
    """The smallest number of documents that reaches a recall, overall and in every language."""
    return cards.smallest_k(table(_curve(spark, sf_dir)), (0.25, 0.5, 0.9))
