"""Evidence retrieval of ``benchmark`` items over ``documents``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.jobs.corpus_jobs import CHUNKS, NORM, documents
from lumenry.jobs.registry import query, read
from lumenry.operators import answers, cards, chunking, evaluation, profiles, retrieval
from lumenry.sources.shared import prepared, table

ASCII = r"[a-zA-Z][a-zA-Z0-9.\-]+|\d{3,}"
NUMERIC = r"(?:19|20)\d{2}|\d+(?:\.\d+)?%"


def _terms(text: str) -> str:
    n = NORM.format(text)
    return f"list_filter(list_concat(regexp_extract_all({n}, '{NUMERIC}'), regexp_extract_all({n}, '{ASCII}')), lambda x: length(x) >= 2)"


BASE = rf"least(length(term), 6) * CASE WHEN regexp_full_match(term, '{NUMERIC}') THEN 3.0 ELSE 1.0 END"

ITEM_TERMS = f"""
item_terms AS (SELECT item_id, term, CAST({BASE} AS DOUBLE) AS weight FROM (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark))"""

COUNTS = f"""
tokens AS (SELECT chunk_id, unnest(regexp_extract_all({NORM.format("text")}, '{ASCII}')) AS term FROM chunks),
counts AS (SELECT chunk_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM item_terms) GROUP BY chunk_id, term),
sizes AS (SELECT chunk_id, doc_id, k, length({NORM.format("text")}) AS size FROM chunks)"""

SCORED = """
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (SELECT item_id, chunk_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * size / mean))), 4) AS score, count(*) AS n_matched
  FROM counts JOIN item_terms USING (term) JOIN df USING (term) JOIN sizes USING (chunk_id), (SELECT count(*) AS n, avg(size) AS mean FROM sizes) GROUP BY item_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""

FULL = f"{CHUNKS}, {ITEM_TERMS}, {COUNTS}, {SCORED}"


def _chunks(spark, sf_dir):
    """All windows with their normalised text ``t``, made once an application and input."""
    return prepared(spark, "chunks", sf_dir, lambda: chunking.chunks(documents(spark, sf_dir)).withColumn("t", T.normalize(F.col("text"))))


def _titles(spark, sf_dir):
    return prepared(spark, "titles", sf_dir, lambda: cards.titles(_chunks(spark, sf_dir)))


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark")


def _scored(spark, sf_dir):
    chunked, terms = _chunks(spark, sf_dir), retrieval.query_terms(_items(spark, sf_dir))
    stats = chunked.agg(F.count("*").alias("n"), F.avg(F.length("t")).alias("mean"))
    return retrieval.bm25(retrieval.token_counts(chunked, terms), terms, stats, ["item_id"])


def _options(items):
    """Four options, the quarters of an item's text; the question is its first half; the format goes by the id."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    parts = F.array(*(F.struct(F.lit("ABCD"[i]).alias("option"), F.col("text").substr(quarter * i + 1, quarter).alias("option_text")) for i in range(4)))
    fmt = F.element_at(F.array(F.lit("multi"), F.lit("mcq"), F.lit("tf")), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))
    half = F.col("text").substr(F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return items.select("item_id", fmt.alias("answer_format"), half.alias("question"), F.explode(parts).alias("o")).select("item_id", "answer_format", "question", "o.*")


OPTIONS = """
options AS (SELECT item_id, answer_format, question, o AS option, substr(text, CAST(length(text) // 4 * i + 1 AS INT), CAST(length(text) // 4 AS INT)) AS option_text FROM (
  SELECT item_id, text, ['multi', 'mcq', 'tf'][CAST(item_id % 3 AS INT) + 1] AS answer_format, substr(text, 1, CAST(length(text) // 2 AS INT)) AS question FROM benchmark),
  (SELECT unnest([0, 1, 2, 3]) AS i, unnest(['A', 'B', 'C', 'D']) AS o))"""


@query(f"""WITH {OPTIONS}, every AS (
  SELECT DISTINCT item_id, option, unnest({_terms("option_text")}) AS term, 2.0 AS s FROM options UNION ALL
  SELECT DISTINCT item_id, option, unnest({_terms("question")}) AS term, 1.0 AS s FROM options)
SELECT item_id, option, term, CAST(round(max(s) * {BASE} * CASE WHEN count(*) = 2 THEN 1.5 ELSE 1.0 END, 6) AS DOUBLE) AS weight FROM every GROUP BY item_id, option, term""")
def term_weights(spark, sf_dir):
    return retrieval.option_weights(_options(_items(spark, sf_dir)))


@query(f"WITH {FULL} SELECT item_id, chunk_id, score, n_matched, rank FROM ranked WHERE rank <= 5")
def bm25_token_topk(spark, sf_dir):
    """The five best windows of each item by BM25 over tokens."""
    return retrieval.top(_scored(spark, sf_dir), ["item_id"])


@query(f"WITH {FULL} SELECT item_id, count(*) AS n_chunks, round(max(score), 3) AS best, round(sum(score) / 1000, 1) AS total FROM scored GROUP BY item_id")
def retrieval_confidence(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy("item_id").agg(F.count("*").alias("n_chunks"), F.round(F.max("score"), 3).alias("best"), F.round(F.sum("score") / 1000, 1).alias("total"))


@query(f"""WITH {FULL} SELECT item_id, chunk_id, rank FROM ranked WHERE rank <= CASE WHEN item_id % 3 = 0 THEN 24 ELSE 8 END""")
def depth_by_format(spark, sf_dir):
    """24 windows for multi questions, 8 for others."""
    s = _scored(spark, sf_dir)
    return retrieval.top(s, ["item_id"], F.when(F.pmod("item_id", F.lit(3)) == 0, 24).otherwise(8)).select("item_id", "chunk_id", "rank")


@query(f"""WITH {CHUNKS}, {ITEM_TERMS}, texts AS (SELECT chunk_id, {NORM.format("text")} AS t FROM chunks)
SELECT term, count(*) AS df, CAST(sum((length(t) - length(replace(t, term, ''))) // length(term)) AS BIGINT) AS tf FROM (SELECT DISTINCT term FROM item_terms), texts WHERE contains(t, term) GROUP BY term""")
def substring_frequencies(spark, sf_dir):
    """Document and term frequency of query terms as substrings of windows."""
    counts = retrieval.substring_counts(_chunks(spark, sf_dir), retrieval.query_terms(_items(spark, sf_dir)))
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


TITLES = rf"""
early AS (SELECT *, row_number() OVER (PARTITION BY domain, doc_id ORDER BY chunk_id) AS c FROM chunks),
lines AS (SELECT domain, doc_id, regexp_replace(regexp_replace(l, '\s+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g') AS line FROM (
  SELECT domain, doc_id, unnest(list_slice(string_split(text, chr(10)), 1, 20)) AS l FROM early WHERE c <= 4)),
rated AS (SELECT *, CASE WHEN length(line) BETWEEN 6 AND 80 THEN 1 ELSE 0 END - CASE WHEN length(line) > 100 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(line, '保险') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(line, '合同|条款|办法|报告|募集说明书') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(line, '目录|阅读指引|提示|释义|第一章') THEN 3 ELSE 0 END AS score FROM lines WHERE length(line) >= 4),
titles AS (SELECT domain, doc_id, line AS title FROM (SELECT *, row_number() OVER (PARTITION BY domain, doc_id ORDER BY score DESC, length(line), line) AS r FROM rated) WHERE r = 1)"""

CARDS = rf"""
kw AS (SELECT domain, doc_id, term, sum(w) AS count FROM (
  SELECT domain, doc_id, term, 1 AS w FROM (SELECT DISTINCT domain, doc_id, chunk_id, unnest({_terms("text")}) AS term FROM chunks) UNION ALL
  SELECT domain, doc_id, term, 8 AS w FROM (SELECT DISTINCT domain, doc_id, unnest({_terms("title")}) AS term FROM titles)) GROUP BY domain, doc_id, term),
kdf AS (SELECT domain, term, count(*) AS df FROM kw GROUP BY domain, term),
dsize AS (SELECT domain, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY domain),
kscore AS (SELECT domain, doc_id, term, count, round(ln(1 + count) * ln(1 + (docs + 0.5) / (df + 0.5)) * least(length(term), 6) * CASE WHEN regexp_full_match(term, '{NUMERIC}') THEN 2.5 ELSE 1.0 END, 6) AS score
  FROM kw JOIN kdf USING (domain, term) JOIN dsize USING (domain)),
cards AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, doc_id ORDER BY score DESC, length(term) DESC, term) AS rank FROM kscore) WHERE rank <= 180)"""

CARD_TOP = rf"""
csize AS (SELECT domain, doc_id, count(*) AS n FROM cards GROUP BY domain, doc_id),
years AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '(?:19|20)\d{{2}}')) AS term FROM (SELECT doc_id, text AS t FROM chunks UNION ALL SELECT doc_id, title FROM titles)),
parts AS (SELECT item_id, doc_id, {BASE} * (1.0 + 2.0 * (n - rank + 1) / n) AS s FROM item_terms JOIN cards USING (term) JOIN csize USING (domain, doc_id) UNION ALL
  SELECT item_id, doc_id, {BASE} * 12.0 AS s FROM item_terms JOIN titles ON contains({NORM.format("title")}, term) UNION ALL
  SELECT item_id, doc_id, {BASE} * 4.0 AS s FROM item_terms JOIN years USING (term)),
cscored AS (SELECT item_id, doc_id, round(sum(s), 6) AS score FROM parts GROUP BY item_id, doc_id),
ctop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cscored) WHERE rank <= 12)"""

SCOPED = f"""{CHUNKS}, {TITLES}, {CARDS}, {ITEM_TERMS}, {CARD_TOP},
places AS (SELECT item_id, doc_id FROM ctop),
own AS (SELECT item_id, domain, chunks.doc_id, k, chunk_id, text, {NORM.format("text")} AS t FROM chunks JOIN places USING (doc_id)),
hits AS (SELECT item_id, doc_id, k, chunk_id, length(t) AS size, term, weight, (length(t) - length(replace(t, term, ''))) // length(term) AS tf FROM own JOIN item_terms USING (item_id) WHERE contains(t, term)),
df AS (SELECT item_id, term, count(*) AS df FROM hits GROUP BY item_id, term),
stats AS (SELECT item_id, count(*) AS n, avg(length(t)) AS mean FROM own GROUP BY item_id),
scored AS (SELECT item_id, doc_id, chunk_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * size / mean))), 4) AS score
  FROM hits JOIN df USING (item_id, term) JOIN stats USING (item_id) GROUP BY item_id, doc_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, chunk_id) AS doc_rank FROM scored)"""


def _places(spark, sf_dir):
    """Candidate documents of an item that names none: the twelve best cards."""
    return _card_top(spark, sf_dir).select("item_id", "doc_id")


def _candidates(spark, sf_dir):
    """Windows of the items' candidate documents, with the length of their normalised text, made once an application and input."""

    def build():
        docs = documents(spark, sf_dir).join(_places(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")
        return chunking.chunks(docs).drop("char_count").withColumn("size", F.length(T.normalize(F.col("text"))))

    return prepared(spark, "candidate chunks", sf_dir, build)


def _candidate_titles(spark, sf_dir):
    return cards.titles(_candidates(spark, sf_dir))


def _scoped(spark, sf_dir):
    """Substring BM25 inside each item's candidate documents."""
    terms = retrieval.query_terms(_items(spark, sf_dir)).distinct()
    hits = retrieval.candidate_hits(_candidates(spark, sf_dir), _places(spark, sf_dir), terms)
    return hits.groupBy("item_id", "doc_id", "chunk_id").agg(F.round(F.sum(retrieval.score_part(F.col("weight"))), 4).alias("score"))


@query(f"WITH {SCOPED} SELECT item_id, doc_id, chunk_id, score, rank, rank > 5 AS is_extra FROM ranked WHERE rank <= 5 OR doc_rank <= 2")
def quota_coverage(spark, sf_dir):
    """The best five windows of an item, and at least two of each of its documents."""
    return retrieval.quota(_scoped(spark, sf_dir), ["item_id"]).select("item_id", "doc_id", "chunk_id", "score", "rank", "is_extra")


@query(f"""WITH {SCOPED}, picked AS (SELECT *, rank > 5 AS is_extra, count(*) OVER (PARTITION BY item_id) AS n FROM ranked WHERE rank <= 5 OR doc_rank <= 2),
near AS (SELECT item_id, chunk_id, concat_ws(chr(10), text, lag(text) OVER w, lead(text) OVER w) AS merged, concat_ws(',', chunk_id, lag(chunk_id) OVER w, lead(chunk_id) OVER w) AS merged_ids FROM own WINDOW w AS (PARTITION BY item_id, domain, doc_id ORDER BY k)),
sized AS (SELECT item_id, chunk_id, merged, merged_ids, CAST(greatest(200, CASE WHEN is_extra THEN least(1400, 7000 // n, 800) ELSE least(1400, 7000 // n) END) AS BIGINT) AS max_chars FROM picked JOIN near USING (item_id, chunk_id)),
found AS (SELECT item_id, chunk_id, min(instr({NORM.format("merged")}, term)) AS pos FROM sized JOIN item_terms USING (item_id) WHERE contains({NORM.format("merged")}, term) GROUP BY item_id, chunk_id)
SELECT item_id, chunk_id, merged_ids, max_chars, md5(CASE WHEN length(merged) <= max_chars THEN merged ELSE substr(merged, CAST(greatest(coalesce(pos, 1) - max_chars // 3, 1) AS INT), CAST(max_chars AS INT)) END) AS text_md5
FROM sized LEFT JOIN found USING (item_id, chunk_id)""")
def evidence_windows(spark, sf_dir):
    """Selected evidence with its neighbours, cut to its budget around the earliest term."""
    picked = retrieval.budget(retrieval.quota(_scoped(spark, sf_dir), ["item_id"]), ["item_id"]).select("item_id", "chunk_id", "max_chars")
    near = retrieval.with_neighbors(_candidates(spark, sf_dir).select("domain", "doc_id", "k", "chunk_id", "text")).select("chunk_id", "merged", "merged_ids")
    terms = retrieval.query_terms(_items(spark, sf_dir)).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    rows = picked.join(near, "chunk_id").join(terms, "item_id", "left")
    text = retrieval.cut_around(F.col("merged"), F.coalesce("terms", F.array().cast("array<string>")), F.col("max_chars"))
    return rows.select("item_id", "chunk_id", "merged_ids", "max_chars", F.md5(text).alias("text_md5"))


@query(f"""WITH {SCOPED}, kept AS (SELECT item_id, doc_id, k, text FROM ranked JOIN own USING (item_id, doc_id, chunk_id) WHERE doc_rank <= 3)
SELECT item_id, doc_id, coalesce(n, 0) AS n, coalesce(evidence, md5(head)) AS evidence FROM (
  SELECT item_id, doc_id, substr(text, 1, 4000) AS head FROM places JOIN documents USING (doc_id))
LEFT JOIN (SELECT item_id, doc_id, count(*) AS n, md5(string_agg(text, chr(10) || '...' || chr(10) ORDER BY k)) AS evidence FROM kept GROUP BY item_id, doc_id) USING (item_id, doc_id)""")
def source_order_evidence(spark, sf_dir):
    """The best three windows of each candidate document in its own order; without any, the document's beginning."""
    best = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "chunk_id"))
    places = table(_places(spark, sf_dir))
    kept = _scoped(spark, sf_dir).withColumn("d", best).where("d <= 3").select("item_id", "chunk_id").join(_candidates(spark, sf_dir).select("chunk_id", "doc_id", "k", "text"), "chunk_id")
    joined = retrieval.in_order(kept, ["item_id", "doc_id"])
    every = documents(spark, sf_dir).select("doc_id", "text").join(places, "doc_id")
    rows = every.join(joined, ["item_id", "doc_id"], "left")
    return rows.select("item_id", "doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.coalesce("evidence", F.substring("text", 1, 4000))).alias("evidence"))


@query(f"""WITH {SCOPED}, top AS (SELECT item_id, rank, 'doc ' || doc_id AS header, text FROM ranked JOIN own USING (item_id, doc_id, chunk_id) WHERE rank <= 3)
SELECT item_id, md5(string_agg('[' || rank || '] ' || header || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS block FROM top GROUP BY item_id""")
def prompt_block(spark, sf_dir):
    """Numbered evidence of each item."""
    picked = retrieval.top(_scoped(spark, sf_dir), ["item_id"], 3).join(_candidates(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    rows = picked.withColumn("header", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return answers.evidence_block(rows, ["item_id"]).select("item_id", F.md5("block").alias("block"))


GOLD = f"""gold AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {NORM.format("text")} AS b FROM benchmark), (SELECT doc_id, {NORM.format("text")} AS t FROM documents) WHERE contains(t, b))"""


@query(f"WITH {CHUNKS}, {TITLES} SELECT domain, doc_id, title FROM titles")
def doc_titles(spark, sf_dir):
    return _titles(spark, sf_dir)


@query(f"WITH {CHUNKS}, {TITLES}, {CARDS} SELECT domain, doc_id, term, CAST(count AS BIGINT) AS count, round(score, 4) AS score FROM cards")
def doc_cards(spark, sf_dir):
    return cards.card_terms(_chunks(spark, sf_dir), _titles(spark, sf_dir)).select("domain", "doc_id", "term", "count", F.round("score", 4).alias("score"))


BEST = 12


def _best_by_tables(spark, sf_dir, asked):
    chunked, titled = _chunks(spark, sf_dir), _titles(spark, sf_dir)
    terms = table(cards.card_terms(chunked, titled).select("domain", "doc_id", "term", "rank"))
    return cards.score_cards(asked, terms, titled, cards.card_facts(chunked, titled), BEST)


def _card_top(spark, sf_dir):
    """The best documents of every item by their cards, made once an application and input."""

    def build():
        asked = retrieval.query_terms(_items(spark, sf_dir)).drop("weight").distinct()
        best = profiles.best_cards(documents(spark, sf_dir), asked, BEST)
        return _best_by_tables(spark, sf_dir, asked) if best is None else best

    return prepared(spark, f"best {BEST} cards", sf_dir, build)


@query(f"WITH {CHUNKS}, {TITLES}, {CARDS}, {ITEM_TERMS}, {CARD_TOP} SELECT item_id, doc_id, round(score, 3) AS score, rank FROM ctop")
def card_topk(spark, sf_dir):
    """The twelve best documents of each item by their cards."""
    return _card_top(spark, sf_dir).select("item_id", "doc_id", F.round("score", 3).alias("score"), "rank")


#: Characters of distinct passages that are broadcast for one scan of the documents.
PASSAGE_CHARS = 2_000_000


def _gold(spark, sf_dir):
    """Items whose whole passage a document contains: by one scan of the documents for all passages, or, where these are too many to be broadcast, by shared words."""
    items = _items(spark, sf_dir).select("item_id", T.normalize(F.col("text")).alias("b")).where("b <> ''")
    distinct = items.select("b").distinct()
    if (distinct.agg(F.sum(F.length("b"))).first()[0] or 0) > PASSAGE_CHARS:
        return _gold_by_words(spark, sf_dir)
    found = profiles.containing(documents(spark, sf_dir), [r[0] for r in distinct.collect()], "b")
    return found.join(items, "b").select("item_id", "doc_id").distinct()


def _gold_by_words(spark, sf_dir):
    """Items whose whole passage a document contains. A passage of some words is contained only where its inner words stand as words, so pairs share the
    longest of them, up to five; passages without an inner word are looked for by a scan of the texts."""
    norm = T.normalize(F.col("text"))
    items = _items(spark, sf_dir).select("item_id", norm.alias("b")).where("b <> ''").withColumn("w", F.split("b", " ")).withColumn("n", F.least(F.size("w") - 2, F.lit(5)))
    hashed = lambda n, part: F.xxhash64(n, F.array_join(part, " "))
    long = items.where("n > 0").select("item_id", "b", "n", hashed(F.col("n"), F.slice("w", F.lit(2), F.col("n"))).alias("g"))
    lengths = [r[0] for r in long.select("n").distinct().collect()]
    docs = documents(spark, sf_dir).select("doc_id", norm.alias("t")).withColumn("w", F.split("t", " "))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: hashed(F.lit(n), F.slice("w", i, n)))
    grams = F.concat(*map(gram, lengths)) if lengths else F.array().cast("array<bigint>")
    # only ids and hashes meet; texts of what meets follow
    met = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("g")).join(long.select("item_id", "g"), "g").select("doc_id", "item_id").distinct()
    found = met.join(long.select("item_id", "b"), "item_id").join(docs.select("doc_id", "t"), "doc_id").where(F.contains("t", "b")).select("item_id", "doc_id")
    short = items.where("n <= 0").select("item_id", F.col("b").alias("term"))
    by_scan = retrieval.substring_counts(documents(spark, sf_dir), short, "doc_id").join(short, "term").select("item_id", "doc_id")
    return found.unionByName(by_scan).distinct()


@query(f"WITH {GOLD} SELECT item_id, doc_id FROM gold")
def gold_documents(spark, sf_dir):
    return _gold(spark, sf_dir)


@query(f"""WITH {CHUNKS}, {TITLES}, {CARDS}, {ITEM_TERMS}, {CARD_TOP}, {GOLD},
per AS (SELECT k, item_id, count(*) AS n, count(*) FILTER (coalesce(rank, 99) <= k) AS h FROM gold LEFT JOIN ctop USING (item_id, doc_id), (SELECT unnest(range(1, 13)) AS k) GROUP BY k, item_id)
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN h = n THEN 1.0 ELSE 0.0 END), 6) AS complete, round(sum(h)::DOUBLE / sum(n), 6) AS micro FROM per GROUP BY k""")
def recall_at_k(spark, sf_dir):
    r = evaluation_recall(spark, sf_dir)
    return r.select(F.col("k").cast("bigint").alias("k"), "complete", "micro")


def evaluation_recall(spark, sf_dir):
    return cards.recall_at(_card_top(spark, sf_dir), _gold(spark, sf_dir), 12)


ROUTES = f"""{OPTIONS},
cand AS (SELECT item_id, doc_id FROM ctop),
hits AS (SELECT o.item_id, o.option, o.answer_format, c.doc_id, titles.title, list_filter(list_distinct({_terms("option_text")}), lambda x: contains({NORM.format("titles.title")}, x)) AS m
  FROM options o JOIN cand c USING (item_id) LEFT JOIN titles USING (doc_id)),
rated2 AS (SELECT *, CASE WHEN title IS NULL THEN NULL ELSE coalesce(list_sum(list_transform(m, lambda x: least(length(x), 6))), 0) END AS score, coalesce(list_max(list_transform(m, lambda x: length(x))), 0) AS longest FROM hits),
nth AS (SELECT *, row_number() OVER (PARTITION BY item_id, option ORDER BY score DESC NULLS LAST, longest DESC, doc_id) AS r FROM rated2),
one AS (SELECT item_id, option, max(answer_format) AS f, count(*) AS n, count(*) FILTER (title IS NULL) AS missing, max(score) FILTER (r = 1) AS s1, max(longest) FILTER (r = 1) AS l1, max(doc_id) FILTER (r = 1) AS d1, max(score) FILTER (r = 2) AS s2 FROM nth GROUP BY item_id, option)"""


@query(f"""WITH {CHUNKS}, {TITLES}, {CARDS}, {ITEM_TERMS}, {CARD_TOP}, {ROUTES}
SELECT item_id, option, reason, CASE WHEN reason LIKE 'high%' THEN 'route' ELSE 'fallback' END AS decision, CASE WHEN reason LIKE 'high%' THEN d1 END AS doc_id FROM (SELECT *, CASE WHEN f <> 'multi' THEN 'non_multi' WHEN n < 2 THEN 'fewer_than_two_documents' WHEN missing > 0 THEN 'missing_document_metadata'
 WHEN l1 < 4 THEN 'longest_match_below_threshold' WHEN s1 < 12 THEN 'title_score_below_threshold' WHEN s1::DOUBLE / greatest(s2, 1) < 3 THEN 'score_ratio_below_threshold' WHEN s1 - s2 < 8 THEN 'score_margin_below_threshold'
 ELSE 'high_confidence_unique_title_match' END AS reason FROM one)""")
def route_decision(spark, sf_dir):
    """Whether an option of a multi question is routed to one of its item's candidate documents."""
    options = _options(_items(spark, sf_dir)).drop("question").join(_places(spark, sf_dir), "item_id")
    return cards.routes(options, _candidate_titles(spark, sf_dir))


@query(f"""WITH {SCOPED}, a AS (SELECT item_id, chunk_id FROM ranked WHERE rank <= 5), b AS (SELECT item_id, chunk_id FROM ranked WHERE rank <= 5 OR doc_rank <= 1), req AS (SELECT item_id, chunk_id FROM ranked WHERE doc_rank = 1)
SELECT item_id, count(*) AS n, count(a.chunk_id) AS n_control, count(b.chunk_id) AS n_treatment, count(*) FILTER (b.chunk_id IS NOT NULL AND a.chunk_id IS NULL) AS gained, count(*) FILTER (a.chunk_id IS NOT NULL AND b.chunk_id IS NULL) AS lost
FROM req LEFT JOIN a USING (item_id, chunk_id) LEFT JOIN b USING (item_id, chunk_id) GROUP BY item_id""")
def chunk_recall_change(spark, sf_dir):
    """Each document's best window is required: found by the best five alone, and with the quota of one."""
    every = table(retrieval.quota(_scoped(spark, sf_dir), ["item_id"], 5, 1))
    return evaluation.recall_change(every.where("doc_rank = 1").select("item_id", "chunk_id"), every.where("rank <= 5"), every, ["item_id"])
