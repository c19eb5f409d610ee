"""Document cards (ranked keywords), card scoring, document top-k, recall, and routing of options to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import text as T
from lumenry.operators.retrieval import substring_counts

KEYWORDS = 180
TITLE_WEIGHT = 8
YEAR = r"((?:19|20)\d{2})"
# Words of a title line and their points; kinds of documents.
TITLE_WORDS = ((("保险",), 4), (("合同", "条款", "办法", "报告", "募集说明书"), 2), (("目录", "阅读指引", "提示", "释义", "第一章"), -3))
TYPE_TERMS = ("保险条款", "养老年金", "医疗保险", "财产保险", "年度报告", "募集说明书", "公司债券", "可转换债券", "管理办法", "实施细则", "反洗钱法", "证券研究报告", "行业研究", "深度报告")
# Factors of a query term found in title, entity, years and keywords.
IN_TITLE, IN_ENTITY, IN_YEARS, IN_TYPES = 7.0, 5.0, 4.0, 3.0
# What an option's best title must reach to be routed.
ROUTE_LONGEST, ROUTE_SCORE, ROUTE_RATIO, ROUTE_MARGIN = 4, 12, 3.0, 8


def titles(chunked: DataFrame, first_chunks: int = 4, first_lines: int = 20) -> DataFrame:
    """(domain, doc_id, title): the best-scored line among the first lines of the first chunks; ties go to the shorter, then by text."""
    order = Window.partitionBy("domain", "doc_id").orderBy("chunk_id")
    early = chunked.withColumn("c", F.row_number().over(order)).where(F.col("c") <= first_chunks)
    lines = early.select("domain", "doc_id", F.explode(F.slice(F.split("text", "\n"), 1, first_lines)).alias("line"))
    lines = lines.withColumn("line", T.clean_line(F.col("line"))).where("length(line) >= 4")
    n = F.length("line")
    has = lambda words: F.col("line").rlike("|".join(words))
    score = F.when(n.between(6, 80), 1).otherwise(0) - F.when(n > 100, 3).otherwise(0)
    for words, points in TITLE_WORDS:
        score = score + F.when(has(words), points).otherwise(0)
    best = F.row_number().over(Window.partitionBy("domain", "doc_id").orderBy(F.desc("score"), n, "line"))
    return lines.withColumn("score", score).withColumn("r", best).where("r = 1").select("domain", "doc_id", F.col("line").alias("title"))


def card_terms(chunked: DataFrame, titled: DataFrame, keywords: int = KEYWORDS) -> DataFrame:
    """(domain, doc_id, term, count, score, rank): the ranked keywords of every document.

    A term counts once a chunk and ``TITLE_WEIGHT`` more if the title has it; its document frequency is taken in the domain."""
    plain = chunked.select("domain", "doc_id", T.normalized(chunked).alias("t"))  # once a text, before terms are exploded
    in_chunks = plain.select("domain", "doc_id", F.explode(T.latin_terms_of(F.col("t"))).alias("term"), F.lit(1).alias("w"))
    in_title = titled.select("domain", "doc_id", F.explode(T.latin_terms(F.col("title"))).alias("term"), F.lit(TITLE_WEIGHT).alias("w"))
    counts = in_chunks.unionByName(in_title).groupBy("domain", "doc_id", "term").agg(F.sum("w").alias("count"))
    df = counts.groupBy("domain", "term").agg(F.count("*").alias("df"))
    sizes = chunked.groupBy("domain").agg(F.countDistinct("doc_id").alias("docs"))
    scored = counts.join(df, ["domain", "term"]).join(sizes, "domain")
    idf = F.ln(1 + (F.col("docs") + 0.5) / (F.col("df") + 0.5))
    scored = scored.withColumn("score", F.round(F.log1p("count") * idf * T.term_base(F.col("term"), 2.5), 6))
    order = Window.partitionBy("domain", "doc_id").orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keywords)
    return ranked.select("domain", "doc_id", "term", "count", "score", "rank")


def card_facts(chunked: DataFrame, titled: DataFrame) -> DataFrame:
    """(doc_id, term, factor): the years that a document's title or text names, and its kinds."""
    every = chunked.select("doc_id", "text").unionByName(titled.select("doc_id", F.col("title").alias("text")))
    years = every.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(YEAR), F.lit(1))).alias("term")).distinct().withColumn("factor", F.lit(IN_YEARS))
    kinds = F.filter(F.array(*map(F.lit, TYPE_TERMS)), lambda t: F.contains(F.col("text"), t))
    typed = every.where(F.col("text").rlike("|".join(TYPE_TERMS))).select("doc_id", F.explode(kinds).alias("term")).distinct()
    return years.unionByName(typed.withColumn("factor", F.lit(IN_TYPES)))


def score_cards(query_terms: DataFrame, cards: DataFrame, titled: DataFrame, facts: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """(key, doc_id, score, rank): the best ``k`` documents of each query by keywords, title, years and kinds.

    Keywords, years and kinds are equi-joins on the term; a term that is a substring of a title is found by one scan of the titles. A
    title is its document's entity too."""
    sizes = cards.groupBy("domain", "doc_id").agg(F.count("*").alias("n"))
    base = T.term_base(F.col("term"))
    hits = query_terms.join(cards, "term").join(sizes, ["domain", "doc_id"])
    by_keyword = hits.select(key, "doc_id", (base * (1.0 + 2.0 * (F.col("n") - F.col("rank") + 1) / F.col("n"))).alias("s"))
    in_title = substring_counts(titled.select("doc_id", F.col("title").alias("text")), query_terms, "doc_id")
    by_title = query_terms.join(in_title, "term").select(key, "doc_id", (base * (IN_TITLE + IN_ENTITY)).alias("s"))
    by_fact = query_terms.join(facts, "term").select(key, "doc_id", (base * F.col("factor")).alias("s"))
    total = by_keyword.unionByName(by_title).unionByName(by_fact).groupBy(key, "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_at(ranked: DataFrame, gold: DataFrame, most: int, key: str = "item_id") -> DataFrame:
    """(k, complete, micro) for k up to ``most``: share of queries with all, and of pairs with, the wanted documents among the best k."""
    found = gold.join(ranked.select(key, "doc_id", "rank"), [key, "doc_id"], "left")
    per = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))
    by_query = per.groupBy("k", key).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"))
    return by_query.groupBy("k").agg(
        F.round(F.avg((F.col("h") == F.col("n")).cast("double")), 6).alias("complete"), F.round(F.sum("h") / F.sum("n"), 6).alias("micro")
    )


def routes(options: DataFrame, titled: DataFrame) -> DataFrame:
    """(item_id, option, decision, reason, doc_id): whether one of an option's documents is plainly meant by its text.

    options: item_id, option, option_text, doc_id (a row for each candidate document), answer_format."""
    matched = F.filter(T.latin_terms(F.col("option_text")), lambda t: F.contains(T.normalize(F.col("title")), t))
    sized = F.transform(matched, lambda t: F.least(F.length(t), F.lit(6)))
    scored = options.join(titled.select("doc_id", "title"), "doc_id", "left").select(
        "item_id", "option", "answer_format", "doc_id", "title",
        F.aggregate(sized, F.lit(0), lambda a, x: a + x).alias("score"),
        F.coalesce(F.array_max(F.transform(matched, F.length)), F.lit(0)).alias("longest"),
    )
    by = Window.partitionBy("item_id", "option")
    ranked = scored.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), F.desc("longest"), "doc_id")))
    one = ranked.groupBy("item_id", "option").agg(
        F.max("answer_format").alias("answer_format"), F.count("*").alias("n"), F.count_if(F.col("title").isNull()).alias("missing"),
        *(F.max(F.when(F.col("r") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("score", "longest", "doc_id")),
    )
    ratio = F.col("score1") / F.greatest(F.col("score2"), F.lit(1))
    reason = (
        F.when(F.col("answer_format") != "multi", "non_multi")
        .when(F.col("n") < 2, "fewer_than_two_documents")
        .when(F.col("missing") > 0, "missing_document_metadata")
        .when(F.col("longest1") < ROUTE_LONGEST, "longest_match_below_threshold")
        .when(F.col("score1") < ROUTE_SCORE, "title_score_below_threshold")
        .when(ratio < ROUTE_RATIO, "score_ratio_below_threshold")
        .when(F.col("score1") - F.col("score2") < ROUTE_MARGIN, "score_margin_below_threshold")
        .otherwise("high_confidence_unique_title_match")
    )
    decided = one.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "high_confidence_unique_title_match", "route").otherwise("fallback"))
    return decided.select("item_id", "option", "decision", "reason", F.when(F.col("decision") == "route", F.col("doc_id1")).alias("doc_id"))


def recall_by_domain(ranked: DataFrame, gold: DataFrame, most: int, key: str = "item_id") -> DataFrame:
    """(k, domain, complete, micro): recall overall (domain null) and by the domain of the wanted documents, in one rollup."""
    found = gold.join(ranked.select(key, "doc_id", "rank"), [key, "doc_id"], "left")
    per = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    by_query = per.groupBy("k", "domain", key).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))).alias("h"))
    return by_query.rollup("k", "domain").agg(
        F.round(F.avg((F.col("h") == F.col("n")).cast("double")), 6).alias("complete"), F.round(F.sum("h") / F.sum("n"), 6).alias("micro")
    ).where("k is not null")


def smallest_k(by_domain: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, k_overall, k_all_domains): the smallest k whose complete recall reaches the threshold, overall and in every domain."""
    own = by_domain.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    per = own.groupBy("threshold", "k").agg(
        F.max(F.when(F.col("domain").isNull(), F.col("complete") >= F.col("threshold"))).alias("overall"), F.bool_and(F.col("domain").isNull() | (F.col("complete") >= F.col("threshold"))).alias("each")
    )
    return per.groupBy("threshold").agg(F.min(F.when(F.col("overall"), F.col("k"))).alias("k_overall"), F.min(F.when(F.col("each"), F.col("k"))).alias("k_all_domains"))


def routed(scored: DataFrame, decisions: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, option, chunk_id, rank, routed): the best k of the target document, if it has k hits; else of all candidates.

    scored: (item_id, option, doc_id, chunk_id, score) by the full index; decisions: (item_id, option, doc_id)."""
    by, own = Window.partitionBy("item_id", "option"), Window.partitionBy("item_id", "option", "doc_id")
    ranked = scored.withColumn("all_rank", F.row_number().over(by.orderBy(F.desc("score"), "chunk_id"))).withColumn("own_rank", F.row_number().over(own.orderBy(F.desc("score"), "chunk_id")))
    ranked = ranked.withColumn("hits", F.count("*").over(own)).join(decisions.select("item_id", "option", F.col("doc_id").alias("target")), ["item_id", "option"], "left")
    ranked = ranked.withColumn("mine", F.coalesce((F.col("doc_id") == F.col("target")) & (F.col("hits") >= k), F.lit(False)))
    ranked = ranked.withColumn("routed", F.max("mine").over(by))
    rank = F.when(F.col("routed"), F.when(F.col("mine"), F.col("own_rank"))).otherwise(F.col("all_rank"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "option", "chunk_id", "rank", "routed")
