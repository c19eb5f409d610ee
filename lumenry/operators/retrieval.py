"""Evidence retrieval: term weights, BM25 in token and substring form, selection, rendering.

Scores are rounded before ranks are taken, and ties go to the smaller chunk id, so results do not depend
on the order in which Spark adds up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import text as T

K1, B = 1.2, 0.4
TOP = 5
PER_DOC = 2
#: Distinct terms that are broadcast at once (some 100 bytes each in an automaton).
BROADCAST_TERMS = 200_000
ONE_MAX, ALL_MAX, EXTRA_MAX, FLOOR = 1400, 7000, 800, 200


def query_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, term, weight): distinct terms of an item's text with their base weights."""
    rows = items.select(key, F.explode(T.latin_terms(F.col("text"))).alias("term"))
    return rows.withColumn("weight", T.term_base(F.col("term")))


def option_weights(questions: DataFrame) -> DataFrame:
    """(item_id, option, term, weight) of questions with columns question, option, option_text, domain_terms.

    A term's weight is the largest over its sources (option 2, question 1, domain 0.3) and half as large again if
    option and question both have it."""
    sources = [("option_text", 2.0), ("question", 1.0)]
    parts = [
        questions.select("item_id", "option", F.explode(T.latin_terms(F.col(c))).alias("term"), F.lit(w).alias("s"), F.lit(c).alias("source")) for c, w in sources
    ]
    if "domain_terms" in questions.columns:
        parts.append(questions.select("item_id", "option", F.explode("domain_terms").alias("term"), F.lit(0.3).alias("s"), F.lit("domain").alias("source")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    both = F.count_if(F.col("source") == "option_text") * F.count_if(F.col("source") == "question") > 0
    return (
        every.groupBy("item_id", "option", "term")
        .agg(F.max("s").alias("s"), both.alias("both"))
        .select("item_id", "option", "term", F.round(F.col("s") * T.term_base(F.col("term")) * F.when(F.col("both"), 1.5).otherwise(1.0), 6).alias("weight"))
    )


def token_counts(chunked: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, size, term, tf) of the terms asked for, dealt by chunk, so that counts and scores of a chunk need no further exchange. The join drops other tokens before they are shuffled."""
    plain = chunked.select("chunk_id", T.normalized(chunked).alias("t"))
    tokens = plain.select("chunk_id", F.length("t").alias("size"), F.explode(T.ascii_terms(F.col("t"))).alias("term"))
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    return tokens.join(asked, "term", "left_semi").repartition("chunk_id").groupBy("chunk_id", "size", "term").agg(F.count("*").alias("tf"))


class Terms:
    """Terms as broadcast; a worker builds their automaton once."""

    def __init__(self, words: list[str]):
        self.words, self.automaton = words, None

    def counts(self, text: str) -> dict[int, int]:
        """Numbers of non-overlapping places of each term that occurs, in one pass over the text."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, w in enumerate(self.words):
                self.automaton.add_word(w, (k, len(w)))
            self.automaton.make_automaton()
        found: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, (k, n) in self.automaton.iter(text):
            if end - n + 1 >= free.get(k, 0):
                free[k] = end + 1
                found[k] = found.get(k, 0) + 1
        return found


def substring_counts(texts: DataFrame, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, term, tf) with tf the number of non-overlapping places where the term is a substring of the normalised ``text``.

    Every text is scanned once by an automaton of the terms, in Arrow batches; only hits leave a task. Terms are broadcast, in parts of
    BROADCAST_TERMS, one scan each."""
    spark = texts.sparkSession
    kind = texts.select(key).schema[0].dataType.simpleString()
    own = texts.select(key, T.normalized(texts).alias("t")).where("t is not null")
    asked = terms.select("term").distinct()
    parts = max(1, -(-asked.count() // BROADCAST_TERMS))

    def scan(words: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Terms(words))

        def run(batches):
            for batch in batches:
                rows = [(i, k, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, n in shared.value.counts(t).items()]
                names = shared.value.words
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], batch.schema[0].type), pa.array([names[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=[key, "term", "tf"]
                )

        return own.mapInArrow(run, f"{key} {kind}, term string, tf bigint")

    found = None
    for p in range(parts):
        words = [r[0] for r in asked.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect()]
        if words:
            found = scan(words) if found is None else found.unionByName(scan(words))
    return own.select(key, F.lit("").alias("term"), F.lit(0).cast("bigint").alias("tf")).limit(0) if found is None else found


def bm25(counts: DataFrame, weights: DataFrame, stats: DataFrame, query: list[str]) -> DataFrame:
    """Scores of (query, chunk) over the whole corpus. counts: (chunk_id, size, term, tf), dealt by chunk, used twice by way of one exchange; weights: (query, term, weight); stats: one row (n, mean)."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))  # a chunk has a term once
    asked = weights.join(df, "term")
    asked = F.broadcast(asked) if weights.count() <= BROADCAST_TERMS else asked
    rows = counts.crossJoin(F.broadcast(stats)).join(asked, "term")  # stats is one row
    return rows.groupBy("chunk_id", *query).agg(F.round(F.sum(F.col("weight") * score_part(F.lit(1.0))), 4).alias("score"), F.count("*").alias("n_matched")).select(*query, "chunk_id", "score", "n_matched")


def score_part(weight: Column) -> Column:
    """A term's part of the score, from columns n, mean, df, tf, size."""
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))


def candidate_chunks(chunked: DataFrame, places: DataFrame) -> DataFrame:
    """Chunks of each item's candidate documents (item_id, doc_id), with t, size, and the item's n and mean size. Sizes are summed up by item without the texts."""
    sized = chunked.withColumn("t", T.normalized(chunked)).withColumn("size", F.length("t"))
    return sized.join(places.join(item_sizes(chunked, places), "item_id"), "doc_id")


def item_sizes(chunked: DataFrame, places: DataFrame) -> DataFrame:
    """(item_id, n, mean): number and mean size of each item's candidate chunks."""
    size = F.col("size") if "size" in chunked.columns else F.length(T.normalized(chunked))
    return chunked.select("doc_id", size.alias("size")).join(places, "doc_id").groupBy("item_id").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def _counted(own: DataFrame, keep: list[str]) -> DataFrame:
    """Hits of a row's ``terms`` (structs with the term) in its t, counted inside the row, so that only hits leave it."""
    tf = lambda t: ((F.length("t") - F.length(F.replace(F.col("t"), t, F.lit("")))) / F.length(t)).cast("bigint")
    counted = F.filter(F.transform("terms", lambda t: F.struct(t.alias("of"), tf(t["term"]).alias("tf"))), lambda x: x["tf"] > 0)
    return own.select(*keep, F.explode(counted).alias("x")).select(*keep, "x.of.*", "x.tf")


def _listed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("item_id").agg(F.collect_list(F.struct(*(c for c in terms.columns if c != "item_id"))).alias("terms"))


def term_hits(own: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidate chunks' hits of their item's distinct terms as substrings, with tf and the item's df."""
    keep = [c for c in own.columns if c not in ("t", "text")]
    hits = _counted(own.join(_listed(terms.select("item_id", "term").distinct()), "item_id"), keep)
    return hits.withColumn("df", F.count("*").over(Window.partitionBy("item_id", "term")))


def candidate_hits(chunked: DataFrame, places: DataFrame, terms: DataFrame) -> DataFrame:
    """``term_hits`` in the chunks of each item's candidate documents: (item_id, domain, doc_id, chunk_id, size, n, mean, tf, df) and the columns of ``terms``, a row an item and term.

    Terms go to the documents, so a text moves once for all its items; hits are dealt by item, and what is grouped by item after that needs no exchange."""
    asked = places.join(item_sizes(chunked, places), "item_id").join(_listed(terms), "item_id")
    own = chunked.withColumn("t", T.normalized(chunked)).withColumn("size", F.length("t")).join(asked, "doc_id")
    hits = _counted(own, ["item_id", "domain", "doc_id", "chunk_id", "size", "n", "mean"]).repartition("item_id")
    return hits.withColumn("df", F.count("*").over(Window.partitionBy("item_id", "term")))


def top(scored: DataFrame, query: list[str], k: int | Column = TOP) -> DataFrame:
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quota(scored: DataFrame, query: list[str], k: int = TOP, per_doc: int = PER_DOC) -> DataFrame:
    """The best k, and what fills every document to ``per_doc``; ``is_extra`` tells the latter."""
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "chunk_id")
    own = Window.partitionBy(*query, "doc_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("doc_rank", F.row_number().over(own))
    return ranked.where((F.col("rank") <= k) | (F.col("doc_rank") <= per_doc)).withColumn("is_extra", F.col("rank") > k)


def budget(selected: DataFrame, query: list[str]) -> DataFrame:
    """``max_chars``: the query's budget shared by its evidence, less for extras, never under the floor."""
    share = F.floor(F.lit(ALL_MAX) / F.count("*").over(Window.partitionBy(*query)))
    one = F.least(F.lit(ONE_MAX), share)
    return selected.withColumn("max_chars", F.greatest(F.lit(FLOOR), F.when(F.col("is_extra"), F.least(one, F.lit(EXTRA_MAX))).otherwise(one)).cast("bigint"))


def with_neighbors(chunked: DataFrame) -> DataFrame:
    """Each chunk with the text of itself, the one before and the one after of its document, in this order."""
    order = Window.partitionBy("domain", "doc_id").orderBy("k")
    before, after = F.lag("text").over(order), F.lead("text").over(order)
    ids = F.concat_ws(",", "chunk_id", F.lag("chunk_id").over(order), F.lead("chunk_id").over(order))
    return chunked.withColumn("merged", F.concat_ws("\n", "text", before, after)).withColumn("merged_ids", ids)


def cut_around(text: Column, terms: Column, width: Column) -> Column:
    """A text over ``width`` cut to a window that begins a third of the width before the earliest term found."""
    n = T.normalize(text)
    found = F.filter(F.transform(terms, lambda t: F.instr(n, t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(found), F.lit(1)) - F.floor(width / 3), F.lit(1)).cast("int")
    return F.when(F.length(text) <= width, text).otherwise(text.substr(start, width.cast("int")))


def in_order(selected: DataFrame, query: list[str]) -> DataFrame:
    """The selected chunks' texts joined in the order of the document; (query, text, n)."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "text")))
    return selected.groupBy(*query).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n...\n").alias("evidence"), F.count("*").alias("n"))


def option_best(options: DataFrame, own: DataFrame) -> DataFrame:
    """(item_id, option, best, n_chunks): the best score of an option's text alone, 0 without a hit; low ones tell options without evidence.

    options: (item_id, option, option_text); own: candidate chunks with t. Document frequencies are those inside each document, a chunk's length doesn't count, and neither does the question."""
    terms = option_terms(options)
    hits = term_hits(own.select("item_id", "doc_id", "chunk_id", "t"), terms).drop("df").join(by_term(terms), ["item_id", "term"])
    return option_best_of(options, hits, own.groupBy("item_id", "doc_id").agg(F.count("*").alias("n")))


def option_terms(options: DataFrame) -> DataFrame:
    """(item_id, option, term, weight) of the options' texts alone."""
    plain = options.select("item_id", "option", T.normalize(F.col("option_text")).alias("t"))
    return plain.select("item_id", "option", F.explode(T.latin_terms_of(F.col("t"))).alias("term")).withColumn("weight", T.term_base(F.col("term")))


def by_term(weights: DataFrame) -> DataFrame:
    """(item_id, term, options): options that have a term, with their weights."""
    return weights.groupBy("item_id", "term").agg(F.collect_list(F.struct("option", "weight")).alias("options"))


def option_best_of(options: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``option_best`` from hits with the options of their terms, and (item_id, doc_id, n): numbers of a document's chunks."""
    counted = hits.withColumn("df", F.count("*").over(Window.partitionBy("item_id", "doc_id", "term")))
    rows = counted.drop("n").join(sizes, ["item_id", "doc_id"]).select("*", F.explode("options").alias("o")).select("item_id", "o.option", "chunk_id", "o.weight", "tf", "n", "df")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1)
    scored = rows.groupBy("item_id", "option", "chunk_id").agg(F.round(F.sum(part), 4).alias("score"))
    best = scored.groupBy("item_id", "option").agg(F.max("score").alias("best"), F.count("*").alias("n_chunks"))
    return options.select("item_id", "option").join(best, ["item_id", "option"], "left").fillna(0, ["best", "n_chunks"])


def option_evidence(scored: DataFrame, many: Column, k: int = TOP, per_doc: int = PER_DOC) -> DataFrame:
    """Every option's evidence from (item_id, option, doc_id, chunk_id, score): the best k, and where ``many`` holds what fills each document to ``per_doc``; with its budget of characters."""
    picked = quota(scored, ["item_id", "option"], k, per_doc).where(many | ~F.col("is_extra"))
    return budget(picked, ["item_id", "option"])
