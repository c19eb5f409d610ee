"""Scores, accuracies, splits, paired comparison, recall, failure layers, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_BUDGET = 5_000_000
LAYERS = ("data_or_question", "parsing", "retrieval", "evidence_organization", "reasoning_or_prompt", "answer_synthesis", "no_failure")


def token_factor(tokens: Column) -> Column:
    return 0.7 + 0.3 * F.greatest(F.lit(0.0), (TOKEN_BUDGET - tokens) / TOKEN_BUDGET)


def competition_score(accuracy: Column, tokens: Column) -> Column:
    share = F.when(tokens <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (TOKEN_BUDGET - tokens) / TOKEN_BUDGET)))
    return 100 * accuracy * (0.7 + 0.3 * share)


def accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy in all and by each of the columns, in one grouping-sets aggregation. A missing prediction is wrong."""
    right = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    return answers.groupingSets([[], *([b] for b in by)], *by).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.round(F.avg(right.cast("double")), 6).alias("accuracy")).select(*by, "n", "right", "accuracy")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.4) -> DataFrame:
    """``part``: holdout for the share of each stratum that comes first by the md5 of the key. Deterministic, no seed state."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    n = F.count("*").over(Window.partitionBy(stratum))
    return rows.withColumn("part", F.when(F.row_number().over(order) <= F.floor(n * share + 0.5), "holdout").otherwise("train"))


def paired(rows: DataFrame) -> DataFrame:
    """Counts of questions that before or after alone, both or none get right, from (gold, before, after)."""
    b, a = F.coalesce(F.col("before") == F.col("gold"), F.lit(False)), F.coalesce(F.col("after") == F.col("gold"), F.lit(False))
    return rows.agg(
        F.count_if(a & ~b).alias("n_gained"), F.count_if(b & ~a).alias("n_lost"), F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("churn"),
    )


def halves(rows: DataFrame, score: str, key: str, parts: int = 2) -> DataFrame:
    """(part, n, accuracy) of equal parts by score, lowest first; the last part has the remainder."""
    r = F.row_number().over(Window.orderBy(score, key)) - 1
    n = F.count("*").over(Window.partitionBy())
    part = F.least(F.floor(r / F.greatest(F.floor(n / parts), F.lit(1))), F.lit(parts - 1))
    return rows.withColumn("part", part.cast("bigint")).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))


def scored_parts(rows: DataFrame, score: str, parts: int) -> DataFrame:
    """``halves`` without a global sort: equal scores are counted first, and a running count over the few distinct
    (rounded) scores places them. Rows of a score on a boundary are shared out in proportion to their accuracy."""
    counted = rows.groupBy(F.round(score, 2).alias("s")).agg(F.count("*").alias("n"), F.sum("correct").alias("right"))
    running = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy())
    placed = counted.withColumn("first", F.coalesce(F.sum("n").over(running), F.lit(0))).withColumn("size", F.floor(total / parts))
    every = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low = F.col("part") * F.col("size")
    high = F.when(F.col("part") == parts - 1, F.lit(2**62)).otherwise(low + F.col("size"))
    share = F.greatest(F.least(F.col("first") + F.col("n"), high) - F.greatest(F.col("first"), low), F.lit(0))
    kept = every.withColumn("m", share).where("m > 0")
    return kept.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.sum("m").cast("bigint").alias("n"), F.round(F.sum(F.col("right") * F.col("m") / F.col("n")) / F.sum("m"), 6).alias("accuracy"))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, precision) of predicting where the score reaches the threshold. One pass: rows explode to the thresholds they
    reach, and partial aggregation keeps the exchange at a row a threshold and task."""
    reached = rows.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))))
    return reached.groupBy("threshold").agg(F.count_if("truth").alias("tp"), F.count_if(~F.col("truth")).alias("fp"), F.round(F.avg(F.col("truth").cast("double")), 6).alias("precision"))


def recall_change(required: DataFrame, control: DataFrame, treatment: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, n_control, n_treatment, gained, lost) of required chunks found by either arm."""
    found = required.join(control.select(*key, "chunk_id").distinct().withColumn("c", F.lit(True)), [*key, "chunk_id"], "left").join(
        treatment.select(*key, "chunk_id").distinct().withColumn("t", F.lit(True)), [*key, "chunk_id"], "left"
    )
    c, t = F.col("c").isNotNull(), F.col("t").isNotNull()
    return found.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(c).alias("n_control"), F.count_if(t).alias("n_treatment"), F.count_if(t & ~c).alias("gained"), F.count_if(c & ~t).alias("lost"))


def failure_layer(case: DataFrame) -> DataFrame:
    """``layer`` and ``risk_flags`` of cases (in_source, in_chunks, in_retrieval, in_rendering: nullable booleans; gold, oracle,
    reasoning, final: answers). Incomplete cases have no layer."""
    complete = F.lit(True)
    for c in ("in_source", "in_chunks", "in_retrieval", "in_rendering"):
        complete = complete & F.col(c).isNotNull()
    for c in ("gold", "oracle", "reasoning", "final"):
        complete = complete & (F.coalesce(c, F.lit("")) != "")
    layer = (
        F.when(~F.col("in_source"), "data_or_question")
        .when(~F.col("in_chunks"), "parsing")
        .when(F.col("oracle") != F.col("gold"), "reasoning_or_prompt")
        .when(F.col("final") == F.col("gold"), "no_failure")
        .when(~F.col("in_retrieval"), "retrieval")
        .when(~F.col("in_rendering"), "evidence_organization")
        .when(F.col("reasoning") != F.col("gold"), "reasoning_or_prompt")
        .otherwise("answer_synthesis")
    )
    flags = F.concat_ws(
        ",", F.when(~F.col("in_retrieval"), "retrieval"), F.when(~F.col("in_rendering"), "evidence_organization"), F.when(F.col("oracle") != F.col("gold"), "reasoning_or_prompt")
    )
    return case.withColumn("layer", F.when(complete, layer)).withColumn("risk_flags", F.when(complete, flags))


def layer_counts(classified: DataFrame) -> DataFrame:
    """(layer, n) for every layer, zero where none. The grouped side has a row a layer at most."""
    every = classified.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return every.join(classified.groupBy("layer").agg(F.count("*").alias("n")), "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))


def by_parts(scored: DataFrame, score: str, key: str, parts: int, names: tuple[str, ...], column: str) -> DataFrame:
    """(column, n, accuracy) of equal parts by rank of (score, key), the last with the remainder.

    Only the borders are looked for: distinct scores are counted, their running counts give the score that holds a border, and ties at
    a border are ranked by key."""
    counts = scored.groupBy(score).agg(F.count("*").alias("n"))
    total = scored.count()
    size = total // parts
    # running counts over ranges of scores: a first pass counts ranges, a second one the scores of the ranges that hold a border
    edges = [size * (i + 1) for i in range(parts - 1)]
    low, high = counts.agg(F.min(score), F.max(score)).first() if total else (0, 1)
    width = (float(high) - float(low)) / 1024 or 1.0
    ranged = counts.withColumn("r", F.floor((F.col(score) - F.lit(float(low))) / width))
    sums = {r["r"]: r["n"] for r in ranged.groupBy("r").agg(F.sum("n").alias("n")).collect()}  # 1,025 rows at most
    part = F.lit(0)
    for edge in edges:
        before = 0
        for r in sorted(sums):
            if before + sums[r] >= edge:
                break
            before += sums[r]
        if not edge:
            continue
        inside = scored.where(F.floor((F.col(score) - F.lit(float(low))) / width) == r)
        cut = inside.orderBy(score, key).limit(edge - before).agg(F.max(F.struct(score, key)).alias("x")).first()["x"]
        part = part + F.when((F.col(score) > cut[0]) | ((F.col(score) == cut[0]) & (F.col(key) > cut[1])), 1).otherwise(0)
    label = F.element_at(F.array(*map(F.lit, names)), part + 1)
    return scored.groupBy(label.alias(column)).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, upper_median): the middle value, the upper one of two, from counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("until", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), F.min(F.when(F.col("until") > F.floor(F.col("n") / 2), F.col(value))).alias("upper_median"))


def alternative_probability(replies: DataFrame, letter: str = "letter", least: float = 0.01) -> DataFrame:
    """The replies with ``best`` and ``appeared``: the largest probability that any candidate at any place of the reply has which contains the letter, and whether it is over ``least``.

    replies have ``places``: array<struct<candidates: array<struct<token: string, logprob: double>>>>. A reply without places, and a letter that no candidate has, give 0."""
    each = F.flatten(F.transform("places", lambda p: F.coalesce(p["candidates"], F.array().cast("array<struct<token:string,logprob:double>>"))))
    own = F.transform(F.filter(each, lambda c: F.contains(c["token"], F.col(letter))), lambda c: F.exp(c["logprob"]))
    best = F.coalesce(F.array_max(own), F.lit(0.0))
    return replies.withColumn("best", best).withColumn("appeared", best > least)
