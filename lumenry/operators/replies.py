"""Model replies: the first JSON object of a text, and the judgments read from it.

An object's end is found for all braces of a text at once. Quotes that no odd run of backslashes escapes divide a text into stretches; seen from a brace, what
lies in a stretch of the same parity is structure, the rest is inside of strings. Within a parity, the running sum of braces is a depth, and an opening brace ends at
the next brace of its depth: a window, no walk. Of the stretches that end, the first one that is an object by the grammar counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenry.functions import answers as words
from lumenry.operators.parsing import JUDGMENTS

VERDICTS = ("true", "false", "uncertain")
RATIONALE, FAILED_RATIONALE, TF_RATIONALE, CLAIM = 200, 100, 300, 200
#: A run of other characters with the quote, brace or backslashes that end it.
_TOKEN = r'[^"{}\\]*(?:\\*"|[{}]|\\+)'
_STRING = r'"(?:[^"\\\x00-\x1f]|\\.)*+"'
_NOT_JSON = r"""['"\x00-\x08\x0b\x0c\x0e-\x1f]"""


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def unfenced(text: Column) -> Column:
    """A reply without blanks around it and without the marks of a code block."""
    return F.regexp_replace(_strip(text), r"\A```(?:json)?\s*|\s*```\z", "")


def _clean(text: Column) -> Column:
    """Whether strings have double quotes and no control characters, which Spark's parser doesn't ask for."""
    return ~F.regexp_replace(text, _STRING, "").rlike(_NOT_JSON)


def is_object(text: Column) -> Column:
    """Whether a text from { to its matching } is a JSON object."""
    return F.json_object_keys(text).isNotNull() & _clean(text)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value: as a member of an object it is followed by the next key, which no text knows."""
    key = F.md5(text)
    whole = F.concat(F.lit('{"v":'), text, F.lit(',"'), key, F.lit('":0}'))
    return F.coalesce((F.json_object_keys(whole) == F.array(F.lit("v"), key)) & _clean(whole), F.lit(False))


def blocks(texts: DataFrame, key: str = "k", text: str = "t") -> DataFrame:
    """(key, start, stop) of every opening brace that has a matching one; places are characters from 1. Keys are unique."""
    token = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("i", "token"))
    order = Window.partitionBy(key).orderBy("i")
    quote = F.col("token").rlike(r'(?<!\\)(?:\\\\)*"\z').cast("int")
    step = F.when(F.endswith("token", F.lit("{")), 1).when(F.endswith("token", F.lit("}")), -1).otherwise(0)
    at = token.select(key, "i", step.alias("step"), F.sum(F.length("token")).over(order).alias("at"), (F.sum(quote).over(order) % 2).alias("parity"))
    own = Window.partitionBy(key, "parity").orderBy("i")
    depth = F.sum("step").over(own) + F.when(F.col("step") < 0, 1).otherwise(0)
    braces = at.where("step <> 0").withColumn("depth", depth)
    level = Window.partitionBy(key, "parity", "depth").orderBy("i")
    ends = braces.withColumn("stop", F.lead("at").over(level))
    return ends.where("step > 0 and stop is not null").select(key, F.col("at").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def with_object(replies: DataFrame, text: str, name: str = "json") -> DataFrame:
    """The replies with ``name``: a whole JSON text if it is an object (null if it is another value), else the first object in the text, else null.

    Equal texts are looked at once."""
    own = replies.withColumn("_k", F.sha2(text, 256))
    once = own.select(F.col("_k").alias("k"), unfenced(F.col(text)).alias("t")).where("t is not null").dropDuplicates(["k"])
    whole = F.when(is_json(F.col("t")), F.when(F.startswith("t", F.lit("{")), F.col("t")).otherwise(F.lit("")))
    told = once.select("k", "t", whole.alias("whole"))
    found = blocks(told.where("whole is null and contains(t, '{')")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("blocks"))
    part = lambda b: F.substring(F.col("t"), b["start"], b["stop"] - b["start"] + 1)
    first = F.aggregate("blocks", F.lit(None).cast("string"), lambda got, b: F.when(got.isNull(), F.when(is_object(part(b)), part(b))).otherwise(got))
    done = told.join(found, "k", "left").select(F.col("k").alias("_k"), F.when(F.col("whole").isNull(), first).when(F.col("whole") != "", F.col("whole")).alias(name))
    return own.join(done, "_k", "left").drop("_k")


def _refs(values: Column) -> Column:
    """Numbers of a list of references: whole ones, or texts of digits."""
    digits = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda r: r.rlike(r"\A[0-9]+\z"))
    return F.filter(F.transform(digits, lambda r: r.try_cast("bigint")), lambda r: r.isNotNull())


def judgment(json: Column) -> Column:
    """A struct (judgment, rationale, refs, error) of an option's judgment. ``error`` is the first of not_json, judgment, or null."""
    got = F.from_json(json, "judgment string, rationale string, evidence_refs array<string>")
    said = F.lower(_strip(F.coalesce(got["judgment"], F.lit(""))))
    fails = F.when(json.isNull(), "not_json").when(~said.isin(*JUDGMENTS), "judgment")
    why = F.coalesce(got["rationale"], F.lit(""))
    none = F.array().cast("array<bigint>")
    return F.struct(
        F.when(fails.isNull(), said).otherwise("error").alias("judgment"),
        F.when(fails.isNull(), F.substring(why, 1, RATIONALE)).otherwise(F.substring(why, 1, FAILED_RATIONALE)).alias("rationale"),
        F.when(fails.isNull(), _refs(got["evidence_refs"])).otherwise(none).alias("refs"),
        fails.alias("error"),
    )


def true_or_false(json: Column) -> Column:
    """A struct (verdict, checks, rationale, error) of a statement's judgment with its fact checks; ``error`` is the first of not_json, verdict,
    inconsistent (the rationale contradicts the verdict), or null. Checks that are no objects are left out."""
    got = F.from_json(json, "verdict string, rationale string, fact_checks array<string>")
    said = F.lower(_strip(F.coalesce(got["verdict"], F.lit(""))))
    listed = F.filter(F.coalesce(got["fact_checks"], F.array().cast("array<string>")), is_object)
    parsed = F.transform(listed, lambda c: F.from_json(c, "claim string, verdict string, evidence_refs array<string>"))
    checks = F.transform(
        parsed,
        lambda c: F.struct(
            F.substring(F.coalesce(c["claim"], F.lit("")), 1, CLAIM).alias("claim"), F.lower(_strip(F.coalesce(c["verdict"], F.lit("")))).alias("verdict"), _refs(c["evidence_refs"]).alias("refs")
        ),
    )
    why = F.coalesce(got["rationale"], F.lit(""))
    bad = ~said.isin(*VERDICTS)
    fails = F.when(json.isNull(), "not_json").when(bad, "verdict").when(~words.consistent(said, F.substring(why, 1, TF_RATIONALE)), "inconsistent")
    return F.struct(
        F.when(fails.isNull(), said).otherwise("error").alias("verdict"),
        F.when(json.isNull(), F.array().cast("array<struct<claim:string,verdict:string,refs:array<bigint>>>")).otherwise(checks).alias("checks"),
        F.substring(why, 1, F.when(bad, RATIONALE).otherwise(TF_RATIONALE)).alias("rationale"),
        fails.alias("error"),
    )


def strict(reply: Column, option: Column) -> Column:
    """A struct (judgment, rationale, error) of a reply that has to be one object of exactly the keys option, judgment and rationale. ``error`` is the first of
    not_json, not_an_object, keys, option (another identity), judgment, rationale (types), or null."""
    whole = _strip(reply)
    got = F.from_json(whole, "option variant, judgment variant, rationale variant")
    keys = F.array_sort(F.array_distinct(F.json_object_keys(whole)))
    text = lambda c: F.when(F.schema_of_variant(got[c]) == "STRING", F.try_variant_get(got[c], "$", "string"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    error = (
        F.when(~F.coalesce(is_json(whole), F.lit(False)), "not_json")
        .when(~F.startswith(whole, F.lit("{")), "not_an_object")
        .when(~same(keys, F.array(*map(F.lit, ("judgment", "option", "rationale")))), "keys")
        .when(~same(text("option"), option), "option")
        .when(~F.coalesce(text("judgment").isin(*JUDGMENTS), F.lit(False)), "judgment")
        .when(text("rationale").isNull(), "rationale")
    )
    return F.struct(
        F.when(error.isNull(), text("judgment")).otherwise("error").alias("judgment"), F.when(error.isNull(), text("rationale")).otherwise("").alias("rationale"), error.alias("error")
    )


def loop_reply(json: Column, raw: Column, many: Column) -> Column:
    """A struct (answer, missing) of a reply that answers and names what it lacks; a reply without an object gives its letters and lacks nothing."""
    got = F.from_json(json, "answer string, missing array<string>")
    missing = F.filter(F.coalesce(got["missing"], F.array().cast("array<string>")), lambda m: F.trim(m) != "")
    said = F.when(json.isNull(), raw).otherwise(F.coalesce(got["answer"], F.lit("")))
    return F.struct(words.letters(said, many).alias("answer"), missing.alias("missing"))
