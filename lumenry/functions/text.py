"""Text functions as Spark expressions: normalisation, term extraction, canonical answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width characters and their half-width forms.
FULL_WIDTH = "０１２３４５６７８９％（）：，。；"
HALF_WIDTH = "0123456789%():,.;"

# Numeric terms, in order of preference (years, percentages, amounts, numbers with units, articles).
NUMERIC = (
    r"(?:19|20)\d{2}(?:年度?)?"
    r"|\d+(?:\.\d+)?%"
    r"|\d+(?:\.\d+)?(?:亿元|万元|亿|万|元)"
    r"|\d+(?:\.\d+)?(?:个月|周岁|日|天|年|月|倍|次|期|号)"
    r"|第[一二三四五六七八九十百千0-9０-９]+[章节条款项]"
)
# Latin words and long numbers; runs of CJK characters.
ASCII = r"[a-zA-Z][a-zA-Z0-9.\-]+|\d{3,}"
CJK_RUN = "[一-鿿]+"

# CJK terms and characters that make no term.
STOP_TERMS = (
    "以下", "哪些", "哪个", "哪项", "说法", "正确", "错误", "关于", "根据", "属于",
    "包括", "或者", "以及", "并且", "对于", "其中", "无论", "均不", "可以", "不得",
    "应当", "如果", "但是", "所以", "因此", "这个", "那个", "什么", "怎样", "如何",
    "选项", "题目", "下列", "本题", "均为", "都是", "不是", "没有", "允许",
)
STOP_CHARACTERS = "的了在与和或及为是对于按之其此该等被把从向到由于至因而则若如"


def normalize(text: Column) -> Column:
    """Half width, lower case, runs of white space to one space, no space at the ends."""
    half = F.translate(text, FULL_WIDTH, HALF_WIDTH)
    return F.trim(F.regexp_replace(F.lower(half), r"(?U)\s+", " "))


def normalized(rows: DataFrame, text: str = "text") -> Column:
    """A table's normalised text: its column ``t`` where it has one."""
    return F.col("t") if "t" in rows.columns else normalize(F.col(text))


def numeric_terms(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({NUMERIC})"), F.lit(1))


def ascii_terms(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({ASCII})"), F.lit(1))


def is_numeric(term: Column) -> Column:
    return term.rlike(f"^(?:{NUMERIC})$")


def _grams(run: Column, n: int) -> Column:
    """All substrings of n characters, by start."""
    every = F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))
    return F.when(F.length(run) >= n, every).otherwise(F.array().cast("array<string>"))


def cjk_terms(normalized: Column) -> Column:
    """A run of 2 to 6 characters itself, then its 2- to 4-grams; stop terms and grams of stop characters don't count."""
    runs = F.regexp_extract_all(normalized, F.lit(f"({CJK_RUN})"), F.lit(1))

    def of_run(run):
        grams = F.concat(*(_grams(run, n) for n in (2, 3, 4)))
        kept = F.filter(grams, lambda g: ~g.isin(*STOP_TERMS) & (F.length(F.translate(g, STOP_CHARACTERS, "")) > 0))
        whole = F.when(F.length(run).between(2, 6) & ~run.isin(*STOP_TERMS), F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, kept)

    return F.flatten(F.transform(runs, of_run))


def terms(text: Column) -> Column:
    """Distinct terms of a text in the order of first occurrence: numbers, Latin words, CJK phrases and grams."""
    n = normalize(text)
    every = F.concat(numeric_terms(n), ascii_terms(n), cjk_terms(n))
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.trim(t)), lambda t: F.length(t) >= 2))


def latin_terms(text: Column) -> Column:
    """``terms`` for texts known to have no CJK character: the same list, without looking for any."""
    return latin_terms_of(normalize(text))


def latin_terms_of(normalized: Column) -> Column:
    """``latin_terms`` of a text that is normalised already."""
    return F.array_distinct(F.filter(F.concat(numeric_terms(normalized), ascii_terms(normalized)), lambda t: F.length(t) >= 2))


def term_base(term: Column, numeric_factor: float = 3.0) -> Column:
    return F.least(F.length(term), F.lit(6)) * F.when(is_numeric(term), numeric_factor).otherwise(1.0)


def canonical_answer(value: Column) -> Column:
    """Upper case; letters A-D sorted and distinct, other answers unchanged; null becomes empty."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    letters = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))), "")
    return F.when(text.rlike("^[ABCD]+$"), letters).otherwise(text)


def clean_line(line: Column) -> Column:
    """Private-use characters dropped, white space collapsed, blanks and hyphens stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "[-]", ""), r"\s+", " "), "^[ -]+|[ -]+$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
