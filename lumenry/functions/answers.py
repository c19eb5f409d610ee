"""Answers, verdicts, fields and placeholders in texts, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that contradict a verdict, words of a verdict, marks of a placeholder, fields of a label card.
POSITIVE = ("支持", "为真", "正确", "成立", "符合")
NEGATIVE = ("不支持", "不正确", "为假", "错误", "否定", "矛盾", "不成立")
SUPPORT, REFUTE = "支持", "否定"
PLACEHOLDERS = ("dry-run 占位", "dry_run_mock", "mock 占位")
FIELDS = {"answer": "答案(?:（.*?）)?", "confidence": "置信度(?:（.*?）)?", "evidence": "决定性证据", "reason": "简短理由", "labeler": "标定人", "completed_at": "完成时间"}
ARTICLE = "第[一二三四五六七八九十百千]+[章节条款项]"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def consistent(verdict: Column, rationale: Column) -> Column:
    """False where a rationale's words contradict the verdict."""
    yes, no = _any(rationale, POSITIVE), _any(rationale, NEGATIVE)
    return ~(((verdict == "true") & no) | ((verdict == "false") & yes & ~no))


def word_judgment(text: Column) -> Column:
    """The verdict word that a reply contains; support goes first, anything else is insufficient."""
    return F.when(F.contains(text, F.lit(SUPPORT)), "support").when(F.contains(text, F.lit(REFUTE)), "refute").otherwise("insufficient")


def has_placeholder(value: Column) -> Column:
    """Whether a nested value, as JSON, holds a placeholder anywhere."""
    return _any(F.lower(value), PLACEHOLDERS)


def card_field(card: Column, name: str) -> Column:
    """A field of a label card in Markdown, stripped; empty if it isn't there."""
    return F.trim(F.regexp_extract(card, rf"(?m)^- {FIELDS[name]}[：:][ \t]*([^\r\n]*)$", 1))


def label_answer(value: Column) -> Column:
    """Separators removed, upper case, letters sorted and distinct."""
    bare = F.upper(F.regexp_replace(value, r"[\s,，、;；/|]+", ""))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(bare, ""), lambda c: c != ""))), "")


def letters(value: Column, many: Column) -> Column:
    """All letters A-D of a reply: sorted and distinct where many are allowed, else the first."""
    found = F.regexp_extract_all(value, F.lit("[A-D]"), F.lit(0))
    return F.when(many, F.array_join(F.array_sort(F.array_distinct(found)), "")).otherwise(F.coalesce(F.get(found, 0), F.lit("")))


def has_number(term: Column) -> Column:
    return term.rlike(rf"\d|{ARTICLE}")
