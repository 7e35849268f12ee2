"""Words as the problems count them: runs of letters and digits, case ignored, i ı I İ one letter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
CITATION = r"\[[^\[\]]*\]"


def fold(text: str) -> str:
    """Lower case with one letter i; offsets stay as they are."""
    return text.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(fold(text)) if text else []


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, "İIı", "iii"))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")
