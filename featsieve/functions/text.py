"""Label text: white space of any kind stripped, case folded the same way on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: letters whose folded form is not their lower case
_FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s"}


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def folded(c: Column) -> Column:
    text = F.lower(c)
    for letter, form in _FOLDS.items():
        text = F.replace(text, F.lit(letter), F.lit(form))
    return text


def folded_text(text: str) -> str:
    """The Python side of ``folded(stripped(...))``."""
    text = text.strip().lower()
    for letter, form in _FOLDS.items():
        text = text.replace(letter, form)
    return text
