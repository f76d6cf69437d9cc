"""Projections of results for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(score: Column, real_rows: Column) -> Column:
    return score / F.greatest(real_rows, F.lit(1))


def match_fraction(score: Column, real_rows: Column) -> Column:
    return F.least(F.greatest(normalized(score, real_rows), F.lit(0.0)), F.lit(1.0))


def match_percent(score: Column, real_rows: Column) -> Column:
    """Rounded half away from zero."""
    return F.round(match_fraction(score, real_rows) * 100).cast("long")


def score_percentage(score: Column) -> Column:
    """Cut towards zero."""
    return (score * 100).cast("long")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "green").when(score >= 0.4, "orange").otherwise("gray")


def preview(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("...")))


def display_name(name: Column, chunk_index: Column) -> Column:
    return F.when(chunk_index > 0, F.concat(name, F.lit(" (chunk "), (chunk_index + 1).cast("string"), F.lit(")"))).otherwise(name)
