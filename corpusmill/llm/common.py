"""Column helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ASCII white space, the only word break of the word-based operators.
SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def space_words(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space."""
    for c in "\t\n\x0b\x0c\r":  # one literal blank splits faster than a class
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def doubles(values: list[float]) -> Column:
    """A folded array literal: one string in the plan, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
