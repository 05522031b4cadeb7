"""Filter conditions written as text, and regions, as columns."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"<=": operator.le, ">=": operator.ge, "==": operator.eq, "<": operator.lt, ">": operator.gt, "": operator.ge}


def comparison(column: str, condition: str, whole: bool = False) -> Column:
    """``"10"`` (at least), ``"<=0.5"``, ``"==3"``, ``">0"`` and so on, about one column."""
    number = r"\d+" if whole else r"\d+\.?\d*"
    found = re.fullmatch(rf"\s*(<=|>=|==|<|>|)\s*({number})\s*", condition)
    if not found:
        raise ValueError(f"not a condition: {condition!r}")
    return _COMPARE[found[1]](F.col(column), int(found[2]) if whole else float(found[2]))


def sites(condition: str) -> Column:
    """One site, a list ``x,y,z`` or an inclusive range ``x-y``; a range without sites filters nothing."""
    if found := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", condition):
        low, high = int(found[1]), int(found[2])
        return F.col("site").between(low, high) if low <= high else F.lit(True)
    return F.col("site").isin(*(int(x) for x in condition.split(",")))


def bases(condition: str) -> Column:
    wanted = condition.split(",")
    if not set(wanted) <= set("ACGUN"):
        raise ValueError(f"not bases: {condition!r}")
    return F.col("ref_base").isin(*wanted)


def mismatch_types(condition: str, all_of: bool = False) -> Column:
    """``R-M[,R-M]``: any of the pairs of reference and majority base (all of them, with ``all_of``)."""
    pairs = [p.strip().split("-", 1) for p in condition.split(",")]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"not mismatch types: {condition!r}")
    tests = [(F.col("ref_base") == r) & (F.col("majority_base") == m) for r, m in pairs]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if all_of else out | t
    return out


def region(text: str, lengths: dict[str, int]) -> Column:
    """``chr`` or ``chr:start-end`` (commas dropped), within a reference whose lengths are known."""
    name, _, span = text.partition(":")
    if name not in lengths:
        raise ValueError(f"unknown chromosome: {name!r}")
    if not span:
        return F.col("chr") == name
    found = re.fullmatch(r"(\d+)-(\d+)", span.replace(",", ""))
    if not found or not 1 <= int(found[1]) < int(found[2]) <= lengths[name]:
        raise ValueError(f"not a region of {name!r}: {span!r}")
    return (F.col("chr") == name) & F.col("site").between(int(found[1]), int(found[2]))


def share(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError(f"not between 0 and 1: {value}")
    return value


def not_negative(value: float) -> float:
    if value < 0:
        raise ValueError(f"negative: {value}")
    return value
