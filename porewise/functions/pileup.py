"""Columns computed from a pileup row: base counts, rates, majority, quality."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BASES


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def without_starts(bases: Column) -> Column:
    """Lowered, and without read starts and the mapping quality that follows each."""
    return F.regexp_replace(F.lower(bases), r"(?s)\^.", "")


def _indel_pattern() -> str:
    """A mark with its number n, up to 99, and at most n characters before the next mark."""
    text = lambda n: "(?![0-9])(?s:(?![+-][0-9]).){0,%d}" % n
    first = (f"{d}(?:{text(d)}|{'|'.join(f'{e}{text(10 * d + e)}' for e in range(10))})" for d in range(1, 10))
    return f"[+-](?:{'|'.join(first)})"


INDELS = _indel_pattern()


def without_indels(x: Column) -> Column:
    """Without every ``+n`` or ``-n`` and the n characters after it."""
    digits = lambda c: F.regexp_extract(c, r"^[+-]([0-9]+)", 1)
    tail = lambda c: F.substring(c, F.length(digits(c)) + digits(c).cast("int") + 2, F.length(c))
    cut = lambda c: F.when(c.rlike(r"^[+-][0-9]+"), tail(c)).otherwise(c)
    # any number is read mark by mark; one pattern does for the usual ones of one or two digits
    any_number = F.array_join(F.transform(F.split(x, r"(?=[+-][0-9])"), cut), "")
    return F.when(x.rlike("[+-](?:0|[0-9]{3})"), any_number).otherwise(F.regexp_replace(x, INDELS, ""))


def to_rna(base: Column) -> Column:
    return F.translate(base, "T", "U")


def base_counts(x: Column, core: Column, ref_base: Column) -> dict[str, Column]:
    """Counts by letter; the reference base's count is that of the match marks."""
    match = occurrences(core, ".") + occurrences(core, ",")
    letters = {f"n_{b.lower()}": F.when(ref_base == b, match).otherwise(occurrences(core, "t" if b == "U" else b.lower())) for b in BASES}
    return letters | {
        "n_del": occurrences(x, "*"),
        "n_ins": F.regexp_count(x, F.lit(r"\+[0-9]+[acgtn]+")),
        "n_ref_skip": occurrences(core, "<") + occurrences(core, ">"),
    }


def rate(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count.cast("double"), total), F.lit(0.0))


def gapless_reads() -> Column:
    return F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_u")


def mismatch_rate(total: Column) -> Column:
    """Sum of the rates of the bases that differ from the reference, in the order A, C, G, U."""
    terms = [F.when(F.col("ref_base") == b, 0.0).otherwise(rate(F.col(f"n_{b.lower()}"), total)) for b in BASES]
    return reduce(add, terms, F.lit(0.0))


def majority_base() -> Column:
    counts = F.array("n_a", "n_c", "n_g", "n_u", "n_del")
    return F.element_at(F.array(*map(F.lit, (*BASES, "-"))), F.array_position(counts, F.array_max(counts)).cast("int"))


def rate_columns() -> dict[str, Column]:
    """All rates and the majority base of rows that have the counts, ``n_reads`` and ``ref_base``."""
    n = F.col("n_reads")
    plain = {f"{b.lower()}_rate": rate(F.col(f"n_{b.lower()}"), n) for b in BASES}
    return plain | {
        "deletion_rate": rate(F.col("n_del"), n),
        "insertion_rate": rate(F.col("n_ins"), n),
        "refskip_rate": rate(F.col("n_ref_skip"), n),
        "mismatch_rate": mismatch_rate(n),
        "mismatch_rate_alt": mismatch_rate(gapless_reads()),
        "majority_base": majority_base(),
    }


def kept_scores(core: Column, qualities: Column, newline_counts: bool = False) -> Column:
    """The phred scores as an array, without those at the places of reference skips.

    Places are counted with deletion marks removed and read-end marks kept. ``newline_counts``
    adds the line's end as one more score.
    """
    text = F.concat(F.coalesce(qualities, F.lit("")), F.lit("\n" if newline_counts else ""))
    marks = F.replace(core, F.lit("*"), F.lit(""))
    # both texts are walked side by side; where the marks are longer, nothing is left to keep
    kept = F.zip_with(F.split(text, ""), F.split(marks, ""), lambda c, m: F.when(m.isin("<", ">"), "").otherwise(c))
    text = F.when(marks.rlike("[<>]"), F.array_join(kept, "")).otherwise(text)
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c) - 33)).otherwise(F.array().cast("array<int>"))


def mean_and_std(scores: Column) -> dict[str, Column]:
    """Mean and population deviation of an array of numbers; -1 if it is empty. Exact sums, so no second pass is needed."""
    n, zero = F.size(scores), F.lit(0).cast("long")
    total = F.aggregate(scores, zero, lambda a, v: a + v)
    squares = F.aggregate(scores, zero, lambda a, v: a + v * v)
    std = F.try_divide(F.sqrt((n * squares - total * total).cast("double")), n)
    return {"q_mean": F.coalesce(F.try_divide(total.cast("double"), n), F.lit(-1.0)), "q_std": F.coalesce(std, F.lit(-1.0))}
