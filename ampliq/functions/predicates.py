"""Filter predicates and small classifiers on Columns (FLT family)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from . import seq as S
from .seq import col


def length_class(length, expected) -> Column:
    n, e = col(length), col(expected)
    return (F.when(n < P.FRAGMENT_MIN, "short").when(n < P.FULL_LOW * e, "fragment")
            .when(n <= P.FULL_HIGH * e, "full").otherwise("concatemer"))


def is_concatemer(median_length, expected) -> Column:
    return col(median_length) > P.CONCATEMER_FACTOR * col(expected)


def alignment_sufficient(aligned, floor_bp, record_len) -> Column:
    a, r = col(aligned), col(record_len)
    whole = r.isNotNull() & (r > 0) & (a >= 250) & (a >= 0.90 * r)
    return (a >= col(floor_bp)) | whole


def oligo_length_ok(oligo) -> Column:
    return F.length(col(oligo)).between(*P.OLIGO_LENGTH)


def violations(oligo, gc, tm, hairpin_tm=None, homodimer_tm=None,
               gc_range=(40, 60), tm_range=(58, 62), need_end_gc=True, need_last5=True) -> Column:
    """Names of the violated oligo rules, empty when the oligo passes (FLT-01)."""
    o, g, t = col(oligo), col(gc), col(tm)
    rules = [
        F.when(~oligo_length_ok(o), "length"),
        F.when(~g.between(*gc_range), "gc"),
        F.when(~t.between(*tm_range), "tm"),
    ]
    if hairpin_tm is not None:
        rules.append(F.when(col(hairpin_tm) >= P.HAIRPIN_TM_MAX, "hairpin"))
    if homodimer_tm is not None:
        rules.append(F.when(col(homodimer_tm) >= P.HOMODIMER_TM_MAX, "homodimer"))
    if need_end_gc:
        rules.append(F.when(~S.last_base(o).isin("G", "C"), "end_not_gc"))
    if need_last5:
        rules.append(F.when(S.gc_in_last5(o) > 3, "last5_gc"))
    rules.append(F.when(S.is_degenerate(o), "degenerate"))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def invariant_oligo_ok(oligo) -> Column:
    """Rules that hold whatever the grid cell: length, concrete bases, no run of four (FLT-02)."""
    o = col(oligo)
    return oligo_length_ok(o) & ~S.is_degenerate(o) & ~S.has_run_of_four(o)


def composition_reason(oligo, gc_min=40.0, gc_max=60.0, max_run=4, max_last5_gc=3) -> Column:
    """First composition rule an oligo breaks, NULL when none (FLT-04)."""
    o = col(oligo)
    g = S.gc_percent(o)
    return (F.when(S.is_degenerate(o), "degenerate").when((g < gc_min) | (g > gc_max), "gc")
            .when(S.max_run(o) > max_run, "run").when(~S.last_base(o).isin("G", "C"), "end_not_gc")
            .when(S.gc_in_last5(o) > max_last5_gc, "last5_gc"))


def same_size(bp, expected, tolerance: int = 10) -> Column:
    """Product of the expected length within tolerance; without an expectation never (FLT-15)."""
    return F.coalesce(F.abs(col(bp) - col(expected)) <= tolerance, F.lit(False))
