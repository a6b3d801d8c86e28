"""Closed-form statistics on Columns (MTH family)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .seq import col


def _wilson_terms(k, n, z):
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / n
    z2 = z * z
    den = 1.0 + z2 / n
    mid = (p + z2 / (2.0 * n)) / den
    half = z * F.sqrt(p * (1.0 - p) / n + z2 / (4.0 * n * n)) / den
    return mid, half


def wilson_lower(k, n, z: float = P.WILSON_Z) -> Column:
    """Lower Wilson bound; nothing measured gives 0."""
    mid, half = _wilson_terms(k, n, z)
    return F.when(col(n) > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(F.lit(0.0))


def wilson_upper(k, n, z: float = P.WILSON_Z) -> Column:
    """Upper Wilson bound; nothing measured gives 1."""
    mid, half = _wilson_terms(k, n, z)
    return F.when(col(n) > 0, F.least(mid + half, F.lit(1.0))).otherwise(F.lit(1.0))


def ratio(num, den) -> Column:
    """Quotient that stays NULL when the denominator is absent or zero."""
    return F.when(col(den) > 0, col(num) / col(den))


def fold_to_dcq(fold, efficiency: float = 1.0) -> Column:
    """ln(fold) / ln(1 + efficiency); undefined folds stay NULL."""
    f = col(fold)
    return F.when(f > 0, F.log(f) / F.log(F.lit(1.0 + efficiency)))


def required_dcq(abundance_ratio) -> Column:
    """Cycle distance an assay must show for a given abundance ratio."""
    r = col(abundance_ratio)
    by_ratio = F.when(r > 0, F.log2(r) + 4.3)
    return F.greatest(F.coalesce(by_ratio, F.lit(3.32)), F.lit(3.32))


def mixture_threshold(error_rate) -> Column:
    """Identity below which a cluster counts as mixed, from the read error rate."""
    e = F.coalesce(col(error_rate), F.lit(0.02))
    return F.least(F.greatest(100.0 - 2.5 * 2.0 * e * 100.0, F.lit(88.0)), F.lit(99.0))


def reference_separable(d_ref, error_rate, length) -> Column:
    limit = F.greatest(F.lit(3.0), 3.0 * F.sqrt(col(error_rate) * col(length) + 1.0))
    return col(d_ref) >= limit


def measurement_separable(m1, m2) -> Column:
    return F.abs(col(m1) - col(m2)) >= 3.0 * F.sqrt(col(m1) + col(m2) + 1.0)


def fold_class(fold) -> Column:
    """Order class of a separation fold; an undefined fold is a universal target."""
    f = col(fold)
    return (
        F.when(f.isNull(), "UNIVERSAL")
        .when(f >= P.FOLD_THRESHOLD, "CERTAIN")
        .when(f >= P.FOLD_CONDITIONAL, "CONDITIONAL")
        .otherwise("NOT RECOMMENDED")
    )
