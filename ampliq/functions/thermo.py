"""Nearest-neighbour thermodynamics (THR family).

Melting temperatures are closed-form column expressions of published parameters. Structure
energies use ungapped stems only, so they are an approximation and are named as such.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P
from .seq import col

# SantaLucia (1998) unified parameters, enthalpy kcal/mol and entropy cal/(K mol).
STACKS = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
}
END_GC, END_AT, SYMMETRY = (0.1, -2.8), (2.3, 4.1), (0.0, -1.4)
GAS = 1.987
# Owczarzy (2008) divalent salt correction, times 1e-5.
OWCZARZY = dict(a=3.92, b=-0.911, c=6.26, d=1.42, e=-48.2, f=52.5, g=8.31)

_PAIR = str.maketrans("ACGT", "TGCA")


def stack(pair: str) -> tuple[float, float]:
    """Parameters of a dinucleotide or of its reverse complement."""
    return STACKS.get(pair) or STACKS[pair.translate(_PAIR)[::-1]]


ALL_STACKS = {x + y: stack(x + y) for x in "ACGT" for y in "ACGT"}


def _sums(oligo: Column) -> Column:
    """struct(h, s): stack sums, end terms and symmetry; NULL for non-ACGT oligos."""
    h = F.create_map(*[F.lit(v) for k, (a, _) in ALL_STACKS.items() for v in (k, a)])
    s = F.create_map(*[F.lit(v) for k, (_, b) in ALL_STACKS.items() for v in (k, b)])
    zero = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"))
    body = F.aggregate(F.sequence(F.lit(1), F.length(oligo) - 1), zero, lambda acc, i: F.struct(
        (acc["h"] + F.element_at(h, F.substring(oligo, i, F.lit(2)))).alias("h"),
        (acc["s"] + F.element_at(s, F.substring(oligo, i, F.lit(2)))).alias("s")))

    def ends(k):
        def one(c):
            return F.when(c.isin("G", "C"), F.lit(END_GC[k])).otherwise(F.lit(END_AT[k]))
        return one(F.substring(oligo, 1, 1)) + one(F.right(oligo, F.lit(1)))

    palindrome = F.reverse(F.translate(oligo, "ACGT", "TGCA")) == oligo
    sym = F.when(palindrome, F.lit(SYMMETRY[1])).otherwise(F.lit(0.0))
    return F.struct((body["h"] + ends(0)).alias("h"), (body["s"] + ends(1) + sym).alias("s"), palindrome.alias("p"))


def monovalent_equivalent(r: P.Reaction) -> float:
    free = max(r.divalent_mm - r.dntp_mm, 0.0)
    return (r.monovalent_mm + 120.0 * math.sqrt(free)) / 1000.0


def melting_temperature(oligo, r: P.Reaction = P.Reaction()) -> Column:
    """Tm with the entropy salt correction (THR-01)."""
    o = col(oligo)
    salt = 0.368 * math.log(monovalent_equivalent(r))

    def finish(x):
        conc = F.when(x["p"], F.lit(r.oligo_nm * 1e-9)).otherwise(F.lit(r.oligo_nm * 1e-9 / 4.0))
        return 1000.0 * x["h"] / (x["s"] + salt * (F.length(o) - 1) + GAS * F.log(conc)) - 273.15

    return F.get(F.transform(F.array(_sums(o)), finish), F.lit(0))


def melting_temperature_divalent(oligo, r: P.Reaction = P.Reaction()) -> Column:
    """Tm of the same stacks with the divalent salt correction (THR-02)."""
    o = col(oligo)
    mon = r.monovalent_mm / 1000.0
    dntp, mg = r.dntp_mm / 1000.0, r.divalent_mm / 1000.0
    if dntp > 0:  # magnesium bound by dNTP
        k = 3e4
        b = k * dntp - k * mg + 1.0
        mg = (-b + math.sqrt(b * b + 4.0 * k * mg)) / (2.0 * k)
    c = dict(OWCZARZY)
    ratio = math.sqrt(mg) / mon
    lm, lg = math.log(mon), math.log(mg)
    if 0.22 <= ratio < 6.0:
        c["a"] *= 0.843 - 0.352 * math.sqrt(mon) * lm
        c["d"] *= 1.279 - 4.03e-3 * lm - 8.03e-3 * lm ** 2
        c["g"] *= 0.486 - 0.258 * lm + 5.25e-3 * lm ** 3
    gc = F.length(F.regexp_replace(o, "[^GC]", "")) / F.length(o)
    if ratio < 0.22:
        corr = (4.29 * gc - 3.95) * 1e-5 * lm + 9.40e-6 * lm ** 2
    else:
        corr = (c["a"] + c["b"] * lg + gc * (c["c"] + c["d"] * lg)
                + (1.0 / (2.0 * (F.length(o) - 1))) * (c["e"] + c["f"] * lg + c["g"] * lg ** 2)) * 1e-5

    def finish(x):
        conc = F.when(x["p"], F.lit(r.oligo_nm * 1e-9)).otherwise(F.lit(r.oligo_nm * 1e-9))
        t = 1000.0 * x["h"] / (x["s"] + GAS * F.log(conc))
        return 1.0 / (1.0 / t + corr) - 273.15

    return F.get(F.transform(F.array(_sums(o)), finish), F.lit(0))


def product_class(bp) -> Column:
    b = col(bp)
    return (F.when(b.between(*P.PRODUCT_IDEAL), "ideal").when(b <= P.PRODUCT_NOT_ADVISED, "acceptable")
            .otherwise("not_advised"))


def pair_measures(tm_f, tm_r, bp) -> Column:
    """Pair-level quantities that need no structure energies (THR-06)."""
    f, r = col(tm_f), col(tm_r)
    low = F.least(f, r)
    return F.struct(F.round(F.abs(f - r), 2).alias("dtm"), F.round(low - P.TA_RULE, 2).alias("ta"),
                    F.round(low - P.TA_TARGET, 2).alias("margin_60"),
                    (F.round(low - P.TA_RULE, 2) >= P.TA_TARGET - 0.5).alias("fits_60"), product_class(bp).alias("product_class"))
