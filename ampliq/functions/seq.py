"""Sequence expressions on Columns (SEQ family). All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alphabet as ab

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_AS_BASES = "".join("ACGT"[i % 4] for i in range(26))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it many times inside ``fn``: without this a long
    cascade repeats its input expression at every use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are computed once. Filters and projections later on are merged with a plain column's expression, which
    then runs again at every use; they are not merged with a generated row."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def text_to_bases(text) -> Column:
    """Map free text onto ACGT letter by letter; everything else is dropped."""
    t = F.translate(col(text), _LETTERS + _LETTERS.upper(), _AS_BASES * 2)
    return F.regexp_replace(t, "[^ACGT]", "")


def clean(seq) -> Column:
    """Upper case, anything outside ACGTUN becomes N, U becomes T."""
    up = F.translate(col(seq), "acgtun", "ACGTUN")
    return F.translate(F.regexp_replace(up, "[^ACGTUN]", "N"), "U", "T")


def revcomp(seq) -> Column:
    """Reverse complement that keeps ambiguity codes meaningful."""
    return F.reverse(F.translate(col(seq), ab.COMPLEMENT_FROM, ab.COMPLEMENT_TO))


def digits(seq) -> Column:
    """A,C,G,T -> 0,1,2,3 and anything else 4 (a code that never matches)."""
    return F.translate(F.regexp_replace(col(seq), "[^ACGT]", "4"), "ACGT", "0123")


def gc_percent(seq) -> Column:
    s = col(seq)
    return 100.0 * F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s)


def max_run(seq) -> Column:
    """Length of the longest run of one base; 0 when there is none."""
    runs = F.regexp_extract_all(col(seq), F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def has_run_of_four(seq) -> Column:
    return col(seq).rlike("AAAA|CCCC|GGGG|TTTT")


def last_base(seq) -> Column:
    return F.right(col(seq), F.lit(1))


def gc_in_last5(seq) -> Column:
    return F.length(F.regexp_replace(F.right(col(seq), F.lit(5)), "[^GC]", ""))


def is_degenerate(seq) -> Column:
    return col(seq).rlike("[^ACGT]")


def primer_mask(seq) -> Column:
    return F.translate(col(seq), ab.CODES, ab.PRIMER_MASK_TO)


def template_mask(seq) -> Column:
    return F.translate(col(seq), ab.CODES, ab.TEMPLATE_MASK_TO)


def base_matches(primer_base, template_base) -> Column:
    """Ambiguity-aware base match; N on the template matches nothing."""
    m = F.ascii(primer_mask(primer_base)).bitwiseAND(F.ascii(template_mask(template_base)))
    return m.bitwiseAND(15) != 0


def mismatch_positions(primer_masks, template_masks, length) -> Column:
    """1-based positions at which two mask strings of equal length disagree."""
    p, t = col(primer_masks), col(template_masks)
    return F.filter(
        F.sequence(F.lit(1), col(length)),
        lambda i: F.ascii(F.substring(p, i, F.lit(1)))
        .bitwiseAND(F.ascii(F.substring(t, i, F.lit(1)))).bitwiseAND(15) == 0,
    )


def expand_codes(seq, limit: int = 64) -> Column:
    """All concrete sequences of an ambiguous oligo; NULL above ``limit``."""
    s = col(seq)
    table = F.create_map(*[x for c, b in ab.IUPAC.items() for x in (F.lit(c), F.array(*map(F.lit, b)))])
    sizes = F.transform(F.split(s, ""), lambda c: F.size(F.element_at(table, c)).cast("long"))
    total = F.aggregate(sizes, F.lit(1).cast("long"), lambda a, n: F.least(a * n, F.lit(limit + 1).cast("long")))
    # the guard feeds the fold, so a refused oligo is never expanded at all
    letters = F.when(total <= limit, F.split(s, "")).otherwise(F.lit(None).cast("array<string>"))
    return F.aggregate(
        letters,
        F.array(F.lit("")),
        lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(
            F.element_at(table, c), lambda b: F.concat(a, b)))),
    )


def canonical(kmer) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(col(kmer), revcomp(kmer))


def phred_error(qual) -> Column:
    """Mean error probability of a quality string: mean of 10^(-Q/10)."""
    chars = F.regexp_extract_all(col(qual), F.lit("(.)"), F.lit(1))
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.pow(F.lit(10.0), -(F.ascii(c) - 33) / 10.0))
    return total / F.length(col(qual))


def cigar_ops(cigar) -> Column:
    """CIGAR text -> array of (len, op)."""
    each = F.regexp_extract_all(col(cigar), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def _consumed(ops, letters: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*letters), o["len"]).otherwise(0))


def cigar_reference_length(cigar) -> Column:
    return _consumed(cigar_ops(cigar), "MDN=X")


def cigar_query_length(cigar) -> Column:
    return _consumed(cigar_ops(cigar), "MI=X")


def _clip_start(ops) -> Column:
    first = ops[0]
    return F.when(first["op"].isin("S", "H"), first["len"]).otherwise(0)


def cigar_clip_start(cigar) -> Column:
    """Bases clipped before the alignment starts on the query."""
    return _clip_start(cigar_ops(cigar))


def cigar_measures(cigar) -> Column:
    """struct(ref_len, query_len, clip, walk) of a CIGAR that is read once."""
    return let(cigar_ops(cigar), lambda ops: F.struct(
        _consumed(ops, "MDN=X").alias("ref_len"), _consumed(ops, "MI=X").alias("query_len"), _clip_start(ops).alias("clip"), _walk(ops).alias("walk")))


def cigar_walk(cigar) -> Column:
    """Operations with the running reference and query offsets they start at."""
    return _walk(cigar_ops(cigar))


def _walk(ops) -> Column:
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"),
                     F.array().cast("array<struct<r:int,q:int,len:int,op:string>>").alias("steps"))

    def step(acc, o):
        entry = F.struct(acc["r"].alias("r"), acc["q"].alias("q"), o["len"].alias("len"), o["op"].alias("op"))
        return F.struct(
            (acc["r"] + F.when(o["op"].isin(*"MDN=X"), o["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(o["op"].isin(*"MIS=X"), o["len"]).otherwise(0)).alias("q"),
            F.concat(acc["steps"], F.array(entry)).alias("steps"),
        )

    return F.aggregate(ops, start, step)["steps"]


def ambiguity_reject(template, iupac_max: int, clamp: int) -> Column:
    """Reason an oligo template may not be used, or NULL when it may.

    ``clamp`` is the number of 3' bases, in oligo orientation, that must be concrete.
    """
    s = col(template)
    n_amb = F.length(F.regexp_replace(s, "[ACGT]", ""))
    return (
        F.when(s.contains("N"), F.lit("template_n"))
        .when(s.rlike("[^ACGTRYSWKMBDHVN]"), F.lit("unknown_code"))
        .when(n_amb > iupac_max, F.lit("too_many_codes"))
        .when(F.right(s, F.lit(clamp)).rlike("[^ACGT]"), F.lit("code_in_3prime"))
    )
