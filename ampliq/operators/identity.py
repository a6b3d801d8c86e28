"""Defensible naming from ranked hits and several databases
(DEC-01..07, DEC-12, DEC-20, DEC-23, AGG-03, AGG-04, WIN-05, WIN-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import cut_lineage

# Identity thresholds per locus, alignment floors, margins, locus strength.
SPECIES_FLOOR = {"SSU": 98.7, "LSU": 98.7, "LSU_FUNGAL": 99.8, "ITS": 99.6, "OPERON": 98.7, "MIXED": 98.7}
GENUS_FLOOR = {"SSU": 94.5, "LSU": 94.5, "LSU_FUNGAL": 98.2, "ITS": 94.3, "OPERON": 94.5, "MIXED": 94.5}
ALIGNED_FLOOR = {"SSU": 1200, "LSU": 600, "LSU_FUNGAL": 600, "ITS": 600, "OPERON": 1200, "MIXED": 1200}
MIN_EVIDENCE = 250
MARGIN = 0.5
LADDER_IDENTITY = 90.0
LOCUS_STRENGTH = {"ITS": 3, "28S": 2, "18S": 1, "23S": 3, "16S": 2}
SPECIES_LOCI = ("ITS", "28S", "16S", "23S")
LADDER = ("ITS", "28S", "18S")
GATE_IDENTITY, GATE_MARGIN = 95.0, 2.0


def by_locus(table: dict, locus: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), locus), F.lit(default))


def dominant_category(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Most frequent category with its share; every row stays in the denominator (AGG-03)."""
    c = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("neg"), F.col(category).alias("c"))).alias("m"))
    return g.select(*keys, F.col("m.c").alias("category"), (-F.col("m.neg")).alias("n"), (-F.col("m.neg") / F.col("total")).alias("share"))


def named_hits(hits: DataFrame, header: str = "header") -> DataFrame:
    """Adds organism, genus and epithet; unnamed records get NULLs."""
    return hits.select(*hits.columns, F.inline(F.array(N.describe(header))))


def species_margin_hits(hits: DataFrame, key: list[str]) -> DataFrame:
    """Per key: the best hit of any length (``any``: identity, aligned), the top hit, the first species-named hit
    within the margin of it, and the nearest rival species. Hits are read once and counted down to one row per key and name.

    hits: (key, identity, aligned, header, record_len, name, genus, epithet).
    """
    ok = F.col("aligned") >= MIN_EVIDENCE
    order = F.struct((-F.col("identity")).alias("ni"), (-F.col("aligned")).alias("na"), F.col("header"))
    row = F.struct(order.alias("o"), F.col("identity"), F.col("aligned"), F.col("record_len"), F.col("name"), F.col("genus"), F.col("epithet"))
    named = ok & F.col("epithet").isNotNull()
    g = hits.groupBy(*key, "name").agg(F.max(F.struct("identity", "aligned")).alias("any"), F.min(F.when(ok, row)).alias("top"),
                                       F.min(F.when(named, row)).alias("sp"), F.min(F.when(named, -F.col("identity"))).alias("ni"))
    w = Window.partitionBy(*key)
    top = g.select(*key, "name", "ni", F.max("any").over(w).alias("any"), F.min("top").over(w).alias("top"), F.min("sp").over(w).alias("sp"))
    near = (F.col("top.identity") - F.col("sp.identity")) < MARGIN
    use_sp = F.col("top.epithet").isNull() & F.col("sp").isNotNull() & near
    top = top.withColumn("pick", F.when(use_sp, F.col("sp")).otherwise(F.col("top"))).withColumn("skipped_top", use_sp)
    rival = (F.col("name") != F.col("pick.name")) & (F.col("pick.identity") + F.col("ni") < MARGIN)
    r = top.groupBy(*key).agg(F.max("any").alias("any"), F.min("pick").alias("pick"), F.max("skipped_top").alias("skipped_top"),
                              F.min(F.when(rival, F.struct("ni", "name"))).alias("rv"))
    return r.select(*key, "any", "pick", "skipped_top", F.col("rv.name").alias("rival"))


def locus_decision(hits: DataFrame, key: list[str], locus: Column) -> DataFrame:
    """Decision of one locus with its own thresholds (DEC-02).

    ``locus`` is a column of the key columns. Levels: species, genus (with cf. when a rival
    species is inside the margin), none.
    """
    d = species_margin_hits(named_hits(hits), key)
    p = F.col("pick")
    te, ce, fl = by_locus(SPECIES_FLOOR, locus, 98.7), by_locus(GENUS_FLOOR, locus, 94.5), by_locus(ALIGNED_FLOOR, locus, 600)
    enough = (p["aligned"] >= fl) | (p["record_len"].isNotNull() & (p["aligned"] >= 0.90 * p["record_len"]))
    reason = (F.when(p.isNull(), "no_evidence").when(p["genus"].isNull(), "unnamed_record")
              .when(p["identity"] < ce, "below_genus")
              .when(p["identity"] < te, "below_species").when(p["epithet"].isNull(), "no_species_name")
              .when(~F.coalesce(enough, F.lit(False)), "short_alignment").when(F.col("rival").isNotNull(), "rival").otherwise("species"))
    d = d.withColumn("reason", reason)
    named = ~F.col("reason").isin("no_evidence", "unnamed_record", "below_genus")
    name = (F.when(~named, "cannot be named").when(F.col("reason") == "species", p["name"])
            .when(F.col("reason") == "rival", F.concat(p["genus"], F.lit(" cf. "), p["epithet"]))
            .otherwise(F.concat(p["genus"], F.lit(" sp."))))
    level = F.when(~named, "none").when(F.col("reason") == "species", "species").otherwise("genus")
    return d.select(*key, name.alias("name"), F.when(named, p["genus"]).alias("genus"),
                    F.when(F.col("reason") == "species", p["name"]).alias("species"), level.alias("level"),
                    F.coalesce(p["identity"], F.col("any.identity")).alias("identity"),
                    F.coalesce(p["aligned"], F.col("any.aligned")).alias("aligned"), "reason",
                    F.coalesce("skipped_top", F.lit(False)).alias("skipped_top"))


def merge_loci(decisions: DataFrame, key: list[str]) -> DataFrame:
    """One name from the decisions of several loci (DEC-03).

    decisions: (key, locus, name, genus, species, level, identity, aligned). Genus by vote,
    then strongest locus, then longest alignment. A species is taken only from loci that can
    separate species; two different species become cf.
    """
    decisions = cut_lineage(decisions)  # a row per key and locus, read by the vote, the pick and the list of keys
    use = decisions.where(F.col("genus").isNotNull())
    power = by_locus(LOCUS_STRENGTH, F.col("locus"), 0)
    use = use.withColumn("power", power)
    vote = use.groupBy(*key, "genus").agg(F.count(F.lit(1)).alias("v"), F.max("power").alias("p"), F.max("aligned").alias("a"))
    win = vote.groupBy(*key).agg(F.min(F.struct((-F.col("v")).alias("nv"), (-F.col("p")).alias("np"), (-F.col("a")).alias("na"),
                                                F.col("genus").alias("g"))).alias("w"), F.count(F.lit(1)).alias("genera"))
    j = use.join(win.select(*key, F.col("w.g").alias("win"), "genera"), key)
    mine = F.col("genus") == F.col("win")
    gives = F.col("locus").isin(*SPECIES_LOCI)
    # strongest locus, longest alignment, then the locus and name that sort first
    best = F.struct((-F.col("power")).alias("np"), (-F.col("aligned")).alias("na"), F.col("locus"), F.col("name"), F.col("species"), F.col("identity"))
    sp = mine & gives & (F.col("level") == "species")
    cf = mine & gives & F.col("name").contains(" cf. ")
    g = j.groupBy(*key, "win", "genera").agg(
        F.min(F.when(sp, best)).alias("sp"), F.countDistinct(F.when(sp, F.col("species"))).alias("n_species"),
        F.min(F.when(cf, best)).alias("cf"), F.max(F.struct("aligned", "identity")).alias("longest"))
    name = (F.when(F.col("sp").isNotNull() & (F.col("n_species") > 1),
                   F.concat(F.col("win"), F.lit(" cf. "), F.element_at(F.split("sp.species", " "), -1)))
            .when(F.col("sp").isNotNull(), F.col("sp.species")).when(F.col("cf").isNotNull(), F.col("cf.name"))
            .otherwise(F.concat(F.col("win"), F.lit(" sp."))))
    ident = F.coalesce(F.col("sp.identity"), F.col("cf.identity"), F.col("longest.identity"))
    out = g.select(*key, name.alias("name"), ident.alias("identity"), (F.col("genera") > 1).alias("loci_diverge"))
    every = decisions.select(*key).distinct()
    return every.join(out, key, "left").select(*key, F.coalesce("name", F.lit("cannot be named")).alias("name"), "identity",
                                               F.coalesce("loci_diverge", F.lit(False)).alias("loci_diverge"))


def ladder_report(hits: DataFrame, key: list[str], ladder=LADDER) -> DataFrame:
    """First locus of the ladder with a species-named hit, its runner-up, and a flag when
    another locus is clearly stronger (DEC-04, WIN-06).

    hits: (key, locus, identity, aligned, header).
    """
    h = named_hits(hits).where((F.col("aligned") >= MIN_EVIDENCE) & (F.col("identity") >= LADDER_IDENTITY) & F.col("epithet").isNotNull())
    row = F.struct((-F.col("identity")).alias("ni"), (-F.col("aligned")).alias("na"), F.col("header"), F.col("name"))
    # one row per locus and name, so the second row of a locus is its runner-up; hits are read once
    names = h.groupBy(*key, "locus", "name").agg(F.min(row).alias("b"))
    place = F.row_number().over(Window.partitionBy(*key, "locus").orderBy("b"))
    per = names.withColumn("place", place).where("place <= 2").groupBy(*key, "locus").agg(
        F.min(F.when(F.col("place") == 1, F.col("b"))).alias("b"), F.min(F.when(F.col("place") == 2, F.col("b"))).alias("s"))
    rank = F.array_position(F.array(*map(F.lit, ladder)), F.col("locus"))
    first = F.min(F.when(rank > 0, F.struct(rank.alias("r"), F.col("locus"), F.col("b"), F.col("s")))).over(Window.partitionBy(*key))
    f = per.select(*key, F.col("locus").alias("ol"), F.col("b").alias("ob"), first.alias("f")).where("f IS NOT NULL")
    identity, aligned = -F.col("f.b.ni"), -F.col("f.b.na")
    stronger = (F.col("f.locus").isin(*SPECIES_LOCI) & F.col("ol").isin(*SPECIES_LOCI) & (F.col("ol") != F.col("f.locus"))
                & (-F.col("ob.ni") >= identity + 2.0) & (-F.col("ob.na") >= 1.5 * aligned))
    return f.groupBy(*key).agg(F.min("f").alias("f"), F.min(F.when(stronger, F.col("ol"))).alias("stronger_locus")).select(
        *key, "f.locus", "f.b.name", identity.alias("identity"), aligned.alias("aligned"), F.col("f.s.name").alias("runner_up"),
        F.round(identity + F.col("f.s.ni"), 6).alias("margin"), "stronger_locus")


def kingdom_gate(hits: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose best non-fungal eukaryote clearly beats the best fungal record (DEC-05)."""
    h = hits.where(F.col("locus").isin("18S", "28S") & (F.col("aligned") >= MIN_EVIDENCE)).withColumn(
        "outside", N.non_fungal_eukaryote("header"))
    g = h.groupBy(*key, "locus").agg(
        F.coalesce(F.max(F.when(F.col("outside").isNull(), F.col("identity"))), F.lit(0.0)).alias("fungal"),
        F.max(F.when(F.col("outside").isNotNull(), F.struct("identity", "aligned", "outside"))).alias("o"))
    opened = g.where((F.col("o.identity") >= GATE_IDENTITY) & (F.col("o.identity") - F.col("fungal") >= GATE_MARGIN))
    m = opened.groupBy(*key).agg(F.max(F.struct(F.col("o.identity").alias("identity"), F.col("o.outside").alias("name"),
                                                F.col("locus"), F.col("fungal"))).alias("m"))
    return m.select(*key, F.concat(F.lit("outside kingdom: "), F.col("m.name")).alias("name"), "m.identity", "m.locus", "m.fungal")


def nt_reconcile(our_name, our_identity, nt_name, nt_rank, nt_identity, nt_bp, species_floor) -> Column:
    """A species name can only be lowered to cf. by an outside search, never replaced (DEC-06)."""
    o, n = F.col(our_name), F.col(nt_name)
    words = F.size(F.split(F.trim(F.regexp_replace(o, "^Candidatus ", "")), "\\s+"))
    applies = (~o.contains(" cf. ") & (F.col(nt_rank) == "species") & (words >= 2) & (N.current_name(nt_name) != N.current_name(our_name))
               & (F.col(nt_identity) >= F.col(species_floor)) & (F.col(nt_identity) >= F.col(our_identity) - MARGIN)
               & (F.col(nt_bp) >= MIN_EVIDENCE))
    lowered = F.concat(F.regexp_extract(o, "^(.*) [^ ]+$", 1), F.lit(" cf. "), F.element_at(F.split(o, " "), -1))
    return F.when(F.coalesce(applies, F.lit(False)), lowered).otherwise(o)


def database_verdict(best: DataFrame, key: list[str]) -> DataFrame:
    """Genus vote over databases: two or more independent ones confirm (DEC-07).

    best: (key, database, genus, accession), one best hit per database. Databases that agree
    through one and the same record are flagged as not independent. Ties: votes, then name.
    """
    v = best.where(F.col("genus").isNotNull()).groupBy(*key, "genus").agg(
        F.countDistinct("database").alias("databases"), F.countDistinct("accession").alias("accessions"))
    w = v.groupBy(*key).agg(F.min(F.struct((-F.col("databases")).alias("nd"), F.col("genus"), F.col("accessions"))).alias("w"))
    every = best.select(*key).distinct().join(w, key, "left")
    d = F.coalesce(-F.col("w.nd"), F.lit(0))
    return every.select(*key, F.col("w.genus").alias("genus"), d.alias("databases"),
                        F.when(d >= 2, "CONFIRMED").when(d == 1, "NOT CONFIRMED (single source)").otherwise("NOT CONFIRMED").alias("verdict"),
                        ((d >= 2) & (F.col("w.accessions") == 1)).alias("same_record"))


def claim_verdict(verdict: DataFrame, claimed: str) -> DataFrame:
    """CONFIRMED / CORRECT IT / CANNOT for a claimed genus against the database vote (DEC-07)."""
    return verdict.withColumn("claim", F.when(F.col("databases") < 2, "CANNOT")
                              .when(F.lower("genus") == F.lower(claimed), "CONFIRMED").otherwise("CORRECT IT"))


def nearest_organisms(hits: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """Nearest organisms, first occurrence per organism (WIN-05)."""
    from .ranking import top_n
    b = hits.where(F.col("name").isNotNull()).groupBy(*key, "name").agg(F.max(F.struct("identity", "aligned")).alias("m"))
    return top_n(b.select(*key, "name", "m.identity", "m.aligned"), key, [F.desc("identity"), F.desc("aligned"), F.col("name")], n)


def populations(best: DataFrame, bin_col: str, genus_floor: float) -> DataFrame:
    """Reads per genus and species of their best record (AGG-04); genus rows have NULL species."""
    ok = best.where((F.col("identity") >= genus_floor) & F.col("genus").isNotNull())
    sp = F.when(F.col("epithet").isNotNull(), F.concat_ws(" ", "genus", "epithet"))
    g = ok.groupBy(bin_col, "genus", sp.alias("species")).agg(F.count(F.lit(1)).alias("n"))
    # a species counts for itself and, under null, for its genus
    both = g.select(bin_col, "genus", F.explode(F.array_distinct(F.array(F.col("species"), F.lit(None).cast("string")))).alias("species"), "n")
    return both.groupBy(bin_col, "genus", "species").agg(F.sum("n").alias("n"))


def sub_populations(pop: DataFrame, bin_col: str, min_reads: int = 10, min_share: float = 0.15) -> DataFrame:
    """Populations to be polished apart (DEC-20): bin, genus, species, n, origin.

    The species groups of the dominant genus that hold enough reads and share of that genus, if
    they are two at least; and the second genus, if it has enough reads and share of the bin.
    pop: as from ``populations``. Equal counts are ordered by name.
    """
    pop = cut_lineage(pop)  # counted once, read for each of the steps
    g = pop.where("species IS NULL").select(bin_col, "genus", "n")
    w = Window.partitionBy(bin_col).orderBy(F.desc("n"), "genus")
    ranked = g.withColumn("rank", F.row_number().over(w)).where("rank <= 2").join(g.groupBy(bin_col).agg(F.sum("n").alias("total")), bin_col)
    first = ranked.where("rank = 1").select(bin_col, "genus", F.col("n").alias("of"))
    large = pop.where("species IS NOT NULL").join(first, [bin_col, "genus"]).where((F.col("n") >= min_reads) & (F.col("n") / F.col("of") >= min_share))
    several = large.groupBy(bin_col).agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select(bin_col)
    groups = large.join(several, bin_col, "left_semi").select(bin_col, "genus", "species", "n", F.lit("species group").alias("origin"))
    second = ranked.where((F.col("rank") == 2) & (F.col("n") >= min_reads) & (F.col("n") / F.col("total") >= min_share))
    return groups.unionByName(second.select(bin_col, "genus", F.lit(None).cast("string").alias("species"), "n", F.lit("second genus").alias("origin")))


def name_level(name) -> Column:
    """Level a reported name claims (DEC-12): an open name is a candidate, one ending in sp. a genus,
    two words a species, anything else and a missing name nothing."""
    n = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return (F.when(n.contains("cf."), "cf.").when(n.endswith("sp."), "genus")
            .when(n.contains(" ") & ~n.isin("cannot be named", "no match"), "species").otherwise("unnamed"))
