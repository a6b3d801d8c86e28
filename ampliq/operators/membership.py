"""Targets, members and competitors (JOIN-17..22, JOIN-26, JOIN-27, DEC-14..16, WIN-15..17, TAX-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import seq as S
from ..functions import stats as M
from .ranking import top_n

# Shares that make a bin a member, or mixed.
MEMBER_SHARE, MIXED_SHARE = 0.50, 0.15


def keyword_pool(records: DataFrame, keys: DataFrame, min_len: int) -> DataFrame:
    """Records whose header contains any key of a class (JOIN-17).

    keys: (class, key), a control table of a few hundred rows at most, so it travels as one row.
    A key is found anywhere in a header, also within a word; a record matching several keys of a
    class counts once.
    """
    k = keys.select("class", F.lower("key").alias("key")).where("key <> ''").distinct()
    one = F.broadcast(k.agg(F.collect_list(F.struct("class", "key")).alias("keys")))
    h = S.bind(records.where(F.length("seq") >= min_len).select("rec_id", "header"), h=F.lower("header")).select("rec_id", "h").crossJoin(one)
    found = F.array_distinct(F.transform(F.filter("keys", lambda x: F.contains(F.col("h"), x["key"])), lambda x: x["class"]))
    return S.bind(h, found=found).select(F.explode("found").alias("class"), "rec_id").distinct()


def resolve_context(targets: DataFrame, explicit: DataFrame, alias: DataFrame, bins: DataFrame) -> DataFrame:
    """(target, bin, role): explicit membership first, alias table second, class wildcard third;
    competitors default to the rest of the class (JOIN-19).

    targets: (target, class); explicit / alias: (target, bin, role); bins: (bin, class).
    """
    has_explicit = explicit.select("target").distinct()
    has_alias = alias.select("target").distinct()
    rest = targets.join(has_explicit, "target", "left_anti")
    given = explicit.join(targets.select("target"), "target", "left_semi").unionByName(
        alias.join(rest, "target", "left_semi"))
    wild = rest.join(has_alias, "target", "left_anti").join(bins, "class").select("target", "bin", F.lit("member").alias("role"))
    known = given.unionByName(wild)
    own = targets.join(bins, "class").select("target", "bin")
    default = own.join(known.select("target", "bin"), ["target", "bin"], "left_anti").withColumn("role", F.lit("competitor"))
    return known.unionByName(default)


def related_classes(pairs: DataFrame) -> DataFrame:
    """Classes whose bins compete with a class: itself and its relatives (JOIN-20). pairs: (a, b)."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = both.select("a", F.col("a").alias("b"))
    return both.union(own).distinct()


def competitor_bins(targets: DataFrame, bins: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bins of a target's class and of its related classes, per target (JOIN-20).

    targets: (target, class); bins: (bin, class); pairs: (a, b) related classes.
    """
    own = targets.select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    near = related_classes(pairs).union(own).distinct()
    return (targets.join(near, targets["class"] == near["a"]).select("target", F.col("b").alias("class")).distinct()
            .join(bins, "class").select("target", "bin").distinct())


def order_mapping(left: DataFrame, right: DataFrame, cls: str, a: str, b: str) -> DataFrame:
    """i-th of one sorted list with i-th of the other, only where the counts agree (JOIN-21)."""
    def numbered(df, value):
        d = df.select(cls, value).distinct()
        n = d.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
        return d.withColumn("_i", F.row_number().over(Window.partitionBy(cls).orderBy(value))).join(n, cls)

    return numbered(left, a).join(numbered(right, b), [cls, "_i", "_n"]).select(cls, a, b)


def resolve_names(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact target, else the only target starting with the name and an underscore, else NULL (JOIN-22).

    refs: (ref); targets: (target). Prefixes of target names are exploded at underscores, so
    the prefix match is an equi-join as well.
    """
    exact = targets.select(F.col("target").alias("ref"), F.col("target").alias("exact"))
    parts = targets.select("target", F.split("target", "_").alias("p")).where(F.size("p") > 1)
    pre = parts.select("target", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"), "p").select(
        F.concat_ws("_", F.slice("p", F.lit(1), F.col("i"))).alias("ref"), "target")
    only = pre.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("prefix")).where("n = 1").drop("n")
    return refs.join(exact, "ref", "left").join(only, "ref", "left").select("ref", F.coalesce("exact", "prefix").alias("target"))


def expand_wildcards(rules: DataFrame, bins: DataFrame) -> DataFrame:
    """Membership cells resolved to bins (JOIN-26).

    rules: (target, pattern, excluded ARRAY): '*A' is every bin of a class that begins with A,
    anything else one bin. bins: (bin, class). Beginnings of class names meet the patterns in an
    equi-join.
    """
    starts = bins.select("class").distinct().select("class", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("class")), lambda i: F.concat(F.lit("*"), F.substring(F.col("class"), F.lit(1), i)))).alias("pattern"))
    w = rules.where(F.col("pattern").startswith("*")).join(starts, "pattern").join(bins, "class")
    e = rules.where(~F.col("pattern").startswith("*")).withColumn("bin", F.col("pattern")).join(bins, "bin", "left_semi")
    allr = w.select("target", "bin", "excluded").unionByName(e.select("target", "bin", "excluded"))
    return allr.where(~F.array_contains("excluded", F.col("bin"))).select("target", "bin").distinct()


def headers_of_hits(hits: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Counts per hit id with its header; a missing header stays unknown (JOIN-27)."""
    c = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.join(headers, key, "left")


def paired_hits(hits: DataFrame, lo: int, hi: int) -> DataFrame:
    """Products on a subject from separate forward and reverse primer hits (JOIN-18).

    hits: (pair, subject, primer 'F'/'R', strand, start, end). Opposite strands facing each
    other within the window; both strand arrangements are one product key.
    """
    plus = hits.where("strand = '+'").select("pair", "subject", F.col("primer").alias("p1"), F.col("start").alias("s"),
                                            F.explode(F.array(F.floor(F.col("start") / hi), F.floor(F.col("start") / hi) + 1)).alias("cell"))
    minus = hits.where("strand = '-'").select("pair", "subject", F.col("primer").alias("p2"), F.col("end").alias("e"),
                                             F.floor(F.col("end") / hi).alias("cell"))
    size = F.col("e") - F.col("s")
    return plus.join(minus, ["pair", "subject", "cell"]).where((F.col("p1") != F.col("p2")) & size.between(lo, hi)).select(
        "pair", "subject", "p1", "s", "e", size.alias("bp"))


def rederive(old: DataFrame, shares: DataFrame) -> DataFrame:
    """New role per (target, bin): the old one stands unless there is positive evidence (DEC-14).

    old: (target, bin, role); shares: (target, bin, share) with NULL = not measured.
    """
    j = old.join(shares, ["target", "bin"], "full_outer")
    s = F.col("share")
    measured = F.when(s >= MEMBER_SHARE, "member").when(s >= MIXED_SHARE, "mixed").when(s.isNotNull(), F.col("role"))
    return j.select("target", "bin", F.col("role").alias("old"), F.coalesce(measured, F.col("role"), F.lit("none")).alias("new"),
                    (F.coalesce(measured, F.col("role"), F.lit("none")) != F.coalesce("role", F.lit("none"))).alias("changed"))


def scenario_rates(rates: DataFrame, definitions: DataFrame) -> DataFrame:
    """Several membership definitions measured side by side (DEC-15).

    definitions: (scenario, bin, role); rates: (pair, bin, k, n).
    """
    g = rates.join(definitions, "bin").groupBy("scenario", "pair").agg(
        F.min(F.when(F.col("role") == "member", M.wilson_lower("k", "n"))).alias("member_low"),
        F.max(F.when(F.col("role") == "competitor", M.wilson_upper("k", "n"))).alias("rival_high"))
    return g.withColumn("fold", M.ratio("member_low", "rival_high"))


def level_test(products: DataFrame, targets: DataFrame) -> DataFrame:
    """What a panel separates: species, genus or nothing (DEC-16).

    products: (target, species, genus, n) reference records amplified; targets: (target, species, genus).
    """
    g = (products.join(targets.select("target", F.col("species").alias("ts"), F.col("genus").alias("tg")), "target").groupBy("target").agg(
        F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("species") == F.col("ts"), F.col("n"))), F.lit(0)).alias("own_species"),
        F.coalesce(F.sum(F.when(F.col("genus") == F.col("tg"), F.col("n"))), F.lit(0)).alias("own_genus")))
    return targets.select("target").join(g, "target", "left").withColumn(
        "level", F.when(F.col("records").isNull(), "NO PANEL").when((F.col("own_species") == F.col("records")), "SPECIES SPECIFIC")
        .when(F.col("own_genus") == F.col("records"), "GENUS SPECIFIC").otherwise("NOT SPECIFIC"))


def source_precedence(sources: DataFrame, order: list[str]) -> DataFrame:
    """One source per bin: set priority, longest record; undecided ones are left out and every
    skipped row stays in the manifest (WIN-15). sources: (bin, set, rec_id, len, undecided)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("set"))
    best = sources.where(~F.col("undecided") & (rank > 0)).groupBy("bin").agg(F.min(F.struct(
        rank.alias("r"), (-F.col("len")).alias("nl"), F.col("rec_id"))).alias("m")).select("bin", F.col("m.rec_id").alias("_best"))
    j = sources.join(best, "bin", "left")
    status = (F.when(F.col("rec_id") == F.col("_best"), "chosen").when(F.col("undecided"), "undecided").when(rank == 0, "unknown_set").otherwise("superseded"))
    return j.select("bin", "set", "rec_id", status.alias("status"))


def fill_codes(core, reference) -> Column:
    """Ambiguous bases from a reference of the same length, else the first base of the code (WIN-16).

    With such a reference every letter that is no base, N too, takes the reference's base or the first base of its code;
    without one an N stays N. A letter that is no code gives N.
    """
    from ..functions import alphabet as ab
    c, r = F.col(core), F.col(reference)
    first = F.create_map(*[F.lit(x) for k, v in ab.IUPAC.items() if k != "N" for x in (k, v[0])])
    return F.concat_ws("", F.zip_with(F.split(c, ""), F.split(F.when(F.length(r) == F.length(c), r).otherwise(c), ""),
                                      lambda x, y: F.when(x.isin(*"ACGT"), x).otherwise(F.coalesce(F.element_at(first, y), F.lit("N")))))


def capped_species(records: DataFrame, max_species: int, max_records: int) -> DataFrame:
    """First records of the first species per genus, with what the caps cut (WIN-17).

    The caps are the report itself: the counts of everything cut are returned next to it.
    records: (genus, species, rec_id).
    """
    per = top_n(records, ["genus", "species"], [F.col("rec_id")], max_records, rank="record_rank")
    firsts = records.groupBy("genus", "species").agg(F.min("rec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    sp = top_n(firsts, ["genus"], [F.col("first"), F.col("species")], max_species, rank="species_rank")
    kept = per.join(sp.select("genus", "species", "species_rank"), ["genus", "species"])
    k = kept.groupBy("genus").agg(F.count(F.lit(1)).alias("kept_records"), F.countDistinct("species").alias("kept_species"))
    t = firsts.groupBy("genus").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("species"))
    return t.join(k, "genus").select("genus", "kept_records", "kept_species", (F.col("records") - F.col("kept_records")).alias("cut_records"),
                                     (F.col("species") - F.col("kept_species")).alias("cut_species"))


def purity(sizes: DataFrame, key: str, min_reads: int = 3, min_share: float = 0.05, dominant_floor: float = 0.50) -> DataFrame:
    """Purity of a bin from its cluster sizes (AGG-17). sizes: (key, cluster, n)."""
    t = sizes.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", "cluster")).alias("top"))
    j = sizes.join(t, key)
    sec = (F.col("cluster") != F.col("top.cluster")) & (F.col("n") >= min_reads) & (F.col("n") / F.col("total") >= min_share)
    g = j.groupBy(key).agg(F.count(F.when(sec, 1)).alias("secondary"), F.max(F.col("top.n") / F.col("total")).alias("dominant_share"))
    return g.withColumn("purity", F.when((F.col("secondary") > 0) | (F.col("dominant_share") < dominant_floor), "MIXED").otherwise("PURE"))


def representatives(consensus: DataFrame, keys: list[str], min_covered: int = 200) -> DataFrame:
    """Most covered consensus per class and taxon (AGG-23). consensus: (keys, bin, seq)."""
    c = consensus.withColumn("covered", F.length(F.regexp_replace("seq", "N", ""))).where(F.col("covered") >= min_covered)
    m = c.groupBy(*keys).agg(F.min(F.struct((-F.col("covered")).alias("neg"), F.col("bin"))).alias("m"))
    return m.select(*keys, "m.bin", (-F.col("m.neg")).alias("covered"))


def target_genera(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """Genera a target declares and those measured for it (TAX-17): target, genus, declared, measured.

    declared: (target, name); measured: (target, identity), names separated by ';' or ',', remarks
    in brackets. A name without a genus gives none.
    """
    def genus(name):  # the first word of four letters that isn't a description
        return F.get(N.token_set(name, N.TITLE_NOISE), F.lit(0))

    own = declared.select("target", genus("name").alias("genus")).where("genus IS NOT NULL").distinct()
    seen = measured.select("target", F.explode(F.split("identity", "[;,]")).alias("part")).select(
        "target", genus(F.regexp_replace("part", "\\(.*?\\)", " ")).alias("genus")).where("genus IS NOT NULL").distinct()
    j = own.withColumn("d", F.lit(True)).join(seen.withColumn("m", F.lit(True)), ["target", "genus"], "full_outer")
    return j.select("target", "genus", F.coalesce("d", F.lit(False)).alias("declared"), F.coalesce("m", F.lit(False)).alias("measured"))
