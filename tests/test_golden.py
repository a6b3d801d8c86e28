"""Known inputs with known verdicts."""

import pytest
from pyspark.sql import functions as F

from ampliq.functions import names as N
from ampliq.functions import predicates as X
from ampliq.functions import seq as S
from ampliq.functions import stats as M
from ampliq.operators import binning as B
from ampliq.operators import design as D
from ampliq.operators import identity as I
from ampliq.operators import lineage as L
from ampliq.operators import measure as ME
from ampliq.operators import specificity as SP


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_length_class(spark):
    got = [one(spark, X.length_class(F.lit(n), F.lit(1500))) for n in (250, 600, 1199, 1200, 1500, 1875, 1876, 2900)]
    assert got == ["short", "fragment", "fragment", "full", "full", "full", "concatemer", "concatemer"]


def test_concatemer_bins(spark):
    assert one(spark, X.is_concatemer(F.lit(2880), F.lit(1500)))
    assert one(spark, X.is_concatemer(F.lit(7400), F.lit(3700)))
    assert not one(spark, X.is_concatemer(F.lit(2400), F.lit(1500)))


def test_wilson(spark):
    assert one(spark, M.wilson_lower(F.lit(1), F.lit(10))) == pytest.approx(0.0178757, abs=1e-6)
    assert one(spark, M.wilson_lower(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, M.wilson_upper(F.lit(0), F.lit(0))) == 1.0


def test_base_match(spark):
    def m(p, t):
        return one(spark, S.base_matches(F.lit(p), F.lit(t)))
    assert not m("N", "N") and not m("A", "N")
    assert m("Y", "C") and not m("Y", "G") and m("N", "A")


def test_expand_and_revcomp(spark):
    assert sorted(one(spark, S.expand_codes(F.lit("AYR")))) == ["ACA", "ACG", "ATA", "ATG"]
    assert one(spark, S.expand_codes(F.lit("NNNN"))) is None
    assert one(spark, S.revcomp(F.lit("ACGTRYSWKMBDHVN"))) == "NBDHVKMWSRYACGT"


def paf(spark, rows):
    return spark.createDataFrame(rows, "q string, qlen int, qs int, qe int, t string, tlen int, ts int, te int, identity double")


def test_tiered_assignment(spark):
    rows = []
    def add(q, ident, t="c1", cov=1.0):
        rows.append((q, 1000, 0, int(1000 * cov), t, 1000, 0, 1000, ident))
    add("a", 0.98)
    add("b", 0.96); add("b", 0.93, "c2")
    add("c", 0.96); add("c", 0.95, "c2")
    add("d", 0.99, cov=0.80)
    add("e", 0.94)
    got = {r["q"] for r in B.tiered_assignment(paf(spark, rows)).collect()}
    assert got == {"a", "b"}
    assert {r["q"] for r in B.tiered_assignment(paf(spark, rows), tiered=False).collect()} == {"a"}


def test_segments(spark):
    rows = [("two", 3000, 0, 1500, "c", 1500, 0, 1500, 0.98), ("two", 3000, 1500, 3000, "c", 1500, 0, 1500, 0.98),
            ("over", 3000, 0, 1500, "c", 1500, 0, 1500, 0.99), ("over", 3000, 1000, 2500, "c", 1500, 0, 1500, 0.98),
            ("chain", 3100, 0, 3090, "c", 1500, 0, 1500, 0.98), ("short", 1500, 0, 1000, "c", 1500, 0, 1000, 0.99)]
    got = [(r["q"], r["qs"]) for r in B.segments(paf(spark, rows), 0.97).collect()]
    assert sorted(got) == [("over", 0), ("two", 0), ("two", 1500)]


def test_satellite(spark):
    def hits(b, per_centre, cover=1.0):
        return [(b, f"{b}{c}{i}", c, 0, int(1000 * cover), 1000, 0.98) for c, n in per_centre.items() for i in range(n)]
    rows = hits("s", {"c1": 31}) + hits("n", {f"c{i}": 15 for i in range(4)}) + hits("l", {"c1": 60}, cover=0.7)
    df = spark.createDataFrame(rows, "bin string, q string, t string, ts int, te int, tlen int, identity double")
    size = spark.createDataFrame([("s", 60), ("n", 60), ("l", 60)], "bin string, sampled int")
    assert [(r["bin"], r["parent"]) for r in B.satellite_parent(df, size).collect()] == [("s", "c1")]


def hits(spark, rows):
    return spark.createDataFrame(rows, "k string, locus string, identity double, aligned int, header string, record_len int")


def test_locus_tie(spark):
    h = hits(spark, [
        ("near", "ITS", 100.0, 700, "X1 g;Petriella sp", None), ("near", "ITS", 99.8, 700, "X2 Petriella setifera strain", None),
        ("far", "ITS", 100.0, 700, "X1 g;Petriella sp", None), ("far", "ITS", 99.4, 700, "X2 Petriella setifera strain", None)])
    got = {r["k"]: r["name"] for r in I.locus_decision(h, ["k"], F.lit("ITS")).collect()}
    assert got == {"near": "Petriella setifera", "far": "Petriella sp."}


def test_rival_and_short(spark):
    h = hits(spark, [
        ("rival", "SSU", 99.5, 1400, "X1 Aaa bbb x", None), ("rival", "SSU", 99.3, 1400, "X2 Aaa ccc x", None),
        ("short", "SSU", 99.5, 600, "X1 Aaa bbb x", 1500), ("whole", "SSU", 99.5, 600, "X1 Aaa bbb x", 620),
        ("weak", "SSU", 99.9, 200, "X1 Aaa bbb x", None), ("low", "SSU", 90.0, 1400, "X1 Aaa bbb x", None)])
    got = {r["k"]: r["name"] for r in I.locus_decision(h, ["k"], F.lit("SSU")).collect()}
    assert got == {"rival": "Aaa cf. bbb", "short": "Aaa sp.", "whole": "Aaa bbb", "weak": "cannot be named", "low": "cannot be named"}


OUT = "acc|18S_rRNA|nucleus|strain|Eukaryota|TSAR|Parakahliella_macrostoma"


def test_kingdom_gate(spark):
    h = hits(spark, [
        ("open", "18S", 99.65, 1725, OUT, None), ("open", "18S", 87.78, 1700, "A Inocybe x", None),
        ("close", "18S", 99.65, 1725, OUT, None), ("close", "18S", 99.0, 1700, "A Inocybe x", None),
        ("low", "18S", 94.0, 1725, OUT, None), ("tiny", "18S", 99.65, 120, OUT, None), ("its", "ITS", 99.65, 1725, OUT, None)])
    got = I.kingdom_gate(h, ["k"]).collect()
    assert [(r["k"], r["name"]) for r in got] == [("open", "outside kingdom: Parakahliella macrostoma")]


def test_nt_reconciliation(spark):
    rows = [("a", "Aaa bbb", 99.8, "Ccc ddd", "species", 99.9, 1400, 98.7), ("syn", "Methanosaeta concilii", 99.8, "Methanothrix soehngenii", "species", 99.9, 1400, 98.7),
            ("rank", "Aaa bbb", 99.8, "Ccc", "genus", 99.9, 1400, 98.7), ("bp", "Aaa bbb", 99.8, "Ccc ddd", "species", 99.9, 200, 98.7)]
    d = spark.createDataFrame(rows, "k string, n string, p double, nn string, nr string, np double, bp int, fl double")
    got = {r["k"]: r["x"] for r in d.select("k", I.nt_reconcile("n", "p", "nn", "nr", "np", "bp", "fl").alias("x")).collect()}
    assert got == {"a": "Aaa cf. bbb", "syn": "Methanosaeta concilii", "rank": "Aaa bbb", "bp": "Aaa bbb"}


def test_lineage_consensus_and_ranks(spark):
    d = spark.createDataFrame([("k", "A;B;C"), ("k", "A;B;C"), ("k", "A;B;D"), ("h", "A;B"), ("h", "A;C")], "k string, t string")
    got = {r["k"]: r["lineage"] for r in L.rank_consensus(d.withColumn("r", F.split("t", ";")), "k", "r", 0.51).collect()}
    assert got == {"k": "A;B;C", "h": "A"}
    assert one(spark, N.ranks(F.lit("k__A;p__B_x;uncultured bacterium;C"))) == ["A", "B x"]
    assert one(spark, N.ranks(F.lit("k__Fungi;p__X;g__Incertae sedis;s__y"))) == ["Fungi", "X"]


HEADERS = {
    "CP009514.1 Archaea;Halobacteriota;Methanosarcinaceae;Methanosarcina mazei": "Methanosarcina mazei",
    "NR_041956.1 Methanosarcina mazei strain DSM 2053": "Methanosarcina mazei",
    "AY882347|k__Fungi;p__Ascomycota;g__Petriella;s__Petriella_setifera|SH1": "Petriella setifera",
    "RS_GCF_1 d__Archaea;g__Nitrosocosmicus;s__Nitrosocosmicus sp [x=1]": "Nitrosocosmicus",
    "AB1_U|18S_rRNA|nucleus||Eukaryota|Unruhdinium|Unruhdinium_kevei": "Unruhdinium kevei",
    "ZZ1 Bacteria;Bacteroidota;Petrimonas;uncultured bacterium": "Petrimonas",
}


@pytest.mark.parametrize("header", HEADERS)
def test_organism(spark, header):
    assert one(spark, N.organism(F.lit(header))) == HEADERS[header]


def test_header_parse_and_class(spark):
    def parse(h, db):
        return one(spark, N.parse_header(F.lit(h), F.lit(db)))
    assert parse("NR_1.1 Sphingosinicella wutangchuni strain LY54", "bacteria.16S.fna")["domain"] == "Bacteria"
    assert not parse("NR_1.1 Sphingosinicella wutangchuni strain LY54", "bacteria.16S.fna")["has_taxonomy"]
    assert parse("X|k__Fungi;p__A|SH", "UNITE.fasta")["domain"] == "Eukaryota"
    assert parse("foo bar", "x.fa")["domain"] == "?"

    def cls(h, db, clade, dom):
        return one(spark, N.hit_class(N.parse_header(F.lit(h), F.lit(db)), F.array(F.lit(clade)), F.lit(dom)))
    silva = "AB1 Bacteria;Bacteroidota;Bacteroidales;Petrimonas"
    assert cls(silva, "SILVA", "Bacteroidales", "Bacteria") == "in"
    assert cls(silva, "SILVA", "Clostridia", "Bacteria") == "same_domain"
    assert cls(silva, "SILVA", "Fungi", "Eukaryota") == "other_domain"
    # an organism name alone cannot disprove membership of an order
    assert cls("NR_1 Petrimonas mucosa strain X", "bacteria.16S.fna", "Bacteroidales", "Bacteria") == "unknown"
    assert cls("AB2 Bacteria;Cyanobacteriota;Chloroplast;x", "SILVA", "Cyanobacteriota", "Bacteria") == "organelle"


def test_unnamed(spark):
    assert one(spark, N.is_unnamed(F.lit("Uncultured bacterium"))) and one(spark, N.is_unnamed(F.lit("Bacterium enrichment")))
    assert not one(spark, N.is_unnamed(F.lit("Petrimonas sulfuriphila")))
    assert one(spark, N.is_unnamed(F.lit(None).cast("string")))


def test_layers_unknown_is_never_clean(spark):
    rows = [("all", 0, 0, 0, 0), ("two", 0, 0, None, 0), ("one", 0, None, None, 0), ("none", None, None, None, 0),
            ("loose", 3, 0, 0, 0), ("clash", 0, 5, 0, 0), ("risky", 2, 5, None, 0), ("org", 0, 0, 0, 4)]
    d = spark.createDataFrame(rows, "t string, local_hits int, thermo_hits int, network_hits int, organelle int")
    got = {r["t"]: r["category"] for r in SP.merge_layers(d).collect()}
    assert got == {"all": "CERTAIN", "two": "CONDITIONAL", "one": "INCOMPLETE", "none": "INCOMPLETE", "loose": "REVIEW",
                   "clash": "CONTRADICTORY", "risky": "RISKY", "org": "REVIEW"}


def test_read_level_verdict(spark):
    d = spark.createDataFrame([("sys", 1, 1, 92.0, 92.0, 92.0, 0.0, 1.0, 1.0), ("weak", 1, 0, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0)],
                              "pair string, member_bins int, member_bins_10 int, member_min double, member_max double, pooled_mm1 double, "
                              "pooled_mm0 double, worst_competitor double, pooled_competitor double")
    got = {r["pair"]: (r["verdict"], r["systematic_mismatch"]) for r in ME.read_level_verdict(d).collect()}
    assert got == {"sys": ("PASSED", True), "weak": ("NO / WEAK PRODUCT IN MEMBERS", False)}


def test_no_competitor_is_not_measurable(spark):
    rates = spark.createDataFrame([("p", "m", 90, 100)], "pair string, bin string, k long, n long")
    mem = spark.createDataFrame([("m", "member")], "bin string, role string")
    r = ME.panel_decision(ME.separation(rates, mem)).first()
    assert r["decision"] == "NOT MEASURABLE" and r["fold_pool"] is None and r["fold_worst"] is None


def test_grid_and_arms(spark):
    assert D.grid_cells(spark).count() == 144
    p = spark.createDataFrame([("p", "ACGTACGTACGTACGTACGT")], "pair string, oligo string")
    v = D.arms_variants(p).collect()
    assert len(v) == 15 and len({x["variant"] for x in v}) == 15


def test_end_penalty(spark):
    def p(pos, pair=None):
        return one(spark, SP.end_penalty(F.array(*map(F.lit, pos)), F.lit(pair).cast("string")))
    assert p([1]) == 6.6 and p([1], "AA") == 4.3 and p([1], "TG") == 0.0
    assert p([2]) == 10.0 and p([3]) == pytest.approx(3.3) and p([12]) == 0.0 and p([1, 2, 3]) == 15.0


def test_lineage_has_no_depth_limit(spark):
    from ampliq.operators import lineage as L
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(200, 200)], "child long, parent long")
    close = L.closure(chain)
    assert close.where("node = 0").agg({"dist": "max"}).first()[0] == 200 and close.count() == 201 * 202 // 2
    with pytest.raises(ValueError):
        L.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))
    rows = spark.createDataFrame([("f", k, k % 80, k) for k in range(160)], "file string, pos long, depth int, node long")
    got = {r["node"]: r["parent"] for r in L.parents_from_order(rows, "file", "pos", "depth", "node").collect()}
    assert got == {k: (k - 1 if k % 80 else None) for k in range(160)}


def test_template_letters(spark):
    from ampliq.operators import membership as MB
    d = spark.createDataFrame([("NNRA", ""), ("RNA", "YCA"), ("ANT", "ANT"), ("RYK", "R-N")], "core string, ref string")
    assert [r[0] for r in d.select(MB.fill_codes("core", "ref")).collect()] == ["NNAA", "CCA", "ANT", "ANN"]


def test_keys_are_found_within_words_and_wildcards_are_whole(spark):
    from ampliq.operators import membership as MB
    rec = spark.createDataFrame([(1, "k__Fungi;p__Ascomycota", "A" * 9), (2, "a Candidatus foo", "A" * 9), (3, "short", "A")], "rec_id long, header string, seq string")
    keys = spark.createDataFrame([("X", "mycota"), ("X", "candidatus foo"), ("Y", "short")], "class string, key string")
    assert sorted(map(tuple, MB.keyword_pool(rec, keys, 5).collect())) == [("X", 1), ("X", 2)]
    name = "c" * 150
    rules = spark.createDataFrame([("t", "*" + name, ["b2"])], "target string, pattern string, excluded array<string>")
    bins = spark.createDataFrame([("b1", name), ("b2", name), ("b3", "d")], "bin string, class string")
    assert [tuple(r) for r in MB.expand_wildcards(rules, bins).collect()] == [("t", "b1")]


def test_clade_tokens_are_no_patterns(spark):
    from ampliq.functions import names as N
    h = spark.createDataFrame([("AB123456.1.1500 Bacteria;Bacillota;Bacillus", "SILVA_SSU.fasta")], "h string, d string").withColumn("p", N.parse_header("h", "d"))
    assert h.select(N.hit_class("p", F.array(F.lit("[Eubacterium]")), F.lit("Bacteria"))).first()[0] == "same_domain"
