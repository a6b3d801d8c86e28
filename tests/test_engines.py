"""Equal results from different plans and from brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ampliq.functions import alphabet as ab
from ampliq.operators import graph as G
from ampliq.operators import products, sites
from ampliq.operators import similarity as A
from ampliq.skew import salted_join


def rc(s):
    return "".join(ab.complement_code(c) for c in reversed(s))


def make_reads(rng, n=60, primers=()):
    out = []
    for i in range(n):
        s = [rng.choice("ACGT") for _ in range(rng.randint(5, 300))]
        for p in primers:
            if len(s) > 120 and rng.random() < 0.6:
                q = [rng.choice(ab.IUPAC[c]) for c in (p if rng.random() < 0.5 else rc(p))]
                for _ in range(rng.randint(0, 3)):
                    q[rng.randrange(len(q))] = rng.choice("ACGTN")
                at = rng.randrange(len(s) - len(q))
                s[at:at + len(q)] = q
        out.append((i, "".join(s)))
    return out


def brute(reads, pats, max_mm, tail):
    got = set()
    for rid, s in reads:
        for pair, strand, side, p in pats:
            for i in range(len(s) - len(p) + 1):
                bad = [k for k in range(len(p)) if s[i + k] not in ab.IUPAC[p[k]]]
                edge = range(len(p) - tail, len(p)) if side == "L" else range(tail)
                if len(bad) <= max_mm and not set(bad) & set(edge):
                    got.add((rid, pair, strand, side, i, len(bad)))
    return got


@pytest.mark.parametrize("max_mm", [0, 1, 3])
def test_seeded_scan_and_brute_agree(spark, max_mm):
    rng = random.Random(max_mm)
    prim = [("a", "ACGTTGCAYGGATCCATG", "GGCATTACGRTTACGATCA"), ("b", "TTGACCANTGACCATGACC", "CATGCATTTGGACCATNGC")]
    reads = make_reads(rng, primers=[x for p in prim for x in p[1:]])
    r = spark.createDataFrame(reads, "read_id long, seq string")
    p = spark.createDataFrame(prim, "pair string, fwd string, rev string")
    pats = sites.patterns(p)
    want = brute(reads, [(x["pair"], x["strand"], x["side"], x["pattern"]) for x in pats.collect()], max_mm, 2)
    keys = ["read_id", "pair", "strand", "side", "start", "mm"]
    seeded = {tuple(x) for x in sites.seeded_sites(r, p, max_mm).select(*keys).collect()}
    scanned = {tuple(x) for x in sites.scan_sites(r, pats, max_mm).select(*keys).collect()}
    assert seeded == want and scanned == want
    if max_mm:
        assert want


def test_primer_outside_bounds_is_refused(spark):
    r = spark.createDataFrame([(1, "ACGT" * 20)], "read_id long, seq string")
    p = spark.createDataFrame([("x", "ACGTACGTACGTACGT", "ACGTACGTACGTACGTACGT")], "pair string, fwd string, rev string")
    with pytest.raises(Exception, match="outside the declared bounds"):
        sites.seeded_sites(r, p, 1).collect()


def test_overhang_bindings(spark):
    rng = random.Random(5)
    oligo = "ACGTTGCATGGATCCATGCA"
    reads = [(0, oligo[6:] + "TTTTTTTTTTTT"), (1, "GG" + oligo + "AC"), (2, "AAAA" + rc(oligo)[:15]), (3, oligo[10:] + "ACGTACGT")]
    reads += make_reads(rng, 30, [oligo])[:30] and [(10 + i, s) for i, s in make_reads(rng, 30, [oligo])]
    want = set()
    for rid, s in reads:
        for orient, t in (("+", s), ("-", rc(s))):
            for end in range(5, len(t) + 1):
                start = end - len(oligo)
                j0 = max(0, -start)
                if len(oligo) - j0 < 12:
                    continue
                bad = [j for j in range(j0, len(oligo)) if t[start + j] != oligo[j]]
                if len(bad) <= 3 and sum(j >= 15 for j in bad) <= 1 and not any(j >= 18 for j in bad):
                    want.add((rid, orient, end - 1, len(bad)))
    o = spark.createDataFrame([("o", oligo)], "oligo_id string, oligo string")
    got = {(x["read_id"], x["orient"], x["end3"], x["mm"]) for x in sites.oligo_bindings(
        spark.createDataFrame(reads, "read_id long, seq string"), o).collect()}
    assert got == want and {0, 1, 2} <= {x[0] for x in got}


def test_products_on_both_strands(spark):
    f, r = "ACGTTGCATGGATCCATGCA", "GGCATTACGATTACGATCAG"
    amp = "T" * 10 + f + "ACCA" * 20 + rc(r) + "G" * 7
    reads = [(1, amp), (2, rc(amp)), (3, "A" + amp[:15] + ("A" if amp[15] != "A" else "C") + amp[16:]), (4, amp.replace(f, f[:-1] + "T" if f[-1] != "T" else f[:-1] + "C"))]
    rd = spark.createDataFrame(reads, "read_id long, seq string")
    p = spark.createDataFrame([("x", f, r)], "pair string, fwd string, rev string")
    pr = products.products(sites.seeded_sites(rd, p, 1), 60, 400)
    best = {x["read_id"]: (x["strand"], x["bp"], x["mm"]) for x in products.best_products(pr).collect()}
    assert best == {1: ("+", 120, 0), 2: ("-", 120, 0), 3: ("+", 120, 1)}
    cut = {x["read_id"]: x["product"] for x in products.excise(products.best_products(pr), rd).collect()}
    assert cut[1] == cut[2] == amp[10:130]


def test_infix_distance_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        q = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 15)))
        t = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(q, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d or c == "N"), row[j] + 1, new[j - 1] + 1))
            row = new
        assert A.infix_distance(q, t) == min(row)


@pytest.mark.parametrize("hot", [5, None])
def test_components_with_a_hub(spark, hot):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {n: find(n) for e in edges for n in e}
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    got = {r["node"]: r["component"] for r in G.components(e, nodes, task_rows=hot).collect()}
    assert got == want


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)] + [(9, 1)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (5, "d")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, salted_join(left, right, ["k"], how, task_rows=50).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect()))


def test_set_match_against_brute_force(spark):
    rng = random.Random(8)
    sets = {i: {0} | {rng.randrange(1, 12) for _ in range(rng.randint(1, 6))} for i in range(40)}
    rows = [(k, m) for k, s in sets.items() for m in s]
    d = spark.createDataFrame(rows, "a long, member long")
    reps = {min(k for k in sets if sets[k] == s) for s in sets.values()}
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = {(r["a"], r["b"]) for r in G.set_match(d, d.withColumnRenamed("a", "b"), same=True).collect()}
    assert got == want and want
    assert {r["a"]: r["representative"] for r in G.set_classes(d, "a").collect()} == {a: min(k for k in sets if sets[k] == sets[a]) for a in sets}


def test_systematic_sample_with_an_outlier(spark):
    from ampliq.operators import ranking
    d = spark.createDataFrame([("k", i) for i in range(2000)] + [("k", 10**12), ("j", 5)], "key string, pos long")
    got = sorted((r["key"], r["pos"]) for r in ranking.systematic_sample(d, ["key"], "pos", 10).collect())
    assert got == sorted([("k", p) for i, p in enumerate([*range(2000), 10**12]) if i % 200 == 0] + [("j", 5)])


def test_global_scan_counts_each_record_once(spark):
    f, r = "ACGTTGCATGGATCCATGCA", "GGCATTACGATTACGATCAG"
    amp = f + "ACCA" * 20 + rc(r)
    bad = amp[:19] + ("A" if amp[19] != "A" else "C") + amp[20:]  # terminal 3' mismatch still counts here
    reads = [(1, amp), (2, bad), (3, amp + "TTTTT" + amp), (4, "ACGT" * 40)]
    rd = spark.createDataFrame(reads, "read_id long, seq string")
    p = spark.createDataFrame([("x", f, r)], "pair string, fwd string, rev string")
    cls = spark.createDataFrame([(1, "in"), (2, "same_domain"), (3, "unknown"), (4, "in")], "read_id long, class string")
    s = sites.scan_sites(rd, sites.patterns(p), 5, exact_tail=0)
    counts, rows = products.global_scan(s, cls, 60, 400, 5)
    got = counts.first()
    assert (got["n_in"], got["n_same"], got["n_unknown"], got["off_clade"]) == (1, 1, 1, 1)
    assert sorted(x["read_id"] for x in rows.collect()) == [1, 2, 3]


def test_command_line(spark, tmp_path, capsys):
    from ampliq.__main__ import main
    assert main(["list"]) == 0 and "primer_sites_mm1" in capsys.readouterr().out
    assert main(["run", "length_class", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_alignment_goes_through_the_whole_short_list(spark, monkeypatch):
    from ampliq.plans import similarity as P
    rng = random.Random(12)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    query = base(200)
    recs = [(k, "decoy", query[:60] + base(45)) for k in range(220)] + [(1000 + k, "other", base(150)) for k in range(400)] + [(999, "winner", base(10000) + query + base(10000))]
    monkeypatch.setattr(P, "_queries", lambda s, sf: s.createDataFrame([(1, query)], "query_id long, seq string"))
    monkeypatch.setattr(P, "_records", lambda s, sf: s.createDataFrame(recs, "rec_id long, header string, seq string"))
    got = {r["rank"]: r for r in P.infix_alignment(spark, "").collect()}
    assert sorted(got) == list(range(1, 11))
    assert got[1].rec_id == 999 and got[1].identity == 100 and got[1].seed_rank > 200 and got[1].late_winner
    seen = []
    monkeypatch.setattr(P.A, "discriminating_window", lambda best, q, r: seen.extend(x.rec_id for x in best.collect()))
    P.discriminating_window(spark, "")
    assert len(seen) == 8 and 999 in seen


def test_only_positions_with_a_seed_leave_the_reads(spark):
    rng = random.Random(13)
    reads = [(str(i), "".join(rng.choice("ACGT" * 10 + "N") for _ in range(rng.randint(0, 300)))) for i in range(40)] + [("x", "AC\u00e9GT" * 30), ("y", ""), ("z", None), (None, "ACGTTGCATGGATCCATGCA" * 3)]
    df = spark.createDataFrame(reads, "read_id string, seq string")
    for k in (4, 10, 18):
        kmers = sorted({s[p:p + k] for _, s in reads if s for p in range(0, len(s) - k + 1, 40)} - {""})
        kmers = [w for w in kmers if set(w) <= set("ACGT")][:30]
        seeds = spark.createDataFrame([(w,) for w in kmers], "kmer string").selectExpr("cast(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS long) word")
        want = {(i, len(s), p, (("N" * 20 + s + "N" * 20)[p:p + 40]).replace("\u00e9", "N")) for i, s in reads if s for p in range(len(s) - k + 1) if s[p:p + k] in kmers}
        rows = sites.seed_positions(df, seeds, k, 20, 20).collect()
        assert {(r.read_id, r.seq_len, r.pos, r.context) for r in rows} == want and len(rows) == len(want) and want
    p = spark.createDataFrame([("o", "ACGTTGCATGGATCCATGCA", "TGCATGGATCCATGCAACGT")], "pair string, fwd string, rev string")
    assert "Generate explode_outer" not in sites.seeded_sites(df, p, 1)._jdf.queryExecution().optimizedPlan().toString()
