"""Work that is settled where a row lies: equal to loops, and nothing but its results is shuffled."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ampliq.functions import alphabet as ab
from ampliq.operators import group_design as G
from ampliq.operators import kmers as K
from ampliq.operators import similarity as A
from ampliq.operators import sites
from ampliq.plans import REGISTRY, recovery


def sequences(rng, ids, most=200, letters="ACGT"):
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))) for i in ids]


def test_unique_profile(spark):
    rows = sequences(random.Random(1), [1, 2, 3, 3, 4, None, None], letters="AACGTN")
    want = {}
    for key in {i for i, _ in rows}:
        n = Counter(s[p:p + 4] for i, s in rows if i == key for p in range(len(s) - 3))
        at = [p for i, s in rows if i == key for p in range(len(s) - 3) if n[s[p:p + 4]] == 1 and "N" not in s[p:p + 4]]
        if at:
            want[key] = (len(at), sum(at))
    df = K.unique_profile(spark.createDataFrame(rows, "read_id long, seq string"), 4)
    assert {r.read_id: (r.unique_kmers, r.pos_sum) for r in df.collect()} == want and {3, None} <= set(want)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_containment_of_packed_sets(spark, monkeypatch, limit):
    monkeypatch.setattr(K, "BROADCAST_KMERS", limit)
    rng = random.Random(2)
    a, b = sequences(rng, [1, 2, 3, None], 60), sequences(rng, [7, 8, 8, 9, 10, None], 300)
    b += [(11, a[0][1] + "TTT"), (12, a[1][1][:30]), (12, a[2][1])]

    def sets(rows):
        out = {}
        for i, s in rows:
            out.setdefault(i, set()).update(s[p:p + 5] for p in range(len(s) - 4))
        return {i: x for i, x in out.items() if i is not None and x}

    want = {(i, j, len(x & y)) for i, x in sets(a).items() for j, y in sets(b).items() if x & y and len(x & y) / min(len(x), len(y)) >= 0.3}
    left = K.packed_sets(spark.createDataFrame(a, "a long, seq string"), 5, "a").withColumnRenamed("n", "na")
    right = K.packed_sets(spark.createDataFrame(b, "b long, seq string"), 5, "b").withColumnRenamed("n", "nb")
    got = K.containment(left, right, 0.3)
    assert {(r.a, r.b, r.shared) for r in got.collect()} == want and {11, 12} <= {j for _, j, _ in want}


@pytest.mark.parametrize("max_mm", [0, 1, 2, 3, 5])
def test_pattern_index_equals_loops(max_mm, monkeypatch):
    rng = random.Random(max_mm)
    for held in (64, 1 << 20):
        monkeypatch.setattr(sites, "HELD", held)
        pats = [(f"p{j}", rng.choice("+-"), rng.choice("LR"), "".join(rng.choice("ACGTACGTACGTR" if j % 4 == 0 else "ACGT") for _ in range(rng.choice([6, 18, 20, 25, 34])))) for j in range(12)]
        reads = []
        for i, s in sequences(rng, range(30), 120, "ACGTACGTACGTN"):
            p = rng.choice(pats)[3].replace("R", "G")
            for _ in range(rng.randint(0, max_mm)):
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("ACGTN") + p[at + 1:]
            reads.append((i, s[:40] + p + s[40:]))
        want = set()
        for rid, s in reads:
            for pair, strand, side, p in pats:
                for i in range(len(s) - len(p) + 1):
                    bad = [k for k in range(len(p)) if s[i + k] not in ab.IUPAC[p[k]]]
                    edge = (len(p) - 2, len(p) - 1) if side == "L" else (0, 1)
                    if len(bad) <= max_mm and not set(bad) & set(edge):
                        want.add((rid, pair, strand, side, i, len(bad)))
        got = sites._scan(pd.DataFrame(reads, columns=["read_id", "seq"]), sites.PatternIndex(pats, max_mm, 2))
        rows = list(got[["read_id", "pair", "strand", "side", "start", "mm"]].itertuples(index=False, name=None))
        assert set(rows) == want and len(rows) == len(want) and want


def test_pattern_index_compares_few_windows(monkeypatch):
    rng = random.Random(3)
    pats = [(f"p{j}", "+", "L", "".join(rng.choice("ACGT") for _ in range(20))) for j in range(200)]
    index = sites.PatternIndex(pats, 5, 0)
    # of 4^10 words each half of a pattern is within two letters of 436
    assert sum(ids.size for _, ids, _ in index.tables.values()) == 2 * 200 * 436


def test_tolerant_searches_join_no_seeds(spark):
    oligo = "ACGTTGCATGGATCCATGCA"
    reads = spark.createDataFrame([(1, "GG" + oligo + "AC"), (2, oligo[6:] + "TTTTTTTTTTTT"), (3, "GG" + oligo[:3] + "N" + oligo[4:])], "read_id long, seq string")
    got = sites.oligo_bindings(reads, spark.createDataFrame([("o", oligo)], "oligo_id string, oligo string"))
    assert {(r.read_id, r.orient, r.end3, r.mm) for r in got.collect()} >= {(1, "+", 21, 0), (2, "+", 13, 0), (3, "+", 21, 1)}
    assert "Join" not in got._jdf.queryExecution().toString()
    p = spark.createDataFrame([("o", "+", "L", oligo), ("r", "+", "R", oligo)], "pair string, strand string, side string, pattern string")
    s = sites.scan_sites(reads, p, 3, 2, keep_positions=True).collect()
    assert {(r.read_id, r.pair, r.start, r.seq_len, tuple(r.from_3prime)) for r in s} == {
        (1, "o", 2, 24, ()), (1, "r", 2, 24, ()), (3, "o", 2, 22, (17,)), (3, "r", 2, 22, (4,))}


def test_oligos_outside_bounds_are_refused(spark):
    reads = spark.createDataFrame([(1, "ACGT" * 20)], "read_id long, seq string")
    with pytest.raises(Exception, match="outside the declared bounds"):
        sites.oligo_bindings(reads, spark.createDataFrame([("o", "ACGTACGTACGT")], "oligo_id string, oligo string")).collect()


def test_regenerated_gate_keeps_one_base_per_letter(spark, tmp_path):
    from ampliq.plans import REGISTRY
    spark.createDataFrame([(1, "A\u00dfxx"), (2, "Axxxx"), (3, "aCgt"), (4, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.reason for r in REGISTRY["regenerated_gate"].run(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: "too_many_n", 3: None}


def test_systematic_sample_reads_one_set_of_bounds(spark):
    from ampliq.operators import ranking
    rows = [("k", i) for i in range(2000)] + [(None, i) for i in range(40)]
    got = ranking.systematic_sample(spark.createDataFrame(rows, "key string, pos long"), ["key"], "pos", 10)
    # the bounds depend on the order of merging: computed once for each use, they may differ
    assert "percentile_approx" not in got._jdf.queryExecution().toString()
    assert {(r.key, r.pos) for r in got.collect()} == {("k", i) for i in range(0, 2000, 200)} | {(None, i) for i in range(0, 40, 4)}


def test_small_groups_split_as_in_rounds(spark):
    from ampliq.operators import splitting
    rng = random.Random(4)
    members = [(g, m) for g in ("a", "b", "c", "d") for m in range(rng.randint(1, 8))]
    have = [(g, p, m) for g, m in members for p in range(5) if g != "d" and rng.random() < 0.6]
    args = spark.createDataFrame(members, "grp string, member int"), spark.createDataFrame(have, "grp string, pair int, member int")
    rows = [sorted(tuple(r) for r in x.select("grp", "member", "set_no", "pairs").collect()) for x in (
        splitting.split_groups(*args), splitting.split_groups(*args, cells=0), splitting.split_in_rounds(*args))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(members)


def test_kmer_rows_of_a_batch_are_held_in_parts(monkeypatch):
    monkeypatch.setattr(K, "HELD", 100)
    seqs = pa.array(["A" * 60, None, "C" * 60, "", "G" * 500, "T"])
    runs = list(K._held(seqs))
    assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(6)) and len(runs) >= 3
    assert all(hi == lo + 1 or sum(len(s.as_py() or "") for s in seqs.slice(lo, hi - lo)) <= 100 for lo, hi in runs)


def test_word_sites_equal_loops(spark):
    rng = random.Random(5)
    reads = sequences(rng, [1, 2, 3, 4, 4], 300, "ACGT" * 20 + "N") + [(None, "ACCGTTGA" * 9), (7, "ACGTR" * 9), (8, None), (9, "")]
    cut = [s[p:p + rng.choice([18, 20])] for _, s in reads if s and len(s) > 60 for p in (0, 7, 30, len(s) - 20)]
    pats = [(f"p{j}", "+-"[j % 2], "LR"[j % 2], t) for j, t in enumerate(t for t in cut if "N" not in t)] + [("code", "+", "L", "ACGTAACGTRACGTAACGTA"), ("away", "+", "L", "A" * 20)]
    want = Counter((i, pair, strand, side, a, len(t), 0) for i, s in reads if s for pair, strand, side, t in pats for a in range(len(s) - len(t) + 1)
                   if all(ab.MASK[x] & (0 if y == "N" else ab.MASK[y]) for x, y in zip(t, s[a:a + len(t)])))
    df = sites.word_sites(spark.createDataFrame(reads, "read_id long, seq string").where("seq is not null"), spark.createDataFrame(pats, "pair string, strand string, side string, pattern string"), (18, 25))
    assert Counter(map(tuple, df.collect())) == want and {"code"} <= {k[1] for k in want} and {None, 7} <= {k[0] for k in want}


def test_oligo_sites_never_make_a_row_of_every_position(spark):
    rng = random.Random(6)
    seqs = spark.createDataFrame([(i, i, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(20)], "seq_id long, grp long, seq string")
    oligos = seqs.where("seq_id < 3").selectExpr("substr(seq, 50, 20) oligo")
    for mm in (0, 1):
        found = G.oligo_sites(seqs, oligos, G.Rules(lengths=(20, 20), max_mm=mm))
        assert "Generate explode_outer" not in found._jdf.queryExecution().optimizedPlan().toString() and {0, 1, 2} <= {r.seq_id for r in found.collect()}


@pytest.mark.parametrize("name, times", [("keyword_pool", 1), ("name_agreement", 2), ("taxonomy_nodes", 1), ("lineage_consensus", 1), ("dominant_lineage_depth", 2),
                                         ("single_locus_level", 1), ("locus_decisions", 1), ("multi_locus_name", 0), ("ladder_report", 1), ("nearest_organisms", 1),
                                         ("population_split", 1), ("sub_populations", 0), ("cigar_walk", 1)])
def test_long_expressions_run_once(spark, name, times):
    """The sentence or CIGAR is taken apart once per read of the table; 0 where the rows come from a written table."""
    plan = REGISTRY[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == times


def test_recovery_pairs_members_with_the_first_of_their_class(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(recovery.RC, "recover", lambda targets, rates, roles, identities: seen.update(members=roles.where("role = 'member'").count(), pairs=identities.count()))
    recovery.recovery_routes(spark, "/root/testdata/sf0.01")
    assert seen["members"] // 2 <= seen["pairs"] <= seen["members"]


def test_seed_hits_equal_loops(spark):
    rng = random.Random(8)
    rows = [(i, s) for i, s in sequences(rng, range(1, 9), 300, "ACGT" * 20 + "NR") if s] + [(9, "ACGTR" * 30), (9, "ACGTTGCA" * 9)]
    seeds = {(i % 3, s[p:p + 16]) for i, s in rows for p in range(0, len(s) - 15, 25) if "N" not in s[p:p + 16]}
    want = {(q, i, k) for i, s in rows for q, k in seeds if k in s}
    records, asked = spark.createDataFrame(rows, "rec_id long, seq string"), spark.createDataFrame(sorted(seeds), "query_id long, kmer string")
    for df in (records, records.withColumn("rec_id", records.rec_id.cast("string"))):
        got = [(r.query_id, int(r.rec_id), r.kmer) for r in A.seed_hits(df, asked).collect()]
        assert len(got) == len(want) and set(got) == want and any("R" in k for _, _, k in want)
    # only words that are seeds are written by the tasks that hold the records
    assert A.seed_hits(records, asked)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_anchored_diagonals_equal_loops(spark, monkeypatch):
    from ampliq.operators import consensus as C
    rng = random.Random(9)
    tpl = {b: "".join(rng.choice("ACGT") for _ in range(200)) for b in ("a", "b", None)}
    rows = [(b, i, (lambda s: s[rng.randrange(90):][:rng.randint(0, 110)])(tpl[b] if rng.random() < 0.7 else tpl["a"]) + rng.choice(["", "NACGR", "ACGTACGT"]) + tpl[b][:30])
            for i, b in enumerate(rng.choice(["a", "b", None]) for _ in range(60))] + [("a", None, tpl["a"]), ("a", 70, None), ("c", 71, tpl["a"]), ("b", 0, tpl["b"][40:90])]
    want = {}
    for b in ("a", "b"):
        n = Counter(tpl[b][p:p + 6] for p in range(195))
        at = {tpl[b][p:p + 6]: p for p in range(195) if n[tpl[b][p:p + 6]] == 1}
        for i in {i for c, i, _ in rows if c == b}:
            d = {}
            for c, j, s in rows:
                for p in range(len(s or "") - 5):
                    if (c, j) == (b, i) and s[p:p + 6] in at:
                        d.setdefault(at[s[p:p + 6]] - p, []).append(at[s[p:p + 6]])
            best = sorted(((-len(x), g, min(x), max(x)) for g, x in d.items() if len(x) >= 3))[:2]
            want |= {(b, i, g): (-m, lo, hi) for m, g, lo, hi in best}
    reads, t = spark.createDataFrame(rows, "bin string, read_id long, seq string"), spark.createDataFrame([(b, s) for b, s in tpl.items()], "bin string, seq string")
    for limit in (0, 1_000_000):
        monkeypatch.setattr(K, "BROADCAST_KMERS", limit)
        df = C.anchored_diagonals(reads, t, 6, "bin", "read_id", top=2)
        assert {(r.bin, r.read_id, r["diag"]): (r.hits, r.t_start, r.t_end) for r in df.collect()} == want and len(want) > 40
    assert "explode_outer" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_joined_up_where_they_lie(spark, monkeypatch):
    from ampliq.operators import graph
    rng = random.Random(10)
    for nodes, n in ((1, 0), (40, 20), (400, 380), (400, 2000), (3000, 2999)):
        edges = [(i, i + 1) for i in range(n)] if nodes == 3000 else [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
        edges = [(a * 7 - 900, b * 7 - 900) for a, b in edges]
        root = {a: a for e in edges for a in e}

        def top(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
        u, v = graph.joined_up(*(np.array([e[i] for e in edges], dtype=np.int64) for i in range(2)))
        assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {a: top(a) for a in root if top(a) != a}
        if nodes == 400:
            df = spark.createDataFrame(edges + [(None, 5), (5, None)], "a long, b long").repartition(8)
            want = {a: top(a) for a in root} | {10**9: 10**9}
            for held in (50, 1 << 20):  # in parts and as a whole; the rounds join the parts
                monkeypatch.setattr(graph, "HELD", held)
                got = graph.components(df, spark.createDataFrame([(a,) for a in want], "node long"))
                assert {r.node: r.component for r in got.collect()} == want
    star = spark.range(20000).selectExpr("id % 100 a", "100 + id % 77 b").coalesce(1)
    assert graph.contracted(star.toDF("u", "v")).count() == 176
