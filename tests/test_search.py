"""Searches (group design, splitting, satellites, racing, plates, funnel), accepted writes, the stream and the table function against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ampliq.functions import tables
from ampliq.operators import binning, funnel, group_design, recovery, search, sites, splitting
from ampliq.sources import sinks
from ampliq.streaming import presence


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def places(oligo, seq, max_mm, tail):
    """(strand, start) of the sites of an oligo, both strands."""
    out = []
    for strand, pat, edge in (("+", oligo, range(len(oligo) - tail, len(oligo))), ("-", rc(oligo), range(tail))):
        for i in range(len(seq) - len(pat) + 1):
            bad = {k for k in range(len(pat)) if seq[i + k] != pat[k]}
            if len(bad) <= max_mm and not bad & set(edge):
                out.append((strand, i))
    return out


def lengths(fwd, rev, seq, rules):
    f, r = places(fwd, seq, rules.max_mm, rules.exact_tail), places(rev, seq, rules.max_mm, rules.exact_tail)
    return [(j + len(rev) - i) if s == "+" else (i + len(fwd) - j) for s, i in f for t, j in r if s != t]


def test_group_pairs_find_the_conserved_windows(spark):
    rng = random.Random(8)
    left, right = "ACGTGCTTGACCATGCAGTC", "GGATCCTAGCATGCTTGACG"
    core = left + bases(rng, 60) + right
    members = [bases(rng, 50) + core + bases(rng, 40) for _ in range(3)]
    off = 50 + 8  # one mismatch inside the left site of one member
    members.append(members[0][:off] + ("A" if members[0][off] != "A" else "C") + members[0][off + 1:])
    members.append(rc(members[1]))  # stored in reverse
    rivals = [bases(rng, 200), bases(rng, 60) + left + bases(rng, 150)]
    lone = [bases(rng, 200), bases(rng, 200)]  # a group with nothing in common
    seqs = [(i, 1, s) for i, s in enumerate(members)] + [(100 + i, None, s) for i, s in enumerate(rivals)] + [(200 + i, 2, s) for i, s in enumerate(lone)]
    rules = group_design.Rules(lengths=(20, 20), max_mm=1, tm_best=(50, 70), dtm=6.0, slices=60, keep=50)
    got = group_design.group_pairs(spark.createDataFrame(seqs, "seq_id long, grp long, seq string"), rules).collect()
    assert got and {r.grp for r in got} == {1}
    assert [r["rank"] for r in sorted(got, key=lambda r: r.penalty)][0] == 1
    for r in got:
        for s in members:
            assert any(60 <= n <= 400 for n in lengths(r.fwd, r.rev, s, rules))
        for s in rivals + lone:
            assert not any(40 <= n <= 600 for n in lengths(r.fwd, r.rev, s, rules))
        free = [not any(places(o, s, 1, 2) for s in rivals + lone) for o in (r.fwd, r.rev)]
        assert r.orphan == {(True, True): "both", (True, False): "forward", (False, True): "reverse"}[tuple(free)]
        assert r.members == 5
    served = group_design.supports(spark.createDataFrame(seqs, "seq_id long, grp long, seq string"), rules)
    assert {r.pair for r in got} <= {r.pair for r in served.collect()}


def test_masks_of_more_members_than_a_word_has_bits(spark):
    members = spark.range(130).select(F.lit(7).alias("grp"), F.col("id").alias("seq_id"))
    bits = group_design.member_bits(members)
    masks = group_design.full_masks(bits)
    assert masks.count() == 3
    reach = bits.withColumn("pair", F.lit("all")).unionByName(bits.where("seq_id <> 64").withColumn("pair", F.lit("not 64")))
    assert [r.pair for r in group_design.in_every_member(reach, masks, ["grp", "pair"]).collect()] == ["all"]


def one_by_one(members, supports, least, most):
    """The loop: take out whom most pairs are blamed on until a pair serves all who are left."""
    pool, out, number = sorted(members), {}, 1
    while pool and number <= most:
        cur, gone, done = list(pool), [], False
        while len(cur) >= least:
            blame = {}
            served = 0
            for have in supports.values():
                first = next((m for m in cur if m not in have), None)
                served += first is None
                if first is not None:
                    blame[first] = blame.get(first, 0) + 1
            if served:
                out |= {m: (number, served) for m in cur}
                pool, number, done = sorted(gone), number + 1, True
                break
            if not blame:
                break
            worst = min(blame, key=lambda m: (-blame[m], m))
            cur.remove(worst)
            gone.append(worst)
        if not done:
            break
    return {m: out.get(m, (None, 0)) for m in members}


def test_splitting_equals_the_loop(spark):
    rng = random.Random(3)
    groups = {g: (list(range(rng.randint(1, 9))), {p: {m for m in range(9) if rng.random() < share} for p in range(rng.randint(1, 6))})
              for g, share in enumerate([0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95, 0.0])}
    members = [(g, m) for g, (ms, _) in groups.items() for m in ms]
    supports = [(g, p, m) for g, (ms, ps) in groups.items() for p, have in ps.items() for m in have if m in ms]
    got = splitting.split_groups(spark.createDataFrame(members, "grp int, member int"), spark.createDataFrame(supports, "grp int, pair int, member int"), 2, 20).collect()
    assert sorted((r.grp, r.member) for r in got) == sorted(members)
    for g, (ms, ps) in groups.items():
        real = {p: have & set(ms) for p, have in ps.items() if have & set(ms)}
        assert {r.member: (r.set_no, r.pairs) for r in got if r.grp == g} == one_by_one(ms, real, 2, 20), g


def taken_in_turn(bins, hits, sampled, share):
    chosen, out = [], {}
    for b in bins:
        votes = {}
        for q in {h[1] for h in hits if h[0] == b}:
            mine = [(-h[3], h[2]) for h in hits if h[0] == b and h[1] == q and h[2] in chosen]
            if mine:
                votes[min(mine)[1]] = votes.get(min(mine)[1], 0) + 1
        out[b] = bool(votes) and max(votes.values()) >= share * sampled[b]
        if not out[b]:
            chosen.append(b)
    return out


def test_satellites_in_order_of_choice(spark):
    chain = [(f"b{k:02d}", 0, f"b{k - 1:02d}", 0.99) for k in range(1, 50)]  # each sits on the one before: every other one is chosen
    rng = random.Random(6)
    names = [f"r{k:02d}" for k in range(25)]
    loose = [(names[k], q, names[rng.randrange(25)], rng.choice([0.97, 0.98, 0.99])) for k in range(25) for q in range(6) for _ in range(3)]
    loose = [h for h in {(b, q, c): (b, q, c, i) for b, q, c, i in loose if b != c}.values()]
    bins = [("chain", f"b{k:02d}", k + 1) for k in range(50)] + [("loose", n, k + 1) for k, n in enumerate(names)]
    sampled = [("chain", f"b{k:02d}", 1) for k in range(50)] + [("loose", n, 6) for n in names]
    rows = [("chain", b, q, c, i) for b, q, c, i in chain] + [("loose", b, q, c, i) for b, q, c, i in loose]
    got = {(r.barcode, r.bin): r.satellite for r in binning.settle_satellites(
        spark.createDataFrame(bins, "barcode string, bin string, place int"), spark.createDataFrame(rows, "barcode string, bin string, q int, centre string, identity double"),
        spark.createDataFrame(sampled, "barcode string, bin string, sampled int"), 0.5).collect()}
    assert [got["chain", f"b{k:02d}"] for k in range(50)] == [k % 2 == 1 for k in range(50)]
    want = taken_in_turn(names, loose, dict.fromkeys(names, 6), 0.5)
    assert {b: s for (c, b), s in got.items() if c == "loose"} == want and any(want.values())


def test_race_has_the_winners_of_a_full_measurement(spark):
    rng = random.Random(1)
    rows = [(t, t * 100_000 + i, rng.random()) for t in range(4) for i in range(3000)]
    reads = spark.createDataFrame(rows, "target int, read_id long, x double")
    cands = spark.createDataFrame([(t, c, (c * (t + 3) % 20) / 20) for t in range(4) for c in range(20)], "target int, cand int, p double")

    def measure(r, c):
        return r.join(c, "target").groupBy("target", "cand").agg(F.count_if(F.col("x") < F.col("p")).alias("k"), F.count(F.lit(1)).alias("n"))

    full = {r.target: r.cand for r in search.race(reads, cands, measure, depth=10_000, z=50.0).collect()}
    got = search.race(reads, cands, measure, depth=200, z=3.0).collect()
    assert {r.target: r.cand for r in got} == full
    assert all(r.kept < r.raced and r.rows_read < r.rows_in_full / 2 for r in got)


def test_plates_equal_brute_force_over_the_seeds(spark):
    rng = random.Random(2)
    targets = [(i, rng.randint(60, 160), rng.choice([58.0, 59.0, 61.0]), rng.randrange(3)) for i in range(18)] + [(99, 100, 40.0, 1)]
    plates = [(0, 54.0), (1, 55.5), (2, 57.0)]

    def clash(where):
        return sum(1 for a in targets for b in targets if a[0] < b[0] and where[a[0]] == where[b[0]] and abs(a[1] - b[1]) < 10)

    may = {t[0]: sorted(p for p, ta in plates if ta <= t[2] - 3 + 0.6) or [t[3]] for t in targets}
    now, best = {t[0]: t[3] for t in targets}, None
    for seed in range(120):
        where = {t: m[int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest()[:8], 16) % len(m)] for t, m in may.items()}
        sizes = [sum(1 for x in where.values() if x == p) for p, _ in plates]
        if min(sizes) >= 2 and max(sizes) <= len(targets) // 2 + 2:
            best = min(best, (clash(where), seed, where)) if best and best[:2] != (clash(where), seed) else best or (clash(where), seed, where)
    got = search.assign_plates(spark.createDataFrame(targets, "target long, bp int, tm_min double, plate long"), spark.createDataFrame(plates, "plate long, ta double"), 120, chunk=500).collect()
    assert {(r.before, r.after, r.seed) for r in got} == {(clash(now), best[0], best[1])} and best[0] < clash(now)
    assert {r.target: r.proposed for r in got} == best[2]
    same = search.assign_plates(spark.createDataFrame(targets[:4], "target long, bp int, tm_min double, plate long"), spark.createDataFrame(plates, "plate long, ta double"), 5).collect()
    assert all(r.seed is None and r.plate == r.proposed for r in same)  # four targets can't fill three plates


def test_funnel_counts_what_it_cuts(spark):
    rng = random.Random(4)
    back = spark.createDataFrame([(1, bases(rng, 300)), (2, bases(rng, 260))], "target long, seq string")
    reads = back.select(F.col("target").alias("read_id"), "seq").where("read_id = 1")
    rules = group_design.Rules(lengths=(20, 20), max_mm=0)
    chosen, f = funnel.design_funnel(back, reads, rules, per_cell=2, to_sample=9, keep=4)
    t = f.table(spark).orderBy("step").collect()
    assert [r.stage for r in t][0] == "windows" and t[0].rows_out == 2 * (281 + 241)
    assert all(a.rows_out == b.rows_in and b.cut == b.rows_in - b.rows_out for a, b in zip(t, t[1:], strict=False))
    assert t[-1].rows_out == chosen.count() <= 4 and {r.target for r in chosen.collect()} <= {1}


def test_routes_leave_what_others_took(spark):
    rates = spark.createDataFrame([(1, "a", 90, 100), (1, "x", 0, 400), (2, "a", 30, 100), (2, "x", 20, 400), (3, "a", 80, 100), (3, "b", 79, 100), (3, "c", 2, 100), (3, "x", 1, 900), (4, "w", 50, 100)],
                                  "target int, bin string, k long, n long")
    roles = spark.createDataFrame([(1, "a", "member"), (1, "x", "competitor"), (2, "a", "member"), (2, "x", "competitor"), (3, "a", "member"), (3, "b", "member"), (3, "c", "member"), (3, "x", "competitor"), (4, "w", "member"), (5, "z", "member")],
                                  "target int, bin string, role string")
    near = spark.createDataFrame([(3, "a", "b", 99.4), (3, "b", "c", 95.0)], "target int, a string, b string, identity double")
    targets = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, True)], "target int, universal boolean")
    got = {r.target: (r.route, r.outcome) for r in recovery.recover(targets, rates, roles, near).collect()}
    assert got == {2: (4, "equivalent"), 3: (2, "passes"), 4: (1, "fails"), 5: (None, "waits for a new design")}


def test_refused_output_never_shows(spark, tmp_path):
    good = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    path = str(tmp_path / "out")
    sinks.write_accepted(good, path, 1, ["name"], {"positive": "id > 0"})
    for bad in (good.limit(0), good.withColumn("name", F.lit(None).cast("string")), good.withColumn("id", -F.col("id"))):
        with pytest.raises(sinks.Refused):
            sinks.write_accepted(bad, path, 1, ["name"], {"positive": "id > 0"})
    assert sorted(map(tuple, sinks.read_accepted(spark, path).collect())) == [(1, "x"), (2, "y")]


def test_reads_of_two_batches_count_once(spark, tmp_path):
    f, r = "ACGTTGCATGGATCCATGCA", "GGCATTACGATTACGATCAG"
    amp = f + "ACCA" * 20 + rc(r)
    p = spark.createDataFrame([("x", f, r)], "pair string, fwd string, rev string")
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def run(ids):
        spark.createDataFrame([(i, "b", "l", amp) for i in ids], presence.READ_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        presence.start_presence(presence.read_stream(spark, source, 1), p, out, ck).awaitTermination(180)
        return {(t["pair"], t["bin"]): t["k"] for t in presence.totals(spark, out).collect()}

    assert run([1, 2, 2]) == {("x", "b"): 2}
    assert run([2, 3]) == {("x", "b"): 3}  # a restart: 2 was counted before


def test_table_function_from_sql(spark):
    rng = random.Random(7)
    primer = "ACGTTGCATGGATCCATGCA"
    rows = [(i, bases(rng, 60) + (primer if i % 3 else rc(primer)) + bases(rng, 50)) for i in range(9)] + [(20, None), (21, "ACG"), (22, "N" * 40)]
    tables.register(spark)
    d = spark.createDataFrame(rows, "id long, seq string")
    got = spark.sql("SELECT d.id, s.strand, s.start FROM {d} d, LATERAL sites(d.seq, :p, 1) s", args={"p": primer}, d=d).collect()
    assert sorted(map(tuple, got)) == sorted((i, *at) for i, s in rows if s for at in places(primer, s, 1, 2))
    assert spark.sql("SELECT count(*) AS n FROM sites(NULL, 'ACGT', 1)").first().n == 0


def test_panels_of_any_size(spark):
    rng = random.Random(9)
    reads = [(i, bases(rng, 120)) for i in range(12)]
    panel = [(f"p{k}", bases(rng, 20)) for k in range(7488)]
    panel += [(f"q{i}-{a}", s[a:a + 20]) for i, s in reads for a in (5, 90)]
    pats = spark.createDataFrame(panel, "pair string, fwd string").select("pair", "fwd", F.col("fwd").alias("rev"))
    pats = sites.patterns(pats)
    assert pats.count() > 30_000
    r = spark.createDataFrame(reads, "read_id long, seq string")
    keys = ["read_id", "pair", "strand", "side", "start", "mm"]
    whole = sites.scan_sites(r, pats, 1, block=40_000).select(*keys)
    grid = sites.scan_sites(r, pats, 1, block=4_000, share=5).select(*keys)
    got = sorted(map(tuple, grid.collect()))
    assert got == sorted(map(tuple, whole.collect())) and {x[1] for x in got} >= {f"q{i}-5" for i, _ in reads}


def test_packed_kmers_are_the_kmers():
    from ampliq.operators import kmers
    rng = random.Random(11)
    code = {c: i for i, c in enumerate("ACGT")}

    def number(word):
        n = 0
        for c in word:
            n = n * 4 + code[c]
        return n

    for k in (1, 2, 3, 7, 15, 16, 21, 31):
        for n in (0, k - 1, k, k + 1, 90):
            s = "".join(rng.choice("ACGTACGTACGTACGTACGTN") for _ in range(n))
            words = [s[i:i + k] for i in range(n - k + 1) if "N" not in s[i:i + k]]
            fwd, rev = kmers.pack(s.encode(), k)
            assert fwd.tolist() == [number(w) for w in words] and rev.tolist() == [number(rc(w)) for w in words], (k, s)


def test_profile_and_markers_on_odd_reads(spark):
    from ampliq.operators import kmers
    rows = [(1, "a", "ACGTACGTACGG"), (2, "a", "ACGTACGTTTTT"), (3, "b", "TTTTTTTTGCAA"), (4, "b", None), (5, "b", "ACG"), (6, None, "GGGGGGGGGGGG")]
    d = spark.createDataFrame(rows, "read_id long, library string, seq string")
    want = {}
    for i, _, s in rows:
        words = [s[j:j + 5] for j in range(len(s) - 4)] if s else []
        if words:
            want[i] = (len(words), len(set(words)), len({min(w, rc(w)) for w in words}))
    assert {r.read_id: (r.n_kmers, r.distinct_kmers, r.canonical_kmers) for r in kmers.profile(d, 5).collect()} == want
    sets = {i: {s[j:j + 5] for j in range(len(s) - 4)} if s else set() for i, _, s in rows}
    owners = {}
    for i, g, _ in rows:
        for w in sets[i]:
            owners.setdefault(w, set()).add(g)
    marks = {g: {w for w, o in owners.items() if o == {g}} for g in ("a", "b", None)}
    best = {i: len(sets[i] & marks[g]) / min(len(marks[g]), len(sets[i])) for i, g, _ in rows if sets[i] and marks[g]}
    got = {r.read_id: (r.grp, round(r.share, 9)) for r in kmers.assign_by_markers(d, 5, "library", 0.3).collect()}
    assert got == {i: (g, round(best[i], 9)) for i, g, _ in rows if best.get(i, 0) >= 0.3}
