"""What queries do with rows that larger tables hold, and the plans that let them grow."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from ampliq.functions import thermo as T
from ampliq.operators import design as D
from ampliq.operators import graph as G
from ampliq.operators import group_design as GD
from ampliq.operators import kmers as K
from ampliq.operators import window_design as W
from ampliq.plans import REGISTRY


def test_backbone_clusters_of_empty_and_huge_lengths(spark, tmp_path):
    rows = [("a", 9), ("a", 7), ("a", 4), ("a", 0), ("b", 0), ("c", 1 << 40), ("c", 3), ("c", None)]
    spark.createDataFrame(rows, "source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.bin: r.heads for r in REGISTRY["backbone_clusters"].run(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(oracle_sql()["backbone_clusters"]).fetchall())
    assert got == {"a": "9,4,0", "b": "0", "c": f"{1 << 40},3"}


def test_markers_travel_as_stretches(spark, monkeypatch):
    rng = random.Random(5)
    common = "".join(rng.choice("ACGT") for _ in range(80))
    rows = []
    for i in range(60):
        s = "".join(rng.choice("ACGT" * 20 + "N") for _ in range(rng.randint(0, 200))) + (common if i % 3 else "") + "A" * rng.randint(0, 40)
        rows.append((i % 50, rng.choice(["a", "b", None]), s if i % 11 else None))
    rows += [(7, *rows[7][1:]), (None, "c", common), (100, "c", common[:21] * 3), (101, "c", "ACG")]
    d = spark.createDataFrame(rows, "read_id long, library string, seq string").repartition(3, "library")
    for k in (11, 21, 31):
        sets = [(i, g, {s[j:j + k] for j in range(len(s) - k + 1) if "N" not in s[j:j + k]} if s else set()) for i, g, s in rows if i is not None]
        owners = {}
        for _, g, words in sets:
            for w in words:
                owners.setdefault(w, set()).add(g)
        want = Counter((i, len(words), sum(len(owners[w]) == 1 for w in words)) for i, _, words in sets if words)
        n, markers = K.marker_counts(d.where("read_id is not null").withColumn("g", F.xxhash64("library")), k)
        assert Counter((r.read_id, r.n_kmers, r.c) for r in n.collect()) == want
        per = Counter(next(iter(o)) for o in owners.values() if len(o) == 1)
        assert sorted(r.markers for r in markers.collect()) == sorted(per.values())

    raw = np.frombuffer("".join(rng.choice("ACGT") for _ in range(1 << 16)).encode(), dtype=np.uint8)
    start, size, word, _ = K._stretches(raw, 21)
    owner, group = np.sort(np.arange(start.size) % 7), np.array([3, 3, 3, 4, 4, 5, 5])
    assert len(K._block(np.unique(group, return_counts=True), 7, owner, size, word, 21)) < 2 * size.sum()
    whole = K._marked(group, owner, size, word, 21)
    monkeypatch.setattr(K, "SORTED", 5000)
    parts = K._marked(group, owner, size, word, 21)
    assert all((a == b).all() for a, b in zip(whole[:2], parts[:2])) and whole[2] == parts[2]


def test_members_of_sets_travel_as_digests(spark, monkeypatch):
    rng = random.Random(6)
    lines = [f"line {i} " + "x" * 500 for i in range(14)]
    sets = [{i: frozenset(rng.choice(lines[:n]) for _ in range(rng.randint(1, 9))) for i in range(50)} for n in (12, 14)]
    rows = [[(i, m) for i, s in f.items() for m in s] * 2 + [(None, m) for m in lines[:3]] for f in sets]  # repeats count once, a key is missing
    left, right = (spark.createDataFrame(r, f"{k} long, member string") for r, k in zip(rows, "ab"))
    cut, written = G.cut_lineage, []
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    reps = [{min(k for k in f if f[k] == s): s for s in f.values()} for f in sets]
    likeness = lambda x, y: len(x & y) / len(x | y)
    got = {(r.a, r.b): (r.shared, round(r.jaccard, 9)) for r in G.set_match(left, right).collect()}
    want = {(a, b): (len(x & y), round(likeness(x, y), 9)) for a, x in reps[0].items() for b, y in reps[1].items() if likeness(x, y) >= 0.8}
    assert got == want and want
    got = {(r.a, r.b) for r in G.set_match(left, left.withColumnRenamed("a", "b"), same=True).collect()}
    assert got == {(a, b) for a, x in reps[0].items() for b, y in reps[0].items() if a < b and likeness(x, y) >= 0.8}
    assert "sha2(" in written[0].split("== Final Plan")[0].rsplit("Exchange", 1)[1]  # before anything is shuffled


@pytest.mark.parametrize("part", [None, 300])
def test_exact_oligos_are_sought_after_their_group_is_asked(spark, monkeypatch, part):
    rng = random.Random(9)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    line, rows = base(70), []
    for grp in range(1, 7):
        core = base(160) + line + base(90)
        members = [base(30) + core + base(20), turn(base(10) + core), core[:100] + "N" + core[101:] + core[60:130], core]
        rows += [(10 * grp + i, grp, m) for i, m in enumerate(members)]
    rows += [(20, 2, rows[4][2]), (31, None, base(50)), (None, 4, rows[14][2]), (90, None, line + base(80)), (91, None, rows[0][2][40:110] + base(9)), (92, None, None), (13, 2, rows[5][2])]
    asked, seek = [], GD.oligo_sites
    monkeypatch.setattr(GD, "oligo_sites", lambda seqs, oligos, rules: asked.append(oligos.count()) or seek(seqs, oligos, rules))
    if part:  # values that the workers' functions don't read
        monkeypatch.setattr(GD, "PART", part)
        monkeypatch.setattr(GD, "SHARE", 2)
    rules = GD.Rules(lengths=(20, 21), max_mm=0, tm_best=(50, 70), dtm=6.0, slices=8, keep=50)
    got = {}
    for odd in (False, True):  # a letter outside of A, C, G, T and N: all candidates are sought
        d = spark.createDataFrame(rows + [(99, None, "RRR")] * odd, "seq_id long, grp long, seq string")
        got[odd] = [sorted(map(tuple, f.select(*sorted(f.columns)).collect())) for f in (GD.group_pairs(d, rules), GD.supports(d, rules))]
    assert got[False] == got[True] and all(got[False])
    assert max(asked[:2]) <= 6 * 2 * 8 < min(asked[2:]) / 4


def test_window_temperatures_are_the_rounded_ones(spark):
    rng = random.Random(10)
    seq = "".join(rng.choice("ACGT") for _ in range(1500)) + "ACGTACGTACGTACGTACGT"
    for size in (18, 20, 25):
        code, words, known = D.packed_words(seq, size)
        back = D.sites.turned(words, np.full(words.size, size))
        at = np.arange(words.size)
        texts = [seq[i:i + size] for i in at]
        rows = [(int(i), w, t) for w, ts in (("F", texts), ("R", [t[::-1].translate(str.maketrans("ACGT", "TGCA")) for t in texts])) for i, t in zip(at, ts)]
        want = {(r.i, r.way): (r.tm, r.m) for r in spark.createDataFrame(rows, "i int, way string, oligo string").select(
            "i", "way", F.round(T.melting_temperature("oligo"), 2).alias("tm"), D.measures("oligo")["pm"].alias("m")).collect()}
        for way, (mask, tm) in zip("FR", D.window_measures(code, words, back, at, size)):
            assert [(t, int(m)) for t, m in zip(D.two_digits(tm), mask)] == [want[int(i), way] for i in at]


@pytest.mark.parametrize("words", [1024, 2])
def test_competitors_of_pairs_meet_in_cells(spark, monkeypatch, words):
    monkeypatch.setattr(W, "WORDS", words)
    rng = random.Random(11)
    home = {i: rng.choice([1, 2, 3, None]) for i in range(-70, 700, 3)}
    binds = {(o, s): set(rng.sample(sorted(home), rng.choice([1, 5, 90]))) for o in "abcdefgh" for s in "+-" if o + s != "h-"}
    found = spark.createDataFrame([(o, s, i) for (o, s), ids in binds.items() for i in ids], "oligo string, strand string, seq_id long")
    pairs = [(g, f, r) for g in (1, 2, 3, 4) for f in "abcdefgh" for r in "abcdefghx" if rng.random() < 0.6]
    need = W.member_masks(spark.createDataFrame([(i, g, bool(i % 2)) for i, g in home.items()], "seq_id long, grp long, long boolean"))
    got = W.shared_competitors(spark.createDataFrame(pairs + pairs[:5], "grp long, fwd string, rev string"), W.binding_masks(found), need)
    want = {(g, f, r): sum(home[i] != g for i in binds[f, "+"] & binds.get((r, "-"), set())) for g, f, r in pairs}
    assert {tuple(x)[:3]: x.rivals for x in got.collect()} == {k: n for k, n in want.items() if n} and any(want.values())
    assert not re.search(r"Join .*word#", got._jdf.queryExecution().optimizedPlan().toString())  # no row of a pair and a mask word
