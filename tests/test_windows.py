"""Window designs against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliq.operators import design as D
from ampliq.operators import group_design as G
from ampliq.operators import window_design as W
from tests.test_search import bases, lengths, places

SEQS = "seq_id long, grp long, long boolean, seq string"


def leaders(lens, ratio):
    out = []
    for n in sorted(lens, reverse=True):
        if not out or out[-1] >= ratio * n:
            out.append(n)
    return out


def test_backbones_are_the_leaders_of_the_length_classes(spark):
    rng = random.Random(11)
    rows = [(i, i % 3, False, "A" * rng.choice((90, 120, 180, 181, 270, 400, 405, 600, 900, 901))) for i in range(60)]
    rows += [(100, None, False, "A" * 999)]
    got = W.backbones(spark.createDataFrame(rows, SEQS)).collect()
    for g in range(3):
        want = leaders({len(r[3]) for r in rows if r[1] == g and len(r[3]) >= 120}, 1.5)
        assert sorted((r.seq_id, len(r.seq)) for r in got if r.grp == g) == sorted(
            (min(r[0] for r in rows if r[1] == g and len(r[3]) == n), n) for n in want)


def test_masks_of_far_and_negative_ids(spark):
    rows = [(-5, 1, True, "x"), (62, 1, False, "x"), (63, 1, True, "x"), (10**12, 1, False, "x"), (7, None, False, "x")]
    need = W.member_masks(spark.createDataFrame(rows, SEQS))
    at = [("a", i) for i in (-5, 62, 63, 10**12)] + [("b", -5), ("b", 63), ("b", 7), ("c", 62)]
    marks = W.binding_masks(spark.createDataFrame([(o, "+", i) for o, i in at], "oligo string, strand string, seq_id long"))
    asked = spark.createDataFrame([(1, o, "+") for o in "abc"], "grp long, oligo string, strand string")
    assert {(r.oligo, r.base) for r in W.universal(asked, marks, need).collect()} == {("a", "all"), ("a", "long"), ("b", "long")}
    both = marks.unionByName(W.binding_masks(spark.createDataFrame([("z", "-", i) for i in (7, 63, 62)], "oligo string, strand string, seq_id long")))
    pairs = spark.createDataFrame([(1, "a", "z"), (1, "b", "z"), (1, "c", "z")], "grp long, fwd string, rev string")
    assert [tuple(r) for r in W.shared_competitors(pairs, both, need).collect()] == [(1, "b", "z", 1)]


def test_window_designs_equal_loops(spark):
    rng = random.Random(5)
    core = bases(rng, 620)
    other = core[:200] + bases(rng, 420)  # a competitor that shares the first part
    seqs = [(1, 1, True, core), (2, 1, True, core), (3, 1, False, core[:450] + bases(rng, 170)), (4, None, False, other), (5, 2, False, bases(rng, 300))]
    reads = [(10 * i + k, f"bin{s[0]}", s[3]) for i, s in enumerate(seqs) for k in range(3)]
    roles = [(g, f"bin{s[0]}", "member" if s[1] == g else "competitor", s[2]) for g in (1, 2) for s in seqs]
    rules = W.Rules(lengths=(20, 20), max_mm=0, width=300, step=150, keep=60, min_reads=2)
    df = spark.createDataFrame(seqs, SEQS)
    loci = spark.createDataFrame([(1, 100, 400)], "seq_id long, lo int, hi int")
    back = W.backbones(df)
    best = W.window_candidates(df, back, loci, rules).collect()
    assert best and {r.base for r in best} == {"all", "long"}
    by_id = {s[0]: s for s in seqs}

    def binds(o, seq, strand):
        return any(s == strand for s, _ in places(o, seq, 0, 2))

    for r in best:
        outside = r.backbone == 1 and (r.f_pos >= 400 or r.r_end <= 100)
        assert r.base == ("long" if outside else "all")
        assert by_id[r.backbone][3][r.f_pos:r.f_pos + 20] == r.fwd and r.bp == r.r_end - r.f_pos
        for s in seqs:
            if s[1] == r.grp and (s[2] or r.base == "all"):
                assert binds(r.fwd, s[3], "+") and binds(r.rev, s[3], "-")
        assert r.rivals == sum(binds(r.fwd, s[3], "+") and binds(r.rev, s[3], "-") for s in seqs if s[1] != r.grp)
    # past the shared part and past what the third member has, only long members have sites
    assert any(r.f_pos >= 450 for r in best)
    won = {(r.grp, r.window): r for r in W.window_designs(df, spark.createDataFrame(reads, "read_id long, bin string, seq string"),
                                                          spark.createDataFrame(roles, "grp long, bin string, role string, long boolean"), loci, rules).collect()}
    assert {k for k in won if k[0] == 1} == {(1, i) for i in range(4)} and {k for k in won if k[0] == 2} == {(2, 0), (2, 1)}
    for key, r in won.items():
        mine = [b for b in best if (b.grp, b.window) == key]
        assert r.candidates == len(mine) and (r.fwd is None) == (not mine)
        if mine:
            seen = [b for b in roles if b[0] == key[0] and b[2] == "member" and (b[3] or r.base == "all")]
            hit = [any(60 <= n <= 400 for n in lengths(r.fwd, r.rev, by_id[int(b[1][3:])][3], rules)) for b in seen]
            assert r.member_bins == len(seen) and r.covered_bins == sum(hit)


def test_no_members_no_windows(spark):
    empty = spark.createDataFrame([(1, None, False, "ACGT" * 50)], SEQS)
    out = W.window_designs(empty, spark.createDataFrame([], "read_id long, bin string, seq string"),
                           spark.createDataFrame([], "grp long, bin string, role string, long boolean"), spark.createDataFrame([], "seq_id long, lo int, hi int"))
    assert out.count() == 0
    assert G.WORD == 63


def _families(rng):
    """Two groups with copies, changed copies and a repeated passage, and sequences of no group that share parts of them."""
    line = bases(rng, 90)
    one, two = bases(rng, 500) + line * 4 + bases(rng, 500), bases(rng, 300) + line + bases(rng, 400)
    seqs = [(1, 1, True, one), (2, 1, False, one[:1200] + bases(rng, 60)), (3, 1, True, one), (4, 2, True, two), (5, 2, False, "ACG" + two[3:600])]
    seqs += [(10 + i, None, False, bases(rng, 40) + (one if i % 2 else two)[i * 30:] + line) for i in range(9)]
    return seqs + [(30, None, False, "NNACG"), (31, 3, True, bases(rng, 90)), (32, 3, True, bases(rng, 130))]


@pytest.mark.parametrize("lengths, listed", [((20, 20), 3), ((18, 20), 5)])
def test_ranking_in_windows_equals_masks(spark, monkeypatch, lengths, listed):
    """Groups in parts, backbones in several pieces and lists that are too short change nothing."""
    monkeypatch.setattr(W, "LISTED", listed)
    monkeypatch.setattr(W, "PART", 1000)
    monkeypatch.setattr(W, "CHUNK", 2)
    seqs = _families(random.Random(3))
    rules = W.Rules(lengths=lengths, max_mm=0, width=400, step=150)
    loci = spark.createDataFrame([(1, 200, 700), (4, None, 100)], "seq_id long, lo int, hi int")
    got = []
    for more in ([], [(99, None, False, "RYRYRY")]):  # a letter that packed words can't hold: the masks are used
        df = spark.createDataFrame(seqs + more, SEQS)
        rows = W.window_candidates(df, W.backbones(df), loci, rules).collect()
        got.append(sorted(tuple(sorted(r.asDict().items())) for r in rows))
    assert got[0] and got[0] == got[1]
    assert any(dict(r)["rivals"] for r in got[0])


def test_pairs_become_rows_only_if_they_can_be_among_the_best(spark, monkeypatch):
    written = []

    def cut(df, real=W.cut_lineage):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(W, "cut_lineage", cut)
    rng = random.Random(8)
    core, line = bases(rng, 2500), bases(rng, 90)
    seqs = [(1, 1, True, core), (2, 1, True, core), (3, 2, True, line * 12), (4, 2, True, line * 12 + "A")] + [(9 + i, None, False, line + bases(rng, 9)) for i in range(3)]
    rules = W.Rules(lengths=(20, 20), max_mm=0)
    monkeypatch.setattr(W, "LISTED", 2, raising=False)
    df = spark.createDataFrame(seqs, SEQS)
    back = W.backbones(df)
    written.clear()
    best = W.window_candidates(df, back, spark.createDataFrame([], "seq_id long, lo int, hi int"), rules).count()
    assert best and max(written) <= 1000  # all pairs are 190,973


def test_grid_masks_equal_measures(spark):
    rng = random.Random(2)
    for size in (18, 20, 25):
        seq = bases(rng, 3000) + "ACGTACGTACGTACGTACGTACGTAC" * 2
        code, words, known = W._packed(seq, size)
        at = np.flatnonzero(known)
        turned = W._turned(words, np.full(words.size, size))
        assert all(W._text(int(w), size) == seq[i:i + size] for i, w in enumerate(words[:50]))
        f, r = W._grid_masks(code, words, turned, at, size)
        rows = spark.createDataFrame([(i, W._text(int(words[i]), size), W._text(int(turned[i]), size)) for i in range(words.size)], "i int, f string, r string")
        want = rows.select("i", D.measures(F.col("f"))["pm"].alias("f"), D.measures(F.col("r"))["pm"].alias("r")).orderBy("i").collect()
        assert [x.f for x in want] == f.tolist() and [x.r for x in want] == r.tolist() and f.any()
