"""Conversation repair, the prefix trie and quality rules against brute force and SQL, on small odd tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampliq.llm import conversation_repair as repair
from ampliq.llm import conversation_trie as trie
from ampliq.llm import quality_rules as rules
from ampliq.llm.queries import ORACLES

CONV = "conv_id long, turn long, role string, text string, place long, node string, family string, gone string, copy string, fault string, nth string, n long"


def conversations(spark, table):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "c", "f", "n", 5) for r in table], CONV)


def odd_table(seed, n=400, texts=("Yes.", "No", "a?", " ", "", None, "Why.\n", "Long " * 300 + "end!"), roles=("user", "assistant", "system", "user", "assistant", None, "tool", "u")):
    rng = random.Random(seed)
    table = []
    for conv in [0, 1, 2, 5, 99, 100, 101, 150, 201, 202, -3, -205, None, 10**12]:
        turns = sorted(rng.sample(range(-3, 40), rng.randint(1, 12))) + rng.choice([[], [None], [None, None], [7, 7]])
        table += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return table[:n]


def by_sql(name, table):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create view conversations as select conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text from given")
    cur = con.execute(ORACLES[name])
    return sorted(map(str, ({d[0]: v for d, v in zip(cur.description, r, strict=True)}.items() for r in cur.fetchall())), key=str), [d[0] for d in cur.description]


def as_sql(df, names):
    return sorted(str({n: r[n] for n in names}.items()) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_sql(spark, seed):
    table = odd_table(seed)
    want, names = by_sql("op11_conversation_repair", table)
    got = repair.summary(repair.edits(repair.damaged(conversations(spark, table)), marked=True))
    assert as_sql(got, names) == want
    assert repair.summary(repair.edits(repair.damaged(conversations(spark, [])), marked=True)).count() == 0


def test_repair_gives_turns(spark):
    table = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (1, 3, "user", "B"), (2, 0, "system", "only."), (3, 0, None, None)]
    found = repair.edits(conversations(spark, table)).where("edit is not null").orderBy("conv_id", "place").collect()
    audits = {c: "".join(r.edit for r in rows) for c, rows in itertools.groupby(found, lambda r: r.conv_id)}
    assert audits == {1: "KRKD", 2: "D", 3: "D"}
    for c, rows in itertools.groupby(found, lambda r: r.conv_id):
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in rows if r.edit != "D"))
    assert {r.text for r in found if r.edit == "I"} <= {""}


def every_way(rows):
    """All edits of a few rows, without pruning: the least (cost, audit, turns)."""
    best = None
    space = [[]]
    for k, (_, role, text, fault) in enumerate(rows):
        late = 3 * (fault == "truncated")
        ways = [(4, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(late, "K", (role, text)), (3 + late, "R", ("user", text)), (3 + late, "R", ("assistant", text))]
        space = [s + [w] for s in space for w in ways]
    new = [[], [(3, "I", ("user", ""))], [(3, "I", ("assistant", ""))]]
    for way in space:
        base = sum(w[0] for w in way)
        if best is not None and base > best[0]:
            continue
        for gaps in itertools.product(new, repeat=len(rows) + 1):
            full = list(gaps[0])
            for w, g in zip(way, gaps[1:], strict=True):
                full += [w, *g]
            cost = sum(w[0] for w in full)
            if best is None or cost <= best[0]:
                kept = [w[2] for w in full if w[2]]
                if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in kept)) and all(t[0] for t in kept):
                    key = (cost, "".join(w[1] for w in full), tuple(kept))
                    best = min(best, key) if best else key
    return best


def test_decoder_against_all_ways():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "assistant", "", "tool"]), f"t{i}", rng.choice(["", "", "truncated", "blank", "duplicate"])) for i in range(rng.randint(0, 4))]
        d, got = repair.Decoder(), []
        for r in rows:
            got += d.push(r)
        got += d.finish()
        assert (sum(n.cost for n in got), "".join(n.edit for n in got), tuple((n.role, n.row[2] if n.row else "") for n in got if n.edit != "D")) == every_way(rows), rows


def test_decoder_lets_go_of_what_is_settled():
    d, rng, most, seen = repair.Decoder(), random.Random(3), 0, 0
    for i in range(20_000):
        seen += len(d.push((i, rng.choice(["user", "assistant", "system"]), "t", rng.choice(["", "", "truncated", "blank"]))))
        most = max(most, d.held)
    assert most < 200 and seen > 19_000
    d, ties = repair.Decoder(), []  # a run of one role leaves two ways tied to its end
    for i in range(3000):
        ties += d.push((i, "assistant", "t", ""))
    assert not ties and d.held == 3000
    assert "".join(n.edit for n in d.finish()) == "RK" * 1500


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_sql(spark, seed):
    rng = random.Random(seed)
    table = [r for r in odd_table(seed, texts=("a", "b", None), roles=("user", None)) if r[0] != 150]
    table += [(c, t, "user", "same" if t < rng.choice([3, 9, 14]) else rng.choice("xy")) for c in range(300, 340) for t in range(rng.choice([2, 4, 8, 15]))]
    want, names = by_sql("op12_conversation_trie", table)
    got = trie.prefix_trie(trie.rebuilt(conversations(spark, table)))
    assert as_sql(got, names) == want
    assert trie.prefix_trie(trie.rebuilt(conversations(spark, []))).count() == 0


def test_trie_of_plain_conversations(spark):
    table = [(1, 0, "user", "hello"), (1, 1, "assistant", "bye"), (2, 0, "user", "hello"), (3, 0, "user", "hello"), (3, 1, "assistant", "so"), (4, 0, "user", "hello"), (4, 1, "assistant", "so")]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(trie.blocks(trie.turns(conversations(spark, table)))).collect()}
    assert {k: (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for k, r in got.items()} == {
        (1, 0): (None, 4, 1, 2, 17), (1, 1): (1, 4, 2, 2, 17), (1, 2): (1, 1, 0, 1, 0), (3, 2): (1, 2, 0, 1, 2)}


def counts_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    many = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if many[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


DOCS = "doc_id long, text string, lang string, source string, w long, h string, n_words string, bad string, part string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "h", "n", "b", "p") for i, t in enumerate(texts)], DOCS)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\n", "a b c d e f a b c d e", "x " * 40, "\x0b a\x0cb\r\nc  #*$%&|<>!?", "é𝄞 日本 " * 9, "one\n one\none\n\none", "w w w w w w", " ".join(f"v{i % 4001}" for i in range(30_000))]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = {r.doc_id: r for r in rules.statistics(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts_of(t), (i, t)


def learned(rows, cuts):
    """The same covering over lists of (bad, grows, statistics)."""
    test = lambda c, s: s[c[0]] > c[2] if c[1] else s[c[0]] <= c[2]
    covers = lambda rule, s: all(test(c, s) for c in rule)
    out, names = [], list(rules.STATISTICS)
    while len(out) < rules.RULES:
        left = [r for r in rows if not any(covers(q, r[2]) for q in out)]
        grow, prune, rule = [r for r in left if r[1]], [r for r in left if not r[1]], []
        while len(rule) < rules.CONDITIONS:
            here = [r for r in grow if covers(rule, r[2])]
            p0, top, best = sum(r[0] for r in here), 0.0, None
            n0 = len(here) - p0
            if not p0 or not n0:
                break
            for name in names:
                for cut in cuts[name]:
                    for above in (False, True):
                        on = [r[0] for r in here if test((name, above, cut), r[2])]
                        p = sum(on)
                        g = p * (math.log2(p / len(on)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if g > top + 1e-9:
                            top, best = g, (name, above, cut)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        held = [[r[0] for r in prune if covers(rule[:k], r[2])] for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda k: ((2 * sum(held[k]) - len(held[k])) / max(len(held[k]), 1), -k))
        if not sum(held[k]) or sum(held[k]) < rules.PRECISION * len(held[k]):
            break
        out.append(rule[:k + 1])
    return out


def test_list_is_what_sequential_covering_gives(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "caps", "marks", "both"])
        words = [rng.choice(["stone", "river", "walks", "over", "blue", "hill."]) + str(rng.randint(0, 99)) * (kind == "both") for _ in range(rng.randint(12, 40))]
        if kind == "caps":
            words = [w.upper() + "!!" for w in words]
        if kind == "marks":
            words = [w + rng.choice(["###", ""]) for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(kind in ("good", "both")) if rng.random() > 0.03 else 0))
    docs, given = documents(spark, texts), spark.createDataFrame([*labels, (None, 0), (9999, 1), (5, 1 - labels[5][1]), (7, None), (8, 3)], "doc_id long, quality int")
    stats = rules.written(rules.statistics(docs), "s")
    got = rules.learn(stats, given)
    known = dict(labels)
    del known[5]
    rows = [(not known[r.doc_id], r.grows, {n: r[n] for n in rules.STATISTICS}) for r in stats.where(~rules.base_failed()).where(F.col("doc_id").isin(list(known))).select(
        "doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grows"), *[F.expr(e).cast("double").alias(n) for n, e in rules.STATISTICS.items() if n != "n_words"], "n_words").collect()]
    cuts = {n: sorted({sorted(r[2][n] for r in rows)[max(math.ceil(k / 32 * len(rows)) - 1, 0)] for k in range(1, 32)}) for n in rules.STATISTICS}
    assert [[(c.name, c.above, c.cut) for c in r] for r in got.rules] == learned(rows, cuts) and got.rules
    judged = rules.judge(docs, given).collect()
    wrong = sum(r.kept != (known[r.doc_id] == 1) for r in judged if r.doc_id in known and not r.base_failed)
    assert wrong < 0.08 * len(texts)
    assert all(not r.kept for r in judged if r.base_failed) and len(judged) == len(texts)


def test_no_labels_keep_what_passes(spark):
    docs = documents(spark, ["a b c d e f g h i j k", "short", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.base_failed, r.kept) for r in rules.judge(docs, none).orderBy("doc_id").collect()] == [(False, True), (True, False), (True, False)]
    assert rules.judge(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(0, 0)], "doc_id long, quality int")
    assert rules.judge(docs, one).where("kept").count() == 1


def test_shared_heads_follow_the_rule(spark):
    table = [(200, t, "user", f"h{t}") for t in range(3)] + [(c, t, "user", f"{c}-{t}") for c in (201, 202, 203, 204, 305) for t in range(4)]
    got = trie.rebuilt(conversations(spark, table)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.conv_id] += len(r.points)
    for c in (201, 202, 203, 204):
        h = zlib.crc32(str(c).encode()) % 6
        assert sizes[c] == min(h, 3) + max(4 - h, 0)
    assert sizes[305] == max(4 - zlib.crc32(b"305") % 6, 0) and sizes[200] == 3
