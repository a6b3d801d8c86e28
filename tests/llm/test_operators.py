"""The training-data operators against brute force, libraries and their own round trips, on small odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliq.llm import common, exact_dedup, html_text, licenses, mixing, ngram_join, quality, sentence_pieces, token_counts, topk_search, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string, rep long, digest string, tokens int, ids string, h int, block int, held_out string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def rows(texts, ids=None, sources=None):
    return [(None if ids and ids[i] is None else (ids[i] if ids else i), t, None, sources[i] if sources else f"s{i % 3}", None, 0.1, 1, "k", 7, "d", 3, "x", 1, 1, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "one", "a b c d e f g", "a b c d e f g", "a  b\tc d e f g", LONG, LONG + " tail", "x<|endoftext|>y", "é𝄞 日本\n\nz ", "abcdefg"]
    return spark.createDataFrame(rows([*texts, "one"], [*range(len(texts) - 1), None, 3]), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(common.model_path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(odd).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(none).count() == 0
    m, rng = token_counts.Merges(common.model_path("byte_bpe_50k.json")), random.Random(3)
    texts = ["".join(rng.choice("ab  \n\t'sré1２,. \x1c　") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["ab" * 400, " " * 300 + "x", "<|endoftext|><|endoftext|> a"]
    assert m.texts(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def groups_of(table):
    by = defaultdict(list)
    for d, t in table:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), math.inf if d is None else d))
    return {k: (min(v)[1], len(v)) for k, v in by.items()}


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.dedup(odd).collect()
    table = [(r.doc_id, r.text) for r in odd.collect()]
    want = groups_of(table)
    expect = Counter((d, want[b][0] if want[b][0] != math.inf else None, want[b][1], hashlib.sha256(b.encode()).hexdigest())
                     for d, t in table for b in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expect
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.dedup(none).count() == 0


def test_exact_dedup_against_history(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old, new = docs.where("doc_id < 90"), docs.where("doc_id >= 60")
    history = exact_dedup.winners(exact_dedup.fingerprints(old))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup(new, common.written(history, "h")).collect()}
    a, b = [(r.doc_id, r.text) for r in old.collect()], [(r.doc_id, r.text) for r in new.collect()]
    want = groups_of(a + b)
    assert got == {d: want[re.sub(r"[\x20\x09-\x0D]", "", t)] for d, t in b}


def test_perfect_hash_is_minimal_and_strangers_are_seen():
    rng = np.random.default_rng(1)
    members, others = rng.integers(0, 2**63, (5000, 4)).astype(np.uint64), rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    levels = exact_dedup.build_levels(members)
    slots = exact_dedup.slots_of(levels, members)
    assert sorted(slots) == list(range(5000))
    table = members[np.argsort(slots)]
    at = exact_dedup.slots_of(levels, others)
    assert not ((at >= 0) & (table[np.maximum(at, 0)] == others).all(axis=1)).any()


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vec = [[float(x) for x in rng.normal(0, 0.2, 8)] for _ in range(400)]
    vec[3], vec[4], vec[5], vec[6], vec[7] = None, [float("nan")] * 8, [None] * 8, [float("inf")] * 8, []
    vec[21] = vec[20]
    table = [(i, v, "z") for i, v in enumerate(vec)] + [(20, vec[20], "again"), (9, [0.5, 0.5], "short"), (1000, [0.25, -0.5], "short")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()}
    fine = {(r.vec_id, tuple(math.floor(64 * x) for x in r.embedding)) for r in df.collect()
            if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = {}
    for q, a in fine:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in fine if v != q and len(a) == len(b))
            want |= {(q, k + 1): (v, -x) for k, (x, v) in enumerate(s[:7])}
    assert got == want
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>ü" + "x" * 1200, "<p>" + "y" * 999
    table = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "a\r\nb", ""), (5, "u5", "tiny"), (6, "u6", "tiny"), (7, "u7", other), (9, "u9", big), (None, "n", big), (8, "u8", LONG)]
    pages = spark.createDataFrame([(*r, "clash") for r in table], "page_id long, url string, html string, payload_digest string").repartition(3)
    path = warc.write_archives(warc.page_records(pages), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(table) and all(r.verified == (r.record_type == "response") for r in got.values())
    for i, _, html in table:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 9, 2: 9}
    assert warc.page_records(pages.limit(0)).count() == 0


def test_damaged_archives_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>some text</p>")], "page_id long, url string, html string")
    bad = warc.page_records(pages).withColumn("payload_digest", F.lit("0" * 40))
    path = warc.write_archives(bad, f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="payload read as"):
        warc.read_archives(spark, path).collect()


def test_warc_frames_begin_with_their_dictionary():
    records = [warc.record_bytes(i, f"http://h/{i}", f"<html>page {i} {'shared words of every page ' * 20}</html>".encode(), "d" * 40, None) for i in range(300)]
    made = list(warc.frames(iter(records)))
    assert made[0][:4] == bytes.fromhex("5d2a4d18") and len(made) == 301
    data = warc.SEPARATOR.encode().join([*made, b""])
    assert [b for _, b in warc.parse_archive(data)] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]
    assert list(warc.frames(iter([]))) == []
    with pytest.raises(ValueError):
        list(warc.parse_archive(data[:-20]))


def test_quality_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    model = quality.train(docs, labels)
    scored = quality.scored(odd, model, out="s").collect()
    assert len(scored) == odd.count() and all(0 <= r.s <= 1 for r in scored)
    assert quality.classify(odd, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.classify(none, labels).count() == 0


def test_quality_prior_without_negatives():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.7):
        positive = rng.normal(1.5, 1, (1500, 4))
        unlabelled = np.where(rng.random((4000, 1)) < share, rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4)))
        assert abs(quality.estimated_prior(positive, unlabelled) - share) < 0.07
    assert 0 <= quality.estimated_prior(positive[:1], unlabelled[:1]) <= 1


def test_quality_samples_are_bounded(spark, monkeypatch):
    sizes = []
    real = quality.fit
    monkeypatch.setattr(quality, "POSITIVES", 40)
    monkeypatch.setattr(quality, "UNLABELLED", 60)
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: (sizes.append((len(p), len(u))), real(p, u, prior))[1])
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    labels = spark.createDataFrame([(one, 1), (one, 1), (None, 1)], "doc_id long, quality int")
    many = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"))
    assert quality.train(many, labels) is not None
    nulls = spark.range(3000).select(F.when(F.col("id") < 5, F.lit(one)).cast("long").alias("doc_id"), F.concat(F.lit("other words "), "id").alias("text"))
    assert quality.train(nulls, labels) is not None
    assert sizes and all(0 < p <= 80 and 0 < u <= 120 for p, u in sizes)


def test_risk_is_never_negative_and_slopes_agree():
    rng = np.random.default_rng(2)
    p, u = rng.normal(0, 1, 20), rng.normal(0, 1, 30)
    risk, dp, du = quality.nn_pu_risk(p, u, 0.3)
    step = 1e-6
    for k in range(3):
        q = p.copy()
        q[k] += step
        assert abs((quality.nn_pu_risk(q, u, 0.3)[0] - risk) / step - dp[k]) < 1e-4
        v = u.copy()
        v[k] += step
        assert abs((quality.nn_pu_risk(p, v, 0.3)[0] - risk) / step - du[k]) < 1e-4
    assert quality.nn_pu_risk(np.full(5, 9.0), np.full(5, -9.0), 0.9)[0] >= 0


def brute_join(table, threshold=0.8):
    sets = []
    for d, t in table:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    own = [(s, d) for s, (d, _) in zip(sets, table, strict=True) if s]
    reps = {s: min((d for x, d in own if x == s and d is not None), default=None) for s, _ in own}
    names = sorted((s for s in reps if reps[s] is not None), key=lambda s: reps[s])
    root, degree = {s: reps[s] for s in reps}, Counter()
    for i, a in enumerate(names):
        for b in names[:i]:
            n = len(a & b)
            if n and n / (len(a) + len(b) - n) >= threshold:
                degree[a] += 1
                degree[b] += 1
                lo, hi = sorted((root[a], root[b]))
                root = {s: lo if r == hi else r for s, r in root.items()}
    copies = Counter(sets)
    return Counter((d, root[s], degree[s], copies[s]) if s else (d, d, 0, 1) for s, (d, _) in zip(sets, table, strict=True))


def test_ngram_join_equals_brute_force(spark, odd, none):
    rng = random.Random(8)
    texts = []
    for base in range(12):
        words = [f"b{base}x{i}" for i in range(rng.choice([3, 6, 40, 200]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            texts.append(" ".join(copy))
    stem = [f"near{i}" for i in range(120)]  # a group larger than a block, so that blocks are compared with each other
    texts += [" ".join(stem[:k % 100] + [f"own{k}"] + stem[k % 100:]) for k in range(300)]
    docs = spark.createDataFrame(rows(texts + [None, "", texts[0]], list(range(len(texts))) + [9001, 9002, 0]), DOCS)
    for df in (docs, odd):
        got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(df).collect())
        assert got == brute_join([(r.doc_id, r.text) for r in df.collect()])
    assert ngram_join.join(none).count() == 0


def test_join_runs_reach_the_recall():
    runs = ngram_join.roots(0.8, 0.999)
    assert 5 < len(runs) < 60
    rng, met, tries = np.random.default_rng(4), 0, 300
    for _ in range(tries):  # pairs at the threshold itself, by their embeddings
        sig = np.repeat(rng.integers(0, 2**32, (1, ngram_join.COORDS), dtype=np.uint32), 2, axis=0)
        sig[1, rng.random(ngram_join.COORDS) > 0.8] ^= np.uint32(1)
        paths, at = np.repeat(runs, 2), np.tile([0, 1], len(runs))
        for _ in range(ngram_join.LEVELS):
            paths, at = ngram_join.descend(paths, at, sig, 0.8)
        met += bool(set(paths[at == 0].tolist()) & set(paths[at == 1].tolist()))
    assert met >= 0.98 * tries


def test_components_with_a_hub_and_a_path(spark):
    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in common.components(df).collect()}
    assert got == {k: 0 for k in range(400)} | {1000 + k: 1000 for k in range(61)}
    assert common.components(df.limit(0)).count() == 0


def test_mixing_meets_its_targets(spark, none):
    rng = random.Random(2)
    data = [(k, " ".join("w" for _ in range(rng.randint(0, 9))) or None, s) for k, s in enumerate(["big"] * 700 + ["mid"] * 90 + ["low"] * 25 + [None] * 5 + ["blank"])]
    data[-1] = (len(data) - 1, "  ", "blank")
    docs = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, text string, source string, block string, weight int")
    tokens = {k: len((t or "").split()) for k, t, _ in data}
    total = defaultdict(int)
    for k, _, s in data:
        total[s] += tokens[k]
    got = mixing.mix(docs, max_repeats=3.0).collect()
    by = defaultdict(lambda: defaultdict(set))
    for r in got:
        assert r.doc_id not in by[r.source]["%d" % r["pass"]]
        by[r.source]["%d" % r["pass"]].add(r.doc_id)
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9
    drawn = {s: sum(tokens[d] for p in by[s].values() for d in p) for s in by}
    least = max(total[s] / weight[s] for s in weight if weight[s])
    for s, w in weight.items():
        if w:
            assert 0 <= drawn[s] - w * least < 10 and w * least / total[s] <= 3 + 1e-6
    assert max(w * least / total[s] for s, w in weight.items() if w) > 3 - 1e-6
    assert {r.doc_id for r in got} == {k for k, _, _ in data}
    shares = mixing.source_shares(spark.createDataFrame([(s, t) for s, t in total.items()], "source string, tokens long"))
    alpha = mixing.bisect_exponent(shares, target_entropy=1.2)
    p = np.array([t for t in total.values() if t]) ** alpha
    p = p / p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.2) < 1e-6
    assert mixing.mix(none).count() == 0
    half = mixing.mix(docs, target_entropy=1.0, budget=500.0).collect()
    assert abs(sum(r.tokens for r in half) - 500) < 10 * 5


def test_sentence_pieces_equal_the_library(spark, odd, none):
    import sentencepiece
    path = common.model_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in sentence_pieces.encode(odd).collect()}
    for r in odd.collect():
        assert got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
        assert got[r.doc_id].ids == lib.encode(r.text or "")
    assert sentence_pieces.encode(none).count() == 0
    model, rng = sentence_pieces.Pieces(path), random.Random(6)
    texts = ["".join(rng.choice("abcdeinrtshou  \n<>▁日é𝄞") for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["ab" * 500, "=" * 333, " " * 90]
    for t in texts:
        ids = model.encode(t)
        assert ids.tolist() == lib.encode(t) and model.decode(ids) == lib.decode(ids.tolist())
    mine = sentence_pieces.Pieces(path, as_unigram=True)
    for _ in range(200):
        t = " ".join("".join(rng.choice("abcdeinrtshou") for _ in range(rng.randint(1, 60))) for _ in range(3))
        marked, best = sentence_pieces.MARK + t.replace(" ", sentence_pieces.MARK), [0.0]
        for end in range(1, len(marked) + 1):  # the whole lattice at once
            best.append(max(best[i] + mine.score[mine.id[marked[i:end]]] for i in range(max(0, end - mine.longest), end) if marked[i:end] in mine.id))
        ids = mine.encode(t)
        assert mine.decode(ids) == t and sum(mine.score[i] for i in ids) == best[-1]


def test_streaming_commits_before_the_end():
    model = sentence_pieces.Pieces(common.model_path("piece_bpe_32k.model"))
    fed = 0

    def chars():
        nonlocal fed
        for c in "xq" * 2000:
            fed += 1
            yield c

    next(model.stream(chars()))
    assert fed <= 6 * model.longest


def test_main_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='side sidebar'>S<div>in</div>x</div><article><header>Head</header><h1>Big &amp; small</h1>"
            "<p>One <b>two</b>\n three<br>four</p><script>var t='</p>';</script><p>five&nbsp;six<form>no<input></form><div class=\"comments\"><p>reader</p></div><p class=ad>buy<p>last &lt;b&gt;</article>"
            "<footer>&copy; F</footer></body>")
    pages = spark.createDataFrame([(1, "http://a.x/1", html, "k"), (2, None, None, "k"), (3, "http://a.x/3", "", "k"), (1, "http://a.x/1", html, "k"), (4, "u", "<p>5 < 6 & 7", "k")],
                                  "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    text = "Big & small\n\nOne two three four\n\nfive six\n\nlast <b>"
    assert got == Counter({(1, text, len(text)): 2, (2, "", 0): 1, (3, "", 0): 1, (4, "5 < 6 & 7", 9): 1})
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("html", "text"), [
    ('<div class="site no-sidebar"><article>whole</article></div>', "whole"),
    ('<div class="content-with-sidebar"><p>one</div><div id=job-search>two</div><div class="social-science">three</div>', "one|two|three"),
    ('<div class="sidebar"><p>side<article>whole</article>side</div>', "whole"),
    ('<form action="/"><nav>menu</nav><main>whole</main></form>', "whole"),
    ('<article>a<div class="comments"><article>reader</article></div>b</article>', "a|b"),
    ('<p><a title="the hidden valley" href=x>here</a> and <b class="a hidden b">there</b>', "here and there"),
    ('<p hidden>no<p aria-hidden="true">no<div style="color:red; display: none">no</div><p data-x="display:none">yes', "yes"),
    ('<ul><li>a<li class="share">no<li>b</ul>c', "a|b|c"),
    ('<dl><dt>a<dd class=ad>no<dt>b</dl><table><tr><td class="ad">no<td>c<tr><td>d</table>e', "a|b|c|d|e"),
    ('<div><p>a <span class="ad">no</div>b', "a|b"),
    ('<div class="ad"><div>no</div>no<ul><li>no</ul></div>a', "a"),
    ('<aside>no<article>no</article></aside><p>a', "a"),
    ("<div><p>long story here</p></div><article class=card>teaser</article>", "long story here|teaser"),
    ("<script src=https://x.com/>code()</script>a<script src=x />var a=1;</script>b<svg/>c", "abc"),
    ("<a title=it's>here</a> <b x=\"a>b\" y='c>d'>there", "here there"),
    ("<article><p>a <math><mi>x</mi></math> b</article>", "a x b"),
    *((f"<p>story</p><div {mark}>no</div>", "story") for mark in ("class=post-comments", "class=sidebar-left", "id=ad_top", 'class="x cookie-popup"', "id=disqus_thread")),
    ("<article>a<div class='post-comments'>no</div>b</article>", "a|b"),
    ("<div class=menu-page><p>the story</div><p>x", "the story|x")])
def test_cut_keeps_articles(html, text):
    marked, blocks = html_text.cut(html)
    assert "|".join(t for z, t in blocks if z == (2 if marked else 0)) == text


def test_host_repeats_leave_unique_runs(spark):
    base = " ".join(f"boiler{i}" for i in range(20))
    own = ["alpha one two three", "beta four five", "gamma six"]
    pages = [(k, f"https://www.host.net:80/{k}", f"<div>{base} {own[k]}</div><p>{own[k]} {base}") for k in range(3)] + [(7, "http://else.net/", f"<div>{base}</div>")]
    shared = " ".join(f"passage{i}" for i in range(60))
    pages += [(20, "http://art.net/1", f"<article><p>{shared}<p>mine {base}</article>"), (21, "HTTP://user@ART.net/2", f"<article><p>{shared} more</article><div>{base}</div>"), (21, "http://art.net/2", f"<article><p>{shared} more</article><div>{base}</div>")]
    got = Counter((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    # a passage that articles share stays; what another page has outside of its article goes; copies of a page are one page
    assert got == Counter([*((k, f"{own[k]}\n\n{own[k]}") for k in range(3)), (7, base), (20, f"{shared}\n\nmine"), (21, f"{shared} more"), (21, f"{shared} more")])


def test_pages_without_a_host_share_nothing(spark):
    passage = " ".join(f"w{i}" for i in range(18))
    pages = [(k, url, f"<p>own{k} {passage}</p>") for k, url in ((1, None), (2, None), (3, ""), (4, "file:///x"))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own{k} {passage}" for k in range(1, 5)}


def test_repeats_equal_brute_force():
    rng = random.Random(4)
    for _ in range(6):
        streams = [[[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(rng.randint(0, 3))] for _ in range(12)]
        zones = [[rng.randint(0, 2) for _ in blocks] for blocks in streams]
        masks = html_text.repeated(streams, zones, 8)
        seen = defaultdict(set)
        for blocks, zone in zip(streams, zones, strict=True):
            for b, z in zip(blocks, zone, strict=True):
                for i in range(len(b) - 7):
                    seen[tuple(b[i:i + 8])].add((str(blocks), z))
        for blocks, zone, mask in zip(streams, zones, masks, strict=True):
            for b, z, m in zip(blocks, zone, mask, strict=True):
                want = np.zeros(len(b), bool)
                for i in range(len(b) - 7):
                    if any(page != str(blocks) and (z != 2 or k != 2) for page, k in seen[tuple(b[i:i + 8])]):
                        want[i:i + 8] = True
                assert (m == want).all()


def test_extract_equals_one_suffix_array_per_host(spark):
    rng = random.Random(9)
    passages = [" ".join(f"s{rng.randrange(5)}" for _ in range(rng.choice((15, 16, 17, 24, 40)))) for _ in range(12)]
    pages = []
    for k in range(120):
        def block(k=k):
            words = [" ".join(f"k{k}w{rng.randrange(9**6)}" for _ in range(rng.randint(0, 30))) for _ in range(3)]
            return " ".join(x for w in words for x in (w, rng.choice([*passages, ""])) if x)
        kinds = ["nav", "div", "p", "article" if k % 3 else "section"]
        tags = [rng.choice(kinds) for _ in range(rng.randint(1, 5))]
        pages.append((k, f"http://h{k % 4}.net/{k}", "".join(f"<{t}>{block()}</{t}>" for t in tags)))
    pages.append((999, "http://h1.net/long", "<p>" + " ".join(f"l{i}" for i in range(60_000)) + " " + passages[4] + " end"))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    changed = 0
    for h in range(4):
        own = [(p, *html_text.cut(x)) for p, u, x in pages if u.startswith(f"http://h{h}.")]
        # loose blocks of a page that marks an article are no main text, yet are outside of articles
        masks = html_text.repeated([[t.split(" ") for _, t in found] for _, _, found in own], [[z for z, _ in found] for _, _, found in own])
        for (page, marked, found), mask in zip(own, masks, strict=True):
            kept = [" ".join(np.array(t.split(" "))[~m]) for (z, t), m in zip(found, mask, strict=True) if z == (2 if marked else 0)]
            changed += any(m.any() for m in mask)
            assert got[page] == "\n\n".join(t for t in kept if t), page
    assert changed > 60 and len(got) == len(pages)


def test_repeats_of_two_pages_of_a_large_host(spark):
    filler = [" ".join(f"p{k}w{i}" for i in range(400)) for k in range(900)]
    notice = [" ".join(f"notice{k % 450}n{i}" for i in range(20)) if k % 450 < 12 else "" for k in range(900)]  # each on two pages
    pages = [(k, f"http://big.net/{k}", f"<div>{filler[k]} {notice[k]}</div>") for k in range(900)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(filler))


def test_near_copies_keep_their_article(spark):
    article, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    notice = " ".join(f"notice{i}" for i in range(20))
    pages = [(1, "http://c.net/1", f"<div>Monday menu one</div><div>{article}</div><p>{notice}"), (2, "http://c.net/2", f"<div>Friday other links</div><div>{article}</div><p>{notice}"),
             (3, "http://c.net/3", f"<nav>menu</nav><article>{article}</article>"), (4, "http://c.net/4", f"<div>{other}</div><p>{notice}")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: f"Monday menu one\n\n{article}", 2: f"Friday other links\n\n{article}", 3: article, 4: other}


def test_license_scan(spark, odd, none):
    full = licenses.TEMPLATES["MIT"]
    half = full.split(". ")
    texts = [full, "intro words\n" + ".\n".join(half) + "\nother words of mine", "Released under the MIT licence.\nReleased under the MIT License!", None, "", "word", "unrelated " * 50]
    docs = spark.createDataFrame(rows(texts), DOCS)
    got = {(r.doc_id, r.first_line, r.last_line): (r.license, r.dice) for r in licenses.scan(docs).collect()}

    def dice(a, b):
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0

    want = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                best = min(((-dice(licenses.bigrams(" ".join(lines[i:j + 1])), licenses.bigrams(x)), n) for n, x in licenses.TEMPLATES.items()))
                if -best[0] >= 0.9 and (i == j or (i, j) in {(0, len(lines) - 1), (1, len(half))}):
                    want[k, i, j] = (best[1], -best[0])
    assert got == want and (1, 1, len(half)) in got and (2, 1, 1) in got
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == 0


def test_licenses_inside_lines_and_next_to_each_other():
    table = licenses.Templates(licenses.TEMPLATES, 0.9)
    mit, isc = (re.sub(r"(.{50}\S*) ", r"\1\n", licenses.TEMPLATES[n]) for n in ("MIT", "ISC"))
    n, m = len(mit.split("\n")), len(isc.split("\n"))
    assert table.scan("Foo is a tool. Released under the MIT License. See the docs.") == [(0, 0, "MIT notice", 1.0)]
    assert table.scan("Foo. Released under the MIT License. Data: Licensed under CC BY-NC 4.0. Bye") == [(0, 0, "CC-BY-NC-4.0 notice", 1.0), (0, 0, "MIT notice", 1.0)]
    assert table.scan(" ".join(f"before{i}" for i in range(90)) + " " + licenses.TEMPLATES["MIT"] + " " + " ".join(f"after{i}" for i in range(90)) + "\nend") == [(0, 0, "MIT", 1.0)]
    for between in ("\n\n", "\n---\nand\n\n"):
        k = n + between.count("\n") - 1
        assert table.scan(mit + between + isc) == [(0, n - 1, "MIT", 1.0), (k, k + m - 1, "ISC", 1.0)]


def test_top_k_keeps_large_finite_vectors(spark):
    rng = random.Random(9)
    vec = [[rng.choice([-1, 1]) * rng.uniform(4.5e6, 1e7) for _ in range(6)] for _ in range(30)] + [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(30)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(spark.createDataFrame(list(enumerate(vec)), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()}
    fine = [[math.floor(64 * c) for c in v] for v in vec]
    want = {}
    for q in (0, 20, 40):
        s = sorted((-sum(a * b for a, b in zip(fine[q], fine[v], strict=True)), v) for v in range(60) if v != q)
        want |= {(q, k + 1): (v, -score) for k, (score, v) in enumerate(s[:5])}
    assert got == want
    wide, minus = np.full((1, 128), 2**28), np.full((1, 128), -(2**28))
    assert topk_search._products(np.c_[wide, minus] * 2, np.c_[wide, wide] * 2).tolist() == [[0]]
    with pytest.raises(OverflowError):
        topk_search._products(wide * 2, wide * 2)
