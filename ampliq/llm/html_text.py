"""Main text of web pages, with repeats sought by a suffix array over all pages of a host.

A page is cut into blocks: article blocks (inside an article or main element), menus and the like, and loose ones. In a
page that marks an article, tokens of article blocks go if they lie in a run of MIN_RUN tokens or more that another page
has outside of articles: passages that only articles share are no boilerplate. In a page that marks none, tokens of loose
blocks go if they lie in a run that any other page has. Pages whose main texts mostly coincide are one page, so what only
copies share stays, and so do the unique runs.

A host may be of any size, so its suffix array is dealt over shards by prefix, and only where pages can share a run at
all. In each stretch of MIN_RUN tokens the run of ANCHOR tokens with the least hash is its anchor: equal stretches have
equal anchors. Anchors that distinct pages have (1) name the pages whose copies matter and (2) deal the tokens around
them over shards; there the suffixes of all streams are sorted, neighbours with a common prefix of MIN_RUN tokens from
distinct pages are repeats, and their places go back to the pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, groups, partitions, short_batches, written
from .ngram_join import join, mix64, word_hashes

#: Shortest repeat, in tokens; a power of two.
MIN_RUN = 16
#: Tokens of an anchor: one of the stretches of this size within MIN_RUN tokens, chosen by hash; a power of two.
ANCHOR = 8
#: Pages whose main texts are linked at this Jaccard similarity of five-word shingles are copies of one page.
NEAR = 0.8
#: Bytes of html per shard of hashes, about, and hashes that are dealt over the shards at once; neither decides over results.
SHARD_BYTES, HELD = 8_000_000, 1_000_000
#: Fixed values of HTML: elements that start a block, whose content is no text, and that are never main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object canvas audio video".split())
CHROME = frozenset("nav header footer aside form menu dialog button select search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Whole class names, ids and roles that mark what isn't the article ("_" counts as "-").
MARKED = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus "
                   "footer header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related "
                   "replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
                   "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper ads-container comment-list comments-area comments-section cookie-banner cookie-bar cookie-consent cookie-notice "
                   "main-menu main-nav main-navigation nav-bar nav-menu newsletter-signup page-footer page-header related-articles related-links related-posts search-form share-buttons "
                   "share-links side-bar site-footer site-header site-nav site-navigation social-buttons social-icons social-links social-share top-menu top-nav widget-area".split())
#: Elements without a needed end tag: which open siblings a start tag ends, and the elements this doesn't reach beyond.
SIBLINGS = {name: (frozenset(ends.split()), frozenset(bounds.split())) for names, ends, bounds in (
    ("li", "li", "ul ol menu dir"), ("dt dd", "dt dd", "dl"), ("td th", "td th", "tr table"), ("tr", "tr", "table"), ("thead tbody tfoot", "caption thead tbody tfoot", "table"),
    ("option", "option", "select optgroup"), ("optgroup", "optgroup", "select")) for name in names.split()}
#: Elements that an end tag inside of them doesn't close beyond, unless it is one of the table's own.
CELLS = frozenset("td th caption table".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
#: What an element's text is: loose, of an article, menus and the like, the same with an article still to be found in it, hidden.
LOOSE, ARTICLE, CHROME_ONLY, MAY_HOLD, UNSEEN, LIKELY = range(6)
#: Articles are the main text if they have at least this share of what isn't menus and the like.
ARTICLE_SHARE = 1 / 3
#: Words within compound class names and ids ("post-comments") that likely mark the same, and those before them that deny it.
PARTS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar navigation newsletter "
                  "pagination popup promo share sharing sidebar sponsor sponsored subscribe widget".split())
DENY = frozenset("has no non not with without".split())


def likely(name: str) -> bool:
    """Whether a part of a compound name marks it, as in "sidebar-left" but not in "no-sidebar"."""
    parts = name.split("-")
    return any(p in PARTS and (k == 0 or parts[k - 1] not in DENY) for k, p in enumerate(parts))


def cut(html: str) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the page marks an article, and its blocks in page order as (zone, text): 2 article, 1 menus and the like, 0 loose.

    An element whose class, id or role marks it is no menu where it holds an article or main element that isn't inside
    another one. One that a part of a compound name marks is loose after all where such elements hold most of the loose
    text. Articles with less than ARTICLE_SHARE of the text besides menus (teasers) mark nothing and are loose; a main
    element always does. Elements end with their end tag, that of an element around them, or a sibling that ends them.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    opened: list[tuple[str, int]] = []  # elements around, outermost first, and what their text is
    names: dict[str, int] = {}  # how many of a name are open
    marked = firm = False
    at, end = 0, len(html)

    def close() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(((0, 2, 1, 1, 1, 3)[opened[-1][1] if opened else LOOSE], text))

    def leave(size: int) -> None:
        if opened[size:] and opened[-1][1] != (opened[size - 1][1] if size else LOOSE):
            close()  # also where an inline element was no main text
        for name, _ in opened[size:]:
            names[name] -= 1
        del opened[size:]

    def end_open(ends: frozenset[str], bounds: frozenset[str]) -> None:
        if not any(names.get(n) for n in ends):
            return
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] in ends:
                return leave(k)
            if opened[k][0] in bounds:
                return

    while at < end:
        m = TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        held.append(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in RAW and not closing:
            if name == "svg" and m[3].endswith("/"):  # elsewhere in HTML the slash means nothing
                continue
            stop = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        block = name in BLOCKS or name in CHROME
        if block:
            close()
        elif name == "br":
            held.append(" ")
        if name in ("html", "body"):
            continue
        if closing:
            if names.get(name):
                end_open(frozenset((name,)), (frozenset() if name in TABLE else CELLS) if block else BLOCKS)
            continue
        if name in SIBLINGS:
            end_open(*SIBLINGS[name])
        if block and names.get("p"):
            end_open(frozenset("p"), BLOCKS)
        if name in VOID:
            continue
        around = opened[-1][1] if opened else LOOSE
        state = around
        attributes = m[3]
        if around != UNSEEN and attributes:
            of = {}
            for x in ATTRIBUTE.finditer(attributes):
                of.setdefault(x[1].lower(), next((v for v in x.groups()[1:] if v is not None), ""))
            if "hidden" in of or of.get("aria-hidden", "").lower() == "true" or UNSHOWN.search(unescape(of.get("style", ""))):
                state = UNSEEN
            elif around != CHROME_ONLY:
                called = " ".join(of.get(k, "") for k in ("class", "id", "role")).lower().replace("_", "-").split()
                if not MARKED.isdisjoint(called):
                    state = CHROME_ONLY if around == ARTICLE or name in CHROME or name in ("article", "main") else MAY_HOLD
                elif around in (LOOSE, ARTICLE) and name not in ("article", "main") and any(map(likely, called)):
                    state = CHROME_ONLY if around == ARTICLE else LIKELY
        if state == around and state != UNSEEN:
            if name in CHROME and state != CHROME_ONLY:  # a form can be around a whole page
                state = MAY_HOLD if name == "form" and state != ARTICLE else CHROME_ONLY
            elif name in ("article", "main") and state in (LOOSE, MAY_HOLD, LIKELY):
                state, marked, firm = ARTICLE, True, firm or name == "main"
        if state != around:
            close()
        opened.append((name, state))
        names[name] = names.get(name, 0) + 1
    close()
    weight = [sum(len(t) for z, t in out if z == k) for k in range(4)]
    if marked and not firm and weight[2] < ARTICLE_SHARE * (weight[0] + weight[2]):
        marked, weight[0] = False, weight[0] + weight[2]
        out = [(0 if z == 2 else z, t) for z, t in out]
    soft = 0 if not marked and weight[3] > weight[0] else 1
    return marked, [(soft if z == 3 else z, t) for z, t in out]


def shared_starts(tokens: np.ndarray, sizes: np.ndarray, page: np.ndarray, other: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """Where repeats begin in ``tokens``, streams of ``sizes`` one after another: at their first ``least`` tokens another
    ``page`` has the same; a stretch that isn't ``other`` counts only if another page has it in a stream that is.

    The suffixes of all streams are sorted by prefix doubling as far as ``least`` tokens (a power of two), which is as much
    of the suffix array and its common-prefix lengths as decides this. Streams end in separators that equal nothing.
    """
    sizes = np.asarray(sizes, np.int64)
    stream = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tokens)) + stream  # a separator after each stream before
    n = len(tokens) + len(sizes)
    if not len(tokens):
        return np.empty(0, np.int64)
    names, number = np.unique(tokens, return_inverse=True)
    rank = np.full(n, -1, np.int64)
    rank[at] = number.ravel()
    stops = rank < 0
    rank[stops] = len(names) + np.arange(len(sizes))
    reach = 1
    while reach < least:
        after = np.full(n, -1, np.int64)
        after[:-reach] = rank[reach:]
        both = rank * (n + 2) + after + 1  # ranks are below n, so a pair is one number
        order = np.argsort(both, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, both[order[1:]] != both[order[:-1]]])
        reach *= 2
    rank = rank[at]
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    owner, free, ends = np.asarray(page)[stream[order]], np.asarray(other)[stream[order]], np.iinfo(np.int64)
    several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    # of the occurrences outside of articles: the smallest and largest page
    low = np.minimum.reduceat(np.where(free, owner, ends.max), starts)[group]
    high = np.maximum.reduceat(np.where(free, owner, ends.min), starts)[group]
    wide = np.where(free, several[group], np.logical_or.reduceat(free, starts)[group] & ((low != owner) | (high != owner)))
    return np.sort(order[wide])


def covered(starts: np.ndarray, n: int, least: int = MIN_RUN) -> np.ndarray:
    """Which of ``n`` tokens lie in a run of ``least`` that begins at one of ``starts``."""
    starts = np.unique(starts)
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(np.minimum(starts + least, n), minlength=n + 1)[:n + 1])[:n] > 0


def repeated(streams: list[list[list[str]]], zones: list[list[int]], least: int = MIN_RUN) -> list[list[np.ndarray]]:
    """For the blocks of each page, which tokens lie in a run of at least ``least`` tokens that another page has too; for
    tokens of article blocks (zone 2) it counts only if another page has it in a block of another zone.

    One suffix array over all pages at once: extract() is held against it. Pages with one and the same stream are one page.
    """
    ids: dict[str, int] = {}
    same: dict[tuple, int] = {}
    blocks = [b for page in streams for b in page]
    pages = [k for page in streams for k in [same.setdefault(tuple(map(tuple, page)), len(same))] * len(page)]
    sizes = np.array([len(b) for b in blocks], np.int64)
    tokens = np.array([ids.setdefault(t, len(ids)) for b in blocks for t in b], np.int64)
    mask = covered(shared_starts(tokens, sizes, np.array(pages), np.array([z for zone in zones for z in zone]) != 2, least), len(tokens), least)
    cut_up = iter(np.split(mask, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return [[next(cut_up) for _ in page] for page in streams]


def _seed(host: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def anchors(tokens: np.ndarray, sizes: np.ndarray, host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every stretch of MIN_RUN tokens within a block its anchor: hashes together with the host, places among ``tokens``
    (hashes of the words of all blocks) and blocks; each place once, of equal hashes in a stretch the first."""
    block = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.flatnonzero(np.arange(len(tokens)) + MIN_RUN <= np.cumsum(sizes)[block])
    if not len(begins):
        return np.empty(0, np.uint64), begins, begins
    reach, run = 1, tokens
    while reach < ANCHOR:
        after = np.zeros_like(run)
        after[:-reach] = run[reach:]
        run = mix64(run * np.uint64(0x9E3779B97F4A7C15) + after)
        reach *= 2
    places = np.unique(begins + np.lib.stride_tricks.sliding_window_view(run, MIN_RUN - ANCHOR + 1)[begins].argmin(axis=1))
    return mix64(run[places] ^ _seed(host)), places, block[places]


def tokens_of(html: str) -> tuple[bool, np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
    """Of a page: whether it marks an article, zones, words, sizes and word hashes of its blocks."""
    marked, found = cut(html)
    words = [t.split(" ") for _, t in found]
    hashes = word_hashes([w for ws in words for w in ws]) if words else np.empty(0, np.uint64)
    return marked, np.array([z for z, _ in found], np.int64), words, np.array([len(w) for w in words], np.int64), hashes


def _kinds(marked: bool, zone: np.ndarray) -> np.ndarray:
    """Bit 1: outside of articles; bit 2: main text."""
    return ((zone != 2) + 2 * (zone == (2 if marked else 0))).astype(np.uint8)


def _packed(key: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row per value of ``key`` (first of ``names``) with its part of every column as bytes."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    parts = [pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]].astype(np.int64)), *parts], names=names)


def _shared_anchors(rows: DataFrame, shards: int) -> DataFrame:
    """(nonce, keys): anchors of a page that another page of its host has too, where one has it as main text and one outside of articles."""

    def deal(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def shipped() -> pa.RecordBatch:
            keys, nonces, kinds = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return _packed((keys % np.uint64(shards)).astype(np.int64), [keys, nonces, kinds], ["shard", "keys", "nonces", "kinds"])

        for batch in part:
            for h, nonce, html in zip(*(batch.column(c).to_pylist() for c in ("host", "nonce", "html")), strict=True):
                marked, zone, _, sizes, tokens = tokens_of(html)
                keys, _, block = anchors(tokens, sizes, h)
                if len(keys):
                    held.append((keys, np.full(len(keys), nonce, np.int64), _kinds(marked, zone)[block]))
            if sum(len(x[0]) for x in held) >= HELD:
                yield shipped()
        if held:
            yield shipped()

    def meet(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(part, ["shard"]):
            key, nonce, kind = (np.concatenate([np.frombuffer(x, d) for x in t.column(c).to_pylist()]) for c, d in (("keys", np.uint64), ("nonces", np.int64), ("kinds", np.uint8)))
            order = np.argsort(key, kind="stable")
            key, nonce, kind = key[order], nonce[order], kind[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            met = (np.minimum.reduceat(nonce, starts) != np.maximum.reduceat(nonce, starts)) & (np.bitwise_or.reduceat(kind, starts) == 3)
            at = np.flatnonzero(np.repeat(met, np.diff(np.r_[starts, len(key)])))
            if len(at):
                yield _packed(nonce[at], [key[at]], ["nonce", "keys"])

    n = max(partitions(rows.sparkSession), shards // 4)
    dealt = rows.select("host", "nonce", "html").mapInArrow(deal, "shard long, keys binary, nonces binary, kinds binary").repartition(n, "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(meet, "nonce long, keys binary"), "anchors")


def _repeats(rows: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """(nonce, starts): where repeats begin in the main text of a page, among the tokens of all its blocks."""
    held_by = shared.groupBy("nonce").agg(F.collect_list("keys").alias("keys"))
    around = rows.join(held_by, "nonce")

    def deal(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens around shared anchors, from the first to the last that a stretch of MIN_RUN with this anchor can have."""
        for batch in part:
            out: list[list] = [[] for _ in range(6)]
            for h, nonce, copy, html, keys in zip(*(batch.column(c).to_pylist() for c in ("host", "nonce", "copy", "html", "keys")), strict=True):
                marked, zone, _, sizes, tokens = tokens_of(html)
                key, place, block = anchors(tokens, sizes, h)
                own = np.isin(key, np.frombuffer(b"".join(keys), np.uint64))
                key, place, block = key[own], place[own], block[own]
                begin = np.maximum(place - (MIN_RUN - ANCHOR), (np.cumsum(sizes) - sizes)[block])
                end = np.minimum(place + MIN_RUN, np.cumsum(sizes)[block])
                kind, brief = _kinds(marked, zone)[block], (tokens ^ _seed(h)).astype(np.uint32)  # hosts in one shard have no token in common
                for column, value in zip(out, ((key % np.uint64(shards)).astype(np.int64).tolist(), [nonce] * len(key), [copy] * len(key), kind.tolist(), begin.tolist(),
                                               [brief[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), strict=True):
                    column += value
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary()), strict=True)],
                                             names=["shard", "nonce", "copy", "kind", "begin", "tokens"])

    def sort_suffixes(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(part, ["shard"]):
            nonce, copy, kind, begin = (t.column(c).to_numpy() for c in ("nonce", "copy", "kind", "begin"))
            streams = t.column("tokens").to_pylist()
            sizes = np.array([len(x) // 4 for x in streams], np.int64)
            starts = shared_starts(np.frombuffer(b"".join(streams), np.uint32), sizes, copy, (kind & 1) > 0)
            stream = np.repeat(np.arange(len(sizes)), sizes)[starts]
            starts, stream = starts[(kind[stream] & 2) > 0], stream[(kind[stream] & 2) > 0]
            if len(starts):
                yield _packed(nonce[stream], [begin[stream] + starts - (np.cumsum(sizes) - sizes)[stream]], ["nonce", "starts"])

    dealt = around.select("host", "nonce", "copy", "html", "keys").mapInArrow(deal, "shard long, nonce long, copy long, kind byte, begin long, tokens binary")
    dealt = dealt.repartition(max(partitions(rows.sparkSession), shards // 4), "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(sort_suffixes, "nonce long, starts binary"), "repeats")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html (null: empty).

    Blocks are joined by two line ends. Pages with near copies of one main text count as one page (classes of the n-gram
    join, before anything is taken away, among pages that share an anchor), and a repeat is found wherever two other pages
    of a host have it. Repeated rows each give a row; a page whose url is null or names no host is compared with none, and
    a page without text gives an empty one.
    """
    spark = pages.sparkSession
    short_batches(spark)
    host = F.regexp_replace(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(host, r"^/*([^/?#]*)", 1), "^.*@", ""), r"^www\.|:[^:]*$", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("nonce", F.xxhash64("page_id", "url", "html"))
    rows = rows.withColumn("host", F.when(F.col("host") == "", F.concat(F.lit("/"), F.col("nonce").cast("string"))).otherwise(F.col("host")))
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shared = _shared_anchors(rows, max(2 * partitions(spark), -(-size // SHARD_BYTES)))
    met = written(shared.select("nonce").distinct(), "met")
    near = rows.join(bounded(met), "nonce", "left_semi")

    def texts(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            main = [" ".join(t for z, t in found if z == (2 if marked else 0)) for marked, found in map(cut, batch.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("nonce"), pa.array(main, pa.string())], names=["nonce", "text"])

    alike = join(near.select("nonce", "html").mapInArrow(texts, "nonce long, text string"), threshold=NEAR, id_col="nonce")
    alike = written(alike.where("class_id <> doc_id").select(F.col("doc_id").alias("nonce"), "class_id").distinct(), "copies")
    near = near.join(bounded(alike), "nonce", "left").withColumn("copy", F.coalesce("class_id", "nonce"))
    around = (shared.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8 * 4 * (2 * MIN_RUN - ANCHOR)
    gone = _repeats(near, shared, max(2 * partitions(spark), -(-around // SHARD_BYTES)))
    cut_from = bounded(written(gone.select("nonce").distinct(), "cut-from"))

    def judge(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            out = []
            for html, gone in zip(batch.column("html").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                marked, found = cut(html)
                kept = [(z == (2 if marked else 0), t) for z, t in found]
                if gone:
                    words = [t.split(" ") for _, t in kept]
                    stays = iter((~covered(np.frombuffer(b"".join(gone), np.int64), sum(map(len, words)))).tolist())
                    kept = [(main, " ".join([w for w in ws if next(stays)])) for (main, _), ws in zip(kept, words, strict=True)]
                out.append("\n\n".join(t for main, t in kept if main and t))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    whole = rows.join(cut_from, "nonce", "left_anti").withColumn("starts", F.lit(None).cast("array<binary>"))
    parts = rows.join(cut_from, "nonce", "left_semi").join(gone.groupBy("nonce").agg(F.collect_list("starts").alias("starts")), "nonce")
    columns = ("page_id", "url", "html", "starts")
    both = whole.select(*columns).unionByName(parts.select(*columns))
    return both.mapInArrow(judge, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
