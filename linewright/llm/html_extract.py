"""HTML extraction: the article's own text, with a host's repeated runs removed by suffix arrays.

A tolerant scanner cuts a page into blocks. Scripts, styles, forms, menus, footers, sidebars and other elements that are
never part of an article are set aside, and so are block elements whose class or id says nothing but that (``cookie-notice``,
not ``content-with-sidebar``). If the page marks its article (or else its main part), those blocks are its candidates; if it marks
none, all that is not set aside.

Then repetition decides, on every page. The token streams of a host's pages are concatenated, a suffix array with the lengths
of common prefixes gives the maximal runs of ``min_run`` tokens or more that stand on at least ``share`` of the host's distinct
pages and on ``least`` of them: a template's text, not a passage that some pages quote. Pages with equal or nearly equal
candidates (one least hash of their token windows) count as one, so copies make no template. Where an article is marked, a
block that lies in such runs as a whole goes, unless half of the article would; where none is marked, the covered tokens go,
unless all would. Hosts of fewer than ``least`` distinct pages have no templates.

A host's distinct pages are dealt by their least hash to parts of ``part_pages`` at most on average, one array each. A run on ``share`` of
all pages stands on ``share`` of some part (pigeonhole), so the parts' runs are all that need to be counted over a whole host; that
is done by windows of ``min_run`` tokens, and exactly. No host has to fit into one task.

Null html gives an empty text; pages without a host share no template. Pages that repeat are answered each, alike. Equal candidates of one least hash are told
apart by the smaller hash of their blocks. Very long pages are scanned and searched whole. An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored, table, tidy_shuffles
from .url_filter import url_parts

# Element names of HTML and words that sites use in class and id.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog search fieldset head noscript template button select datalist object video audio canvas map svg math iframe".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav widget widgets related recommended recommendations trending share sharing social comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search searchbox pagination pager toolbar disclaimer copyright".split())
PLAIN_WORDS = frozenset("box block bar area section container wrapper wrap inner outer list item items link links button buttons site page main top bottom left right primary secondary global user reader post article text form panel slot unit row group".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note status".split())
ARTICLE_WORDS = frozenset(("articlebody", "article-body", "post-content", "post-body", "entry-content", "article-content"))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
#: What holds a block: an element that is never part of an article; one named so by class or id, which may yet hold the article
#: (WRAPPED; it counts if no other is marked); nothing; the main part; the article.
NEVER, SET_ASIDE, OPEN, WRAPPED, MAIN, ARTICLE = -2, -1, 0, 1, 2, 3


def _says_aside(value: str, words: frozenset) -> bool:
    """Whether one of the names in a class or id consists of words for what is set aside, and of plain ones."""
    for name in value.split():
        found = set(_WORD.findall(name))
        if found & words and found <= words | PLAIN_WORDS:
            return True
    return False


def _kind(tag: str, attributes: str, within: int) -> int:
    """What an element makes of its content, given where it stands; ``within`` if it changes nothing."""
    if within == NEVER or tag in ASIDE_TAGS or tag == "header" and within in (OPEN, WRAPPED):
        return NEVER
    kind = ARTICLE if tag == "article" else MAIN if tag == "main" else within
    aside = False
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = next((v for v in m.groups()[1:] if v is not None), "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return NEVER
            if name == "role":
                if value in ASIDE_ROLES:
                    return NEVER
                kind = max(kind, {"main": MAIN, "article": ARTICLE}.get(value, kind))
            elif name in ("class", "id"):
                if not ARTICLE_WORDS.isdisjoint(value.split()):
                    kind = max(kind, ARTICLE)
                elif tag in BLOCKS and tag not in ("html", "body", "article", "main"):
                    if _says_aside(value, ASIDE_WORDS):
                        if "comment" in value or "repl" in value or "respond" in value or "disqus" in value:
                            return NEVER  # readers' comments are articles of their own in some pages
                        aside = True
                    elif within < MAIN and _says_aside(value, HEAD_WORDS):
                        aside = True
            elif name == "itemprop" and value == "articlebody":
                kind = max(kind, ARTICLE)
    if aside:
        return SET_ASIDE
    if within in (SET_ASIDE, WRAPPED):
        return WRAPPED if kind >= WRAPPED else within
    return max(kind, within)


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block that is not empty, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = block_kind = OPEN

    def close() -> None:
        if held:
            text = "".join(held)
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                out.append((block_kind, text))
            held.clear()

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            if not held:
                block_kind = kind
            elif block_kind != kind:  # a change of kind ends a block even without a block element
                close()
                block_kind = kind
            held.append(page[at:mark])
        if mark == n:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if page[mark + 1 : mark + 2] in ("!", "?"):
            end = page.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, mark)
        if not m:
            if mark + 1 < n and (page[mark + 1].isalpha() or page[mark + 1] == "/"):  # a broken tag: up to the next >
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            else:
                if not held:
                    block_kind = kind
                held.append("<")
                at = mark + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag in BLOCKS:
            close()
        elif tag in ("br", "img") and held:
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    kind = stack[k][1]
                    del stack[k:]
                    break
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = n if stop < 0 else stop + 1
        elif tag not in VOID_TAGS and not attributes.endswith("/"):
            new = _kind(tag, attributes, kind)
            if new != kind or tag in BLOCKS and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                stack.append((tag, kind))
                kind = new
    close()
    return out


PARSED_SCHEMA = "page_id long, url string, host string, marked boolean, packed binary, sig long, content long"


def packed(blocks: list[str]) -> bytes:
    """Blocks hold no line ends; pages are stored and shuffled in this form."""
    return zstandard.compress("\n".join(blocks).encode("utf-8", "surrogatepass"), 3)


def unpacked(found: bytes) -> list[str]:
    text = zstandard.decompress(found).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def token_hashes(texts: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for t in texts for w in t.split(" ")), np.uint64)


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    if len(tokens) < width:
        return np.zeros(0, np.int64)
    total = np.zeros(len(tokens) - width + 1, np.uint64)
    for k in range(width):
        total = (total ^ tokens[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


def candidates(page: str) -> tuple[bool, list[str]]:
    """Whether the page marks its article or main part, and the blocks of it, or else all that are not set aside."""
    blocks = page_blocks(page)
    level = max((k for k, _ in blocks if k >= OPEN), default=OPEN)
    return level > OPEN, [t for k, t in blocks if k == level]


def parse(pages: DataFrame) -> DataFrame:
    """Each page's candidate blocks, a least hash of their token windows (sig) and a hash of them all (content)."""
    rows = pick(pages, page_id="long", url="string", html="string")
    host, _ = url_parts(F.col("url"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            marks, found, sigs, contents = [], [], [], []
            for page in batch.column("html").to_pylist():
                mark, blocks = candidates(page or "")
                tokens = token_hashes(blocks)
                windows = window_hashes(tokens, min(4, len(tokens))) if len(tokens) else np.zeros(1, np.int64)
                marks.append(mark)
                found.append(packed(blocks))
                sigs.append(windows.min())
                contents.append(int(np.bitwise_xor.reduce(windows * np.arange(1, 2 * len(windows) + 1, 2))))
            columns = [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(marks, pa.bool_()), pa.array(found, pa.binary()), pa.array(sigs, pa.int64()), pa.array(contents, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "marked", "packed", "sig", "content"])

    return rows.select("page_id", "url", host.alias("host"), "html").mapInArrow(scan, PARSED_SCHEMA)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of numbers (of at least 0)."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _deeper(depth: int, rank: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """Ranks by up to twice as many tokens; places beyond the end come first."""
    step = min(depth, most - depth)
    behind = np.append(rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64))
    return depth + step, _ranks(rank, behind)


def _pages_of(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix, on how many distinct pages those of its rank begin."""
    pair = np.unique(rank * (int(page.max(initial=0)) + 1) + page)
    return np.bincount(pair // (int(page.max(initial=0)) + 1), minlength=int(rank.max(initial=-1)) + 1)[rank]


def repeated_runs(streams: list[np.ndarray], least: int, min_run: int) -> list[tuple[int, int, int]]:
    """(page, start, length) of the maximal runs of ``min_run`` tokens or more that stand on ``least`` of the pages, each once.

    The suffix array is sorted by doubling, from 1 to ``min_run`` tokens and on until no run so long is frequent. Suffixes whose
    first ``min_run`` tokens stand on too few pages begin no run and leave it. The ranks give the common prefixes of neighbours.
    The least neighbourhoods with suffixes of ``least`` pages, and what a suffix shares with the best of them, say how long a
    run begins at it; one that goes on from a run further left is not maximal.
    """
    size = np.array([len(x) for x in streams], np.int64)
    page = np.repeat(np.arange(len(streams)), size + 1)  # a free place after each page
    end = np.cumsum(size + 1)[page] - 1
    n = len(page)
    if not n:
        return []
    if least < 2:  # whole pages are runs then
        return [(p, 0, int(k)) for p, k in enumerate(size) if k >= min_run]
    at = np.arange(n)
    rank = np.zeros(n, np.int64)
    rank[at != end] = np.unique(np.concatenate(streams), return_inverse=True)[1] + 1
    levels = [(1, rank)]  # ranks by so many tokens
    while levels[-1][0] < min_run:
        levels.append(_deeper(*levels[-1], min_run))
    room = end - at  # tokens up to the page's end
    rank = np.where(room >= min_run, levels[-1][1], -1)
    alive = np.flatnonzero(room >= min_run)
    alive = alive[_pages_of(rank[alive], page[alive]) >= least]
    if not len(alive):
        return []
    own = page[alive]
    while (deep := alive[room[alive] >= levels[-1][0]]).size and (_pages_of(levels[-1][1][deep], page[deep]) >= least).any():
        levels.append(_deeper(*levels[-1], 2 * levels[-1][0]))
    order = np.argsort(levels[-1][1][alive], kind="stable")  # the suffix array
    x, y = alive[order[:-1]], alive[order[1:]]
    common = np.zeros(len(x), np.int64)
    for depth, rank in reversed(levels):
        a, b = np.minimum(x + common, n - 1), np.minimum(y + common, n - 1)
        common += np.where(rank[a] == rank[b], depth, 0)
    common = np.minimum(common, np.minimum(room[x], room[y]))
    best = _best_shared(own[order].tolist(), [0, *common.tolist()], least)
    shared = np.empty(len(alive), np.int64)
    shared[order] = best
    where = np.full(n, -1)
    where[alive] = np.arange(len(alive))
    before = where[np.maximum(alive - 1, 0)]
    outer = np.flatnonzero((alive == 0) | (before < 0) | (shared[before] != shared + 1) | (own[before] != own))
    begins = np.cumsum(size + 1) - size - 1
    out: dict[bytes, tuple[int, int, int]] = {}  # runs that are the same count once
    for p, a, length in zip(own[outer].tolist(), (alive - begins[own])[outer].tolist(), shared[outer].tolist()):
        out.setdefault(streams[p][a : a + length].tobytes(), (p, a, length))
    return list(out.values())


def _best_shared(pages: list[int], common: list[int], least: int) -> list[int]:
    """For each suffix, in order, the longest prefix that suffixes of ``least`` pages have; ``common`` with the one before."""
    n, count, distinct, left = len(pages), {}, 0, 0
    best = [0] * n
    lows: deque = deque()  # places of falling minima of common in the neighbourhood, without its first
    for right in range(n):
        while lows and common[lows[-1]] >= common[right]:
            lows.pop()
        lows.append(right)
        count[pages[right]] = count.get(pages[right], 0) + 1
        distinct += count[pages[right]] == 1
        while distinct >= least:
            if count[pages[left]] == 1 and distinct == least:  # as small as it gets
                while lows and lows[0] <= left:
                    lows.popleft()
                low = common[lows[0]] if lows else 1 << 60
                best[right] = max(best[right], low)
                best[left] = max(best[left], low)
            count[pages[left]] -= 1
            distinct -= count[pages[left]] == 0
            left += 1
    for k in range(1, n):
        best[k] = max(best[k], min(best[k - 1], common[k]))
    for k in range(n - 2, -1, -1):
        best[k] = max(best[k], min(best[k + 1], common[k + 1]))
    return best


def _distinct_pages(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The token streams of each part's distinct pages, from rows (host, part, parts, sig, packed) sorted by these."""
    for key, own in groupby(rows, lambda r: r[:3]):
        yield key, [token_hashes(unpacked(next(same)[4])) for _, same in groupby(own, lambda r: r[3])]


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def template_windows(parsed: DataFrame, min_run: int, share: float, least: int, part_pages: int) -> DataFrame:
    """(host, run) for every window of ``min_run`` tokens in a run that enough of the host's distinct pages hold."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the copies in a batch the first: what copies there are does not pile up in one task."""
        for batch in batches:
            order = sorted((*row, k) for k, row in enumerate(_rows([batch], "host", "sig", "content")))
            kept = [next(same)[3] for _, same in groupby(order, lambda r: r[:2])]
            yield batch.take(pa.array(kept, pa.int64()))

    own = parsed.where("host != ''").select("host", "sig", "content", "packed")
    # pages are shuffled once: hosts of several parts, one for each part_pages rows at most, are broadcast, all others have one
    large = own.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_pages).select("host", F.ceil(F.col("n") / F.lit(part_pages)).cast("int").alias("parts"))
    dealt = own.mapInArrow(once, own.schema).join(F.broadcast(large), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "sig", "content", "packed").select("host", "part", "parts", "sig", "packed")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _, parts), streams in _distinct_pages(_rows(batches, "host", "part", "parts", "sig", "packed")):
            enough = max(least if parts == 1 else 1, int(np.ceil(share * len(streams) - 1e-9)))
            runs = repeated_runs(streams, enough, min_run) if len(streams) >= enough else []
            if parts == 1 and not runs:
                continue
            found = [window_hashes(streams[p][a : a + size], min_run) for p, a, size in runs]
            found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            n = len(found) + 1  # a row without a run says how many pages the part has
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([parts] * n, pa.int32()), pa.array([None, *found.tolist()], pa.int64()), pa.array([len(streams)] * n, pa.int64())], names=["host", "parts", "run", "pages"])

    found = stored(dealt.mapInArrow(runs, "host string, parts int, run long, pages long"))
    one = found.where("parts = 1 AND run IS NOT NULL").select("host", "run")
    several = found.where("parts > 1 AND run IS NOT NULL").select("host", "run").distinct()
    if not several.limit(1).count():
        return one

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, _, _), streams in _distinct_pages(_rows(batches, "host", "part", "parts", "sig", "packed")):
            found, counts = np.unique(np.concatenate([np.unique(window_hashes(x, min_run)) for x in streams]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(found), pa.array(counts, pa.int64())], names=["host", "run", "n"])

    counts = dealt.where("parts > 1").mapInArrow(windows, "host string, run long, n long").join(several, ["host", "run"], "left_semi").groupBy("host", "run").agg(F.sum("n").alias("n"))
    sizes = found.where("parts > 1 AND run IS NULL").groupBy("host").agg(F.greatest(F.ceil(F.sum("pages") * F.lit(share) - F.lit(1e-9)), F.lit(least)).alias("enough"))
    return one.unionByName(counts.join(sizes, "host").where("n >= enough").select("host", "run"))


def without_runs(blocks: list[str], marked: bool, runs: np.ndarray, min_run: int) -> str:
    """The blocks without what lies in windows of ``runs`` (sorted)."""
    kept = blocks
    if len(runs) and blocks:
        windows = window_hashes(token_hashes(blocks), min_run)
        hit = runs[np.minimum(np.searchsorted(runs, windows), len(runs) - 1)] == windows
        if hit.any():
            n = len(windows) + min_run - 1
            change = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(change, at, 1)
            np.add.at(change, at + min_run, -1)
            gone = np.cumsum(change[:n]) > 0
            stop = np.cumsum([t.count(" ") + 1 for t in blocks])
            if marked:
                own = [not gone[b - t.count(" ") - 1 : b].all() for t, b in zip(blocks, stop)]
                left = sum(t.count(" ") + 1 for t, o in zip(blocks, own) if o)
                kept = [t for t, o in zip(blocks, own) if o] if 2 * left > n else blocks
            else:
                parts = [" ".join(w for w, g in zip(t.split(" "), gone[b - t.count(" ") - 1 : b]) if not g) for t, b in zip(blocks, stop)]
                kept = [t for t in parts if t] or blocks
    return "\n".join(kept)


FEW_RUNS = 1 << 18  # windows of all hosts' templates that are broadcast, a few MB; more are joined by host


def extract_text(pages: DataFrame, min_run: int = 8, share: float = 0.3, least: int = 3, part_pages: int = 400) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    with tidy_shuffles(pages.sparkSession):
        parsed = stored(parse(pages))
        runs = stored(template_windows(parsed, min_run, share, least, part_pages))
    templates = runs.groupBy("host").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    if runs.count() <= FEW_RUNS:  # all templates go to the pages, which stay where they are
        joined = parsed.join(F.broadcast(templates), "host", "left")
    else:
        # a host's template is at most 1 / share times as long as its pages are on average; large hosts take it in several copies
        copies = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1000").select("host", F.least(F.ceil(F.col("n") / 1000), F.lit(256)).cast("int").alias("copies"))
        templates = templates.join(copies, "host", "left").select("host", "runs", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
        placed = parsed.join(copies, "host", "left").withColumn("copy", F.pmod(F.xxhash64("page_id", "content"), F.coalesce("copies", F.lit(1))).cast("int"))
        joined = placed.join(templates, ["host", "copy"], "left")

    @F.pandas_udf("string")
    def clean(found: pd.Series, marked: pd.Series, runs: pd.Series) -> pd.Series:
        none = np.zeros(0, np.int64)
        return pd.Series([without_runs(unpacked(b), m, none if r is None else np.asarray(r, np.int64), min_run) for b, m, r in zip(found, marked, runs)], dtype=object)

    found = joined.select("page_id", "url", clean("packed", "marked", "runs").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
