"""Main text of HTML pages: structure proposes it, a suffix array per host takes the boilerplate out.

Structure: a page is read once, into blocks, each with its place: in a ``main`` or ``article``
element, in chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tag,
role or name), or in neither. The blocks of ``main`` (else of the articles) are proposed; of a page
that has neither, all blocks outside chrome. Names of classes and ids are weak evidence: all parts of
one have to be words for furniture, and an element inside an article needs no more than its tag.

Repetition: the token streams of all that is not proposed by ``main`` or ``article``, and of what is
proposed on pages with several articles, from all pages
of a host, are concatenated, and their suffixes are sorted by their first ``RUN`` tokens. A prefix
that occurs on two distinct pages is repeated. A repeated substring of at least that length is a run
of such prefixes, so the union of their windows is what neighbours in a full suffix array with so long
a common prefix cover. On pages without an article, covered tokens go and the unique runs of every
block stay; a page that would lose everything (a copy of another page) keeps its proposed blocks. Every
article is looked up as well: one that such runs cover whole (a teaser that the host shows on several pages) goes,
if a longer one of the page, or its ``main``, has a unique run. An article with a unique run, or the longest of its page, stays whole: its headline or opening may well be what lists and adverts on other pages
repeat. Only on request (``strays``) a block of an article goes that such runs cover whole and that begins
a block in the article of another page as well.

The sorted array of a host of any size is spread by prefix: a prefix only keeps the smallest and
the largest page it occurs on, which is combined before the shuffle, so neither a host nor a passage
that a third of all pages share is gathered in one task. Of an article the first prefix is looked up (for ``strays``, that of each
block); the others follow where it is repeated, since a run that covers it begins with it.

Defined results for odd input: null and empty pages give an empty text; a null or odd url belongs to
an unnamed host; pages with equal urls count as one page, so that a page crawled twice does not
look repeated; repeated rows give repeated results; pages of any length are read whole; unclosed
tags and comments end with the page; an empty table gives an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow, materialize

#: Tokens of the shortest repeated substring that counts.
RUN = 8

# Names of HTML elements and roles, and usual names of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = set("aside audio button canvas datalist dialog footer form head header map menu nav object search select svg video".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = set("comment comments disqus respond".split())
AROUND = set(
    "area bar block bottom box button buttons container content icons inner item items left link links list main outer page panel primary right secondary "
    "section site slot the top wrap wrapper".split()
)
HEAD = set("base head html link meta noscript script style template title".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")

#: What an element is in: nothing special; an article in furniture that only its name tells; such furniture; a form; chrome for certain.
OPEN, SHADED, NAMED, FORM, CHROME_FOR_CERTAIN = range(5)


@dataclass(frozen=True)
class Place:
    """``article``: the number of the outermost article element, from 1; 0: none."""

    kind: int = OPEN
    main: bool = False
    article: int = 0


@dataclass(frozen=True)
class Block:
    place: Place
    text: str


def _furniture(names: str) -> set[str]:
    """The words for furniture in names that consist of such words and of words for places."""
    found: set[str] = set()
    for name in names.lower().split():
        parts = {p for p in re.split(r"[-_]+", name) if p}
        if parts & FURNITURE and parts <= FURNITURE | AROUND:
            found |= parts & FURNITURE
    return found


def _inside(tag: str, attributes: str, around: Place, articles: int) -> Place:
    """The place of what an element holds; ``articles`` have been opened so far."""
    kind, main, article = around.kind, around.main, around.article
    if kind == CHROME_FOR_CERTAIN or tag in {"html", "body"}:
        return around
    given = {}
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            given.setdefault((m[1] or m[5]).lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I)
    opens = tag in {"article", "main"} or role in {"article", "main"}
    within = main or article > 0
    own = tag == "header" and within  # an article's own heading
    if hidden or role in ROLES or (tag in CHROME and tag != "form" and not own):
        return Place(CHROME_FOR_CERTAIN, main, article)
    named = _furniture(f"{given.get('class', '')} {given.get('id', '')}") if not own else set()
    if named:
        kind = CHROME_FOR_CERTAIN if opens or within or named & COMMENTS else max(kind, NAMED)
    if tag == "form":
        kind = CHROME_FOR_CERTAIN if within else max(kind, FORM)
    if opens and kind != CHROME_FOR_CERTAIN:
        kind = {NAMED: SHADED, FORM: OPEN}.get(kind, kind)
        main = main or "main" in {tag, role}
        article = article or (articles + 1 if "article" in {tag, role} else 0)
    return Place(kind, main, article)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, each with its place."""
    found: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, Place]] = []
    opened: Counter = Counter()  # of the stack: an end tag of nothing open costs nothing
    place, at, articles = Place(), 0, 0

    def flush():
        text = " ".join("".join(held).split())
        if text:
            found.append(Block(place, text))
        held.clear()

    def close(k: int):
        nonlocal place
        opened.subtract(tag for tag, _ in stack[k:])
        del stack[k:]
        place = stack[-1][1] if stack else Place()

    def close_open(names: tuple[str, ...], scope: set[str]):
        """Close the outermost open element of these names within a scope."""
        last = None
        if not any(opened[name] for name in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in scope:
                break
            if stack[k][0] in names:
                last = k
        if last is not None:
            close(last)

    end = len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            held.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if tag == "br":
            held.append(" ")
            continue
        if block or (tag in CHROME):
            flush()
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if (stack[k - 1][1] if k else Place()) != place:
                        flush()
                    close(k)
                    break
                if not block and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if block:
            close_open(("p",), BLOCK - {"p"})
        if tag in CLOSES:
            close_open(CLOSES[tag], SCOPES[tag])
        if tag in VOID or m[3].rstrip().endswith("/") and not block:
            continue
        inner = _inside(tag, m[3], place, articles)
        articles = max(articles, inner.article)
        if inner != place:
            flush()
        stack.append((tag, inner))
        opened[tag] += 1
        place = inner
    flush()
    return found


def propose(found: list[Block]) -> tuple[list[bool], bool]:
    """Which blocks structure takes for the main text, and whether an article or main element says so."""
    inside = [b.place.main or b.place.article > 0 for b in found]
    for kind in (OPEN, SHADED):
        chosen = [x and b.place.kind == kind for x, b in zip(inside, found, strict=True)]
        if not any(chosen):
            continue
        if any(x and b.place.main for x, b in zip(chosen, found, strict=True)):
            chosen = [x and b.place.main for x, b in zip(chosen, found, strict=True)]
            sizes: Counter = Counter()
            for x, b in zip(chosen, found, strict=True):
                sizes[b.place.article] += len(b.text.split()) if x else 0
            own = sizes.pop(0, 0)
            if len(sizes) > 1 and own > max(sizes.values()):  # the story is not in the articles: they are teasers
                chosen = [x and not b.place.article for x, b in zip(chosen, found, strict=True)]
        return chosen, True
    return [b.place.kind == OPEN for b in found], False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _prefixes(streams: list[list[str]], hosts: list[int], first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes that have RUN tokens: the number of their stream, their place in it, and a hash of its host and their first RUN tokens.

    ``first``: of whole streams only. All streams are hashed together, whatever their lengths.
    """
    digest = xxhash.xxh3_64_intdigest
    held = np.array([digest(t) for s in streams for t in (s[:RUN] if first else s)], dtype=np.uint64)
    sizes = np.array([min(len(s), RUN) if first else len(s) for s in streams], dtype=np.int64)
    stream = np.repeat(np.arange(len(streams)), sizes)
    n = max(0, len(held) - RUN + 1)
    begins = np.flatnonzero(stream[:n] == stream[RUN - 1 :][:n])
    found = np.array(hosts, dtype=np.uint64)[stream[begins]]
    for k in range(RUN):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + held[begins + k])
    return stream[begins], begins - (np.cumsum(sizes) - sizes)[stream[begins]], found.view(np.int64)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    """The values of each of ``rows`` rows; ``row`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _stream(texts: list[str]) -> list[str]:
    """Words with a mark behind every block."""
    return [t for text in texts for t in (*text.split(), "\n")]


def _streams(found: list[Block], proposed: list[bool], closed: bool) -> list[list[str]]:
    """The token streams that count for repetition: what lies between the proposed blocks of an article, or all."""
    if not closed:
        return [_stream([b.text for b in found])]
    runs: list[list[str]] = [[]]
    for b, x in zip(found, proposed, strict=True):
        if x:
            runs.append([])
        else:
            runs[-1].append(b.text)
    return [_stream(r) for r in runs if r]


def _regions(texts: list[str], regions: list[int]) -> dict[int, list[str]]:
    """The token stream of each article among the proposed blocks; 0: what is in none, of ``main``."""
    found: dict[int, list[str]] = {}
    for text, region in zip(texts, regions, strict=True):
        found.setdefault(region, []).append(text)
    return {region: _stream(held) for region, held in found.items()}


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


READ = "at long, page_id long, url string, host long, page long, closed boolean, blocks array<string>, skipped array<boolean>, prefixes array<long>, heads array<long>, regions array<int>, openings array<long>"


def _read(batches) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for whole in batches:
        for k in range(0, whole.num_rows, 128):
            batch = whole.slice(k, 128)
            at, pages, hosts, closes, texts, skips = ([] for _ in range(6))
            streams, of_stream, opening, of_opening, regions, articles, of_article = ([] for _ in range(7))
            for n, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                found = blocks(page or "")
                proposed, closed = propose(found)
                at.append(part << 40 | row)
                pages.append(xxhash.xxh3_64_intdigest(url if url is not None else f"\x00{part} {row}"))
                row += 1
                hosts.append(xxhash.xxh3_64_intdigest(_host(url)))
                closes.append(closed)
                # Of a page without an article the skipped blocks are in the stream as well, and keep their places.
                taken = [(b.text, not x) for b, x in zip(found, proposed, strict=True) if x or not closed]
                texts.append([t for t, _ in taken])
                skips.append(None if closed else [x for _, x in taken])
                mine = _streams(found, proposed, closed)
                regions.append([b.place.article for b, x in zip(found, proposed, strict=True) if x] if closed else None)
                if closed:
                    own = list(_regions(texts[-1], regions[-1]).values())
                    articles += own
                    of_article += [n] * len(own)
                    mine += own if len(own) > 1 else []
                streams += mine
                of_stream += [n] * len(mine)
                if closed:
                    opening += [t.split(maxsplit=RUN)[:RUN] for t, _ in taken]
                    of_opening += [n] * len(taken)
            stream, _, prefixes = _prefixes(streams, [hosts[n] for n in of_stream])
            block, _, heads = _prefixes(opening, [hosts[n] for n in of_opening], first=True)
            article, _, openings = _prefixes(articles, [hosts[n] for n in of_article], first=True)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), batch.column("page_id"), batch.column("url"), signed(hosts), signed(pages), pa.array(closes, pa.bool_()), pa.array(texts, pa.list_(pa.string())),
                 pa.array(skips, pa.list_(pa.bool_())), _lists(prefixes, np.array(of_stream, np.int64)[stream], len(at)), _lists(heads, np.array(of_opening, np.int64)[block], len(at)),
                 pa.array(regions, pa.list_(pa.int32())), _lists(openings, np.array(of_article, np.int64)[article], len(at))],
                names=[c.split()[0] for c in READ.split(", ")],
            )


def _places(batches) -> Iterator[pa.RecordBatch]:
    """Prefixes of all suffixes that could be covered, in the order of the page: of the stream, or within each block of an article that has strayed into it."""
    for whole in batches:
        for k in range(0, whole.num_rows, 128):
            batch = whole.slice(k, 128)
            streams, hosts, of, base, telling = [], [], [], [], []
            for n, (texts, closed, host, strayed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("blocks", "closed", "host", "strayed")), strict=True)):
                at = 0
                for tokens in [t.split() for t in texts] if closed else [_stream(texts)]:
                    streams.append(tokens)
                    base.append(at)
                    telling.append(set(strayed) if closed else None)
                    hosts.append(host % 2**64)
                    of.append(n)
                    at += len(tokens)
            stream, start, prefixes = _prefixes(streams, hosts)
            heads = {int(s): int(p) for s, p in zip(stream[start == 0], prefixes[start == 0], strict=True)}
            wanted = np.array([t is None or heads.get(s) in t for s, t in enumerate(telling)], bool)
            live = wanted[stream]
            row = np.array(of, np.int64)[stream[live]]
            starts = start[live] + np.array(base, np.int64)[stream[live]]
            yield pa.RecordBatch.from_arrays([batch.column("at").take(pa.array(row)), pa.array(starts), pa.array(prefixes[live])], names=["at", "start", "prefix"])


def _region_places(batches) -> Iterator[pa.RecordBatch]:
    """Prefixes of all suffixes of the articles of pages with several."""
    for whole in batches:
        for k in range(0, whole.num_rows, 128):
            batch = whole.slice(k, 128)
            streams, hosts, of, numbers = [], [], [], []
            for n, (texts, regions, host) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("blocks", "regions", "host")), strict=True)):
                for number, tokens in _regions(texts, regions).items():
                    streams.append(tokens)
                    hosts.append(host % 2**64)
                    of.append(n)
                    numbers.append(number)
            stream, start, prefixes = _prefixes(streams, hosts)
            page, number = np.array(of, np.int64)[stream], np.array(numbers, np.int32)[stream]
            yield pa.RecordBatch.from_arrays([batch.column("at").take(pa.array(page)), pa.array(number), pa.array(start), pa.array(prefixes)], names=["at", "region", "start", "prefix"])


def _teasers(batches) -> Iterator[pa.RecordBatch]:
    """The articles that repeated runs cover whole and that are shorter than one of the page with a unique run."""
    for batch in batches:
        found = []
        for texts, regions, runs in zip(*(batch.column(c).to_pylist() for c in ("blocks", "regions", "runs")), strict=True):
            starts = {r["region"]: r["starts"] for r in runs}
            sizes = {region: len(tokens) - 1 for region, tokens in _regions(texts, regions).items()}  # the last mark is behind the text
            whole = {region for region, size in sizes.items() if _covered(size, starts.get(region, []))[:size].all()}
            longest = max((size for region, size in sizes.items() if region not in whole), default=0)
            found.append([region for region in whole if sizes[region] < longest])
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(found, pa.list_(pa.int32()))], names=["at", "gone"])


def _without_teasers(read: DataFrame, repeated: DataFrame) -> DataFrame:
    """``read`` without the articles that repeated runs cover whole, on pages where a longer one has a unique run."""
    openings = read.where("closed").select("at", F.size(F.array_distinct("regions")).alias("count"), F.explode("openings").alias("prefix"))
    known = materialize(openings.join(repeated, "prefix", "left_semi").where(F.col("count") > 1).select("at").distinct(), "known-openings")
    if known.isEmpty():
        return read
    pages = read.select("at", "host", "blocks", "regions").join(known, "at", "left_semi")
    places = map_arrow(pages, _region_places, "at long, region int, start long, prefix long").join(repeated, "prefix", "left_semi")
    runs = places.groupBy("at", "region").agg(F.collect_list("start").alias("starts")).groupBy("at").agg(F.collect_list(F.struct("region", "starts")).alias("runs"))
    gone = map_arrow(pages.join(runs, "at").select("at", "blocks", "regions", "runs"), _teasers, "at long, gone array<int>")
    gone = materialize(gone.where(F.size("gone") > 0), "teasers")
    left = F.expr("transform(filter(arrays_zip(blocks, regions), x -> not array_contains(gone, x.regions)), x -> x.blocks)")
    return read.join(gone, "at", "left").withColumn("blocks", F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(left)).drop("gone")


def _covered(n: int, starts: list[int]) -> np.ndarray:
    covered = np.zeros(n + RUN, bool)
    for i in starts:
        covered[i : i + RUN] = True
    return covered


def without_strays(texts: list[str], starts: list[int]) -> str:
    """The blocks of an article but for those that prefixes at ``starts`` cover whole."""
    sizes = [len(t.split()) for t in texts]
    covered, at, kept = _covered(sum(sizes), starts), 0, []
    for text, n in zip(texts, sizes, strict=True):
        if not covered[at : at + n].all():
            kept.append(text)
        at += n
    return "\n".join(kept or texts)


def unique_runs(texts: list[str], skipped: list[bool], starts: list[int]) -> str:
    """The blocks of a page without the tokens that prefixes at ``starts`` of its stream cover."""
    covered = _covered(sum(len(t.split()) + 1 for t in texts), starts)
    kept, at = [], 0
    for text, skip in zip(texts, skipped, strict=True):
        words = text.split()
        if not skip:
            kept.append(" ".join(w for k, w in enumerate(words) if not covered[at + k]))
        at += len(words) + 1
    return "\n".join(t for t in kept if t) or "\n".join(t for t, skip in zip(texts, skipped, strict=True) if not skip)


def _assemble(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("closed", "blocks", "skipped", "starts")), strict=True)
        texts = [without_strays(t, s or []) if closed else unique_runs(t, skip, s or []) for closed, t, skip, s in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, strays: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; ``strays``: without blocks of articles that are their host's boilerplate."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = materialize(map_arrow(plain, _read, READ), "pages")

    def done(df: DataFrame) -> DataFrame:
        return df.withColumn("n_chars", F.length("text").cast("long"))

    def text_of(df: DataFrame) -> DataFrame:
        return df.select("page_id", "url", F.array_join("blocks", "\n").alias("text"))

    suffixes = read.select("page", F.explode("prefixes").alias("prefix"))
    repeated = suffixes.groupBy("prefix").agg(F.min("page").alias("first"), F.max("page").alias("last")).where(F.col("first") != F.col("last"))
    repeated = materialize(repeated.select("prefix"), "repeated-prefixes")
    kept = _without_teasers(read, repeated)
    if not strays and read.where(~F.col("closed")).isEmpty():
        return done(text_of(kept))
    marked = kept.drop("prefixes", "heads", "regions", "openings").withColumn("strayed", F.lit(None).cast("array<long>"))
    if strays:
        heads = read.select("at", "page", F.explode("heads").alias("prefix")).join(repeated, "prefix", "left_semi")
        shared = heads.groupBy("prefix").agg(F.min("page").alias("first"), F.max("page").alias("last")).where(F.col("first") != F.col("last"))
        strayed = heads.join(shared.select("prefix"), "prefix", "left_semi").groupBy("at").agg(F.collect_set("prefix").alias("strayed"))
        marked = marked.drop("strayed").join(materialize(strayed, "strayed"), "at", "left")
    untouched = F.col("closed") & F.col("strayed").isNull()
    touched = materialize(marked.where(~untouched).select("at", "page_id", "url", "host", "closed", "blocks", "skipped", "strayed"), "open-pages")
    places = map_arrow(touched.select("at", "host", "closed", "blocks", "strayed"), _places, "at long, start long, prefix long")
    starts = places.join(repeated, "prefix", "left_semi").groupBy("at").agg(F.collect_list("start").alias("starts"))
    rest = touched.join(starts, "at", "left").select("page_id", "url", "closed", "blocks", "skipped", "starts")
    return done(text_of(marked.where(untouched)).unionByName(map_arrow(rest, _assemble, "page_id long, url string, text string")))
