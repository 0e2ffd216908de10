"""Main text of HTML pages by deducing the template that pages of a host share.

A page's tokens are the tags of its blocks and its runs of text, each at its path. All distinct pages of a host with one
layout (the kinds of elements below its body) are looked at together:

1. Every token has an occurrence vector, its counts page by page, held as the number of pages and a hash of
   (page, count) pairs that adds up over pages. Tokens of equal vectors are an equivalence class.
2. A class is kept if it is large and frequent, and valid if its tokens come in one order on every page, round after
   round; valid classes must nest - a round of one lies within a single gap of the other, or apart from it - and
   those that do not are dropped, smaller ones first. The tokens of what is left are the template.
3. What stands between them are the slots. The main slot is the deepest container of the template that holds most of
   the words outside links; its blocks are the text, and a page's main heading. Runs that are template are no text.

Elements break ties: by names, roles, classes and ids, slots that are a menu, header, footer, sidebar, notice, advert,
form or readers' comment go; where a page marks an article or main part, that part is its main slot.

Copies of one page say nothing about a template, so a page counts once; a layout with fewer than LEAST_PAGES distinct
pages has none, and there the elements alone decide. If the runs of a template would take most of a layout's main text, its
pages are near copies of one article and not frames around many; then runs stay.

Pages are never gathered by host: they are read once for tokens, which are pre-aggregated, and once for the text with
the templates beside them. A host with most of the pages is spread over all tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, written

#: Distinct pages and words (a tag counts as one) that a class has at least; its share of the layout's pages; the share
#: of words that makes a main slot; and the share of main text in repeated runs that speaks of near copies.
LEAST_PAGES, LEAST_CLASS, SHARE, MAIN, COPIES = 3, 4, 0.6, 0.6, 0.6
#: Template tokens that are sent to all tasks at most (8 bytes each); beyond that, pages and templates are joined.
SENT_TOKENS = 1 << 20
HELD = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements by kind, from the HTML standard.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead tr ul""".split()
)
CHROME = frozenset("nav aside footer form head script style noscript template iframe button select textarea dialog menu svg math object embed canvas audio video fieldset datalist title search".split())
FLOW = frozenset("body main article section div td center".split())
CLOSED_BY_PARENT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar status".split())
CHROME_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments
    commentlist consent cookie cookies copyright dialog disqus follow footer footnav gdpr header masthead menu modal nav
    navbar navigation navigator newsletter notice notices notification overlay pager pagination paywall popup promo
    promoted promotion related recommended recommendation reply replies respond rail share sharing sidebar side skip
    skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending warning widget widgets""".split()
)
CONTENT_WORDS = frozenset("article-header post-header entry-header article_header post_header entry_header".split())


def _chrome(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is no part of the article."""
    if name in CHROME or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs:
        return False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.strip() in CHROME_ROLES:
            return True
        if key in ("class", "id") and not CONTENT_WORDS.intersection(value.split()):
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()))
            if words & CHROME_WORDS and not (in_article and words & CHROME_WORDS <= {"header", "side", "tags", "byline", "warning", "related", "notice"} and name.startswith("h")):
                return True
    return False


@dataclass
class Block:
    """A run of text inside one block: where it is, its text, and how many of its characters are in links."""

    path: str
    chrome: bool
    article: bool
    text: str
    linked: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tokens: list[str | int] = field(default_factory=list)  # paths of block tags, and numbers of blocks, in page order


def parse(source: str, elements: bool = True) -> Page:
    """The blocks of a page; white space as one space, character references decoded.

    Without elements, only what is never text (scripts, styles and the like) goes.
    """
    page, parts = Page(), []
    stack: list[tuple[str, bool, bool, str]] = []  # name, chrome, article, path of blocks
    root = ("", False, False, "")
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1] if stack else root
            page.tokens.append(len(page.blocks))
            page.blocks.append(Block(top[3], top[1], top[2], text, linked))
        linked = 0

    def close(name: str) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                if any(x[0] in BLOCK for x in stack[k:]):
                    flush()
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                return

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if not m:
            parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(source[at : m.start()]))
            if links:
                linked += len(parts[-1])
        at = m.end()
        if m["cdata"] is not None:
            parts.append(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            close(name)
            continue
        block, attrs = name in BLOCK, m["attrs"] or ""
        if block:
            if stack and any(x[0] == "p" for x in stack[-8:]) and name != "br":
                close("p")
            if name in CLOSED_BY_PARENT:
                for x in reversed(stack):
                    if x[0] == name:
                        close(name)
                        break
                    if x[0] in CLOSED_BY_PARENT[name]:
                        break
            flush()
        top = stack[-1] if stack else root
        chrome = top[1] or elements and _chrome(name, attrs, top[2])
        article = top[2] or elements and (name in ("article", "main") or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None)
        path = f"{top[3]}/{name}" if block else top[3]
        if block:
            page.tokens.append(path)
        if name in VOID:
            if name == "br" or name == "hr":
                flush()
            continue
        if attrs.endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source) if name in ("script", "style", "title", "textarea") else at
            continue
        stack.append((name, chrome, article, path))
        links += name == "a"
    flush()
    return page


def kept(page: Page) -> list[int]:
    """Numbers of the blocks that elements allow as content."""
    good = [k for k, b in enumerate(page.blocks) if not b.chrome]
    marked = [k for k in good if page.blocks[k].article]
    return marked or good


def _named(text: str) -> int:
    """A signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(text)).astype(np.int64))


def _run(block: Block) -> int:
    return _named(f"{block.path} {block.text}")


def layout_of(page: Page) -> int:
    """The kinds of elements below the body (or at the top, where there is none)."""
    below = {re.sub(r"\A(?:/html)?(?:/body)?/?", "", t) for t in page.tokens if isinstance(t, str)}
    return _named(" ".join(sorted(t for t in below if t and "/" not in t)))


@dataclass
class Sketch:
    """Of a page: its layout, a hash of its text, its tokens, the words of each as main text, and the words outside links
    in each container."""

    layout: int
    content: int
    tokens: list[int]
    words: list[int]
    boxes: dict[str, int]


def sketch(page: Page) -> Sketch:
    own = set(kept(page))
    tokens, words, boxes = [], [], Counter()
    for t in page.tokens:
        if isinstance(t, str):
            tokens.append(_named(t))
            words.append(0)
            continue
        b = page.blocks[t]
        n = b.text.count(" ") + 1
        tokens.append(_run(b))
        words.append(n if t in own else 0)
        if not b.chrome:
            free = round(n * max(0, len(b.text) - b.linked) / len(b.text))
            parts = b.path.split("/")
            for k, name in enumerate(parts):
                if name in FLOW:
                    boxes["/".join(parts[: k + 1])] += free
            boxes[""] += free
    return Sketch(layout_of(page), _named("\n".join(page.blocks[k].text for k in sorted(own))), tokens, words, dict(boxes))


def orderly(places: list[list[int]]) -> bool:
    """Whether tokens that come equally often come in one order, round after round; places by token, in that order."""
    flat = [x for round_ in zip(*places) for x in round_]
    return all(a < b for a, b in zip(flat, flat[1:]))


def nests(one: list[list[int]], other: list[list[int]]) -> bool:
    """Whether each round of one of two classes lies in a single gap of the other, or apart from it."""
    for inner, outer in ((one, other), (other, one)):
        marks = np.sort(np.array([x for t in outer for x in t]))
        rounds = np.array([(min(r), max(r)) for r in zip(*inner)])
        if (np.searchsorted(marks, rounds[:, 0]) == np.searchsorted(marks, rounds[:, 1])).all():
            return True
    return False


def page_faults(tokens: list[int], classes: list[list[int]]) -> list[tuple[int, int]]:
    """Of a page that has some of a layout's classes: (a, a) for a class out of order and (a, b) for two that do not
    nest."""
    of = {t: k for k, c in enumerate(classes) for t in c}
    places: list[dict[int, list[int]]] = [defaultdict(list) for _ in classes]
    for at, t in enumerate(tokens):
        k = of.get(t)
        if k is not None:
            places[k][t].append(at)
    there = [k for k, c in enumerate(classes) if places[k]]
    rows = {k: [places[k][t] for t in classes[k]] for k in there}
    bad = [(k, k) for k in there if not orderly(rows[k])]
    wrong = {a for a, _ in bad}
    right = [k for k in there if k not in wrong]
    return bad + [(a, b) for n, a in enumerate(right) for b in right[n + 1 :] if not nests(rows[a], rows[b])]


def chosen(classes: list[list[int]], bad: set[tuple[int, int]]) -> list[int]:
    """Numbers of the classes, larger ones first, that are valid and nest with those before."""
    out: list[int] = []
    for k in range(len(classes)):
        if (k, k) not in bad and not any((j, k) in bad for j in out):
            out.append(k)
    return out


def main_slot(boxes: dict[str, int], template: set[int]) -> str:
    """The deepest container of the template with most of the words outside links, and the article or main part that it
    is in; "" is the whole page."""
    total = boxes.get("", 0)
    found = [p for p, n in boxes.items() if p and n >= MAIN * total and _named(p) in template]
    best = max(found, key=lambda p: (p.count("/"), p), default="")
    parts = best.split("/")
    marked = next((k for k, x in enumerate(parts) if x in ("article", "main")), None)
    return best if marked is None else "/".join(parts[: marked + 1])


@dataclass
class Template:
    """Of a layout: its tokens, its main slot, and whether runs that are template go."""

    tokens: frozenset[int]
    main: str
    runs: bool


def text_of(page: Page, template: Template | None) -> str:
    own = kept(page)
    if template:
        within = lambda b: b.path == template.main or b.path.startswith(template.main + "/")
        marked = any(page.blocks[k].article for k in own)
        own = [k for k in own if within(page.blocks[k]) or not marked and page.blocks[k].path.endswith("/h1")] or own
        if template.runs:
            own = [k for k in own if _run(page.blocks[k]) not in template.tokens]
    return "\n".join(page.blocks[k].text for k in own)


PAGE_ROW = "host string, layout long, content long, tokens array<long>, words array<int>, paths array<string>, free array<int>"
BY = ["host", "layout"]


def _flushed(held: dict, names: list[str], kinds: list[pa.DataType], row) -> pa.RecordBatch:
    """The rows of a table by key, which is emptied."""
    rows = [row(k, v) for k, v in held.items()]
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_pages(pages: DataFrame, elements: bool = True) -> DataFrame:
    """PAGE_ROW for one page of each host, layout and text of pages(host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(parse(h, elements)) for h in batch.column(1).to_pylist()]
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            cols = [batch.column(0), pa.array([s.layout for s in made], pa.int64()), pa.array([s.content for s in made], pa.int64()), pa.array([s.tokens for s in made], longs), pa.array([s.words for s in made], ints)]
            cols += [pa.array([list(s.boxes) for s in made], pa.list_(pa.string())), pa.array([list(s.boxes.values()) for s in made], ints)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PAGE_ROW.split(", ")])

    rows = pages.select("host", "html").mapInArrow(run, PAGE_ROW)
    least = rows.groupBy(*BY, "content").agg(F.min(F.struct("tokens", "words", "paths", "free")).alias("x"))
    return written(least.select(*BY, "content", "x.*"))


def candidate_classes(rows: DataFrame) -> DataFrame:
    """(host, layout, runs, classes): the large and frequent equivalence classes of each layout, larger ones first, tokens
    in the order of their mean places; and whether runs may be template."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "layout", "token", "n", "vector", "size", "main", "place"]
        kinds = [pa.string(), *[pa.int64()] * 6, pa.float64()]
        held: dict[tuple, list] = {}
        out = lambda: _flushed(held, names, kinds, lambda k, v: (*k, *v))
        for batch in batches:
            for host, layout, content, tokens, words in zip(*(batch.column(k).to_pylist() for k in range(5))):
                token, first, times = np.unique(np.array(tokens, np.int64), return_index=True, return_counts=True)
                vector = _mixed(_mixed(np.uint64(content % (1 << 64)) + times.astype(np.uint64))).view(np.int64)
                for t, at, n, v in zip(token.tolist(), first.tolist(), times.tolist(), vector.tolist()):
                    got = held.get((host, layout, t))
                    if got is None:
                        held[host, layout, t] = [1, v, max(1, words[at]), words[at] * n, at / len(tokens)]
                    else:
                        got[0] += 1
                        got[1] ^= v
                        got[2] = max(got[2], words[at])
                        got[3] += words[at] * n
                        got[4] += at / len(tokens)
            if len(held) > HELD:
                yield out()
        yield out()

    counted = rows.select(*BY, "content", "tokens", "words").mapInArrow(count, "host string, layout long, token long, n long, vector long, size long, main long, place double")
    sums = {"n": F.sum, "vector": F.bit_xor, "size": F.max, "main": F.sum, "place": F.sum}
    merged = counted.groupBy(*BY, "token").agg(*[f(c).alias(c) for c, f in sums.items()])
    again = F.sum(F.when(F.col("n") >= LEAST_PAGES, F.col("main")).otherwise(0))
    near = merged.groupBy(*BY).agg((again <= COPIES * F.sum("main")).alias("runs"))
    pages = rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    frequent = merged.join(pages, BY).where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= SHARE * F.col("pages")))
    # A class has no more tokens than a page, a layout no more classes than a page has tokens.
    place = F.struct(F.round(F.col("place") / F.col("n"), 9).alias("p"), "token")
    classes = frequent.groupBy(*BY, "vector", "n").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(place)).alias("t")).where(F.col("size") >= LEAST_CLASS)
    order = F.struct((-F.col("n")).alias("a"), (-F.col("size")).alias("b"), F.col("t.token").alias("tokens"))
    named = classes.groupBy(*BY).agg(F.array_sort(F.collect_list(order)).alias("c"))
    return named.join(near, BY).select(*BY, "runs", F.col("c.tokens").alias("classes"))


def templates(pages: DataFrame, elements: bool = True) -> DataFrame:
    """(host, layout, tokens array<long>, main, runs) of every layout of pages(host, html) that has a template."""
    rows = distinct_pages(pages, elements)
    lists = pa.list_(pa.list_(pa.int64()))
    names = [*BY, "runs", "classes", "bad", "paths", "free"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), lists, pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        out = lambda: _flushed(held, names, kinds, lambda k, v: (*k, v[0], v[1], sorted(v[2]), list(v[3]), list(v[3].values())))
        for batch in batches:
            tokens, paths, free, runs, classes = batch.columns[2:]
            for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2)))):
                if key not in held:
                    held[key] = runs[k].as_py(), classes[k].as_py(), set(), Counter()
                _, own, bad, boxes = held[key]
                bad.update((a << 32) + b for a, b in page_faults(tokens[k].values.to_numpy().tolist(), own))
                boxes.update(dict(zip(paths[k].as_py(), free[k].as_py())))
            if len(held) > HELD // 100:
                yield out()
        yield out()

    seen = rows.select(*BY, "tokens", "paths", "free").join(candidate_classes(rows), BY)
    said = "host string, layout long, runs boolean, classes array<array<long>>, bad array<long>, paths array<string>, free array<long>"
    found = seen.select(*BY, "tokens", "paths", "free", "runs", "classes").mapInArrow(look, said)

    def decide(t: pa.Table) -> pa.Table:
        told = t.to_pylist()
        first, bad, boxes = told[0], set(), Counter()
        for r in told:
            bad.update((x >> 32, x & 0xFFFFFFFF) for x in r["bad"])
            boxes.update(dict(zip(r["paths"], r["free"])))
        tokens = sorted(t for k in chosen(first["classes"], bad) for t in first["classes"][k])
        row = [first["host"], first["layout"], tokens, main_slot(boxes, set(tokens)), first["runs"]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.bool_()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=["host", "layout", "tokens", "main", "runs"])

    # A layout has some rows a task in `found`.
    return written(found.groupBy(*BY).applyInArrow(decide, "host string, layout long, tokens array<long>, main string, runs boolean"))


def main_text(pages: DataFrame, elements: bool = True) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html, ...).

    text is the main text: blocks in page order joined by newlines, white space inside a block as one space.
    Null or empty html has empty text; null urls are one host; repeated rows and null ids are kept;
    long pages are taken whole; no rows give no rows; other columns are ignored. Without elements, names, roles,
    classes and ids say nothing, and the templates alone decide.
    """
    spark = session(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    found = templates(rows, elements)
    kind = dict(pages.dtypes)["page_id"]
    made = f"page_id {kind}, url string, text string"

    def answer(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    size = found.agg(F.coalesce(F.sum(F.size("tokens") + 64), F.lit(0))).first()[0]
    if size <= SENT_TOKENS:
        sent = spark.sparkContext.broadcast({(r.host, r.layout): Template(frozenset(r.tokens), r.main, r.runs) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parsed = [parse(h, elements) for h in batch.column(2).to_pylist()]
                yield answer(batch, [text_of(p, sent.value.get((h, layout_of(p)))) for p, h in zip(parsed, batch.column(3).to_pylist())])

        return rows.mapInArrow(run, made)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = [layout_of(parse(h, elements)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.int64())], names=["page_id", "url", "html", "host", "layout"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(2, 6)]
            yield answer(batch, [text_of(parse(h, elements), Template(frozenset(t), m, r) if t is not None else None) for h, t, m, r in zip(*cols)])

    with_layout = rows.mapInArrow(laid, f"page_id {kind}, url string, html string, host string, layout long")
    return with_layout.join(found, BY, "left").select("page_id", "url", "html", "tokens", "main", "runs").mapInArrow(joined, made)
