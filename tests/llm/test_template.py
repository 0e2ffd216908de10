"""Main text of pages with and without a deducible template."""

import html
import random
import re
from collections import defaultdict

import pandas as pd
import pytest

from lectern.llm import template
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_gives_the_articles(spark):
    got = QUERIES["op2_template_extract"](spark, SF).toPandas().sort_values("page_id")
    pages = pd.read_parquet(f"{SF}/pages.parquet").sort_values("page_id")
    want = []
    for h in pages.html:
        body = h.split("<article>", 1)[1].split("</article>", 1)[0]
        body = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", body)))
        want.append("\n".join(x for x in (" ".join(y.split()) for y in body.split("\n")) if x))
    assert got.page_id.tolist() == pages.page_id.tolist() and got.text.tolist() == want
    assert got.n_chars.tolist() == [len(t) for t in want]


def extract(spark, sources, **how):
    """The main texts of pages of one host."""
    pages = spark.createDataFrame([(k, "http://h.example/x", h) for k, h in enumerate(sources)], "page_id long, url string, html string")
    return [r.text for r in sorted(template.main_text(pages, **how).collect())]


def test_elements_decide(spark):
    page = """<!doctype html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav>menu</nav>
    <div role="navigation">more</div><div class="cookie-notice">We use cookies</div><aside>side</aside>
    <main><article><header><h1>Head &eacute;&#33;</h1></header><p>One   two<br>three <b>bo</b>ld<p>Four<script>var x="</p>";</script>
    <ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form>f<input></form><blockquote>q</blockquote><!-- <p>no</p> --></article>
    <section id="comments"><article class="comment"><p>reader</p></article></section></main><div class="ad-banner">buy</div><footer>foot</footer>"""
    assert extract(spark, [page]) == ["Head é!\nOne two\nthree bold\nFour\na\nb\nc\nd\nq"]


def test_template_words_go_without_marked_article(spark):
    rows = [f"<body><div>Site name</div><p>Story {k} has its own words number {k * 17}.</p><p>Second part {'x' * k}.</p><div>All rights reserved by us</div></body>" for k in range(12)]
    got = extract(spark, rows)
    assert got == [f"Story {k} has its own words number {k * 17}.\nSecond part {'x' * k}." for k in range(12)]
    copies = [rows[0]] * 12
    assert extract(spark, copies)[0].startswith("Site name\nStory 0")


def test_each_layout_has_its_template(spark):
    story = lambda k: f"Story {k} has its own words number {k * 17}."
    layouts = [
        "<body><div>Site name</div><p>{}</p><div>All rights reserved by us</div></body>",
        "<body><section>Notes from our readers</section><p>{}</p><section>Printed on recycled paper</section></body>",
        "<body><ul><li>Weather today and tomorrow</li></ul><p>{}</p><ul><li>Call the desk any time</li></ul></body>",
    ]
    assert extract(spark, [layouts[k % 3].format(story(k)) for k in range(24)]) == [story(k) for k in range(24)]


def plain_templates(pages):
    """(host, layout) -> (tokens, main slot, runs) of pages (host, html), by whole occurrence vectors."""
    groups = defaultdict(dict)
    for host, source in pages:
        page = template.parse(source)
        text = "\n".join(page.blocks[k].text for k in template.kept(page))
        own = [(t, 0) if isinstance(t, str) else (f"{page.blocks[t].path} {page.blocks[t].text}", len(page.blocks[t].text.split()) * (t in template.kept(page))) for t in page.tokens]
        old = groups[host, template.layout_of(page)].get(text)
        if old is None or [template._named(t) for t, _ in own] < [template._named(t) for t, _ in old[0]]:
            groups[host, template.layout_of(page)][text] = own, page
    out = {}
    for key, distinct in groups.items():
        all_pages = [x for x, _ in distinct.values()]
        if len(all_pages) < 3:
            continue
        vectors = defaultdict(set)
        for token in {t for own in all_pages for t, _ in own}:
            vectors[tuple(sum(t == token for t, _ in own) for own in all_pages)].add(token)
        words = {t: max(1, n) for own in all_pages for t, n in own}
        classes = []
        for vector, tokens in vectors.items():
            n = sum(v > 0 for v in vector)
            if n >= 3 and n >= 0.6 * len(all_pages) and sum(words[t] for t in tokens) >= 4:
                classes.append((-n, -sum(words[t] for t in tokens), tokens))
        good = []
        for _, _, tokens in sorted(classes, key=lambda c: c[:2]):
            rows = []
            for own in all_pages:
                at = [k for k, (t, _) in enumerate(own) if t in tokens]
                rounds = [at[k : k + len(tokens)] for k in range(0, len(at), len(tokens))]
                rows.append((rounds, [own[k][0] for k in at]))
            first = next(names[: len(tokens)] for _, names in rows if names)
            if any(names != first * (len(names) // len(tokens)) for _, names in rows):
                continue

            def inside(a, b):
                marks = [x for r in b for x in r]
                return all(sum(m < r[0] for m in marks) == sum(m < r[-1] for m in marks) for r in a)

            if all(inside(a, b) or inside(b, a) for _, other in good for (a, _), (b, _) in zip(rows, other)):
                good.append((tokens, rows))
        known = set().union(*(t for t, _ in good))
        often = {t for v, tokens in vectors.items() if sum(x > 0 for x in v) >= 3 for t in tokens}
        again = sum(n for own in all_pages for t, n in own if t in often)
        out[key] = {template._named(t) for t in known}, again <= 0.6 * sum(n for own in all_pages for _, n in own)
    return out


def made_pages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["sun", "moon", "tree", "river", "stone", "cloud"]) + str(rng.randrange(400))
    pages = []
    for host in range(4):
        tops = rng.sample(["div", "section", "ul", "table", "p", "h2"], 3)
        fixed = [" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(6)]
        for _ in range(rng.randrange(2, 14)):
            body = "".join(f"<p>{' '.join(word() for _ in range(rng.randrange(3, 30)))}</p>" for _ in range(rng.randrange(1, 5)))
            extra = f"<div><b>{fixed[3]}</b><div>{fixed[4]}</div></div>" if rng.random() < 0.7 else ""
            turned = rng.random() < 0.1  # out of the template's order
            ends = [f"<{tops[0]}>{fixed[0]}</{tops[0]}>", f"<{tops[1]}>{fixed[1]}</{tops[1]}>"]
            page = f"<html><body>{ends[turned]}<div>{body}</div>{extra}{ends[not turned]}<{tops[2]}>{fixed[2]} {word() if rng.random() < 0.3 else ''}</{tops[2]}></body></html>"
            pages += [(f"h{host}", page)] * rng.choice([1, 1, 1, 3])
    return pages


@pytest.mark.parametrize("seed", range(3))
def test_templates_match_plain_deduction(spark, seed):
    pages = made_pages(seed)
    got = {(r.host, r.layout): (set(r.tokens), r.runs) for r in template.templates(spark.createDataFrame(pages, "host string, html string").repartition(3)).collect()}
    want = {k: v for k, v in plain_templates(pages).items()}
    assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if v[0]} and any(v[0] for v in want.values())


def test_templates_alone_find_the_articles(spark):
    """On hosts with a template, names of elements and classes are not needed."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    a, b = (sorted((r.page_id, r.text) for r in template.main_text(pages, elements).collect()) for elements in (False, True))
    assert a == b


def test_pages_without_telling_names(spark, monkeypatch):
    story = lambda k: [f"Story {k} has its own words, number {k * 17}.", f"Its second part says {'more ' * (k % 5)}of what happened on day {k * k}."]
    rows = [f"<body><table><tr><td>Weather {k % 3}</td></tr></table><div><div>Our paper</div>{''.join(f'<p>{x}</p>' for x in story(k))}</div><address>Call the desk at any time</address><section>{k} others read this</section></body>" for k in range(10)]
    want = ["\n".join(story(k)) for k in range(10)]
    assert extract(spark, rows) == want
    monkeypatch.setattr(template, "LEAST_CLASS", 10**9)  # no classes
    assert all(w != g for w, g in zip(want, extract(spark, rows)))


def test_near_copies_of_an_article_stay_whole(spark):
    rows = [f"<body><article><h1>One story</h1><p>It is told on all of these pages in the same words.</p><p>Line {k}</p><p>And it ends as it began, as most stories do.</p></article></body>" for k in range(20)]
    assert extract(spark, rows) == [f"One story\nIt is told on all of these pages in the same words.\nLine {k}\nAnd it ends as it began, as most stories do." for k in range(20)]


def test_joined_templates_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = sorted((r.page_id, r.text) for r in template.main_text(pages).collect())
    monkeypatch.setattr(template, "SENT_TOKENS", 0)
    assert sorted((r.page_id, r.text) for r in template.main_text(pages).collect()) == a


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (None, "http://h/x", "<p>b"), (2, "http://h/y", None), (2, "http://h/y", ""), (3, "http://h/z", "plain & text"), (3, "http://h/z", "plain & text"), (4, "x", "<div>" * 3000 + "deep" + "&amp" + "<p>t" * 2000)]
    pages = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text) for r in template.main_text(pages).collect()))
    assert got == sorted([(1, "a"), (0, "b"), (2, ""), (2, ""), (3, "plain & text"), (3, "plain & text"), (4, "deep&\n" + "\n".join("t" for _ in range(2000)))])
    assert template.main_text(pages.limit(0)).count() == 0
