"""Repairing extracted Markdown, pass by pass. Each pass is a text -> text column function; passes that look at single lines
are array functions inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import sliced
from ..functions.text import let
from . import layout as layouts
from . import passes
from .layout import _open

FENCE = r"\A\s*(```|~~~)"


def artifacts(text: Column) -> Column:
    """Character 15 is an epsilon of a common font; other control characters go."""
    return F.regexp_replace(F.regexp_replace(text, "\\x0f", "\u03b5"), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def outside(lines: Column) -> Column:
    """array<struct<x, free>>: each line, and whether it stands outside fences and display math and is no mark of them, which
    is when the marks before it are even in number."""
    fence = lambda x: x.rlike(FENCE)
    math = lambda x: ~fence(x) & (F.trim(x) == "$$")
    places = lambda a, test: F.filter(F.transform(a, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    odd = lambda marks, i: F.size(F.filter(marks, lambda m: m < i)) % 2 == 1
    free = lambda s, x, i: ~(fence(x) | math(x) | odd(s["fences"], i) | odd(s["maths"], i))
    known = lambda a: F.struct(a.alias("lines"), places(a, fence).alias("fences"), places(a, math).alias("maths"))
    return let(lines, lambda a: let(known(a), lambda s: F.transform(s["lines"], lambda x, i: F.struct(x.alias("x"), free(s, x, i).alias("free")))))


def _guarded(text: Column, keep) -> Column:
    """Lines for which keep(line) holds, or that stand in a fence or display math."""
    kept = F.filter(outside(F.split(text, "\n", -1)), lambda r: ~r["free"] | keep(r["x"]))
    return F.array_join(F.transform(kept, lambda r: r["x"]), "\n")


def glyph_garble(text: Column) -> Column:
    """Drops lines of which most words are the gibberish of a font without a character map."""

    def garbled(line: Column) -> Column:
        tokens = F.filter(F.split(F.trim(line), r"(?U)\s+"), lambda t: F.length(t) >= 2)
        bad = F.filter(tokens, lambda t: ~t.rlike("[a-z]") & t.rlike("[A-Z]") & (t.rlike(r"[$%'/*+&^]") | (F.length(t) >= 5) & t.rlike(r"\d")))
        return (F.size(tokens) >= 3) & (F.size(bad) >= 3) & (F.size(bad) * 2 >= F.size(tokens))

    return _guarded(text, lambda x: ~garbled(x))


def blank_runs(text: Column) -> Column:
    """At most one blank line at a time."""
    blank = lambda x: ~x.rlike(r"(?U)\S")
    once = lambda a: F.filter(a, lambda x, i: ~(blank(x) & (i > 0) & blank(F.get(a, F.greatest(i - 1, F.lit(0))))))
    return F.array_join(let(F.split(text, "\n", -1), once), "\n")


def running_headers(layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, header) of first and last page lines, without page numbers, that three or more pages of a document share."""
    pages = layouts.select(key, F.posexplode(F.split("layout", "\f", -1)).alias("page", "text"))
    trimmed = F.filter(F.transform(F.split("text", r"\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != "")
    ends = F.when(F.size("l") > 0, F.array_distinct(F.array(F.get("l", F.lit(0)), F.element_at("l", -1)))).otherwise(F.array().cast("array<string>"))
    lines = pages.withColumn("l", trimmed).select(key, "page", F.explode(ends).alias("x"))
    header = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("x", r"\A\d{1,4}\s+", ""), r"\s+\d{1,4}\z", ""), r"(?U)\s+", " "))
    lines = lines.select(key, header.alias("header")).where((F.length("header") >= 8) & (F.length("header") <= 120) & F.col("header").rlike("[A-Za-z]{3,}"))
    return lines.groupBy(key, "header").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(key, "header")


def without_headers(documents: DataFrame, headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents(key, markdown) without their running headers where a page number stands beside one; structure stays.

    A document's headers are few; they are gathered beside it and applied in one Arrow pass.
    """
    own = headers.groupBy(key).agg(F.sort_array(F.collect_list("header")).alias("_h"))

    def strip(text: str, found: list[str]) -> str:
        names = "|".join(r"\s+".join(map(re.escape, h.split())) for h in sorted(found, key=len, reverse=True))
        numbered = re.compile(rf"\d{{1,4}}\s+(?:{names})|(?:{names})\s+\d{{1,4}}")
        lines = text.split("\n")
        cut = [re.sub(r"[ \t]{2,}", " ", numbered.sub(" ", x)).strip() if free and not re.match(r"\s*(#{1,6}\s|\|)", x) and numbered.search(x) else None for x, free in zip(lines, _open(lines))]
        return "\n".join(x if new is None else new for x, new in zip(lines, cut) if new != "")

    @sliced(T.StringType())
    def apply(text: str | None, found: list[str] | None) -> str | None:
        return strip(text, found) if text is not None and found else text

    return documents.join(own, key, "left").withColumn("markdown", apply("markdown", "_h")).drop("_h")


def repaired(text: Column) -> Column:
    """The passes that need the Markdown alone, in order."""
    return blank_runs(glyph_garble(artifacts(text)))


# Passes over blocks of lines: one Arrow pass a document, as a block ends where a later line says so.

#: Rows, rules, captions and bounds of cells.
PIPE = re.compile(r"\s*\|.*\|\s*\Z")
RULE = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*\Z")
CAPTION = re.compile(r"\b(?:Table|Tab\.?|Figure|Fig\.?|Chart)\s+\d+\s*[:.]", re.I)
#: Words before a caption's label that make it a mention.
MENTION = re.compile(r"(?:\A|\s)(?:in|on|see|from|of|to|and|via|cf\.?|figs?\.?)\Z", re.I)
MOST_CELL, MOST_ROW = 80, 180


def _outside_fences(lines: list[str]):
    """(line, whether it is plain text) of each line; fences and what is in them are not."""
    fence = False
    for line in lines:
        mark = re.match(r"\s*(```|~~~)", line) is not None
        yield line, not (fence or mark)
        fence ^= mark


def captions_apart(text: str) -> str:
    """A caption at the end of a line of prose gets a line of its own; a mention of it does not."""
    out: list[str] = []
    for line, is_text in _outside_fences(text.split("\n")):
        m = CAPTION.search(line) if is_text and not CAPTION.match(line.strip()) else None
        before = line[: m.start()].rstrip() if m else ""
        if m and m.start() >= 20 and (before[-1:] in ".!?)" or len(before) >= 80) and not MENTION.search(before):
            out += [before, "", line[m.start() :].lstrip()]
        else:
            out.append(line)
    return "\n".join(out)


def math_flush(text: str) -> str:
    """Display math without indentation."""
    out, math = [], False
    for line in text.split("\n"):
        mark = line.strip() == "$$"
        out.append(line.strip() if math or mark else line)
        math ^= mark
    return "\n".join(out)


def tables_once(text: str) -> str:
    """A table that is repeated word for word stays at its first place only; blank lines do not pile up."""
    lines, out, seen, k = text.split("\n"), [], set(), 0
    while k < len(lines):
        stop = k + 1
        if k + 1 < len(lines) and PIPE.match(lines[k]) and RULE.match(lines[k + 1]):
            stop = k + 2
            while stop < len(lines) and PIPE.match(lines[stop]):
                stop += 1
            key = tuple(" ".join(x.split()) for x in lines[k:stop])
            if key not in seen:
                seen.add(key)
                out += lines[k:stop]
        else:
            out.append(lines[k])
        k = stop
    return "\n".join(x for n, x in enumerate(out) if x.strip() or not n or out[n - 1].strip()).rstrip()


#: Lines that are no row whatever is in them, and what parts the cells of a row of each kind.
NO_ROW = re.compile(r"#{1,6}\s|>|[-*+]\s|\d+\.\s|<!--|!\[|\$\$")
PARTED = {"bars": r"(?<!\\)\|", "gaps": r"\t+| {2,}"}


def _cells(line: str) -> tuple[str, list[str]] | None:
    """How a line could be a table's row - by bars or by gaps - and its cells."""
    text = line.strip()
    if not 0 < len(text) <= MOST_ROW or NO_ROW.match(text):
        return None
    kind = "bars" if "|" in text and not text.startswith("http") else "gaps"
    cells = [x.strip() for x in re.split(PARTED[kind], text.strip("|") if kind == "bars" else text)]
    cells = cells if kind == "bars" else list(filter(None, cells))
    return (kind, cells) if len(cells) > 1 and max(map(len, cells)) <= MOST_CELL else None


def tables_ruled(text: str) -> str:
    """Runs of rows of equally many cells, two at least, become tables with a rule below the first."""
    out: list[str] = []
    held: list[tuple[str, str, list[str]]] = []

    def flush() -> None:
        rows = [c for line, _, c in held if not RULE.match(line)]
        if len(rows) >= 2 and len({len(c) for c in rows}) == 1:
            mark = lambda c: "| " + " | ".join(c) + " |"
            out.extend([mark(rows[0]), "| " + " | ".join("---" for _ in rows[0]) + " |", *map(mark, rows[1:])])
        else:
            out.extend(line for line, _, _ in held)
        held.clear()

    for line, is_text in _outside_fences(text.split("\n")):
        got = _cells(line) if is_text else None
        if got is None or held and held[0][1] != got[0]:
            flush()
        if got is None:
            out.append(line)
        else:
            held.append((line, *got))
    flush()
    return "\n".join(out)


REFERENCES = re.compile(r"(?:#{1,6}\s*)?(?:\d+\.\s*)?references\b[:.]?", re.I)


def references_listed(text: str) -> str:
    """The entries after the References heading as a numbered list, whatever marks them: [n], n., bullets, or a blank
    line between them."""
    lines = text.split("\n")
    at = next((k for k, line in enumerate(lines) if REFERENCES.match(line.strip())), None)
    if at is None:
        return text
    rest = "\n".join([REFERENCES.sub("", lines[at].strip(), count=1).strip(), *lines[at + 1 :]]).strip()
    rest = re.sub(r"<!--\s*PAGE_BREAK\s*-->", "\n\n", rest, flags=re.I)
    flat = lambda s: " ".join(s.split())
    if not rest:
        return "\n".join([*lines[:at], "## References"])
    marks = list(re.finditer(r"\[(\d{1,3})\]", flat(rest)))
    numbered = list(re.finditer(r"^\s*(\d{1,3})\.\s+(?=\S)", rest, re.M))
    bullets = list(re.finditer(r"^\s*[-*+]\s+(?=\S)", rest, re.M))
    if len(marks) >= 2 or marks and not numbered and not bullets:
        whole = flat(rest)
        found = [(m[1], whole[m.end() : n.start() if n else None]) for m, n in zip(marks, [*marks[1:], None])]
    elif numbered:
        found = [(m[1], rest[m.end() : n.start() if n else None]) for m, n in zip(numbered, [*numbered[1:], None])]
    elif bullets:
        found = [(str(k), rest[m.end() : n.start() if n else None]) for k, (m, n) in enumerate(zip(bullets, [*bullets[1:], None]), 1)]
    else:
        found = [(str(k), x) for k, x in enumerate(re.split(r"\n\s*\n", rest), 1)]
    entries = [f"{int(n)}. {flat(x)}" for n, x in found if flat(x)]
    return "\n".join([*lines[:at], "## References", "", *entries]) if entries else text


def _pass(f):
    return sliced(T.StringType())(lambda t: t if t is None else f(t))


#: The block passes by name, in the order in which they run on the Markdown alone.
BLOCK_PASSES = {
    "tables_ruled": tables_ruled,
    "headings_repaired": passes.headings_repaired,
    "captions_apart": captions_apart,
    "equations_blocked": passes.equations_blocked,
    "references_listed": references_listed,
    "spacing_closed": passes.spacing_closed,
    "tables_once": tables_once,
    "math_unnested": passes.math_unnested,
    "math_flush": math_flush,
}


def block_pass(name: str, text: Column) -> Column:
    return _pass(BLOCK_PASSES[name])(text)


def all_passes(text: Column) -> Column:
    """Every pass that needs the Markdown alone, in order; the block passes share one trip to Python."""

    def blocks(t: str) -> str:
        for f in BLOCK_PASSES.values():
            t = f(t)
        return t

    return blank_runs(glyph_garble(_pass(blocks)(artifacts(text))))


def whole_repair(markdown: Column, layout: Column, pdf: Column) -> Column:
    """Every pass in order, those with the layout among them; a null layout leaves these out. Running headers go before
    (without_headers), as they are found over documents' pages."""

    def blocks(t: str, x: str | None, name: str | None) -> str:
        t = layouts.tables_spliced(tables_ruled(t), x) if x else tables_ruled(t)
        had = re.search(r"^\s*#{1,6}\s+\S", t, re.M) is not None
        t = passes.headings_repaired(t)
        if x:
            t = layouts.title_set(layouts.headings_promoted(t, layouts.headings(x)), layouts.title(x), had)
        t = references_listed(passes.equations_blocked(captions_apart(t)))
        t = passes.figures_linked(passes.placeholders_added(t, x, name), x, name)
        return tables_once(passes.spacing_closed(t))

    def again(t: str, x: str | None) -> str:
        t = layouts.tables_spliced(t, x) if x else t
        t = tables_once(passes.equations_blocked(passes.spacing_closed(t)))
        t = tables_once(math_flush(passes.math_unnested(t)))
        return layouts.equations_set(t, x) if x else t

    @sliced(T.StringType())
    def first(m: str | None, x: str | None, name: str | None) -> str | None:
        return None if m is None else blocks(m, x, name)

    return blank_runs(layouts.with_layout_columns(again, glyph_garble(first(artifacts(markdown), layout, pdf)), layout))
