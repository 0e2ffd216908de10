"""Repair passes that read neighbouring lines: headings, equations, figures, spacing. Each is text -> text (some with the
layout and the PDF's name) and runs in one Arrow pass a document."""

from __future__ import annotations

import re
from itertools import takewhile
from urllib.parse import quote

from .layout import _open, equations, lines_of

#: Numbered titles and the level that each style of number has.
NUMBERED = re.compile(r"\d+\.\s+\S|\d+(?:\.\d+)+\.?\s+\S|[A-Z]\.\s+\S|[IVX]+\.\s+\S")
LEVEL_OF = [(r"(?i)(?:abstract|references)\b", 2), (r"[A-Z]\.\s+\S", 2), (r"[IVX]+\.\s+\S", 2), (r"(?i)S\.\d+\.?\s+\S", 2), (r"\d+\.\d+\.?\s+\S", 3), (r"\d+\.\s+\S", 2)]
CAPITALS = re.compile(r"(?:[A-Z][A-Z0-9 -]{3,}|S\.\d+\.?\s+[A-Z0-9 -]+)\Z")
NO_WORDS = [r"(?i)(?:gt|[A-Z])\s*[:.]\Z", r"\(?\d+\)?\Z", r"(?=.*[,/])[A-Z0-9,./ -]+\Z", r"(?!.*[A-Za-z]{3,})"]
HEADING_MATH = re.compile("[\u2211\u221a\u222b\u2248\u2264\u2265\u00b1\u2212=|{}[\\]()]")


def _formula(text: str) -> bool:
    """Whether a heading's text is a formula, a label or a mark and no title."""
    plain = re.sub("[*_`]", "", text).strip()
    if any(re.match(p, plain) for p in NO_WORDS):
        return True
    return not NUMBERED.match(plain) and bool(HEADING_MATH.search(plain)) and sum(bool(re.search("[A-Za-z]{3,}", w)) for w in plain.split()) <= 2


def _prose(level: int, text: str) -> bool:
    n = len(text.split())
    deep = level >= 4 and (n >= 5 or re.match("[a-z]", text) or text[-1] in ".!?")
    return not NUMBERED.match(text) and bool(deep or level <= 2 and re.match(r"\d+\s+\S", text) and n >= 6)


def headings_repaired(markdown: str) -> str:
    """Headings that are formulas, prose or metadata (between title and abstract) as text; the others at their number's level."""
    out, titled, abstract = [], False, False
    for line in markdown.split("\n"):
        m = re.fullmatch(r"(#{1,6})\s+(.+)", line)
        if not m:
            out.append(line)
            continue
        level, text = len(m[1]), " ".join(m[2].split())
        if re.match(r"(?i)abstract\b", text):
            abstract = True
            body = re.match("(?i)abstract[\u2014-]\\s*(.+)", text)
            out.append("## Abstract" + (f"\n\n{body[1]}" if body else ""))
        elif level <= 4 and CAPITALS.match(text):
            out.append(f"## {text}")
        elif _formula(text) or _prose(level, text) or titled and not abstract and level >= 2 and not NUMBERED.match(text):
            out.append(text)
        else:
            titled = titled or not abstract
            out.append("#" * next((n for p, n in LEVEL_OF if re.match(p, text)), level) + f" {text}")
    return "\n".join(out)


# Figures

FIGURE = re.compile(r"\b(?:Figure|Fig\.?|Chart)\s+(S\.\d+|\d+(?:\.\d+)?)(?:\s*[:.]|\b)", re.I)
FIGURE_HEAD = re.compile(r"(?:\([a-z0-9^]+\)\s*){0,8}(?:Figure|Fig\.?|Chart)\s+", re.I)
MENTION = re.compile(r"(?:\A|.*\s)(?:in|on|see|from|of|to|and|via|cf\.?|figs?\.?)\Z", re.I)
#: What ends a caption that goes on over lines.
CAPTION_END = re.compile(r"\d{1,4}\s+[A-Z]|(?i:Figure|Fig\.?|Table|Tab\.?|Chart)\s+\d|#{1,6}\s|\d+(?:\.\d+)?\.?\s+[A-Z][a-z]|\[\d{1,3}\]|.*\(\d{1,3}\)\s*\Z")
BREAK = re.compile(r"(<!--\s*PAGE_BREAK\s*-->)", re.I)


def figure_of(line: str) -> str | None:
    """The figure that a line names at its head, or after at most four words."""
    text = re.sub(r"\A\*+|\*+\Z", "", line.strip())
    m = FIGURE.search(text)
    if not m:
        return None
    before = text[: m.start()].strip()
    near = not re.search(r"[.!?]\Z", before) and m.start() <= 36 and len(before.split()) <= 4
    return m[1].upper() if FIGURE_HEAD.match(text) or near else None


def caption_of(line: str) -> str | None:
    """The figure whose caption a line is: named, and not only mentioned."""
    m = FIGURE.search(line)
    return figure_of(line) if m and not MENTION.match(line[: m.start()].strip()) else None


def _first_pages(layout: str, named) -> dict[str, tuple[int, list[str], int]]:
    """Figure -> page, that page's lines and the line, where it is first named."""
    out: dict[str, tuple[int, list[str], int]] = {}
    for page, text in enumerate(layout.split("\f"), 1):
        lines = lines_of(text)
        for k, line in enumerate(lines):
            figure = named(line)
            if figure:
                out.setdefault(figure, (page, lines, k))
    return out


def _caption(lines: list[str], k: int) -> str:
    more = takewhile(lambda x: x and not CAPTION_END.match(x), (x.strip() for x in lines[k + 1 : k + 8]))
    text = "\n".join([lines[k].strip(), *more])
    return " ".join(re.sub("(?<=[A-Za-z])-\n", "", text).split())


def _link(pdf: str, page: int) -> str:
    return f"[PDF page {page}](../pdf/{quote(pdf.rsplit('/', 1)[-1], safe=";,/?:@&=+$-_.!~*'()#")}#page={page})"


def figures_linked(markdown: str, layout: str | None, pdf: str | None) -> str:
    """A link to its PDF page below each figure's caption that has none."""
    pages = _first_pages(layout, figure_of) if layout and pdf else {}
    lines = markdown.split("\n")
    out = []
    for k, line in enumerate(lines):
        out.append(line)
        figure = caption_of(line) if pages else None
        following = next((x.strip() for x in lines[k + 1 :] if x.strip()), "") if figure in pages else ""
        if figure in pages and not re.match(r"(?i)>\s*Figure source:", following):
            out += ["", f"> Figure source: {_link(pdf, pages[figure][0])}"]
    return "\n".join(out)


def placeholders_added(markdown: str, layout: str | None, pdf: str | None) -> str:
    """Figures and labelled equations that only the layout has, at the end of their page; after the references below a heading
    of their own."""
    if not layout or not pdf:
        return markdown
    known_figures = {caption_of(x) for x in lines_of(markdown)}
    known_equations = set(re.findall(r"\\tag\{(\d{1,3})\}", markdown)) | {m[1] for x in lines_of(markdown) if re.search(r"Equation source\s*=", x) and (m := re.search(r"\((\d{1,3})\)(?:\s*(?:where\b.*)?)\Z", x.strip(), re.I))}
    new = [(page, f"{_caption(lines, k) or f'Figure {figure}.'}\n\n> Figure source: {_link(pdf, page)} \u2014 source image not extracted") for figure, (page, lines, k) in _first_pages(layout, caption_of).items() if figure not in known_figures]
    new += [(e["page"], f"$$\n{e['latex']}\n\\tag{{{e['label']}}}\n$$") for e in equations(layout) if e["label"] not in known_equations]
    sections = BREAK.split(markdown)
    for page, text in new:
        k = max(0, min(len(sections) - 1, (page - 1) * 2))
        own = sections[k]
        after_list = re.search(r"^## References\b", own, re.M) and not re.search(r"^## Extracted Source Placeholders\b", own, re.M)
        sections[k] = own + ("\n\n## Extracted Source Placeholders\n\n" if after_list else "\n" if own.endswith("\n") else "\n\n") + text + "\n"
    return "".join(sections)


# Spacing and equations

STRUCTURE = re.compile(r"(?:#{1,6}\s|[-*+]\s|\d+\.\s|>\s|!\[|\[|<!--|\||```|~~~)|(?i:Table|Tab\.?)\s+(?:\d+|[IVXLCDMivxlcdm]+)(?:\s*[:.]|\b)")
MATH = re.compile("[=+*\u2211\u221a\u222b\u2248\u2264\u2265\u00b1\u2212\u00d7\u00f7<>|{}^_]|\\\\(?:frac|sum|sqrt|int)")
LABEL_END = re.compile(r"(?:\A|[\s,.;])\((\d{1,3})\)(?:\s*where\b.*)?\s*\Z", re.I)
LOOK_BACK, CONTEXT_LENGTH, INLINE_LENGTH = 16, 120, 40


def _counts(line: str) -> tuple[int, int]:
    return len(MATH.findall(line)), len(re.findall("[A-Za-z]{3,}", line))


def is_equation(line: str) -> bool:
    signs, words = _counts(line)
    return signs >= 2 and words <= 24 or signs == 1 and words <= 1


def is_context(line: str) -> bool:
    signs, words = _counts(line)
    return len(line) <= CONTEXT_LENGTH and (signs >= 2 or words <= 3)


def spacing_closed(markdown: str) -> str:
    """No blank line between lines of one paragraph."""
    lines = markdown.split("\n")
    plain = lambda x: bool(x) and not STRUCTURE.match(x) and not figure_of(x) and not is_equation(x)
    out: list[str] = []
    for line, below in zip(lines, [*lines[1:], None]):
        a, b = (out[-1].strip() if out else ""), (below or "").strip()
        joins = not line.strip() and plain(a) and plain(b) and not (a[-1] in ":.!?" and re.match("[A-Z0-9]", b))
        if not joins:
            out.append(line)
    return "\n".join(out)


#: Glyphs of equations and their LaTeX, and what is set right after them, in order.
SIGNS = {"\x0f": "\\epsilon ", "\u2206": "\\Delta ", "\u2211": "\\sum ", "\u221a": "\\sqrt ", "\u222b": "\\int ", "\u2264": "\\le ", "\u2265": "\\ge ", "\u2248": "\\approx ", "\u00b1": "\\pm ", "\u2212": "-", "\u00d7": "\\times ", "\u00f7": "\\div ", "\u2208": "\\in ", "\u222a": "\\cup ", "\u221e": "\\infty ", "\u03b1": "\\alpha ", "\u03b2": "\\beta ", "\u03b3": "\\gamma ", "\u03b5": "\\epsilon ", "\u03b8": "\\theta ", "\u03bb": "\\lambda ", "\u03bc": "\\mu ", "\u03c0": "\\pi ", "\u03c6": "\\phi ", "\u03f5": "\\epsilon ", "\u2217": "*"}
RIGHTED = [("\u02c6\\s*([A-Za-z])", r"\\hat{\1}"), ("\u02c6(?=[\\s),}\\]]|\\Z)", ""), (r"\b6\s*=", r"\\ne "), (r"\s+-\^\s+", " - "), (r"\^\s+(?=[+\-*/=)]|\Z)", " "), (r"([A-Za-z0-9})])\^(\s|\Z)", r"\1\2"), (r"\s+", " ")]


def _latex(line: str) -> str:
    text = line.translate({ord(k): v for k, v in SIGNS.items()})
    for old, new in RIGHTED:
        text = re.sub(old, new, text)
    return text.strip()


def _segment(line: str) -> str:
    """The equation that ends a line of words."""
    tail = line.rsplit(":", 1)[1].strip() if ":" in line else ""
    if ":" in line and is_context(tail):
        return tail
    m = re.search(r"[A-Za-z][A-Za-z0-9^_{}(),|]*\s*=", line)
    return line[m.start() :].strip() if m and len(line[: m.start()].split()) >= 4 and is_context(line[m.start() :].strip()) else line


def _limit(line: str) -> bool:
    if len(line) > 40 or re.match(r"\\(?:sum|begin|end|tag)", line):
        return False
    return bool(re.match(r"[A-Za-z](?:[A-Za-z0-9,]|\s|\\hat\{[A-Za-z]\}){0,12}\Z", line) or re.search(r"[=\\]", line))


def block_of(lines: list[str]) -> list[str]:
    """Display math of an equation's lines, the last of which may end in its label; a sum takes the line below as its limit,
    and a line that begins with an operator goes on the one above."""
    own = [x.strip() for x in lines if x.strip() and not BREAK.search(x)]
    label = LABEL_END.search(own[-1]) if own else None
    if label:
        own[-1] = re.sub(r"[,.]\s*\Z", "", own[-1][: label.start()].rstrip()).strip()
    rows: list[str] = []
    waiting = None  # the upper limit of a sum that still needs its lower one
    for x in filter(None, (_latex(_segment(y)) for y in own)):
        if waiting is not None and _limit(x):
            rows[-1] = f"\\sum_{{{' '.join(x.split())}}}" + (f"^{{{re.sub('[{}]', '', waiting)}}}" if waiting else "")
            waiting = None
            continue
        alone = re.fullmatch(r"\\sum(?:\s*\^\s*([A-Za-z0-9{}\\]+))?", x)
        waiting = (alone[1] or "") if alone else None
        if rows and re.match(r"[*+\-/]\s*\S", x):
            rows[-1] += f" {x}"
        else:
            rows.append(x)
    if len(rows) > 1:
        rows = ["\\begin{aligned}", *(f"{x} \\\\" for x in rows[:-1]), rows[-1], "\\end{aligned}"]
    return ["", "$$", *rows, *([f"\\tag{{{label[1]}}}"] if label else []), "$$", ""]


def _inline(line: str) -> list[str] | None:
    """A line of prose cut where a labelled equation stands in it."""
    if len(line) < INLINE_LENGTH or "=" not in line:
        return None
    for m in re.finditer(r"\((\d{1,3})\)", line):
        before = line[: m.start()].rstrip()
        starts = [s.start() for s in re.finditer("[A-Za-z\u0391-\u03a9\u03b1-\u03c9][A-Za-z0-9\u0391-\u03a9\u03b1-\u03c9^_{}(),|]*\\s*=", before)]
        at = next((s for s in reversed(starts) if not before[:s].strip() or len(before[:s].split()) >= 3), None)
        body = re.sub(r"[,.]\s*\Z", "", before[at:]).strip() if at is not None else ""
        if body and is_equation(body):
            head, tail = before[:at].rstrip(), line[m.end() :].lstrip()
            return [*([head] if head else []), *block_of([f"{body} ({m[1]})"]), *([tail] if tail else [])]
    return None


def _reach(lines: list[str], k: int) -> int:
    """The first line of the equation that ends on line k."""
    first = k
    for j in range(k - 1, max(-1, k - LOOK_BACK - 1), -1):
        text = lines[j].strip()
        if not text or BREAK.search(text):
            continue
        ends = re.search(r"(?:\A|[\s,.;])\(\d{1,3}\)", text) or REFERENCES.match(text) or figure_of(text) or STRUCTURE.match(text) and (not text.startswith("|") or re.match(r"\|\s*[^|]+\s+\|\s*[^|]+", text))
        if ends or not is_context(text):
            break
        first = j
    return first


REFERENCES = re.compile(r"(?:#{1,6}\s*)?(?:\d+\.\s*)?references\b", re.I)


def equations_blocked(markdown: str) -> str:
    """Labelled equations in running text as display math; what comes after the references stays."""
    lines = markdown.split("\n")
    free = _open(lines)
    last = next((k for k, x in enumerate(lines) if free[k] and REFERENCES.match(x.strip())), len(lines))
    out: list[tuple[int, str]] = []  # line number, text
    for k, line in enumerate(lines):
        text = line.strip()
        whole = _inline(text) if free[k] and k < last else None
        if whole is None and free[k] and k < last and LABEL_END.search(text):
            first = _reach(lines, k)
            if first < k or is_equation(text):
                out = [x for x in out if x[0] < first]
                whole = block_of(lines[first : k + 1])
        out += [(k, x) for x in (whole if whole is not None else [line])]
    texts = [x for _, x in out]
    return "\n".join(x for k, x in enumerate(texts) if x.strip() or not k or texts[k - 1].strip())


NESTED = re.compile(r"^[ \t]*\$\$[ \t]*\n[ \t]*\\begin\{aligned\}[ \t]*\n[ \t]*\$\$ \\\\[ \t]*\n[ \t]*\\begin\{aligned\} \\\\[ \t]*\n((?:(?![ \t]*\$\$ \\\\[ \t]*$).*\n)*?)[ \t]*\$\$ \\\\[ \t]*\n((?:.*\n)*?)[ \t]*\\end\{aligned\}[ \t]*\n[ \t]*(\\tag\{\d{1,3}\})[ \t]*\n[ \t]*\$\$[ \t]*$", re.M)


def math_unnested(markdown: str) -> str:
    """A block of display math inside another as two blocks, one after the other."""
    clean = lambda x: re.sub(r"\s+\\\\\Z", "", x.strip()) if re.search(r"\\\\\s+\\\\\Z|\A\\(?:end\{aligned\}|tag\{\d{1,3}\})\s+\\\\\Z", x.strip()) else x.strip()
    rows = lambda body: [clean(x) for x in body.split("\n")[:-1]]
    return NESTED.sub(lambda m: "\n".join(["$$", "\\begin{aligned}", *rows(m[1]), "$$", "", "$$", "\\begin{aligned}", *rows(m[2]), "\\end{aligned}", m[3], "$$"]), markdown)
