"""Column functions for text, identifiers and titles. All run inside the JVM but normalisation and stemming."""

from __future__ import annotations

import re
import unicodedata
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import sliced

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it (also inside its own functions of elements)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


#: Unicode white space, of which str.split() takes four control characters more; typographic signs as plain ones.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES, BROKEN = re.compile(f"[{SPACE}]+"), re.compile(f"-[ \t]*\n[{SPACE}]*")
SPLIT_ONLY = re.compile("[\x1c-\x1f]")
SIGNS = {ord(c): new for old, new in (("\u00ad", ""), ("\u2018\u2019\u201a\u2032", "'"), ("\u201c\u201d\u201e\u2033", '"'), ("\u2013\u2014\u2212", "-")) for c in old}
SIGN = re.compile(f"[{''.join(map(chr, SIGNS))}]")


def plain_typography(text: str | None, compose: bool = True) -> str | None:
    """A text composed, without soft hyphens, hyphens at line ends joined, quotes and dashes plain, one space for white space."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text) if compose else text
        text = text.replace("\u00ad", "")
    if "-" in text:
        text = BROKEN.sub("", text)
    if not text.isascii() and SIGN.search(text):
        text = text.translate(SIGNS)
    if SPLIT_ONLY.search(text):
        return SPACES.sub(" ", text).strip(" ")
    return " ".join(text.split())


_normal = {compose: sliced(T.StringType())(partial(plain_typography, compose=compose)) for compose in (False, True)}


def normalized(c: Column, compose: bool = True) -> Column:
    """Text as quotes are compared: verbatim up to typography. The order of steps matters."""
    return F.lower(_normal[compose](c))


def quote_tokens(c: Column) -> Column:
    """Distinct words of normalised text without punctuation at their edges."""
    words = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def rounded(c: Column, places: int) -> Column:
    """Half up, as floor(x + 0.5)."""
    return F.floor(c * F.lit(10**places) + 0.5) / F.lit(float(10**places))


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like_any(columns: list[Column], query: str) -> Column:
    """Whether any column has the query as a substring; % and _ in it are wildcards, only A-Z fold."""
    pattern = "%" + query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(ascii_lower(c).like(pattern), F.lit(False))
    return out


# Identifiers


def doi(c: Column) -> Column:
    c = F.regexp_replace(trimmed(c), r"(?i)\Ahttps?://(dx\.)?doi\.org/", "")
    return trimmed(F.regexp_replace(c, r"(?i)\Adoi:", ""))


def valid_doi(c: Column) -> Column:
    return doi(c).rlike(r"\A10\.\d{4,}(\.\d+)*/(?U:\S)+")


def doi_in_url(c: Column) -> Column:
    """The DOI of a resolver URL, else the first bare one; null if none."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(found(r"(?i)https?://(?:dx\.)?doi\.org/(10\.\S+)"), found(r"(10\.\d{4,}(?:\.\d+)*/\S+)"))


def url_class(c: Column) -> Column:
    """struct(type, identifier) of a URL; the first class that fits."""
    t = trimmed(c)
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    kinds = [
        ("arxiv", found(r"(?i)arxiv\.org/abs/([^\s?#]+)")),
        ("arxiv", found(r"(?i)arxiv\.org/pdf/([^\s?#]+)")),
        ("doi", found(r"(?i)https?://(?:dx\.)?doi\.org/(10\.\S+)")),
        ("doi", found(r"\A(10\.\d{4,}(?:\.\d+)*/\S+)\z")),
        ("pubmed", found(r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov|ncbi\.nlm\.nih\.gov/pubmed)/(\d+)")),
    ]
    out = F.when(F.lit(False), F.lit(""))
    for kind, got in kinds:
        out = out.when(got.isNotNull(), F.lit(kind))
    out = out.when(t.rlike(r"(?i)\.pdf(\?|#|\z)"), "pdf").when(t.rlike(r"(?i)\Ahttps?://"), "html").otherwise("unknown")
    return F.struct(out.alias("type"), F.coalesce(*[g for _, g in kinds]).alias("identifier"))


#: DOI prefix, publisher, landing page before the DOI.
PUBLISHERS = [
    ("10.1007/", "springer", "https://link.springer.com/article/"),
    ("10.1038/", "springer", "https://link.springer.com/article/"),
    ("10.1016/", "elsevier", "https://doi.org/"),
    ("10.1145/", "acm", "https://dl.acm.org/doi/"),
]


def publisher(c: Column) -> Column:
    """struct(name, landing_url) by DOI prefix; nulls for others."""
    name = url = F.when(F.lit(False), F.lit(""))
    for prefix, who, page in PUBLISHERS:
        name = name.when(c.startswith(prefix), F.lit(who))
        url = url.when(c.startswith(prefix), F.concat(F.lit(page), c))
    return F.struct(name.alias("name"), url.alias("landing_url"))


def valid_email(c: Column) -> Column:
    return c.rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z")


def usable_email(c: Column) -> Column:
    """A contact address that a service may take; null for blanks and for reserved domains."""
    t = trimmed(c)
    reserved = r"(?i)@([^@]*\.)?(example\.(com|org|net)|example|test|invalid|localhost)\z"
    return F.when((t != "") & ~t.rlike(reserved), t)


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def file_stem(key: Column, doi_: Column, otherwise: str = "citation") -> Column:
    return file_name(F.coalesce(F.nullif(F.trim(key), F.lit("")), F.nullif(F.trim(doi_), F.lit("")), F.lit(otherwise)))


# Titles


def title(c: Column) -> Column:
    """A title as titles are compared: braces and backslashes dropped, lower case, words of a-z and 0-9."""
    plain = F.lower(F.translate(F.coalesce(c, F.lit("")), "{}\\", ""))
    return F.array_join(F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def compared_titles(a: Column, b: Column) -> Column:
    """(longest - distance) / longest of titles that are normalised already; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def title_similarity(a: Column, b: Column) -> Column:
    """The similarity of two titles as they come."""
    return compared_titles(title(a), title(b))


def significant_words(c: Column) -> Column:
    """Words of at least four characters of a comparable text, repeats kept."""
    return F.filter(F.split(title(c), " "), lambda w: F.length(w) >= 4)


def last_names(c: Column) -> Column:
    """Distinct lower-cased last words of authors parted by ' and ', comma or semicolon; three letters at least."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?i)\s+and\s+|[,;]"), lambda p: F.element_at(F.split(title(p), " "), -1))
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3))
