"""Index terms: words without diacritics, stemmed by Porter's algorithm (M. F. Porter, 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import types as T

from .batches import sliced

WORD = re.compile(r"[^\W_]+")


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = "".join("v" if _vowel(stem, k) else "c" for k in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str, k: int) -> bool:
    return w[k] in "aeiou" or w[k] == "y" and k > 0 and not _vowel(w, k - 1)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, k) for k in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


#: Suffixes and what replaces them in steps 2, 3 and 4, from the paper.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log", bli="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(200_000)
def stem(w: str) -> str:
    """The stem of an ASCII word; other words stay."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = _longest(w, STEP4)
    if end:
        base = w[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


NON_ASCII = re.compile(r"[^\x00-\x7f]")


@lru_cache(None)
def _unmarked(c: str) -> str:
    """A character without marks; nothing if it is one."""
    d = unicodedata.normalize("NFD", c)
    c = d[0] if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) else c
    return "" if unicodedata.combining(c) else c


def plain(text: str) -> str:
    """Lower case, Latin letters without their marks."""
    text = text.lower()
    return text if text.isascii() else NON_ASCII.sub(lambda m: _unmarked(m[0]), text)


#: Bytes of ASCII that are in no word as spaces.
PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """WORD's matches; only what has other characters than ASCII is searched for them."""
    found = text.encode("utf-8", "surrogatepass").translate(PARTED).decode("utf-8", "surrogatepass").split()
    return found if text.isascii() else [w for part in found for w in ((part,) if part.isascii() else WORD.findall(part))]


def terms(text: str | None, stemmed: bool = True) -> list[str]:
    words = words_of(plain(text or ""))
    return [stem(w) for w in words] if stemmed else words


def found_terms(wanted: list[str], stemmed: bool = True):
    """A column function: struct(n, found array<struct<pos, term>>) of a text's number of terms and of those wanted."""
    kind = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("term", T.StringType())])))])
    only = frozenset(wanted)

    @sliced(kind)
    def find(text: str | None) -> dict:
        own = terms(text, stemmed)
        return {"n": len(own), "found": [{"pos": k, "term": t} for k, t in enumerate(own) if t in only]}

    return find


@sliced(T.ArrayType(T.StringType()))
def stemmed_terms(text: str | None) -> list[str]:
    return terms(text)


@sliced(T.ArrayType(T.StringType()))
def plain_terms(text: str | None) -> list[str]:
    return terms(text, False)
