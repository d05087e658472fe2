"""Match keys: accent folding, name keys, phonetic keys. Columns in, columns out."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a name's match key leaves out.
HONORIFICS = (
    "dom dr dra sr sra pe padre frei fr mons monsenhor bishop archbishop cardinal pope saint st santo santa sao "
    "são shaykh sheikh sidi prof professor mr mrs ms rev reverend"
).split()
# Titles and connectors that the phonetic key leaves out.
TITLES = (
    "dr dr. dra sr sr. sra pe pe. padre frei dom monsenhor mons mons. bispo arcebispo cardeal papa são santa santo "
    "professor prof prof. fr fr. mr mr. mrs ms bishop archbishop cardinal saint st st. father pope reverend rev rev."
).split()
CONNECTORS = "de da do das dos del della di du van von y e al el bin ibn of the".split()


@functools.cache
def _bases() -> tuple[str, str]:
    """Letters that decompose into one base and marks, and their bases, from Unicode's own data."""
    pairs = []
    for code in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(rest) == 1 and rest != c:
            pairs.append((c, rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unmarked(c: Column) -> Column:
    """:func:`deaccent` of texts that aren't plain ASCII."""
    letters, bases = _bases()
    return F.regexp_replace(F.translate(c, letters, bases), r"[\x{300}-\x{10FFFF}&&\p{Mn}]", "")


def not_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


def deaccent(c: Column) -> Column:
    """Text in decomposed form without its combining marks. Texts of plain ASCII skip the work."""
    return F.when(not_ascii(c), unmarked(c)).otherwise(c)


def fold_key(c: Column) -> Column:
    """De-accented, lower case, everything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(deaccent(c)), r"[^a-z0-9]+", " "))


def initials_key(c: Column) -> Column:
    """The fold key without one-letter words."""
    return F.array_join(F.filter(F.split(fold_key(c), " "), lambda w: F.length(w) > 1), " ")


def normal_name(c: Column) -> Column:
    """The comparison key of a name: folded, without honorifics."""
    words = F.split(F.trim(F.regexp_replace(F.lower(deaccent(c)), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(HONORIFICS)), " ")


# The phonetic rewrites, in order, as (pattern, replacement).
PHONETIC = [
    ("ph", "f"), ("th", "t"), ("ck|qu|q", "k"), ("c([ei])", "s$1"), ("c", "k"), ("[zç]", "s"), ("[yj]", "i"),
    ("w", "v"), ("b(?=[vw])", ""), ("h", ""), (r"(.)\1+", "$1"), ("[^a-z]", ""),
]


def name_key(c: Column) -> Column:
    """The phonetic clustering key of a name."""
    words = F.split(F.regexp_replace(F.replace(F.lower(deaccent(c)), F.lit("-"), F.lit(" ")), r"(?U)\s+", " "), " ")
    words = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:'’\"]+|[.,;:'’\"]+$", ""))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(TITLES) & ~w.isin(CONNECTORS))

    def rewritten(w: Column) -> Column:
        for pattern, to in PHONETIC:
            w = F.regexp_replace(w, pattern, to)
        return w

    return F.array_join(F.filter(F.transform(words, rewritten), lambda w: w != ""), " ")


_PHONETIC = [(re.compile(pattern), to.replace("$1", r"\1")) for pattern, to in PHONETIC]


def key_of_name(name: str) -> str:
    """:func:`name_key` of a string."""
    plain = name if name.isascii() else "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn")
    out = []
    for w in plain.lower().replace("-", " ").split():
        w = w.strip(".,;:'’\"")
        if w and w not in TITLES and w not in CONNECTORS:
            for pattern, to in _PHONETIC:
                w = pattern.sub(to, w)
            out.append(w)
    return " ".join(w for w in out if w)


def is_notable(key: Column) -> Column:
    """A key that may anchor a match across repositories: six characters and two words at least."""
    return (F.length(key) >= 6) & (F.size(F.split(key, " ")) >= 2)


def skip_reason(name: Column) -> Column:
    """Why a name is not searched for; null for one that is."""
    return (
        F.when(~name.rlike(r"^\p{Lu}"), F.lit("not capitalised"))
        .when(F.length(name) < 8, F.lit("too short"))
        .when(F.size(F.split(F.trim(name), r"\s+")) < 2, F.lit("one word"))
    )


def conjunction_parts(surface: Column) -> Column:
    """(left, right) of a surface that joins two capitalised names; null otherwise."""
    pattern = r"^(.+?) (?:e|and|&|y) (.+)$"
    left, right = F.regexp_extract(surface, pattern, 1), F.regexp_extract(surface, pattern, 2)
    fits = left.rlike(r"^\p{Lu}") & right.rlike(r"^\p{Lu}") & (F.length(fold_key(left)) >= 4) & (F.length(fold_key(right)) >= 4)
    return F.when(fits, F.struct(left.alias("left"), right.alias("right")))


def name_variants(name: Column) -> Column:
    """Forms of a name worth matching: its parts, and what stands in parentheses."""
    base = F.regexp_replace(name, r"\([^)]*\)", " ")
    parts = F.split(base, r"\s+[—–-]\s+|\s*[/;]\s*")
    aliases = F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.filter(F.transform(F.concat(parts, aliases), lambda p: F.trim(p)), lambda p: p != "")


def dataset_variants(name: Column) -> Column:
    """name_variants, those split at ``&``, ``and`` and commas, and the whole name."""
    base = name_variants(name)
    split = F.flatten(F.transform(base, lambda p: F.transform(F.split(p, r"\s+&\s+|\s+and\s+|\s*,\s*"), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(F.concat(base, split, F.array(F.trim(name))), lambda p: p != ""))


def paren_terms(text: Column) -> Column:
    """Name-shaped pieces in parentheses: 2 to 60 characters, with an upper-case letter."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1))
    pieces = F.flatten(F.transform(inner, lambda p: F.transform(F.split(p, r"\s*[,;/]\s*"), lambda x: F.trim(x))))
    return F.filter(pieces, lambda p: F.length(p).between(2, 60) & p.rlike(r"\p{Lu}"))


def search_variants(name: Column) -> Column:
    """Forms of a name to search for: split at slashes and commas only if each part looks like a name."""
    base = F.trim(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+", " "))
    parts = F.transform(F.split(base, r"\s*[/,]\s*"), lambda p: F.trim(p))
    named = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\p{Lu}\S+(\s+\S+)+$"))
    aliases = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.trim(p)), lambda p: p.rlike(r"\p{Lu}"))
    return F.array_distinct(F.filter(F.concat(F.when(named, parts).otherwise(F.array(base)), aliases), lambda p: p != ""))
