"""Text column functions (N1–N5), all JVM-side.

Whitespace follows Python's ``str.split()``/``strip()`` set exactly (one
character class, valid in both Java and RE2 regex syntax). Accent folding
(NFKD, then dropping non-ASCII) uses tables of the characters that decompose,
built on first use.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from functools import cache, reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonepulse.functions.columns import col

# Python's whitespace characters (str.isspace), as one regex class.
PY_WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


# Stands for a character that is spelled with several letters (private use; a
# text that holds it is only folded by the longer way).
SPELLED = "\ue000"
BEYOND_ASCII = r"[^\x{00}-\x{7F}]"


@cache
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """What NFKD decomposition and dropping non-ASCII make of each character
    beyond ASCII: those that give one character, and those that give several.
    (Characters that give none are left out; they are dropped at the end.)
    Built when first asked for, from the characters that decompose at all."""
    one, several = {}, {}
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(ch):
            plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if c < "\x80")
            if plain:
                (one if len(plain) == 1 else several)[ch] = plain
    return one, several


def py_strip(c) -> Column:
    return F.regexp_replace(col(c), f"^{PY_WS}+|{PY_WS}+$", "")


def py_squeeze(c) -> Column:
    """' '.join(s.split())"""
    return F.regexp_replace(py_strip(c), f"{PY_WS}+", " ")


def fold_accents(c) -> Column:
    """NFKD, then ASCII only. Texts of ASCII stay as they are; in others the
    simple characters are translated, and only texts with a character that
    gives several letters (ligatures, fractions, units) are spelled out."""
    text = col(c)
    one, several = fold_tables()
    simple = F.translate(text, "".join(one) + "".join(several), "".join(one.values()) + SPELLED * len(several))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    letters = F.transform(F.split(text, ""), lambda x: F.coalesce(F.when(x.rlike(BEYOND_ASCII), F.try_element_at(table, x)), x))
    spelled = F.translate(F.array_join(letters, ""), "".join(one), "".join(one.values()))
    full = F.when(simple.contains(SPELLED), spelled).otherwise(simple)
    return F.when(text.rlike(BEYOND_ASCII), F.regexp_replace(full, BEYOND_ASCII, "")).otherwise(text)


def normalize_for_match(c) -> Column:
    """Accent-folded, lower-cased, whitespace-squeezed text."""
    return py_squeeze(F.lower(fold_accents(c)))


def any_of(words) -> str:
    """One pattern for all words (sorted, none the beginning of another), shared beginnings written once."""
    if len(words) == 1:
        return re.escape(words[0])
    head = os.path.commonprefix([words[0], words[-1]])
    arms = [any_of([w[len(head):] for w in group]) for _, group in groupby(words, key=lambda w: w[: len(head) + 1])]
    return f"{re.escape(head)}(?:{'|'.join(arms)})"


def contains_any(c: Column, words, most_tests: int = 8, pattern_chars: int = 12_000) -> Column:
    """Whether the text holds any of the words as a substring. Up to
    ``most_tests`` words are tested one by one; more are written as a tree of
    shared beginnings, so that a place of the text is compared with the letters
    that may follow there, not with each word. A pattern is a constant of the
    generated code, hence of bounded length; neighbouring words share one."""
    needed: list[str] = []
    for w in sorted(set(words)):
        if not needed or not w.startswith(needed[-1]):  # found wherever its beginning is
            needed.append(w)
    if len(needed) <= most_tests:
        return reduce(lambda out, w: out | c.contains(w), needed, F.lit(False))
    runs, size = [[]], 0
    for w in needed:
        if runs[-1] and size + len(w) > pattern_chars:
            runs, size = [*runs, []], 0
        runs[-1].append(w)
        size += len(w)
    return reduce(lambda out, run: out | c.rlike(any_of(run)), runs, F.lit(False))


def mask_email(c) -> Column:
    """Keep the first 1 (user part ≤2 chars) or 2 characters of the user
    part, then ***; no '@' gives ***."""
    v = py_strip(col(c))
    user = F.substring_index(v, "@", 1)
    domain = F.substring(v, F.instr(v, "@") + 1, 1 << 30)
    keep = F.when(F.length(user) <= 2, F.substring(user, 1, 1)).otherwise(F.substring(user, 1, 2))
    return F.when(~v.contains("@"), F.lit("***")).otherwise(F.concat(keep, F.lit("***@"), domain))


# Fixed value: what counts as an e-mail address.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def is_email(c) -> Column:
    """Whether the trimmed text is an e-mail address: one '@' with no
    blank around it and a domain with a dot inside."""
    return F.coalesce(py_strip(col(c)).rlike(EMAIL_PATTERN), F.lit(False))


def preview(c, max_len: int = 96) -> Column:
    """One-line preview, cut to ``max_len`` characters plus '...'."""
    s = py_squeeze(col(c))
    return F.when(F.length(s) <= max_len, s).otherwise(F.concat(F.substring(s, 1, max_len), F.lit("...")))
