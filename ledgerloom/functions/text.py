"""Text functions of ledgers as Column builders: search keys, amounts, title case."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = r"^-?\d{1,3}(?:\.\d{3})*,\d{2}$"
MONEY = "decimal(18,2)"


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """What NFKD and the loss of all but ASCII make of each character: one letter or digit, or several."""
    one, to, several = [], [], {}
    for c in map(chr, range(0x80, 0x110000)):
        if not unicodedata.decomposition(c):
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalnum())
        if len(folded) == 1:
            one.append(c)
            to.append(folded)
        elif folded:
            several[c] = folded
    return "".join(one), "".join(to), several


def normalize_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits of the text after accents are taken off; nothing else stays.

    Characters that fold to several letters are looked up one by one, only where a text may have any:
    those that Latin text prints are named in the test, the others lie beyond U+2000.
    """
    one, to, several = _foldings()
    folded = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(folded, c), c)), "")
    some = "[" + "".join(c for c in several if c < "\u2000") + r"\x{2000}-\x{10FFFF}]"
    text = F.when(text.rlike(some), wide).otherwise(text)
    return F.lower(F.regexp_replace(F.translate(text, one, to), "[^A-Za-z0-9]", ""))


def normalize_text(text: str) -> str:
    """normalize_key for a search term on the driver."""
    one, to, several = _foldings()
    text = text.translate({ord(c): folded for c, folded in several.items()} | {ord(a): b for a, b in zip(one, to, strict=True)})
    return "".join(x for x in text if x.isascii() and x.isalnum()).lower()


def is_amount(text: Column) -> Column:
    return text.rlike(AMOUNT)


def parse_amount(text: Column) -> Column:
    """1.234.567,89 to a decimal; null for what is no amount, or one beyond sixteen digits."""
    return F.when(is_amount(text), F.translate(F.translate(text, ".", ""), ",", ".").try_cast(MONEY))


def format_amount(value: Column) -> Column:
    """A decimal to 1.234.567,89; null to a hyphen."""
    return F.coalesce(F.translate(F.format_number(value, 2), ",.", ".,"), F.lit("-"))


def title_case(text: Column) -> Column:
    """Every run of letters gets a capital, as after hyphens and apostrophes too."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0)), F.initcap), "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract, with null for no match or an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


