"""Offers that name several products at once, one row for each product.

Three forms: a number of kinds (``4 rūšių``) with one or more sizes, two variants joined by ``arba`` or ``ir``, and a list of
brands in capitals. A size after the last comma belongs to what it follows, in order, the last one to all further.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How sizes, kinds, fat contents and "and others" are written.
SIZE = re.compile(r",\s*\d+(?:[.,]\d+)?(?:\s*[x×]\s*\d+(?:[.,]\d+)?)?\s*(?:g/pak\.?|g|kg|ml|l|vnt\.?(?:/pak\.?)?|pak\.)\s*$", re.IGNORECASE)
KINDS = re.compile(r",?\s*\(?\s*(?:įv\.)?\s*(\d*)\s*rūšių\s*\)?", re.IGNORECASE)
ASIDES = re.compile(r",?\s*\d+(?:[.,]\d+)?%\s*rieb\.|,?\s*a\.\s*r\.", re.IGNORECASE)
CAPITALS = "A-ZÄÖÜÕŽŠĖ"
MODIFIER = re.compile(r"(?:oji|asis|iškas?|[aąeėiįuū][td]as|ytas?|itas?|intas?|..ų)$")
#: Kinds that are meant where no number is given.
USUAL_KINDS = 3
MOST_SIZES = 8


def split_sizes(name: str) -> tuple[str, list[str]]:
    """The name without the sizes at its end, and these."""
    sizes: list[str] = []
    while len(sizes) < MOST_SIZES and (m := SIZE.search(name)):
        sizes.insert(0, m.group().lstrip(",").strip())
        name = name[: m.start()].strip()
    return name, sizes


def in_capitals(text: str) -> bool:
    return text == text.upper() and bool(re.search(f"[{CAPITALS}]", text))


def in_brand_letters(text: str) -> bool:
    return bool(re.fullmatch(f"[{CAPITALS}0-9& ]+", text.strip()) and re.search(f"[{CAPITALS}]", text))


def same_beginning(a: str, b: str, n: int = 4) -> bool:
    a, b = a.lower().rstrip(".,"), b.lower().rstrip(".,")
    return len(a) >= n and a[:n] == b[:n]


def alternatives(name: str, left: str, right: str) -> list[str]:
    """Both products of ``left or right``, each with the words that only the other side spells out."""
    ours, theirs = left.split(), right.split()
    if re.match("[a-zäöüõžšė]", theirs[0]):
        # Two adjectives of one noun: the second reaches as far as it is inflected like the first.
        end = 1
        if same_beginning(ours[-1], theirs[0]):
            while end < len(theirs) and MODIFIER.search(theirs[end].lower().rstrip(".,")):
                end += 1
        shared = theirs[end:]
        return [" ".join([*ours, *shared]), " ".join([*ours[:-1], *theirs[:end], *shared])]
    if all(in_capitals(w) or re.match(r"[\d&+.]", w) for w in theirs):
        # Another brand of the same thing.
        first = next((i for i, w in enumerate(ours) if in_capitals(w)), len(ours))
        return [left, " ".join([*ours[:first], *theirs])]
    # Two whole names; the last common noun may stand in the second alone.
    noun = next((w for w in reversed(theirs) if re.match("[a-zäöüõžšė]", w)), None)
    return [left if noun is None or noun.lower() in left.lower() else f"{left} {noun}", right]


def brands(base: str) -> list[str]:
    """The names of a list of brands after a common beginning, or none."""
    first, *others = re.split(r",\s*", base)
    others_in_capitals = [p for p in others if in_brand_letters(p)]
    if len(others) < 2 or len(others_in_capitals) < 2:
        return []
    words = first.split()
    at = next((i for i, w in enumerate(words) if in_brand_letters(w) or (w[:1].isdigit() and i + 1 < len(words) and in_brand_letters(words[i + 1]))), None)
    common = words[:at] if at else []
    own = " ".join(words[at:]) if at is not None else first
    return [" ".join([*common, b]) for b in [own, *others_in_capitals]]


def expanded(name: str | None) -> list[tuple[str, str | None, int | None]]:
    """(product, size, kinds) of each product an offer names; kinds says how many variants may stand behind it."""
    if not name or not name.strip():
        return []
    if kinds := KINDS.search(name):
        numbers = [int(m.group(1)) for m in KINDS.finditer(name) if m.group(1)]
        plain = re.sub(r"\s+", " ", ASIDES.sub("", KINDS.sub("", name))).strip()
        base, sizes = split_sizes(plain)
        return [(base.rstrip(", "), s, numbers[0] if numbers else USUAL_KINDS) for s in sizes or [None]]
    base, sizes = split_sizes(name)
    size = lambda i: (sizes[i] if i < len(sizes) else sizes[-1]) if sizes else None
    either, both = re.search(r"\barba\b", name), re.search(f"[{CAPITALS}]\\s+ir\\s+[{CAPITALS}]", name)
    if either or both:
        left, *rest = re.split(" arba " if either else f" ir (?=[{CAPITALS}])", base)
        right = " arba ".join(rest).strip()
        if left.strip() and right:
            return [(p, size(i), None) for i, p in enumerate(alternatives(name, left.strip(), right))]
    elif found := brands(base):
        return [(p, size(0), None) for p in found]
    return [(base, size(0), None)]


def expand_offers(offers: DataFrame, column: str = "name") -> DataFrame:
    """A row for each product in ``column``: the offer's columns, and product, size, kinds and part (from 0).

    An offer without a name has no row. Different names are read once.
    """

    def read(batches):
        for pdf in batches:
            rows = [(n, part, *x) for n in pdf["offer_name"] for part, x in enumerate(expanded(n))]
            yield pd.DataFrame(rows, columns=["offer_name", "part", "product", "size", "kinds"]).astype({"part": "int32", "kinds": "Int32"})

    distinct = offers.select(F.col(column).alias("offer_name")).where("offer_name IS NOT NULL").distinct()
    found = distinct.mapInPandas(read, "offer_name string, part int, product string, size string, kinds int")
    return offers.join(found, F.col(column) == F.col("offer_name")).drop("offer_name")
