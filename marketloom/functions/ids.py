"""Deterministic identifiers: hashes of joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import SPACE_CLASS, blank_to_null, clean_text, col, float_text, general_number


def part_id(*parts: Column | str) -> Column:
    """16 hex digits of SHA-1 over the cleaned, non-empty parts joined by ``|``."""
    joined = F.concat_ws("|", *[blank_to_null(clean_text(p)) for p in parts])
    return F.substring(F.sha1(joined.cast("binary")), 1, 16)


def full_part_id(*parts: Column | str) -> Column:
    """20 hex digits of SHA-1 over all parts, empty ones included."""
    joined = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(joined.cast("binary")), 1, 20)


def price_part(price: Column) -> Column:
    return float_text(price)


def text_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def pair_id(left_source: Column, left_key: Column, right_source: Column, right_key: Column) -> Column:
    """Order-free identifier of two listings, 12 hex digits."""
    left = F.concat(F.coalesce(left_source, F.lit("None")), F.lit(":"), F.coalesce(left_key, F.lit("None")))
    right = F.concat(F.coalesce(right_source, F.lit("None")), F.lit(":"), F.coalesce(right_key, F.lit("None")))
    joined = F.concat(F.least(left, right), F.lit("|"), F.greatest(left, right))
    return F.substring(F.sha1(joined.cast("binary")), 1, 12)


def canonical_key(category: Column, brand: Column, core: Column, volume: Column, abv: Column, pack: Column) -> Column:
    """Readable key of a product: category, brand, core name and measures, empty parts left out."""
    present = lambda number: number.isNotNull() & (number != 0)
    return F.concat_ws(
        "|",
        F.coalesce(blank_to_null(category), F.lit("khac")),
        F.coalesce(blank_to_null(brand), F.lit("unknown-brand")),
        blank_to_null(core),
        F.when(present(volume), F.concat(volume.cast("string"), F.lit("ml"))),
        F.when(present(abv), F.concat(general_number(abv), F.lit("pct"))),
        F.when(present(pack), F.concat(F.lit("pack"), pack.cast("string"))),
    )


def evidence_hash(samples: Column) -> Column:
    """Fingerprint of an ordered array of (url, page_type, html) samples, 24 hex digits.

    White space in the HTML is collapsed and each part ends in a NUL, so equal evidence gives an
    equal hash however it was stored.
    """
    nul = F.lit("\x00")
    parts = F.transform(samples, lambda s: F.concat(
        F.coalesce(s["url"], F.lit("")), nul, F.coalesce(s["page_type"], F.lit("")), nul,
        F.trim(F.regexp_replace(F.coalesce(s["html"], F.lit("")), f"[{SPACE_CLASS}]+", " ")), nul))
    return text_hash(F.concat(F.lit(K.EVIDENCE_VERSION), nul, F.array_join(parts, "")), 24)
