"""Text columns: cleaning, folding, number and unit reading. All plain Catalyst expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Every code point that counts as white space, as a regex class body valid in Java and RE2.
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
VOLUME_PATTERN = r"(?i)(\d+(?:[.,]\d+)?)\s*(ml|l|lit|liter|lít)"
FOLDED_VOLUME_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(ml|l|lit|liter|cl)\b"
FOLDED_ABV_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(?:%|\bdo\b)"
FOLDED_PACK_PATTERN = r"\b(?:thung|hop|pack|case)\s*(\d+)|\b(\d+)\s*(?:lon|chai|hop|goi)\b"
PACKAGE_PATTERNS = [
    r"(?i)(?:thùng|hộp|lốc|pack|case)\s*(\d{1,3})",
    r"(?i)(\d{1,3})\s*(?:chai|lon|hộp|goi|gói)\b",
    r"(?i)x\s*(\d{1,3})\b",
]


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """NULL for the empty string. Written so that ``value`` stands in the plan once, also inside
    branches and lambdas, where ``nullif`` would copy it."""
    return F.get(F.regexp_extract_all(col(value), F.lit(r"(?s)^.+$"), F.lit(0)), 0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def found(pattern: str, value: Column, group: int = 1) -> Column:
    """The regex group, or NULL where the pattern does not occur."""
    return blank_to_null(F.regexp_extract(value, pattern, group))


def contains_any(value: Column, words: list[str]) -> Column:
    """Whether any word occurs in the value: one pattern, so the value appears once in the plan."""
    return value.rlike("|".join(re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", word) for word in words))


def clean_text(value: Column | str) -> Column:
    """White space runs to one space, ends trimmed, NULL to the empty string."""
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def first_present(*values: Column | str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(col(v).cast("string")) for v in values])


def first_alias(record: Column, names: list[str]) -> Column:
    """First non-empty entry of a string map under the given keys."""
    return F.coalesce(*[blank_to_null(F.try_element_at(record, F.lit(n))) for n in names])


def lower_keys(record: Column) -> Column:
    """The map with its keys trimmed and lowered; of keys that become alike the last one stays."""
    lowered = F.transform(F.map_entries(record), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(
        F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(let(lowered, last))


def title_case(value: Column) -> Column:
    """Capital at the start of every letter run, also after digits and punctuation."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def clean_price(value: Column | str) -> Column:
    """Digits of the first number-like run, separators dropped: ``29.000 đ`` is 29000."""
    run = F.regexp_extract(clean_text(value), r"\d[\d.,\s]*", 0)
    return blank_to_null(F.regexp_replace(run, r"\D", "")).try_cast("double")


def positive_price(value: Column | str) -> Column:
    price = clean_price(value)
    return F.when(price > 0, price)


def plain_price(value: Column | str) -> Column:
    """Like :func:`clean_price`, but a plain decimal such as ``100000.00`` keeps its value."""
    text = clean_text(value)
    return F.when(text.rlike(r"^\d+\.\d{1,2}$"), text.try_cast("double")).otherwise(clean_price(value))


def _decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def percentage(value: Column | str) -> Column:
    return F.replace(found(r"\d+(?:[.,]\d+)?\s*%", col(value), 0), F.lit(","), F.lit("."))


def _volume(text: Column, pattern: str) -> Column:
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit == "ml", 1).when(unit == "cl", 10).otherwise(1000)
    return (_decimal(found(pattern, text)) * factor).cast("int")


def volume_ml(value: Column | str) -> Column:
    return _volume(col(value), VOLUME_PATTERN)


def infer_volume_ml(*values: Column) -> Column:
    return volume_ml(joined_lower(*values))


def infer_package_count(*values: Column) -> Column:
    """Units in a pack by three patterns in order, kept within 1..500, 1 when none applies."""
    return package_count_of(joined_lower(*values))


def package_count_of(text: Column) -> Column:
    """:func:`infer_package_count` of text that is joined and lowered already."""
    count = F.coalesce(*[found(p, text).cast("int") for p in PACKAGE_PATTERNS], F.lit(1))
    return F.greatest(F.lit(1), F.least(count, F.lit(500)))


def stock_status(value: Column | str) -> Column:
    text = F.lower(col(value))
    return F.when(contains_any(text, K.SOLD_OUT_WORDS), "OUT_OF_STOCK").when(
        contains_any(text, K.IN_STOCK_WORDS), "IN_STOCK")


def rating_number(value: Column | str) -> Column:
    return _decimal(found(r"\d+(?:[.,]\d+)?", col(value), 0))


def review_count(value: Column | str) -> Column:
    return found(r"\d+", col(value), 0).try_cast("int")


def phone(value: Column | str) -> Column:
    return clean_text(found(K.PHONE_PATTERN, col(value), 0))


def joined_lower(*values: Column) -> Column:
    """Cleaned, lowered, space-joined text of the non-empty values."""
    return F.concat_ws(" ", *[blank_to_null(F.lower(clean_text(v))) for v in values])


def product_name_key(value: Column | str) -> Column:
    """Lowered text with every run of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(col(value)), r"[^\p{L}\p{N}_]+", " "))


def _fold_tables() -> tuple[str, str]:
    source, target = [], []
    for point in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(point) and base.isascii():
            source.append(chr(point))
            target.append(base)
    return "".join(source) + "đ", "".join(target) + "d"


_FOLD_FROM, _FOLD_TO = _fold_tables()


def fold_text(value: Column | str, decimal_comma: bool = False) -> Column:
    """Lowered, unaccented text of ``[a-z0-9.%]`` words.

    A comma is a separator as any other sign, so ``14,5%`` becomes ``14 5%``; with
    ``decimal_comma`` a comma between digits is read as a decimal point instead.
    """
    text = F.lower(clean_text(value))
    if decimal_comma:
        text = F.regexp_replace(text, r"(?<=\d),(?=\d)", ".")
    text = F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9.%]+", " "))


def _joined_fold(values: tuple[Column, ...], decimal_comma: bool) -> Column:
    return fold_text(F.concat_ws(" ", *[F.coalesce(col(v).cast("string"), F.lit("")) for v in values]), decimal_comma)


def canonical_volume_ml(*values: Column, decimal_comma: bool = False) -> Column:
    return _volume(_joined_fold(values, decimal_comma), FOLDED_VOLUME_PATTERN)


def canonical_abv(*values: Column, decimal_comma: bool = False) -> Column:
    return _decimal(found(FOLDED_ABV_PATTERN, _joined_fold(values, decimal_comma)))


def canonical_pack_size(*values: Column, decimal_comma: bool = False) -> Column:
    text = _joined_fold(values, decimal_comma)
    return F.coalesce(found(FOLDED_PACK_PATTERN, text, 1), found(FOLDED_PACK_PATTERN, text, 2)).try_cast("int")


def name_core(value: Column | str, brand: Column | str, decimal_comma: bool = False) -> Column:
    """Folded name without its brand, volume, strength, pack and noise words."""
    text, label = fold_text(value, decimal_comma), fold_text(brand, decimal_comma)
    escaped = F.regexp_replace(label, r"([.%])", r"\\$1")
    text = F.when(label != "", F.regexp_replace(text, F.concat(F.lit(r"\b"), escaped, F.lit(r"\b")), F.lit(" "))).otherwise(text)
    for pattern in (FOLDED_VOLUME_PATTERN, FOLDED_ABV_PATTERN, FOLDED_PACK_PATTERN):
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(K.NAME_NOISE_WORDS))
    return F.array_join(words, " ")


def general_number(value: Column) -> Column:
    """A double in its shortest plain form: 40.0 is ``40``, 14.5 is ``14.5``."""
    return F.regexp_replace(value.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def float_text(value: Column) -> Column:
    """A double as text with a trailing ``.0`` for whole numbers and no exponent."""
    return F.when(value == F.floor(value), F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(
        value.cast("string"))


def clean_list(value: Column, pattern: str = r"[,\n]") -> Column:
    """Split on commas and line ends, trim, drop blanks, keep first occurrences."""
    items = F.transform(F.split(value, pattern), clean_text)
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def price_label(price: Column) -> Column:
    """Text shown for a price: dot thousands, comma decimals, ``N/A`` when there is none."""
    shown = F.translate(F.regexp_replace(F.format_number(price, 3), r"\.?0+$", ""), ",.", ".,")
    return F.when(price > 0, F.concat(shown, F.lit(" VND"))).otherwise("N/A")


def address_label(address: Column, status: Column, channel: Column) -> Column:
    offline = F.when((status == "NOT_APPLICABLE") | (channel == "online"), "Online").otherwise("Chưa có địa chỉ")
    return F.coalesce(blank_to_null(address), offline)
