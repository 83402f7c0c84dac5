"""Cleaning of scraped text, as Column -> Column functions.

Patterns carry ``(?U)``, so that white space, digits and word boundaries are Unicode's.
An empty string and null count alike as missing (``falsy``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency text and availability phrases.
BAHT_SIGN, BAHT_WORD = "฿", "บาท"
IN_STOCK = ["in stock", "available", "มีสินค้า", "พร้อมส่ง", "ready", "in-stock", "สินค้าพร้อม"]
OUT_OF_STOCK = ["out of stock", "unavailable", "หมด", "สินค้าหมด", "sold out", "ไม่มีสินค้า", "out-of-stock"]
SKU_PATTERNS = [r"(?iU)(?:SKU|รหัส|Code)[\s:-]*([A-Z0-9-]+)", r"(?U)\b(\d{10})\b", r"(?iU)\b([A-Z]{2,5}-?\d{4,})\b"]
SPACE = r"[\s\x1c-\x1f]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once; written out, each mention of it in a branch is computed again."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def missing_to_null(c) -> Column:
    """Names ``c`` once, unlike nullif: nested, that doubles the work at each level."""
    return F.get(F.array_remove(F.array(col(c)), F.lit("")), F.lit(0))


def first_match(text, pattern: str, group: int = 1) -> Column:
    """Null where nothing matches."""
    return missing_to_null(F.regexp_extract(col(text), pattern, group))


def ascii_digits(c: Column) -> Column:
    """Thai and Arabic-Indic digits as 0-9; other scripts' digits stay."""
    return F.translate(c, "๐๑๒๓๔๕๖๗๘๙٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def extract_price(c) -> Column:
    """The first number once currency signs, commas and white space are gone; at most two
    decimals are read (more are cut), a sign is not. No number: null."""
    bare = F.replace(F.regexp_replace(col(c), rf"(?U)[{BAHT_SIGN},\s\x1c-\x1f]", ""), F.lit(BAHT_WORD), F.lit(""))
    return first_match(ascii_digits(bare), r"(\d+(?:\.\d{1,2})?)").try_cast("decimal(12,2)")


def strip(c) -> Column:
    return F.regexp_replace(col(c), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def clean_text(c) -> Column:
    """Trimmed, runs of white space as one space, without control characters; missing: ''."""
    spaced = F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")
    return F.coalesce(F.regexp_replace(spaced, r"[\x00-\x1f\x7f-\x{9f}]", ""), F.lit(""))


def extract_sku(c) -> Column:
    return F.upper(F.coalesce(*[first_match(c, p) for p in SKU_PATTERNS]))


def availability(c, negatives_first: bool = False) -> Column:
    """in_stock, out_of_stock or unknown by the phrases in the text. The plain order tests
    in-stock phrases first (so 'unavailable', which has 'available', is in stock);
    ``negatives_first`` is the corrected order."""
    has = lambda low, phrases: F.coalesce(F.greatest(*[F.contains(low, F.lit(p)) for p in phrases]), F.lit(False))
    yes, no = (IN_STOCK, "in_stock"), (OUT_OF_STOCK, "out_of_stock")
    first, second = (no, yes) if negatives_first else (yes, no)
    return let(F.lower(col(c)), lambda low: F.when(has(low, first[0]), first[1]).when(has(low, second[0]), second[1]).otherwise("unknown"))


def image_urls(c) -> Column:
    """Trimmed http(s) addresses of an array; those without a scheme get https. Null: []."""
    trimmed = F.transform(F.coalesce(col(c), F.array().cast("array<string>")), strip)
    kept = F.filter(trimmed, lambda u: u.startswith("http://") | u.startswith("https://") | u.startswith("//"))
    return F.transform(kept, lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u))


def feature_list(c) -> Column:
    """Comma-separated text as an array of trimmed, non-empty parts; missing: []."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), strip)
    return F.filter(parts, lambda p: p != "")


def price_pair(markdown) -> Column:
    """struct(current, original) from page text: the sold-count section's two prices, else the
    smaller and larger of the first two baht amounts (neither zero), else the only amount."""
    sold = rf"(?s)มีคนซื้อไปแล้ว.*?{BAHT_SIGN}(\d+(?:,\d+)*)(?U:\s)*/each(?U:\s)*{BAHT_SIGN}(\d+(?:,\d+)*)"
    amounts = lambda text: F.regexp_extract_all(text, F.lit(rf"(?U){BAHT_SIGN}\s*([0-9,]+)"), F.lit(1))
    read = lambda text: F.struct(extract_price(first_match(text, sold, 1)).alias("a"), extract_price(first_match(text, sold, 2)).alias("b"), amounts(text).alias("all"))
    both = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), F.size(m["all"]).alias("n"), extract_price(F.get(m["all"], F.lit(0))).alias("x"), extract_price(F.get(m["all"], F.lit(1))).alias("y"))

    def pick(m):
        a, x, y = m["a"], m["x"], m["y"]
        two = (m["n"] >= 2) & (x != 0) & (y != 0)
        current = F.when(a.isNotNull(), a).when(two, F.least(x, y)).when(m["n"] == 1, x)
        original = F.when(a.isNotNull(), m["b"]).when(two, F.greatest(x, y))
        return F.struct(current.alias("current"), original.alias("original"))

    return let(let(let(ascii_digits(col(markdown)), read), both), pick)


def discount(current, original) -> Column:
    """Percent off, in double; null unless both prices are non-zero and the original is higher."""
    c, o = col(current), col(original)
    return F.when((c != 0) & (o != 0) & (o > c), (o.cast("double") - c.cast("double")) / o.cast("double") * 100)
