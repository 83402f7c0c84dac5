from decimal import Decimal

import pytest

from tamarack.functions import text as t
from tamarack.functions import urls as u


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x")).first()[0]


@pytest.mark.parametrize(
    "text, price",
    [("฿2,490", "2490"), ("1,234.567", "1234.56"), ("-50", "50"), ("1 299 บาท", "1299"), ("100บาท200", "100200"), ("100-200", "100"), ("", None), (None, None), ("0", "0"), ("free", None), ("๑๒๓", "123"), ("1 299", "1299")],
)
def test_price(spark, text, price):
    assert one(spark, t.extract_price, text) == (None if price is None else Decimal(price))


@pytest.mark.parametrize("text, sku", [("SKU: ab-12", "AB-12"), ("SKU-12345", "12345"), ("barcode scanner", "SCANNER"), ("item 1000012345 x", "1000012345"), ("ABC-1234", "ABC-1234"), ("none here", None), (None, None)])
def test_sku(spark, text, sku):
    assert one(spark, t.extract_sku, text) == sku


@pytest.mark.parametrize(
    "text, plain, corrected",
    [("In Stock", "in_stock", "in_stock"), ("Out of stock", "out_of_stock", "out_of_stock"), ("Unavailable", "in_stock", "out_of_stock"), ("ไม่มีสินค้า", "in_stock", "out_of_stock"), ("already sold out", "in_stock", "out_of_stock"), ("", "unknown", "unknown"), (None, "unknown", "unknown"), ("call us", "unknown", "unknown")],
)
def test_availability(spark, text, plain, corrected):
    assert one(spark, t.availability, text) == plain
    assert one(spark, lambda c: t.availability(c, True), text) == corrected


@pytest.mark.parametrize(
    "text, pair",
    [("มีคนซื้อไปแล้ว 5 ฿900 /each ฿1,200", ("900", "1200")), ("฿1,200 now ฿900", ("900", "1200")), ("฿500", ("500", None)), ("฿500 ฿500", ("500", "500")), ("฿0 ฿500", (None, None)), ("", (None, None))],
)
def test_price_pair(spark, text, pair):
    assert tuple(one(spark, t.price_pair, text)) == tuple(None if x is None else Decimal(x) for x in pair)


def test_lists_and_clean_text(spark):
    assert one(spark, t.feature_list, "a, b,,c ") == ["a", "b", "c"]
    assert one(spark, t.feature_list, None) == []
    assert one(spark, t.image_urls, ["//cdn/x.jpg", "ftp://x", "", " https://y ", None], "array<string>") == ["https://cdn/x.jpg", "https://y"]
    assert one(spark, t.image_urls, None, "array<string>") == []
    assert one(spark, t.clean_text, " a\n\t b c\x07 ") == "a b c"
    assert one(spark, t.clean_text, None) == ""


def test_urls(spark):
    html = """<a href="/p/12?a=1#z"> <a href='https://h/p/12#z'> <a href="p/12"> <a href="/x?page=10"> <a href="?page=2">"""
    row = spark.createDataFrame([(html, ["/p/9?x"])], "html string, links array<string>")
    assert row.select(u.page_products("html", "links", "https://b")).first()[0] == ["https://b/p/12", "https://h/p/12", "/p/9"]
    from pyspark.sql import functions as F

    assert row.select(u.pagination("html", F.lit("https://b/c"), "https://b")).first()[0] == ["https://b/c?page=2", "https://b/x?page=10"]
