import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as fn


def one(spark, expression, **columns):
    names = ", ".join(f"{k} {'binary' if isinstance(v, (bytes, bytearray)) else 'string'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], names).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["  a ", " a　", "\x1ca\x1f\n", "a", " \t\n", "", " a b "])
def test_strip_is_pythons(spark, text):
    assert one(spark, fn.strip(F.col("t")), t=text) == text.strip()


@pytest.mark.parametrize(
    ("raw", "encoding", "text"),
    [
        (b"\xef\xbb\xbfHi", "utf-8-sig", "Hi"),
        (b"\xff\xfeH\x00i\x00", "utf-16-le", "﻿Hi"),
        (b"\xfe\xff\x00H\x00i", "utf-16-be", "﻿Hi"),
        ("안녕".encode(), None, "안녕"),
    ],
)
def test_decoding(spark, raw, encoding, text):
    assert one(spark, fn.byte_order_mark(F.col("b")), b=bytearray(raw)) == encoding
    assert one(spark, fn.decoded(F.col("b"), F.coalesce(fn.byte_order_mark(F.col("b")), F.lit("utf-8"))), b=bytearray(raw)) == text


def test_malformed_bytes_are_replaced(spark):
    assert "�" in one(spark, fn.decoded(F.col("b"), F.lit("utf-8")), b=bytearray(b"Hello \xff\xfe World"))


@pytest.mark.parametrize(("raw", "n"), [(b"Hello\xc3", 5), (b"Test\xea\xb0", 4), (b"Hi\xf0\x9f\x98", 2), (b"Hi", 2), ("가".encode(), 3), (b"", 0)])
def test_complete_bytes(spark, raw, n):
    assert one(spark, fn.complete_bytes(F.col("b")), b=bytearray(raw)) == n
