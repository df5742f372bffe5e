from pyspark.sql import functions as F

from feedstack.functions import hashing as H
from feedstack.functions.dates import parse_review_date
from feedstack.functions.rows import sentiment, supports_language
from feedstack.functions.text import java_trim, sanitize_text


def test_java_string_hash(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,), ("Ünïcode ✓",)], "s string")
    got = [r[0] for r in df.select(H.java_string_hash("s")).collect()]
    # String.hashCode values
    assert got[:3] == ["99162322", "0", None]
    expected = 0
    for ch in "Ünïcode ✓":
        expected = (expected * 31 + ord(ch)) & 0xFFFFFFFF
    expected = expected - (1 << 32) if expected >= (1 << 31) else expected
    assert got[3] == str(expected)


def test_hashes(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    r = df.select(H.sha256_hex("s"), H.short_hash("s"), H.valid_hash(H.md5_hex("s"), 32),
                  H.verify_hash("s", H.sha1_hex("s"), F.lit("sha-1")), H.combined_hash("s", F.lit(None))).collect()[0]
    assert r[0] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert r[1] == r[0][:16] and r[2] and r[3]


def test_dates_keep_wall_clock(spark):
    df = spark.createDataFrame([("2025-04-10T05:37:00+07:00",), ("2025-04-10 05:37:00",), ("2025-04-10",),
                                ("2025-04-10T05:37:00+07:00[Asia/Bangkok]",), ("2024-02-30",)], "d string")
    v = [str(r[0]) for r in df.select(parse_review_date("d", validator=True)).collect()]
    assert v == ["2025-04-10 05:37:00", "2025-04-10 05:37:00", "2025-04-10 00:00:00", "None", "None"]
    t = [str(r[0]) for r in df.select(parse_review_date("d", validator=False)).collect()]
    assert t[3] == "2025-04-10 05:37:00"


def test_text_and_rows(spark):
    df = spark.createDataFrame([("  a \t b  ", 7.0, "en, FR", "fr")], "s string, r double, l string, c string")
    r = df.select(java_trim("s"), sanitize_text("s"), sentiment("r"), supports_language("l", "c")).collect()[0]
    assert r[0] == "a \t b" and r[1] == "a b" and r[2] == "positive" and r[3] is True
