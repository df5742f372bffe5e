"""What staging a line costs: methods that the JIT compiles, even tasks, no needless walk over a text; and its exact texts."""

from pyspark.sql import functions as F

from feedstack.functions.jsonfields import variant_int
from feedstack.functions.text import java_trim, java_trim_long
from feedstack.operators import parse
from feedstack.operators.parse import parse_lines
from feedstack.plans import ingest as E
from feedstack.session import several_tasks_a_core
from feedstack.sources import testdata as TD
from tests.helpers import AS_OF, line, lines_df
from tests.test_review_base import tables  # noqa: F401

MERGED = "spark.sql.adaptive.coalescePartitions.minPartitionNum"


def test_every_generated_method_is_small_enough_for_the_jit(spark, tables, monkeypatch):  # noqa: F811
    plans = []
    monkeypatch.setattr(E, "staged", lambda df, name: plans.append(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        E.stage_lines(TD.review_lines(spark, tables), AS_OF)
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(
            plans[0]._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert len(sizes) > 4 and max(sizes) < 8000


def test_staging_deals_the_lines_over_several_tasks_a_core(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "staged", lambda df, name: seen.append(spark.conf.get(MERGED, None)))
    E.stage_lines(lines_df(spark, [line()]), AS_OF)
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(MERGED, None) is None
    spark.conf.set(MERGED, "3")
    try:
        with several_tasks_a_core(spark):
            assert spark.conf.get(MERGED) == "3"
        assert spark.conf.get(MERGED) == "3"
    finally:
        spark.conf.unset(MERGED)


def test_long_trim_equals_the_trim(spark):
    texts = [None, "", " ", "\t\x01", "a", " a", "a\x1f", "\x00 a b \n", "é", "　a　", "a\u0085", "\x7f", "中 \U0001f600"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", java_trim("t").alias("want"), java_trim_long("t").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_texts_and_kinds_of_odd_values(spark):
    texts = ["1", "-0", "1.50", "1e5", "0.0000001", "123456789012345678901234567890", "true", "null", '" y "', '"\\u00e9\\n\\"q"',
             '{"a":1.10}', "[1]"]
    lines = [f'{{"hotelId":{t},"platform":{t},"comment":{{"rating":{t},"reviewComments":{t},"reviewTitle":{t}}}}}' for t in texts]
    lines += ['{"comment":[1]}', '{"comment":{"reviewerInfo":7}}', "5"]
    got = [tuple(r) for r in parse_lines(lines_df(spark, lines)).orderBy("line_no").select(
        "hotel_id", "provider", "rating_kind", "rating_text", "comments_text", "title_text").collect()]
    big = texts[5]
    assert got == [
        (1, "1", "number", "1", "1", "1"), (0, "0", "number", "0", "0", "0"), (1, "1.5", "number", "1.5", "1.5", "1.5"),
        (100000, "100000.0", "number", "100000.0", "100000.0", "100000.0"),
        (0, "0.0000001", "number", "1.0E-7", "0.0000001", "0.0000001"), (0, big, "number", big, big, big),
        (1, "true", "boolean", "true", "true", "true"), (None, None, "null", None, None, None),
        (0, " y ", "string", " y ", " y ", " y "), (0, "é\n\"q", "string", "é\n\"q", "é\n\"q", "é\n\"q"),
        (0, "", "object", '{"a":1.1}', '{"a":1.1}', '{"a":1.1}'), (0, "", "array", "[1]", "[1]", "[1]"),
        *[(None,) * 6] * 3]


def test_rules_are_filtered_for_broken_rows_only(spark):
    rows = E.validate_reviews(parse_lines(lines_df(spark, [line(), line(hotel_id=0, platform="x")])), AS_OF).orderBy("line_no")
    assert [len(r.errors) for r in rows.collect()] == [0, 2]
    assert rows.select(F.col("errors")).schema["errors"].dataType.simpleString() == "array<string>"


NUMBERS = ["1", "-0", "8.0", "8.00", "1.50", "0.0", "-0.0", "1e5", "1E-7", "0.0000001", "10.10", "123456789012345678901234567890", "-5.0",
           "9223372036854775808.0", "9223372036854775807", "9223372036854775808", "99999999.0", "1.0e0", "100000000000000000000.5", "0.0001",
           "1e300", "1e-400", "123456789.123456789123", "3000000000", "-1.9"]


def test_numbers_are_taken_as_written_without_a_second_parse(spark, monkeypatch):
    seen = {}
    plain = parse._as_written
    monkeypatch.setattr(parse, "_as_written", lambda *a: seen.setdefault(a[0], plain(*a)))
    lines = [f'{{"comment":{{"rating":{t},"hotelReviewId":{t}}}}}' for t in NUMBERS]
    df = lines_df(spark, lines)
    want = [r.x for r in df.orderBy("line_no").select(F.from_json("line", "comment struct<rating:string>")["comment"]["rating"].alias("x")).collect()]
    got = parse_lines(df).orderBy("line_no").collect()
    assert [r.rating_text for r in got] == [r.hrid_text for r in got] == want
    node = df.select("line_no", F.try_variant_get(F.parse_json("line"), "$.comment.rating", "variant").alias("n")).withColumn("j", F.to_json("n"))
    told = node.withColumn("d", F.col("j").try_cast("double")).orderBy("line_no").select(plain("n", "j", "d").alias("x")).collect()
    assert set(seen) == {"_rating_node", "_hrid_node"}
    # only these are looked up in the line
    assert [t for t, r in zip(NUMBERS, told, strict=True) if r.x is None] == [
        "0.0", "-0.0", "123456789012345678901234567890", "9223372036854775808.0", "9223372036854775808"]


def test_integers_of_a_variant_equal_its_cast(spark):
    texts = [*NUMBERS, "true", "false", "null", '"5"', '" 7"', '"x"', '"-1"', '"1.5"', "[1]", '{"a":1}']
    rows = lines_df(spark, [f'{{"a":{t}}}' for t in texts] + ["{}"]).select(F.try_variant_get(F.parse_json("line"), "$.a", "variant").alias("n"))
    for r in rows.select(variant_int(F.col("n")).alias("got"), F.try_variant_get("n", "$", "int").alias("want")).collect():
        assert r.got == r.want


def test_the_interpreted_lambdas_only_read_messages(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = E.validate_reviews(parse_lines(lines_df(spark, [line()])), AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    at = plan.index("filter(array(")
    assert plan[at:].startswith("filter(array(_rule_hotel") and "AS _rule_hotel" in plan


def test_the_gate_before_the_store_names_its_messages(spark):
    lines = [line(reviewTitle="t" * 501), line(rating=None), line(hotel_id=0, rating=None, reviewTitle="t" * 501)]
    rows = E.stage_lines(lines_df(spark, lines), AS_OF).orderBy("line_no").select("stage", "line_errors").collect()
    assert [(r.stage, r.line_errors) for r in rows] == [
        ("failed", ["Processing failed - review_title exceeds 500 characters"]), ("failed", ["Processing failed - rating is required"]),
        ("invalid", ["Hotel ID must be positive"])]
