"""The pipeline's stages on planted rows; queries and their SQL."""

import random

import corpus_pipeline
from feedstack.llm import queries

ITEM = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree at night."


def tables(spark, folder):
    rnd = random.Random(8)
    vocab = {"en": "the of and to in that is was for with this from have are by".split(),
             "fr": "le la de et les des une dans pour que qui sur avec pas est".split()}
    rows = []
    for d in range(80):
        lang = "en" if d % 2 else "fr"
        rows.append((d, " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "", "s", "er"]) for _ in range(120)), lang, f"s{d % 3}", 9))
    copy = rows[5][1]
    rows += [(200, copy, "en", "s0", 9), (201, copy + " more", "en", "s1", 9), (5, copy, "en", "s2", 9), (202, None, "en", "s0", 0),
             (203, "", None, None, 0), (204, "12 34", "en", "s0", 5), (205, rows[7][1] + ". " + ITEM, "en", None, 9),
             (206, rows[9][1] + " mail me at joe@site.org", "en", "s0", 9), (None, rows[11][1][::-1], "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, scratch):
    docs = tables(spark, scratch)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, scratch)
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["language"] >= set(range(80)) | {200, 201, 205, 206} and not kept["language"] & {202, 203, 204}
    assert kept["language"] - kept["near_duplicates"] == {200, 201, 206, 205} - kept["near_duplicates"]
    assert {200, 201} & kept["near_duplicates"] == set() and 5 in kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["decontamination"] == {205} & kept["near_duplicates"]
    assert kept["personal_data"] == kept["decontamination"]
    assert {"size", "target", "copies", "taken", "copy"} <= set(docs.columns)


def test_run_and_redaction(spark, scratch):
    tables(spark, scratch)
    out = corpus_pipeline.run(spark, scratch).collect()
    assert out and not any("joe@site.org" in (r.text or "") for r in out)


def test_every_operator_has_a_query():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)


HELPERS = ("_id", "_tkey", "_row_key", "score", "lang_pred", "bits_per_byte", "_text", "_letter", "email", "ip", "card", "phone",
           "spans", "nid", "root", "n", "d1", "d2", "item_id", "words", "slots", "key", "size")


def test_columns_named_like_helpers_come_back_as_they_came(spark, scratch):
    from pyspark.sql import functions as F
    docs = tables(spark, scratch)
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in HELPERS])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, scratch)
        assert out.schema == docs.schema, name
        for r in out.filter("doc_id is not null").collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in HELPERS), (name, r)


def test_the_mix_is_the_same_for_other_partitionings(spark):
    from feedstack.llm import systematic_mix
    rows = [(7, f"word{i} and four more words", "s") for i in range(20)] + [(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = [sorted(map(tuple, systematic_mix.mix(docs.repartition(n, "text")).select("doc_id", "text", "copies").collect()))
            for n in (1, 13)]
    assert seen[0] == seen[1]
