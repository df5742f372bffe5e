"""The SQL twins of op6 and op10 on rows with nulls, ties, short texts and copies."""

import os
import random

import duckdb

from feedstack.llm import queries as Q


def _same(spark, scratch, key, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(scratch, f"{table}.parquet"))
    got = Q.queries()[key](spark, scratch)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{scratch}/{table}.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.oracle_sql()[key].strip()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return want


def test_jaccard_join(spark, scratch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c")]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(i % 4):  # copies with one word more, other case or other blanks
            rows.append((len(rows), "  ".join([*text, "end"]).upper() if rng.random() < 0.5 else " ".join(["x", *text])))
    want = _same(spark, scratch, "op6_token_combinations", "documents", rows, "doc_id long, text string")
    assert len({r[2] for r in want}) < len(want)


def test_top_k_search(spark, scratch):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.0]) for _ in range(64)]) for i in range(0, 320)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (500, [float("nan")] * 64), (501, None), (None, rows[1][1]), (600, [1.0, 2.0])]
    rows.append(rows[7])
    want = _same(spark, scratch, "op10_multi_index", "embeddings", rows, "vec_id long, embedding array<float>")
    assert len(want) == 10 * len({r[0] for r in want})
