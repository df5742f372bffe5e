"""Chat formatting: exact round trip, attachments, loss mask."""

from pyspark.sql import functions as F

from feedstack.llm import chat_format as C

TURNS = [(1, 0, "system", "be <|end|> [INST] \\ nice"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<\\<\\\\[[|\\"),
         (1, 2, "assistant", "<\\<\\\\[[|\\"), (2, None, None, None), (2, 3, "assistant", ""), (2, 1, "us<|text|>er", "\n\té漢😀"),
         (None, 0, "assistant", "no id"), (None, 0, "user", "no id either"), (3, 0, "assistant", "long " * 20000)]


def expected():
    out = {}
    for c, t, r, x in sorted(TURNS, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_round_trip_and_mask(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    done = C.format_conversations(df.withColumn("parts", C.text_parts("text")).repartition(4))
    done = done.withColumn("back", C.read_back(F.col("formatted"))).withColumn("loss", C.masked_text(F.col("formatted"), F.col("turns")))
    rows = {r.conv_id: r for r in done.collect()}
    want = expected()
    assert set(rows) == set(want)
    for c, r in rows.items():
        assert [tuple(x) for x in r.back] == want[c]
        assert r.loss == "".join(t for role, t in want[c] if role == "assistant")
        assert r.attachments == [] and r.placeholder_tokens == 0
        for m, (role, text) in zip(r.turns, want[c], strict=True):
            body = r.formatted[m.body_start:m.body_end]
            assert m.role == role and m.loss == (role == "assistant")
            assert r.formatted[m.start:m.end] == f"<|turn|>{r.formatted[m.start + 8:m.body_start]}{body}<|end|>"
            assert body == "".join(ch + "\\" if ch in "\\<[" else ch for ch in text)


def test_typed_parts(spark):
    text = ('[{"type":"text","text":"look <|image|>"},{"type":"image","ref":"a.png","width":56,"height":29},'
            '{"type":"audio","ref":"b.wav","seconds":1.5},{"type":"document","ref":"c.pdf","pages":3},{"type":"video","ref":"d"}]')
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "[not json"), (1, 2, "user", None)],
                               "conv_id long, turn long, role string, text string")
    r = C.format_conversations(df.withColumn("parts", C.json_parts("text"))).first()
    assert r.formatted.startswith("<|turn|>user<|text|>look <\\|image|><|image|><|audio|><|document|><|other|><|end|>")
    assert [tuple(a) for a in r.attachments] == [
        (0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 768), (0, 4, "other", "d", 0)]
    assert r.placeholder_tokens == 810
    assert r.formatted[r.turns[1].body_start:r.turns[1].body_end] == "[\\not json"


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_conversations(df.withColumn("parts", C.text_parts("text"))).count() == 0
