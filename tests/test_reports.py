import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions.tensor import MEAN, image_tensor
from pagewright.sinks import export
from pagewright.sources.audio import AUDIO_STAGES, hydrate, segments_of, transcribe
from pagewright.sources.convert import read_segmented
from pagewright.sources.layout import page_json

CELL = "array<struct<text:string,rgba:struct<r:int,g:int,b:int,a:int>>>"


@pytest.fixture(scope="module")
def pages(spark):
    c = lambda *t: [(x, (1, 2, 3, 4)) for x in t]
    rows = [("a", 2, c("x", "y"), None, c("two ", None)), ("a", 1, [("z", None)], c("w"), c("one")), ("b", 1, None, None, None)]
    return spark.createDataFrame(rows, f"doc_key string, page_no int, char_cells {CELL}, word_cells {CELL}, textline_cells {CELL}")


def test_extraction_report(pages):
    got = {r.doc_key: r for r in export.extraction_report(pages).collect()}
    assert got["a"].content == "--- Page 1 ---\none\n\n--- Page 2 ---\ntwo\n\n" and got["b"].content == "--- Page 1 ---\n\n"
    assert [(p.page, p.chars, p.words, p.lines) for p in got["a"].pages] == [(1, 1, 1, 1), (2, 2, 0, 2)]
    assert got["a"].colors == {"rgba(1,2,3,4)": 2} and got["b"].colors == {}
    assert {(r.doc_key, r.page_no): r.texts for r in export.text_dump(pages, ["doc_key", "page_no"]).collect()} == {("a", 1): ["one"], ("a", 2): ["two "], ("b", 1): None}


def test_comparison(pages):
    counts = export.page_counts(pages)
    report = export.comparison_report(counts, counts.where("doc_key = 'a'").withColumn("words", F.lit(1)), ["doc_key", "page_no"])
    assert {(r.doc_key, r.page_no): r.equal for r in report.collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): True}
    t = export.comparison_totals(report).first()
    assert (t.pages, t.mismatches, t.left_words, t.right_words) == (3, 1, 1, 2)


def test_rounding_is_that_of_the_binary_value(spark):
    df = spark.createDataFrame([(1, '{"a":[2.0005,{"b":0.0015}],"n":3,"s":"1.23456"}'), (2, "no"), (3, None)], "id int, page_json string")
    got = {r.id: r.rounded for r in export.round_json(df).collect()}
    assert json.loads(got[1]) == {"a": [round(2.0005, 3), {"b": round(0.0015, 3)}], "n": 3, "s": "1.23456"} and got[2] is None and got[3] is None
    assert export.round_json(df.limit(0)).count() == 0


def test_unknown_members_come_back(spark):
    raw = '{"dimension":{"angle":1.5,"odd":"keep"},"textline_cells":[{"text":"t","more":[1]}],"top":{"x":1},"char_cells":{"text":"lone"}}'
    df = spark.createDataFrame([(1, raw), (2, None)], "id int, page_json string")
    own = read_segmented(df).withColumn("w", page_json(F.col("page")))
    assert own.where("id = 1").first().page.char_cells[0].text == "lone"
    out = json.loads(export.with_unknown_members(own.select("id", "page_json", "w"), "page_json", "w").where("id = 1").first().json)
    assert out["top"] == {"x": 1} and out["dimension"]["odd"] == "keep" and out["textline_cells"][0]["more"] == [1] and out["has_words"] is None


def test_envelopes(spark):
    rows = [(1, '{"original":{"cells":{"text":"a"}},"page_number":1}'), (2, '{"original":null,"sanitized":{"images":[{"index":1}],"cells":[]}}'), (3, '{"original":null}'), (4, '{"original":{},"shapes":[]}'), (5, "[1]")]
    got = {r.id: r.page for r in read_segmented(spark.createDataFrame(rows, "id int, page_json string")).collect()}
    assert got[1].char_cells[0].text == "a" and got[1].has_chars and len(got[2].bitmap_resources) == 1 and not got[2].has_chars and got[3] is None and got[4].shapes == []


def test_data_uri(spark):
    assert spark.range(1).select(export.data_uri(F.lit("image/png"), F.lit(bytearray(range(256))))).first()[0].startswith("data:image/png;base64,AAEC") and "\n" not in spark.range(1).select(export.data_uri(F.lit("image/png"), F.lit(bytearray(range(256))))).first()[0]


def test_tensor():
    t = image_tensor(np.full((10, 20, 3), 255, np.uint8))
    assert t.shape == (1, 3, 640, 640) and t.dtype == np.float32 and np.allclose(t[0, 0], (1 - MEAN[0]) / 0.229)
    ramp = image_tensor(np.repeat(np.arange(4, dtype=np.uint8)[None, :, None] * 80, 3, 2), 8)[0, 0, 0]
    assert np.all(np.diff(ramp) >= 0)


def engine(there=True, fails=False):
    class Engine:
        name = "engine"

        def available(self):
            return there

        def transcribe(self, content, check):
            check()
            if fails:
                raise RuntimeError("no speech")
            return [(0.0, 1.0, content.decode(), None), (1.0, 2.5, "end", "v")], "en"

    return Engine()


def test_transcription(spark):
    audio = spark.createDataFrame([("a", "/x/a.wav", bytearray(b"hi")), ("gone", "/x/b.wav", None), ("unc", "\\\\host\\c.wav", bytearray(b"x")), ("none", " ", bytearray(b"x"))], "audio_key string, path string, content binary")
    run = lambda *x, **k: {r.audio_key: r for r in transcribe(audio, *x, **k).collect()}
    got = run(engine(), lambda b: b.upper())
    assert [(s.start_time, s.text, s.voice) for s in got["a"].segments] == [(0.0, "HI", None), (1.0, "end", "v")] and [s.stage for s in got["a"].stages] == list(AUDIO_STAGES)
    assert {k: (r.status, r.failure_stage, r.diagnostics[0].code) for k, r in got.items()} == {"a": ("succeeded", None, "asr_transcription_success"), **{k: ("failed", "load_audio", "stage_failed") for k in ("gone", "unc", "none")}}
    assert got["gone"].stages[4].status == "succeeded"
    assert run(None)["a"].diagnostics[0].code == run(engine(there=False))["a"].diagnostics[0].code == "asr_provider_missing"
    assert run(engine(fails=True))["a"].diagnostics[0].code == "asr_transcription_failed"
    slow = run(engine(), timeout=1e-9)["a"]
    assert (slow.status, slow.diagnostics[0].code) == ("timedout", "timeout")
    page = hydrate(segments_of(transcribe(audio.where("audio_key = 'a'"), engine()))).first()
    assert [c.source.voice for c in page.cells] == [None, "v"]
