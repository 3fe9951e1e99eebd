import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import conversion as c
from pagewright.operators.layout import LABELS
from pagewright.operators.pipeline import STAGES, Policy

RECT = {f"r_{a}{i}": v for i, (x, y) in enumerate([(0, 0), (600, 0), (600, 800), (0, 800)]) for a, v in (("x", float(x)), ("y", float(y)))} | {"coord_origin": "BOTTOMLEFT"}


def rect(l, b, r, t):  # noqa: E741
    return {f"r_{a}{i}": float(v) for i, (x, y) in enumerate([(l, b), (r, b), (r, t), (l, t)]) for a, v in (("x", x), ("y", y))} | {"coord_origin": "BOTTOMLEFT"}


def cell(index, text, *box):
    return {"index": index, "text": text, "orig": text, "rect": rect(*box), "confidence": 1.0}


def page(lines=(), words=(), angle=0.0, bitmap=None, **more):
    return json.dumps({"dimension": {"angle": angle, "rect": RECT}, "textline_cells": list(lines), "word_cells": list(words), "char_cells": [], "bitmap_resources": [{"index": 0, "uri": bitmap}] if bitmap else [], **more})


DOCS = "doc_index int, doc_key string, file_path string, annotations_json string, extract_meta_xml_error string"


@pytest.fixture(scope="module")
def batch(spark):
    docs = spark.createDataFrame([(0, "good", "/d/good.pdf", "{}", None), (1, "broken", "/d/broken.pdf", "{}", None), (2, "absent", "/d/absent.pdf", None, None), (3, "nameless", None, None, None), (4, "meta", "/d/meta.pdf", None, "ValueError: no XML")], DOCS)
    pages = spark.createDataFrame([("good", i, page([cell(0, f"p{i}", 0, 0, 5, 5)])) for i in (1, 2, 3)] + [("broken", 1, page()), ("broken", 2, "{"), ("broken", 3, page()), ("meta", 1, '{"original":null,"sanitized":{"cells":[]}}'), ("nameless", 1, page())], "doc_key string, page_no int, page_json string")
    return docs, pages


def run(batch, **request):
    extra = {k: request.pop(k) for k in ("ocr_providers", "detector") if k in request}
    out = c.convert_documents(*batch, c.Request(**request), **extra)
    return {r.doc_key: r for r in out.documents.collect()}, out


def test_stages_of_every_document(batch):
    got, out = run(batch, annotations=True, meta=True)
    assert {k: (r.status, r.failure_stage, r.page_count, r.attempted, r.succeeded) for k, r in got.items()} == {
        "good": ("succeeded", None, 3, 3, 3),
        "broken": ("failed", "decode_pages", 3, 2, 1),
        "absent": ("failed", "load_document", 0, 0, 0),
        "nameless": ("failed", None, 1, 1, 1),
        "meta": ("failed", "extract_meta_xml", 1, 1, 1),
    }
    status = {k: [s.status for s in r.stages] for k, r in got.items()}
    assert status["good"] == ["succeeded"] * 12 and [s.stage for s in got["good"].stages] == list(STAGES) and status["nameless"] == []
    assert status["broken"] == ["succeeded"] * 2 + ["failed"] + ["skipped"] * 8 + ["succeeded"] and got["broken"].stages[11].kind == "cleanup"
    assert {k: [(d.code, d.recoverable) for d in r.diagnostics] for k, r in got.items()} == {"good": [], "broken": [("stage_failed", False)], "absent": [("stage_failed", False)], "nameless": [("batch_document_unhandled_exception", False)], "meta": [("stage_failed", False)]}
    assert got["good"].annotations_json == "{}" and got["broken"].annotations_json is None and len({r.run_id for r in got.values()}) == 5
    assert sorted((r.doc_key, r.page_no) for r in out.pages.collect() if r.doc_key == "broken") == [("broken", 1)]


def test_page_errors_and_limits(batch):
    got, out = run(batch, continue_on_page_error=True, max_pages=2)
    assert (got["broken"].status, got["broken"].attempted, got["broken"].succeeded, got["broken"].page_count) == ("succeeded", 2, 1, 3)
    assert [(d.code, d.stage_name, d.page_number, d.recoverable, d.message) for d in got["broken"].diagnostics] == [("decode_page_failed", "decode_pages", 2, True, "invalid JSON")]
    assert [(r.doc_key, r.page_no, r.message) for r in out.page_errors.collect()] == [("broken", 2, "invalid JSON")] and got["good"].attempted == 2
    got, _ = run(batch, max_pages=1)
    assert got["broken"].status == "succeeded"
    for bad in ({"timeout": 0}, {"max_pages": 0}):
        with pytest.raises(ValueError):
            c.Request(**bad)


def test_transforms(batch):
    got, out = run(batch, transform=lambda p: p.where("doc_key <> 'good'"), continue_on_page_error=True)
    assert [d.code for d in got["good"].diagnostics] == ["transform_returned_empty"] and got["good"].status == "succeeded"
    got, _ = run(batch, transform=lambda p: None)
    assert (got["good"].status, got["good"].failure_stage) == ("failed", "transform_pages") and got["broken"].failure_stage == "decode_pages"


def reader(status="succeeded"):
    class Reader:  # within a function, so that workers get it by value
        name, priority, external, trusted = "reader", 1, False, True

        def available(self):
            return True

        def supports(self, language):
            return True

        def process(self, request):
            return status, (f"read {request['bitmaps'][0]}", 0.5)

    return Reader()


def test_ocr(spark):
    docs = spark.createDataFrame([(0, "scan", "/d/scan.pdf", None, None), (1, "text", "/d/text.pdf", None, None)], DOCS)
    pages = spark.createDataFrame([("scan", 1, page(bitmap="img/1.png")), ("scan", 2, page(bitmap="http://x/y.png")), ("text", 1, page(words=[cell(3, "w", 0, 0, 1, 1)], bitmap="a.png"))], "doc_key string, page_no int, page_json string")
    got, out = run((docs, pages), ocr=True, ocr_providers=[reader()])
    words = {(r.doc_key, r.page_no): r.page.word_cells for r in out.pages.collect()}
    w = words["scan", 1][0]
    assert (w.text, w.from_ocr, w.text_direction, w.font_key, w.confidence, w.rect.r_x2) == ("read /d/img/1.png", True, "unknown", "ocr", 0.5, 600.0)
    assert len(words["text", 1]) == 1 and not words["scan", 2] and got["scan"].ocr_provider == "reader" and [d.code for d in got["scan"].diagnostics] == ["ocr_provider_succeeded"]
    got, _ = run((docs, pages), ocr=True, ocr_providers=[reader("fatal")])
    assert (got["scan"].failure_stage, got["text"].status) == ("apply_ocr_fallback", "succeeded")
    got, _ = run((docs, pages), ocr=True, policy=Policy(required=True))
    assert got["text"].failure_stage == "apply_ocr_fallback" and [d.code for d in got["text"].diagnostics] == ["ocr_provider_unavailable", "stage_failed"]


@pytest.mark.parametrize("uri,path", [("file:///a/b%20c.png", "/a/b c.png"), ("/x.png", "/x.png"), ("C:\\x.png", "C:\\x.png"), ("img/x.png", "/d/img/x.png"), ("https://h/x.png", None), (" ", None), (None, None)])
def test_bitmap_paths(spark, uri, path):
    df = spark.createDataFrame([(uri, "/d/doc.pdf")], "u string, p string")
    assert df.select(c.resolved_bitmap(F.col("u"), F.col("p"))).first()[0] == path


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, page_no int, pos int, label_id int, score double, l double, t double, r double, b double")


def test_detections_become_clusters(spark):
    d = boxes(spark, [("a", 1, 0, 9, 0.9, 10.0, 20.0, 30.0, 50.0), ("a", 1, 1, 9, 0.05, 0.0, 0.0, 1.0, 1.0), ("a", 1, 2, 99, 0.9, 0.0, 0.0, 1.0, 1.0), ("a", 1, 3, 0, 0.1, 0.0, 0.0, 5.0, 5.0)])
    pages = spark.createDataFrame([("a", 1, 100.0)], "doc_key string, page_no int, page_height double")
    got = [(r.id, r.label, r.l, r.b, r.r, r.t) for r in c.clusters_of(d, pages).orderBy("id").collect()]
    assert got == [(1, "text", 10.0, 50.0, 30.0, 80.0), (2, "caption", 0.0, 95.0, 5.0, 100.0)]


@pytest.mark.parametrize("compat", [False, True])
def test_layout_orders_lines(spark, compat):
    """Two columns: the clusters give column after column; with the compatible look-up only pages of a number that is an angle have them."""
    docs = spark.createDataFrame([(0, "a", "/a.pdf", None, None)], DOCS)
    lines = [cell(i, n, *b) for i, (n, b) in enumerate([("R1", (320, 700, 580, 720)), ("L1", (20, 700, 280, 720)), ("R2", (320, 670, 580, 690)), ("L2", (20, 670, 280, 690))])]
    pages = spark.createDataFrame([("a", 1, page(lines)), ("a", 2, page(lines[:2], angle=2.0))], "doc_key string, page_no int, page_json string")
    text = float(LABELS.index("text"))
    detector = lambda p: boxes(spark, [("a", 1, 0, int(text), 0.9, 320.0, 80.0, 580.0, 130.0), ("a", 1, 1, int(text), 0.9, 20.0, 80.0, 280.0, 130.0)])
    got, out = run((docs, pages), layout=True, compat=compat, detector=detector)
    assert got["a"].layout_applied
    texts = {r.page_no: [x.text for x in r.page.textline_cells] for r in out.pages.collect()}
    assert texts[1] == (["L1", "L2", "R1", "R2"]) and set(texts[2]) == {"L1", "R1"}


def test_clusters_by_angle(spark):
    pages = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.7), ("a", 3, 90.0), ("a", 4, 0.0)], "doc_key string, page_no int, angle double")
    clusters = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3)], "doc_key string, page_no int, id int")
    assert sorted((r.page_no, r.id) for r in c.clusters_by_angle(clusters, pages).collect()) == [(1, 2), (2, 2), (3, 3), (4, 2)]


def test_batches_stop(batch):
    _, out = run(batch)
    results = out.documents.withColumn("batch_run_id", F.lit("b"))
    assert c.batch_documents(results).where("status = 'skipped'").count() == 0
    got = {r.doc_key: r for r in c.batch_documents(results, continue_on_failure=False).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "succeeded", "broken": "failed", "absent": "skipped", "nameless": "skipped", "meta": "skipped"}
    assert [d.code for d in got["absent"].diagnostics] == ["batch_document_skipped"] and got["meta"].page_count == 0 and got["absent"].stages is None


def test_backend_runs(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("b", 1, None, "ValueError: bad")], "doc_key string, page_no int, page string, error string")
    got = {r.doc_key: r for r in c.backend_runs(df).collect()}
    assert (got["a"].status, got["a"].pages, got["a"].stages) == ("succeeded", 2, [])
    assert got["b"].stages[0].stage == "backend_convert" and [(d.code, d.error_type) for d in got["b"].diagnostics] == [("backend_failure", "ValueError")]


def test_empty_batch(spark, batch):
    docs, pages = batch
    out = c.convert_documents(docs.limit(0), pages.limit(0), c.Request(continue_on_page_error=True))
    assert out.documents.count() == out.pages.count() == out.page_errors.count() == 0
