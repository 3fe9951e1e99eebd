import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions.text import document_key, html_encode, number_text, round_half_away, sequence_hash, slug, trim, uri_part, utf16_length
from pagewright.operators import pipeline, spatial
from pagewright.operators.layout import Page
from pagewright.operators.nested import node_tables, page_nodes, read_json
from pagewright.operators.reading_order import order_of
from pagewright.operators.spatial import components, grid_join, interval_join, overlap_join


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "\u00a0 a\u2003b \u3000", "string", trim) == "a\u2003b"
    assert one(spark, "a😀", "string", utf16_length) == 3
    assert [one(spark, v, "double", number_text) for v in (1.0, 0.5, -2.25, 0.0, None)] == ["1", "0.5", "-2.25", "0", None]
    assert [one(spark, v, "double", lambda c: round_half_away(c, 0)) for v in (0.5, -0.5, 2.5)] == [1.0, -1.0, 3.0]
    assert one(spark, "<é&'\">", "string", html_encode) == "&lt;&#233;&amp;&#39;&quot;&gt;"
    assert one(spark, "x/B File.pdf", "string", lambda c: slug(F.lit(0), c)) == "0000-b_file"
    assert one(spark, "a-file.pdf", "string", lambda c: slug(F.lit(1), c)) == "0001-a_file"
    assert one(spark, "--.pdf", "string", lambda c: slug(F.lit(2), c)) == "0002-document"
    assert one(spark, "a b.c.pdf", "string", lambda c: document_key(c, F.lit("run_1"))) == "a_b_c_run_1"
    assert [one(spark, v, "string", lambda c: uri_part(c, "HOST")) for v in ("HTTPS://Ex.org/a", "", None, "no uri")] == ["ex.org", "_empty_", "_missing_", "_invalid_uri_"]
    import hashlib

    assert one(spark, ["a", None], "array<string>", sequence_hash) == hashlib.sha256(b"a\x1f\x1f").hexdigest().upper()


def test_geometry(spark):
    def boxes(a, b, f):
        return spark.createDataFrame([(a, b)], "a struct<l:double,b:double,r:double,t:double>, b struct<l:double,b:double,r:double,t:double>").select(f(F.col("a"), F.col("b")).alias("r")).first()["r"]

    a = (0.0, 0.0, 2.0, 2.0)
    assert boxes(a, (1.0, 1.0, 3.0, 3.0), g.iou) == pytest.approx(1 / 7)
    assert boxes(a, (2.0, 0.0, 3.0, 2.0), g.overlaps) is False and boxes(a, (2.0, 0.0, 3.0, 2.0), g.left_of) is True
    assert boxes(a, (1.0, 1.0, 1.0, 1.0), g.iou) == 0.0 and boxes((1.0, 1.0, 1.0, 1.0), a, g.over_self) == 0.0
    assert tuple(boxes(a, (5.0, 5.0, 6.0, 6.0), g.intersection)) == (0.0,) * 4
    assert boxes((0.0, 3.0, 1.0, 4.0), a, g.above) is True


def test_grid_and_interval_joins_are_whole(spark):
    r = np.random.default_rng(3)
    rows = lambda n: [(1, i, (float(x), float(y), float(x + w), float(y + h))) for i, (x, y, w, h) in enumerate(zip(*r.integers(0, 60, (2, n)), *r.integers(0, 25, (2, n))))]
    box = "struct<l:double,b:double,r:double,t:double>"
    a, b = spark.createDataFrame(rows(60), f"p int, i int, a {box}"), spark.createDataFrame(rows(60), f"p int, j int, b {box}")
    pairs = lambda df: sorted((x.i, x.j) for x in df.collect())
    assert pairs(grid_join(a, b, ["p"], 10.0)) == pairs(overlap_join(a, b, ["p"])) != []
    p = spark.createDataFrame([(1, float(i)) for i in range(0, 50, 3)], "k int, at double")
    i = spark.createDataFrame([(1, float(x), float(x + w)) for x, w in zip(r.integers(0, 50, 30), r.integers(-3, 20, 30))], "k int, lo double, hi double")
    got = sorted((x.at, x.lo, x.hi) for x in interval_join(p, i, ["k"], "at", "lo", "hi", 7.0).collect())
    assert got == sorted((x.at, y.lo, y.hi) for x in p.collect() for y in i.collect() if y.lo <= x.at <= y.hi)


def test_components(spark):
    box = lambda x: (x, 0.0, x + 2, 1.0)
    rows = [(1, 5, box(0.0)), (1, 3, box(1.5)), (1, 9, box(3.0)), (1, 4, box(10.0)), (2, 1, box(0.0))]
    got = components(spark.createDataFrame(rows, "p int, id int, a struct<l:double,b:double,r:double,t:double>"), ["p"], "id").collect()
    assert {(r.p, r.id): r.component for r in got} == {(1, 5): 3, (1, 3): 3, (1, 9): 3, (1, 4): 4, (2, 1): 1}


def page(clusters, cells=(), size=1e6, **options):
    ids, labels, boxes, sure = zip(*clusters) if clusters else ((), (), (), ())
    index = [c[0] for c in cells]
    return Page(list(ids), list(labels), np.array(boxes, float).reshape(-1, 4), np.array(sure, float), np.array([c[2] for c in cells], float).reshape(-1, 4), np.array(index, dtype="int64"), [c[1] for c in cells], np.array([1.0] * len(cells)), size, **options)


def final(p):
    return [(p.ids[f], p.labels[f], [int(p.index[m]) for m in p.members[f]], [p.ids[c] for c in p.children.get(f, [])]) for f in p.run()]


def test_layout_cells_orphans_and_labels():
    p = page([(1, "title", (0, 0, 10, 10), 0.9), (2, "text", (50, 50, 60, 60), 0.4)], [(4, "a", (1, 1, 9, 9)), (2, "b", (20, 20, 30, 30)), (3, " ", (1, 1, 2, 2))])
    assert final(p) == [(3, "text", [2], []), (1, "section_header", [4], [])]


def test_layout_merges_overlaps_and_prefers():
    both = [(0, "x", (0, 0, 10, 10)), (1, "y", (0, 0, 10, 10))]
    p = page([(1, "text", (0, 0, 10, 10), 0.6), (2, "list_item", (0, 0, 10, 10), 0.6)], both)
    assert [x[0] for x in final(p)] == [1]  # the first takes all cells, the other is empty and goes
    p = page([(1, "text", (0, 0, 10, 10), 0.6), (2, "list_item", (0, 0, 10, 10.5), 0.55)], both, assign=False)
    assert [x[:2] for x in final(p)] == [(2, "list_item")]
    p = page([(1, "text", (0, 0, 10, 10), 0.6), (2, "text", (0, 0, 10, 10), 0.9)], both, assign=False)
    assert [x[0] for x in final(p)] == [2]


def test_layout_wrappers_and_pictures():
    p = page([(1, "text", (1, 1, 9, 9), 0.9), (2, "form", (0, 0, 20, 20), 0.9), (3, "picture", (0, 0, 100, 100), 0.9)], [(0, "x", (1, 1, 9, 9))], size=10000)
    assert final(p) == [(2, "form", [0], [1])] and p.box[1].tolist() == [1, 1, 9, 9]


def test_reading_order_columns():
    left, right = [(0, 80, 40, 90), (0, 60, 40, 70)], [(60, 80, 100, 90), (60, 60, 100, 70)]
    assert order_of(np.array([right[1], left[1], right[0], left[0]], float), 100) == [3, 1, 2, 0]
    assert order_of(np.array([(0, 0, 100, 10), (0, 50, 40, 60), (60, 50, 100, 60), (0, 90, 100, 100)], float), 100) == [3, 1, 2, 0]
    assert order_of(np.zeros((0, 4)), 100) == []


def stage(name, f=None, cleanup=False):
    return pipeline.Stage(name, f or (lambda c: None), cleanup)


def fail(_):
    raise ValueError("no")


def test_stages():
    ran = []
    run = pipeline.run_stages([stage("a"), stage("b", fail), stage("c"), stage("d", lambda c: ran.append(1), True)], {})
    assert run.status == "failed" and run.failure_stage == "b" and [r["status"] for r in run.results] == ["succeeded", "failed", "skipped", "succeeded"] and ran
    ticks = iter(range(0, 1000, 3))
    run = pipeline.run_stages([stage("a"), stage("b"), stage("u", fail, True)], {}, timeout=5, clock=lambda: next(ticks))
    assert run.status == "timedout" and run.results[-1]["status"] == "failed"
    with pytest.raises(ValueError):
        pipeline.run_stages([], {}, timeout=0)


def test_convert_each(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")

    def stages():
        def up(c):
            c["upper"] = c["text"].upper()

        return [pipeline.Stage("up", up), pipeline.Stage("unload", lambda c: None, True)]

    runs = pipeline.convert_each(df, stages, "upper string")
    got = {r.id: r for r in runs.collect()}
    assert got[1].upper == "A" and got[1].status == "succeeded" and got[2].status == "failed" and got[2].stages[1].status == "succeeded"
    d = pipeline.stage_diagnostics(runs, ["id"]).collect()
    assert [(x.id, x.code, x.recoverable) for x in d] == [(2, "stage_failed", False)]


class Fake:
    def __init__(self, name, priority=100, external=False, trusted=True, there=True, speaks=True, status="succeeded"):
        self.name, self.priority, self.external, self.trusted, self.there, self.speaks, self.status = name, priority, external, trusted, there, speaks, status

    def available(self):
        return self.there

    def supports(self, language):
        return self.speaks

    def process(self, request):
        if self.status == "raise":
            raise RuntimeError("x")
        return self.status, self.name


def test_providers():
    chain = pipeline.provider_chain([Fake("B", 5)], [Fake("b", 1), Fake("a", 9), Fake("c", 9)], ("C",))
    assert [p.name for p in chain] == ["c", "B", "a"]
    fakes = [Fake("n"), Fake("e", external=True), Fake("u", trusted=False), Fake("s", speaks=False), Fake("x", there=False), Fake("r", status="recoverable"), Fake("ok")]
    result, name, notes = pipeline.run_ocr(fakes, pipeline.Policy(allowed=("e", "u", "s", "x", "r", "ok")), {})
    assert (result, name) == ("ok", "ok") and [c for c, _ in notes] == ["ocr_provider_not_allowed", "ocr_provider_external_blocked", "ocr_provider_untrusted", "ocr_provider_capability_mismatch", "ocr_provider_unavailable", "ocr_provider_recoverable_failure", "ocr_provider_succeeded"]
    assert pipeline.run_ocr([Fake("r", status="recoverable")], pipeline.Policy(), {})[2][-1][0] == "ocr_provider_exhausted"
    with pytest.raises(RuntimeError):
        pipeline.run_ocr([], pipeline.Policy(required=True), {})
    assert pipeline.run_layout([Fake("a", status="raise"), Fake("b", status="no_changes"), Fake("c")], {})[1:] == ("c", [("layout_provider_exception", "a")])


def test_batches(spark, tmp_path):
    runs = spark.createDataFrame([("r0", "b", 0, "B File.pdf", "failed", 1, 1, 0), ("r1", "b", 1, "a-file.pdf", "succeeded", 2, 2, 2)], "run_id string, batch_run_id string, doc_index int, file_path string, status string, page_count int, attempted int, succeeded int")
    d = spark.createDataFrame([("r0", "stage_failed", "decode", None, "E", "m", False), ("r1", "batch_document_skipped", None, None, "E", "m", True)], "run_id string, code string, stage_name string, page_number int, error_type string, message string, recoverable boolean")
    runs = pipeline.stop_on_failure(runs, "batch_run_id", "doc_index")
    s = pipeline.batch_summary(runs, d).first()
    assert (s.documents, s.succeeded_documents, s.failed_documents, s.skipped_documents, s.pages, s.attempted_pages, s.succeeded_pages, s.diagnostics, s.recoverable_diagnostics) == (2, 0, 1, 1, 1, 1, 0, 2, 1)
    pages = spark.createDataFrame([("r0", 1, "{}"), ("r1", 1, "{}")], "run_id string, page_no int, page_json string")
    files = pipeline.artifact_bundle(runs, d, slug("doc_index", "file_path"), pages)
    names = sorted(r.relative_path for r in files.collect())
    assert names == [f"{x}/{n}.json" for x in ("0000-b_file", "0001-a_file") for n in ("diagnostics", "pages.segmented", "summary")] + ["manifest.json"]
    out = tmp_path / "out"
    out.mkdir()
    (out / "stale").write_text("x")
    pipeline.write_bundle(files, str(out))
    assert not (out / "stale").exists() and (out / "0000-b_file" / "summary.json").exists()
    with pytest.raises(ValueError):
        pipeline.write_bundle(files.withColumn("relative_path", F.lit("../x")), str(out))
    maps = pipeline.count_maps(runs.withColumn("pipeline_status", F.lit(" ")), d).first()
    assert (maps.status_counts, maps.pipeline_status_counts, maps.code_counts, maps.stage_counts) == ({"failed": 1, "skipped": 1}, {}, {"stage_failed": 1, "batch_document_skipped": 1}, {"decode": 1})


def test_nodes(spark):
    text = '{"char_cells":{"index":1,"source":{"start_time":1}},"shapes":[null,{"points":[[1,2],[3,4]]},7],"x":{"char_cells":[1]},"bitmap_resources":[{"image":null}]}'
    rows = page_nodes(text)
    assert sorted(r[:3] for r in rows) == [("bitmap_resources", 0, -1), ("char_cells", 0, -1), ("char_cells.source", 0, -1), ("shapes", 1, -1), ("shapes", 2, -1), ("shapes.points", 1, 0), ("shapes.points", 1, 1)]
    by = {r[:3]: r for r in rows}
    outer, inner = by["shapes", 1, -1], by["shapes.points", 1, 1]
    assert outer[3] < inner[3] and inner[4] < outer[4] and inner[6] == outer[3]
    assert [read_json(x) for x in ("{", "", None, "NaN", '{"a":1} x')] == [None] * 5
    assert page_nodes('{"original":null,"sanitized":{"cells":[{}],"images":{}}}')[0][0] == "char_cells"
    assert page_nodes("[1]") == [] and page_nodes('{"original":null}') == []
    assert [r[:2] for r in page_nodes(text, paths=frozenset(["shapes.points"]))] == [("shapes.points", 1)] * 2
    more = page_nodes('{"bitmap_resources":[null,{"image":{"size":{"width":1}},"rect":{"r_x0":1}}],"word_cells":[{"rgba":{"r":1},"rect":{}}],"shapes":[{"dash_array":[1,2],"rgb_filling":{"r":2}}],"widgets":[{"rect":{}}]}')
    assert sorted(r[:3] for r in more if "." in r[0]) == [("bitmap_resources.image", 1, -1), ("bitmap_resources.image.size", 1, -1), ("bitmap_resources.rect", 1, -1), ("shapes.dash_array", 0, 0), ("shapes.dash_array", 0, 1), ("shapes.rgb_filling", 0, -1), ("widgets.rect", 0, -1), ("word_cells.rect", 0, -1), ("word_cells.rgba", 0, -1)]
    deep = '{"shapes":[' + "[" * 50000 + "]" * 50000 + "]}"
    assert [r[:2] for r in page_nodes(deep, values=False)] == [("shapes", 0)]
    df = spark.createDataFrame([(1, text, 5), (None, text, 5), (2, None, 5), (3, "no", 5)], "record_id long, page_json string, path int")
    assert node_tables(df).count() == 14 and node_tables(df.limit(0)).count() == 0


def test_relation_against_every_triple():
    from pagewright.operators.reading_order import _relation

    def plain(box):
        n = len(box)
        up, down = [[] for _ in range(n)], [[] for _ in range(n)]
        side = lambda a, c: a[0] < c[2] and c[0] < a[2]
        for j in range(n):
            for i in range(n):
                a, c = box[i], box[j]
                if i == j or not side(a, c) or a[1] < c[3] or a[3] <= c[3]:
                    continue
                if not any((side(a, w) or side(c, w)) and a[1] >= w[3] and w[1] >= c[3] and w[1] < a[1] and w[3] > c[3] for k, w in enumerate(box) if k not in (i, j)):
                    up[j].append(i)
                    down[i].append(j)
        return up, down

    r = np.random.default_rng(1)
    for _ in range(200):
        low = r.integers(0, 20, (r.integers(1, 14), 2))
        box = np.hstack([low, low + np.stack([r.integers(0, 8, len(low)), r.integers(0, 4, len(low))], 1)]).astype(float)
        assert _relation(box) == plain(box)


def test_long_intervals_and_large_boxes_are_not_exploded(spark):
    """An interval of 1e12 and a box over the whole plane meet everything, in bounded rows."""
    points = spark.range(500).selectExpr("'k' AS k", "id", "CAST(id AS DOUBLE) AS at")
    intervals = spark.createDataFrame([("k", 1, 0.0, 1e12), ("k", 2, 10.0, 12.0), ("k", 3, 5.0, 3.0), ("k", 4, 100.0, 100.0 + 10 * 70), ("k", 5, None, 3.0)], "k string, i int, low double, high double")
    got = sorted((r.i, r.id) for r in spatial.interval_join(points, intervals, ["k"], "at", "low", "high", 1.0).collect())
    assert got == sorted([(1, x) for x in range(500)] + [(2, x) for x in (10, 11, 12)] + [(4, x) for x in range(100, 500)])
    box = "struct<l:double,b:double,r:double,t:double>"
    a = spark.createDataFrame([("p", i, (i * 10.0, 0.0, i * 10.0 + 12, 5.0)) for i in range(40)] + [("p", 99, (-1e12, -1e12, 1e12, 1e12))], f"p string, i int, a {box}")
    b = spark.createDataFrame([("p", i, (i * 10.0 + 5, 1.0, i * 10.0 + 9, 3.0)) for i in range(40)] + [("p", 99, (-1e9, 2.0, 1e9, 4.0))], f"p string, j int, b {box}")
    pairs = lambda df: sorted((r.i, r.j) for r in df.collect())
    assert pairs(spatial.grid_join(a, b, ["p"], 7.0)) == pairs(spatial.overlap_join(a, b, ["p"]))


def test_a_page_of_20000_elements():
    lines = np.array([[50.0 + 260 * c, 10.0 * i, 290.0 + 260 * c, 10.0 * i + 8] for c in (0, 1) for i in range(10_000, 0, -1)])
    assert order_of(lines, 600.0) == list(range(20_000))


def test_groups_over_batches_and_clashing_names(spark):
    from pagewright.operators.grouped import per_group

    df = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN 'hot' WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 500 AS STRING) END AS k", "id", "CAST(id AS DOUBLE) AS n")
    got = per_group(df, ["k"], ["id"], lambda g: ([len(g["id"])] * len(g["id"]), list(range(len(g["id"])))), "size int, at int")
    want = {r.k: r.n for r in df.groupBy("k").count().withColumnRenamed("count", "n").collect()}
    rows = got.collect()
    assert len(rows) == 30_000 and all(r.size == want[r.k] for r in rows) and sum(r.at == 0 for r in rows) == len(want)
    assert per_group(df.limit(0), ["k"], ["id"], lambda g: ([],), "x int").count() == 0


def test_typed_tables_and_containment(spark):
    from pagewright.operators.nested import typed, within

    text = '{"bitmap_resources":[{"index":"7","image":{"mimetype":"image/png","dpi":"72","size":{"width":3,"height":"x"}}},{"index":8,"image":[1]},5],"shapes":[{"points":[[1,2]]}]}'
    nodes = node_tables(spark.createDataFrame([(1, text), (2, text), (3, None)], "record_id long, page_json string"))
    bitmaps, images, sizes = (typed(nodes, k) for k in ("bitmap", "image", "size"))
    assert sorted((r.record_id, r.pos, r["index"]) for r in bitmaps.where("record_id = 1").collect() if r["index"]) == [(1, 0, 7), (1, 1, 8)]
    held = within(sizes, within(images, bitmaps, ["index"], "bitmap_"), ["bitmap_index", "mimetype", "dpi"], "image_").collect()
    assert sorted((r.record_id, r.image_bitmap_index, r.image_mimetype, r.image_dpi, r.width, r.height) for r in held) == [(i, 7, "image/png", 72, 3.0, None) for i in (1, 2)]
    assert within(typed(nodes, "rect"), bitmaps, ["index"]).count() == 0 and within(sizes, bitmaps.limit(0), ["index"]).count() == 0
