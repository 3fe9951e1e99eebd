import copy
import json

import pytest
from pagewright.operators.parity import Options, compare, discover, gate, rollup
from pagewright.plans import pages

RECT = {f"r_{a}{i}": float(v) for a, vs in (("x", (0, 1, 1, 0)), ("y", (0, 0, 1, 1))) for i, v in enumerate(vs)} | {"coord_origin": "BOTTOMLEFT"}
RGBA = {"r": 0, "g": 0, "b": 0, "a": 255}


def cell(i, x, conf, font):
    r = {k: (v + x if k.startswith("r_x") else v) for k, v in RECT.items()}
    return {"index": i, "rgba": RGBA, "rect": r, "text": f"t{i}", "orig": f"t{i}", "text_direction": "left_to_right", "confidence": conf, "from_ocr": False, "rendering_mode": 0, "widget": False, "font_key": "k", "font_name": font}


BASE = {
    "dimension": {"angle": 0.0, "rect": RECT, "boundary_type": "crop_box"},
    "bitmap_resources": [{"index": 0, "rect": RECT, "uri": "u", "image": None, "mode": "placeholder"}],
    "char_cells": [],
    "word_cells": [],
    "textline_cells": [cell(0, 0, 0.7, "Body"), cell(1, 1, 0.6, "Mono")],
    "has_chars": False,
    "has_words": False,
    "has_lines": True,
    "widgets": [{"index": 0, "rect": RECT, "widget_text": "w", "widget_description": None, "widget_field_name": "n", "widget_field_type": "Tx"}],
    "hyperlinks": [{"index": 0, "rect": RECT, "uri": "https://Example.com/a"}],
    "lines": [],
    "shapes": [{"index": 0, "parent_id": 0, "points": [[0.0, 0.0], [1.0, 1.0]], "coord_origin": "BOTTOMLEFT", "has_graphics_state": True, "line_width": 1.0, "miter_limit": 4.0, "line_cap": 0, "line_join": 1, "dash_phase": 0.0, "dash_array": [3.0, 1.0], "flatness": 0.0, "rgb_stroking": RGBA, "rgb_filling": RGBA}],
}
LINE = lambda k, v: lambda p: p["textline_cells"][0].__setitem__(k, v)
CHANGES = {
    "same": (lambda p: None, set()),
    "key": (lambda p: p.pop("shapes"), {"missing_required_top_level_key", "missing_expected_top_level_key", "actual_array_missing"}),
    "flag": (lambda p: p.update(has_lines=False), {"boolean_mismatch"}),
    "text": (LINE("text", "zz"), {"text_hash_mismatch", "text_semantic_sequence_mismatch", "text_orig_equality_count_mismatch", "text_index_value_map_mismatch"}),
    "direction": (LINE("text_direction", "x"), {"text_direction_distribution_mismatch"}),
    "mode": (LINE("rendering_mode", 3), {"rendering_mode_distribution_mismatch"}),
    "widget": (LINE("widget", True), {"widget_flag_count_mismatch"}),
    "ocr": (LINE("from_ocr", True), {"ocr_from_ocr_count_mismatch"}),
    "font": (LINE("font_name", "FontC"), {"font_signature_mismatch", "font_name_distribution_mismatch"}),
    "confidence": (LINE("confidence", 0.5), {"confidence_mean_mismatch"}),
    "no confidence": (LINE("confidence", None), {"confidence_value_count_mismatch"}),
    "index": (LINE("index", 1), {"text_index_integrity_mismatch", "reading_order_index_mismatch"}),
    "swap": (lambda p: p["textline_cells"].reverse(), {"text_hash_mismatch", "reading_order_index_mismatch"}),
    "geometry": (lambda p: p["textline_cells"][0]["rect"].update(r_x1=7.0), {"geometry_signature_mismatch"}),
    "dimension": (lambda p: p["dimension"]["rect"].update(r_x0=9.0), {"dimension_rect_mismatch"}),
    "count": (lambda p: p["textline_cells"].pop(), {"array_count_mismatch"}),
    "bitmap": (lambda p: p["bitmap_resources"][0].update(mode="embedded"), {"bitmap_resource_signature_mismatch", "bitmap_mode_distribution_mismatch"}),
    "field": (lambda p: p["widgets"][0].update(widget_field_type="Btn"), {"widget_signature_mismatch", "widget_field_type_distribution_mismatch"}),
    "link": (lambda p: p["hyperlinks"][0].update(uri="http://other.org/a"), {"hyperlink_signature_mismatch", "hyperlink_scheme_distribution_mismatch", "hyperlink_host_distribution_mismatch"}),
    "shape": (lambda p: p["shapes"][0].update(line_width=2.0), {"shape_signature_mismatch", "shape_line_width_mean_mismatch"}),
    "state": (lambda p: p["shapes"][0].update(has_graphics_state=False), {"shape_graphics_state_count_mismatch"}),
    "extra": (lambda p: p.update(unknown=1), {"unexpected_top_level_key"}),
    "boundary": (lambda p: p["dimension"].update(boundary_type="media_box"), {"dimension_boundary_type_mismatch"}),
    "no dimension": (lambda p: p.pop("dimension"), {"actual_dimension_missing"}),
    "no flag": (lambda p: p.pop("has_lines"), {"actual_boolean_missing"}),
    "long": (LINE("text", "a longer text"), {"text_length_distribution_mismatch", "text_orig_length_delta_distribution_mismatch"}),
    "blank": (LINE("text", "\u2003 "), {"text_presence_count_mismatch"}),
    "no orig": (LINE("orig", None), {"orig_presence_count_mismatch"}),
    "font key": (LINE("font_key", "j"), {"font_key_distribution_mismatch"}),
    "colour": (LINE("rgba", RGBA | {"g": 9}), {"text_color_distribution_mismatch"}),
    "no index": (LINE("index", None), {"reading_order_index_count_mismatch"}),
    "image": (lambda p: p["bitmap_resources"][0].update(image={"mimetype": "image/png", "dpi": 72, "size": {"width": 1, "height": 1}}), {"bitmap_mimetype_distribution_mismatch", "bitmap_dpi_distribution_mismatch"}),
    "blank widget": (lambda p: p["widgets"][0].update(widget_text=""), {"widget_text_presence_count_mismatch"}),
    "points": (lambda p: p["shapes"][0]["points"].append([2.0, 2.0]), {"shape_point_count_distribution_mismatch"}),
    "cap": (lambda p: p["shapes"][0].update(line_cap=2), {"shape_line_cap_distribution_mismatch"}),
    "join": (lambda p: p["shapes"][0].update(line_join=2), {"shape_line_join_distribution_mismatch"}),
    "fill": (lambda p: p["shapes"][0].update(rgb_filling=RGBA | {"r": 1}), {"shape_fill_color_distribution_mismatch"}),
    "stroke": (lambda p: p["shapes"][0].update(rgb_stroking=RGBA | {"r": 1}), {"shape_stroke_color_distribution_mismatch"}),
}


@pytest.fixture(scope="module")
def diffs(spark):
    rows = []
    for name, (change, _) in CHANGES.items():
        p = copy.deepcopy(BASE)
        change(p)
        rows.append((name, 1, json.dumps(p)))
    expected = spark.createDataFrame([(n, 1, json.dumps(BASE)) for n in CHANGES], "doc_key string, page_no int, page_json string")
    actual = spark.createDataFrame(rows, "doc_key string, page_no int, page_json string")
    return compare(expected, actual, ["doc_key", "page_no"]).cache()


@pytest.mark.parametrize("name", CHANGES)
def test_change_gives_its_codes(diffs, name):
    codes = {r["code"] for r in diffs.where(diffs.doc_key == name).collect()}
    assert codes >= CHANGES[name][1] and (name != "same" or not codes)


def test_what_the_expected_page_lacks(spark):
    p = {k: v for k, v in BASE.items() if k not in ("dimension", "shapes", "has_lines")}
    df = lambda x: spark.createDataFrame([("a", 1, json.dumps(x))], "doc_key string, page_no int, page_json string")
    codes = {r["code"] for r in compare(df(p), df(BASE), ["doc_key", "page_no"]).collect()}
    assert codes >= {"missing_required_top_level_key_expected", "expected_array_missing", "expected_boolean_missing", "expected_dimension_missing", "unexpected_top_level_key"}


def test_pages_of_one_set_only(spark):
    df = lambda *n: spark.createDataFrame([("a", i, json.dumps(BASE)) for i in n], "doc_key string, page_no int, page_json string")
    got = compare(df(1, 2), df(2, 3), ["doc_key", "page_no"])
    assert sorted((r["page_no"], r["severity"], r["code"], r["message"]) for r in got.collect()) == [(1, "critical", "decode_or_compare_failed", "no actual page"), (3, "critical", "decode_or_compare_failed", "no expected page")]
    levels = {(r["doc_key"], r["page_no"], r["level"]): r["passed"] for r in rollup(got, df(1, 2, 3)).collect()}
    assert levels == {("a", 1, 0): False, ("a", 2, 0): True, ("a", 3, 0): False, ("a", None, 1): False, (None, None, 2): False}


def test_options_leave_out(spark):
    """Without any of the groups only the structure is compared; tolerances hold for means and sizes."""
    changes = ("text", "mode", "ocr", "geometry", "font", "no confidence", "index", "bitmap", "field", "link", "shape", "state", "flag")
    rows = []
    for name in (*changes, "confidence", "dimension"):
        p = copy.deepcopy(BASE)
        CHANGES[name][0](p)
        rows.append((name, 1, json.dumps(p)))
    schema = "doc_key string, page_no int, page_json string"
    expected, actual = spark.createDataFrame([(n, 1, json.dumps(BASE)) for n, _, _ in rows], schema), spark.createDataFrame(rows, schema)
    groups = ("text_hashes", "text_fields", "ocr", "geometry_signatures", "fonts", "confidence", "reading_order", "bitmaps", "widgets", "hyperlinks", "shapes", "context_fields")
    off = compare(expected, actual, ["doc_key", "page_no"], Options(**dict.fromkeys(groups, False))).collect()
    assert {r["code"] for r in off} == {"boolean_mismatch", "dimension_rect_mismatch"}
    wide = compare(expected, actual, ["doc_key", "page_no"], Options(tolerance=100.0, confidence_tolerance=1.0)).where("code in ('dimension_rect_mismatch', 'confidence_mean_mismatch') and doc_key in ('confidence', 'dimension')")
    assert wide.count() == 0


def test_rollup_and_gate(diffs):
    g = gate(diffs).first()
    top = [r for r in rollup(diffs).collect() if r["level"] == 2][0]
    assert not g["passed"] and (top["critical"], top["major"], top["minor"], top["ocr_drift"]) == (g["critical"], g["major"], g["minor"], 1)
    assert gate(diffs.where("doc_key = 'confidence'")).first()["passed"]


def test_severity_can_be_set(spark):
    p = copy.deepcopy(BASE)
    CHANGES["geometry"][0](p)
    df = lambda x: spark.createDataFrame([("a", 1, x)], "doc_key string, page_no int, page_json string")
    got = compare(df(json.dumps(BASE)), df(json.dumps(p)), ["doc_key", "page_no"], Options(geometry="major")).collect()
    assert {(r["severity"], r["code"]) for r in got} == {("major", "geometry_signature_mismatch")}
    bad = compare(df(json.dumps(BASE)), df("no json"), ["doc_key", "page_no"]).collect()
    assert sum(r["code"] == "missing_required_top_level_key" for r in bad) == 12
    assert compare(df(json.dumps(BASE)), df(None), ["doc_key", "page_no"]).count() > 12


def test_discover(spark):
    files = spark.createDataFrame([("x/b.pdf.page_no_2.py.json",), ("x/b.PDF.page_no_1.py.json",), ("x/a.pdf.page_no_10.py.json",), ("x/a.pdf.page_no_9.py.json",), ("x/note.txt",)], "path string")
    assert [(r["doc"], r["page_no"]) for r in discover(files, documents=1).collect()] == [("a.pdf", 9), ("a.pdf", 10)]


def test_every_copy_of_a_page_is_compared(spark, tmp_path):
    p = copy.deepcopy(BASE)
    CHANGES["text"][0](p)
    same, other = json.dumps(BASE), json.dumps(p)
    rows = [(1, "a", 1, same), (2, "a", 1, other), (2, "a", 1, other), (3, "a", 1, same), (None, "a", 1, other), (4, "b", 1, same), (4, "b", 1, same), (5, None, 1, other)]
    spark.createDataFrame(rows, "record_id long, doc_key string, page_no int, page_json string").write.parquet(str(tmp_path / "segmented_pages.parquet"))
    got = pages.parity_diffs(spark, str(tmp_path)).where("code = 'text_hash_mismatch'").collect()
    assert sorted(((r["doc_key"], r["record_id"]) for r in got), key=str) == [("a", 2), ("a", None)]
    assert not pages.parity_gate(spark, str(tmp_path)).first()["passed"]


def test_perturbed_copy_of_all_records(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"d{i}", 1, json.dumps(BASE)) for i in range(60)]
    spark.createDataFrame(rows, "record_id long, doc_key string, page_no int, page_json string").write.parquet(str(tmp_path / "segmented_pages.parquet"))
    got = {}
    for r in pages.parity_perturbed(spark, str(tmp_path)).collect():
        got.setdefault((r["change"], r["record_id"]), set()).add(r["code"])
    codes = {"text": "text_hash_mismatch", "ocr": "ocr_from_ocr_count_mismatch", "geometry": "geometry_signature_mismatch", "key": "missing_expected_top_level_key", "lost": "missing_required_top_level_key"}
    assert {k for k, _ in got} == set(codes) and all(codes[k] in c for (k, _), c in got.items())
    assert 40 <= len(got) < 60
