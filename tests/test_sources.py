import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.sources import files
from pagewright.sources.convert import convert, read_segmented
from pagewright.sources.plain import csv_lines, latex_lines, markdown_lines, text_lines, xml_lines

W = 'xmlns:w="http://w"'
R = 'xmlns:r="http://r"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = package({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t> Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = package(
    {
        "ppt/presentation.xml": f'<p xmlns:p="http://p" {R}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Target="slides/1.xml"/><Relationship Id="b" Target="slides/2.xml"/></Relationships>',
        "ppt/slides/1.xml": '<s><txBody xmlns:a="http://a"><a:t>one </a:t></txBody></s>',
        "ppt/slides/2.xml": '<s><txBody xmlns:a="http://a"><a:t>two</a:t></txBody><txBody><a:t xmlns:a="http://a"> </a:t></txBody></s>',
    }
)
XLSX = package(
    {
        "xl/workbook.xml": f'<w {R}><sheets><sheet name="S" r:id="a"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="/xl/worksheets/1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>hello</t></si></sst>",
        "xl/worksheets/1.xml": '<ws><row><c t="s"><v>0</v></c><c><v>45000</v></c><c/></row><row><c/></row></ws>',
    }
)
EPUB = package({"b.xhtml": "<h1>B</h1><p>b", "a.html": "<p>a", "c.htm": "<p>no"})
HTML_MAIL = b"Subject: =?utf-8?q?=C3=A9?=\r\nFrom: a@b\r\nTo: c@d\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nContent-Type: text/html\r\n\r\n<h2>Head</h2><p>text"
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 5)


@pytest.mark.parametrize(
    "parse,data,expected",
    [
        (files.docx_pages, DOCX, [[("Title", "HeadingFont"), ("ab", "BodyFont"), ("x y", None)]]),
        (files.pptx_pages, PPTX, [[("two", "BodyFont")], [("one ", "BodyFont")]]),
        (files.xlsx_pages, XLSX, [[("S", "BodyFont"), ("hello \t 45000", "BodyFont")]]),
        (files.epub_pages, EPUB, [[("B", "HeadingFont"), ("b", "BodyFont")], [("a", "BodyFont")]]),
        (files.epub_pages, package({"x.txt": ""}), [[]]),
        (files.html_pages, b"<table><td>a<p>b &amp; c</td><td>d</table><p>e<p>f<script>no</script><!-- no -->", [[("ab & c", None), ("b & c", None), ("d", None), ("e", None), ("f", None)]]),
        (files.xml_pages, b"<a>x<b> y </b><![CDATA[<z>]]></a>", [[("x", None), ("y", None), ("<z>", None)]]),
    ],
)
def test_parsers(parse, data, expected):
    assert parse(data) == expected


def test_mail():
    lines = files.eml_pages(HTML_MAIL)[0]
    assert lines[0] == ("Subject: é", "HeadingFont") and lines[4:] == [("Head", "HeadingFont"), ("text", "BodyFont")]
    assert files.eml_pages(b"Subject: s\n\none\n\n two ")[0][4:] == [("one", "BodyFont"), ("two", "BodyFont")]


def test_image_sizes():
    assert files.image_size(PNG) == (3, 5)
    assert files.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)) == (7, 9)
    assert files.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 4, 6) + b"\x01") == (6, 4)
    assert files.image_size(b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12)) == (11, 12)
    with pytest.raises(ValueError):
        files.image_size(b"nothing")


def test_entities_are_refused():
    with pytest.raises(ValueError):
        files.xml_pages(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_plain_lines(spark):
    def lines(f, text):
        c = spark.createDataFrame([(text,)], "t string").select(f("t").alias("l")).first()["l"]
        return None if c is None else [(x["text"], x["font"]) for x in c]

    assert lines(text_lines, " a \r\n\r\n\u2003b\rc") == [("a", "BodyFont"), ("b", "BodyFont"), ("c", "BodyFont")]
    assert lines(markdown_lines, "## H\n* i\n- \n###\n# - x") == [("H", "HeadingFont"), ("i", "BodyFont"), ("-", "BodyFont"), ("", "HeadingFont"), ("x", "HeadingFont")]
    assert lines(csv_lines, 'a, "b,c"\n , \n\tx\t') == [('a \t "b \t c"', None), ("x", None)]
    assert lines(latex_lines, "\\section{a}\n[a-zA-Z]{x} y") == [("\\section{a}", None), ("y", None)]
    assert lines(lambda c: latex_lines(c, True), "\\section{a}\\emph{b}") == [("ab", None)]
    assert lines(xml_lines, "<a>x<b> y </b></a>") == [("x", None), ("y", None)]
    assert lines(text_lines, None) is None and lines(text_lines, "") == []


def test_convert(spark):
    rows = [("t", "a.TXT", b"one\n\ntwo", None), ("m", "x", b"# h", "md"), ("d", "d.docx", DOCX, None), ("p", "p.pptx", PPTX, None), ("i", "i.png", PNG, None), ("bad", "b.docx", b"no zip", None), ("un", "u.zzz", b"", None), ("nul", "n.txt", None, None), ("e", "e.eml", HTML_MAIL, None)]
    df = spark.createDataFrame(rows, "doc_key string, path string, content binary, format string")
    got = {}
    for r in convert(df).collect():
        got.setdefault(r.doc_key, {})[r.page_no] = r
    text = lambda r: [c.text for c in r.page.textline_cells]
    assert text(got["t"][1]) == ["one", "two"] and got["t"][1].page.textline_cells[1].rect.r_y2 == 986.0
    assert got["m"][1].page.textline_cells[0].font_name == "HeadingFont"
    assert [c["index"] for c in got["p"][2].page.textline_cells] == [1] and got["p"][2].page.textline_cells[0].rect.r_y2 == 1000.0
    assert got["i"][1].page.dimension.rect.r_x2 == 3.0 and got["i"][1].page.bitmap_resources[0].uri == "stream://image" and not got["i"][1].page.has_lines
    assert got["bad"][1].page is None and "BadZipFile" in got["bad"][1].error
    assert got["un"][1].page is None and got["nul"][1].error
    assert got["e"][1].page.textline_cells[4].rect.r_y2 == 1000.0 - 14 * 5
    assert convert(df.limit(0)).count() == 0
    mine = {".zzz": lambda data: [[("own", None)]]}
    assert [text(r) for r in convert(df.where("doc_key = 'un'"), mine).collect()] == [["own"]]


def test_envelopes(spark):
    cell = '{"index":7,"text":"x"}'
    rows = [(1, f'{{"page_number":1,"original":{{"cells":[{cell}]}},"sanitized":null}}'), (2, '{"original":null,"sanitized":{"cells":[]}}'), (3, "no json"), (4, f'{{"char_cells":[{cell},{cell}],"has_chars":true}}'), (5, None)]
    got = {r.id: r.page for r in read_segmented(spark.createDataFrame(rows, "id int, page_json string")).collect()}
    assert got[1].char_cells[0]["index"] == 7 and got[1].has_chars and not got[1].has_lines and got[1].word_cells == []
    assert got[2].char_cells == [] and not got[2].has_chars
    assert len(got[4].char_cells) == 2 and got[5] is None
    assert got[3] is None or got[3].char_cells is None


def test_stream(spark, tmp_path):
    from pagewright.streaming.convert import convert_stream, watch_files, windowed_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    for _ in range(2):  # the second run finds nothing new
        convert_stream(watch_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [len(r.page.textline_cells) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    e = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:01", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in windowed_counts(e, "t", ["k"], "1 minute", "10 seconds").collect()) == [1, 2]
