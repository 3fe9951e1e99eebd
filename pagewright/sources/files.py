"""Sources that need a parser: HTML, office files, e-books, mail and images, from text or bytes.

A parser takes bytes and gives pages: (lines, options) where lines are (text, font) pairs. It runs over Arrow batches of
(path, content); a document that can't be read gives an error in place of pages, never a failed task. Lines become cells
in the JVM by the same layout as all other sources. Standard library only; external XML entities are never fetched.
"""

from __future__ import annotations

import email
import email.header
import html
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import SPACE
from pagewright.sources.layout import BODY, HEADING

_SPACE = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", SPACE).replace("\\x0B", "\\x0b") + "]+")
Line = tuple[str, "str | None"]


def strip(s: str) -> str:
    a = _SPACE.match(s)
    s = s[a.end() :] if a else s
    while s and _SPACE.match(s[-1]):
        s = s[:-1]
    return s


def decode(data: bytes) -> str:
    for bom, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(bom):
            return data.decode(name, "replace")
    return data.decode("utf-8", "replace")


#: Elements whose text becomes a line (fixed values).
_WANTED = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th")
#: Elements that end an open paragraph, and elements that end one of their own kind.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Lines(HTMLParser):
    """Wanted elements in document order with their inner text; nested ones give the outer and the inner text.
    A paragraph ends at the next block, an item or table cell at the next of its kind; comments, scripts and styles are no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, int | None]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: Any) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
            return
        if tag in _BLOCKS:
            self._close("p", until=("td", "th", "li", "div", "table"))
        for same in _SAME.get(tag, ()):
            self._close(same, until=("ul", "ol", "table"))
        if tag in _VOID:
            return
        at = None
        if tag in _WANTED:
            at = len(self.found)
            self.found.append((tag, []))
        self.open.append((tag, at))

    def _close(self, tag: str, until: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for _, at in self.open:
                if at is not None:
                    self.found[at][1].append(data)


def html_elements(markup: str) -> list[tuple[str, str]]:
    """(tag, text) of the wanted elements whose text isn't blank."""
    p = _Lines()
    p.feed(markup)
    p.close()
    out = ((tag, strip("".join(parts))) for tag, parts in p.found)
    return [(tag, text) for tag, text in out if text]


def html_pages(data: bytes) -> list[list[Line]]:
    return [[(text, None) for _, text in html_elements(decode(data))]]


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are refused")
    return ElementTree.fromstring(data)


def xml_pages(data: bytes) -> list[list[Line]]:
    return [[(strip(t), None) for t in _xml(data).itertext() if strip(t)]]


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _named(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _local(e) == name]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def docx_pages(data: bytes) -> list[list[Line]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(_named(_xml(z.read("word/document.xml")), "body")), None)
    lines: list[Line] = []
    words = lambda e: "".join(t.text or "" for t in _named(e, "t"))
    for e in body if body is not None else ():
        if _local(e) == "p":
            style = next((_attribute(s, "val") for s in _named(e, "pStyle")), None) or ""
            if text := strip(words(e)):
                lines.append((text, HEADING if style.startswith("Heading") else BODY))
        elif _local(e) == "tbl":
            for c in _named(e, "tc"):
                if text := strip(" ".join(words(p) for p in _named(c, "p"))):
                    lines.append((text, None))
    return [lines]


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets by id of a part's relations, as paths in the package."""
    folder, _, name = part.rpartition("/")
    try:
        root = _xml(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    out = {}
    for r in _named(root, "Relationship"):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        parts: list[str] = []
        for p in path.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        out[r.get("Id", "")] = "/".join(parts)
    return out


def pptx_pages(data: bytes) -> list[list[Line]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = _relations(z, "ppt/presentation.xml")
        ids = [_attribute_id(e) for e in _named(_xml(z.read("ppt/presentation.xml")), "sldId")]
        pages = []
        for i in ids:
            root = _xml(z.read(targets[i]))
            texts = ("".join(t.text or "" for t in _named(b, "t")) for b in _named(root, "txBody"))
            pages.append([(t, BODY) for t in texts if strip(t)])
    return pages


def _attribute_id(e: ElementTree.Element) -> str:
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def xlsx_pages(data: bytes) -> list[list[Line]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in _named(s, "t")) for s in _named(_xml(z.read("xl/sharedStrings.xml")), "si")]
        targets = _relations(z, "xl/workbook.xml")
        pages = []
        for sheet in _named(_xml(z.read("xl/workbook.xml")), "sheet"):
            lines: list[Line] = [(sheet.get("name", ""), BODY)]
            for row in _named(_xml(z.read(targets[_attribute_id(sheet)])), "row"):
                values = []
                for c in _named(row, "c"):
                    v = next((x.text or "" for x in _named(c, "v")), "")
                    if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                        v = shared[int(v)]
                    if strip(v):
                        values.append(v)
                if values:
                    lines.append((" \t ".join(values), BODY))
            pages.append(lines)
    return pages


def epub_pages(data: bytes) -> list[list[Line]]:
    """Pages in the order of the archive; one empty page where there are none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".html", ".xhtml"))]
        pages = [[(text, HEADING if tag.startswith("h") else BODY) for tag, text in html_elements(decode(z.read(n)))] for n in names]
    return pages or [[]]


def eml_pages(data: bytes) -> list[list[Line]]:
    """Four header lines, then the HTML body's elements, or the text body's lines."""
    m = email.message_from_bytes(data)
    lines: list[Line] = [(f"{n}: {_header(m.get(n))}", HEADING if n == "Subject" else BODY) for n in ("Subject", "From", "To", "Date")]
    parts: dict[str, Any] = {}
    for p in m.walk():
        if not p.is_multipart() and p.get_content_disposition() != "attachment":
            parts.setdefault(p.get_content_type(), p)
    if "text/html" in parts:
        return [lines + [(text, HEADING if tag.startswith("h") else BODY) for tag, text in html_elements(_content(parts["text/html"]))]]
    text = _content(parts["text/plain"]) if "text/plain" in parts else ""
    return [lines + [(strip(x), BODY) for x in re.split(r"[\r\n]", text) if strip(x)]]


def _header(raw: Any) -> str:
    """A header's value unfolded, its encoded words read."""
    if raw is None:
        return ""
    s = re.sub(r"\r?\n[ \t]+", " ", str(raw))
    if "=?" not in s:
        return s
    try:
        return str(email.header.make_header(email.header.decode_header(s)))
    except (LookupError, UnicodeDecodeError, ValueError):
        return s


def _content(part: Any) -> str:
    payload = part.get_payload(decode=True) or b""
    try:
        return payload.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, JPEG, BMP, TIFF, GIF or WebP."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return struct.unpack(">II", data[16:24])
    if data.startswith(b"BM"):
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
        return tuple(v & 0x3FFF for v in struct.unpack("<HH", data[26:30]))  # type: ignore[return-value]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            marker = data[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 if marker in (0x01, *range(0xD0, 0xD9)) else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        e = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack(e + "I", data[4:8])
        (n,) = struct.unpack(e + "H", data[at : at + 2])
        size = {}
        for i in range(n):
            tag, kind, _, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            if tag in (256, 257):
                size[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        return size[256], size[257]
    raise ValueError("unknown image format")


Parser = Callable[[bytes], list[list[Line]]]
#: Extensions by parser; plain formats have expressions of their own in plain.py.
PARSERS: dict[str, Parser] = {
    **{e: html_pages for e in (".html", ".htm")},
    **{e: xml_pages for e in (".xml", ".jats", ".mets")},
    **{e: docx_pages for e in (".docx", ".docm", ".dotx", ".dotm")},
    **{e: pptx_pages for e in (".pptx", ".pptm", ".potx", ".potm")},
    **{e: xlsx_pages for e in (".xlsx", ".xlsm", ".xltx", ".xltm")},
    ".epub": epub_pages,
    **{e: eml_pages for e in (".eml", ".msg")},
}
#: Formats whose cells are numbered on from page to page.
RUNNING = (".pptx", ".pptm", ".potx", ".potm")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp")
_PAGES = "pages array<struct<lines:array<struct<text:string,font:string>>,first:int>>, width double, height double, error string"


def parse_files(files: DataFrame, ext: str = "ext", content: str = "content", extra: dict[str, Parser] | None = None) -> DataFrame:
    """files with pages, width, height (of images) and error. Later parsers override earlier ones by extension."""
    parsers = {**PARSERS, **{k.lower(): v for k, v in (extra or {}).items()}}

    def one(suffix: str | None, data: bytes | None) -> dict[str, Any]:
        out: dict[str, Any] = {"pages": None, "width": None, "height": None, "error": None}
        try:
            if data is None:
                raise ValueError("no content")
            data = bytes(data)
            if suffix in IMAGES and suffix not in (extra or {}):
                w, h = image_size(data)
                return {**out, "pages": [{"lines": [], "first": 0}], "width": float(w), "height": float(h)}
            if suffix not in parsers:
                raise ValueError(f"no source reads {suffix}")
            at = 0
            pages = []
            for lines in parsers[suffix](data):
                pages.append({"lines": [{"text": t, "font": f} for t, f in lines], "first": at})
                at += len(lines) if suffix in RUNNING else 0
            return {**out, "pages": pages}
        except Exception as x:  # noqa: BLE001  whatever a broken file makes of a parser
            return {**out, "error": f"{type(x).__name__}: {x}"}

    def work(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for suffixes, contents in batches:
            rows = [one(s, c) for s, c in zip(suffixes, contents)]
            yield pd.DataFrame(rows, columns=["pages", "width", "height", "error"])

    from collections.abc import Iterator as It

    import pandas as pd

    work.__annotations__ = {"batches": It[tuple[pd.Series, pd.Series]], "return": It[pd.DataFrame]}
    parsed = F.pandas_udf(work, _PAGES)(F.col(ext), F.col(content))
    return files.withColumn("_f", parsed).select(*[c for c in files.columns if c not in ("pages", "width", "height", "error")], "_f.*")


def html_lines(text: str | Column) -> Column:
    """Lines of HTML held in a string column."""

    def work(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            yield batch.map(lambda t: None if t is None else [{"text": x, "font": None} for _, x in html_elements(t)]) if len(batch) else pd.Series([], dtype=object)

    from collections.abc import Iterator as It

    import pandas as pd

    work.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return F.pandas_udf(work, "array<struct<text:string,font:string>>")(F.col(text) if isinstance(text, str) else text)


def unescape(text: str) -> str:
    return html.unescape(text)
