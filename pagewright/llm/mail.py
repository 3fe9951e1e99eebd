"""Readable text of raw e-mail messages: MIME parts with their transfer encoding undone, and their sentences.

Reads what a lenient reader would: mbox lines, missing end boundaries, cut messages, wrong charset labels, headers in
any order. Parts that aren't text (images, archives) give nothing. A text without headers is read as a body.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_BREAK = re.compile(r"\r?\n[ \t]*\r?\n")
_HEADER = re.compile(r"^[!-9;-~]+[ \t]*:", re.M)
_FIELD = {name: re.compile(rf"^{name}[ \t]*:[ \t]*((?:.*)(?:\r?\n[ \t]+.*)*)", re.I | re.M) for name in ("content-type", "content-transfer-encoding")}
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:-]+)", re.I)
_HIDDEN = re.compile(r"<(style|script|head|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_BLOCK = re.compile(r"<(?:/?(?:p|div|tr|li|ul|ol|table|h[1-6]|blockquote|section|article|hr)\b|br\b)[^>]*>", re.I)
_TAG = re.compile(r"<[a-z/!][^>]*>?", re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def _decode(data: bytes, charset: str | None) -> str:
    for name in ("utf-8", charset):
        if name:
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                pass
    return data.decode("cp1252", "replace")


def _undo(body: str, how: str, charset: str | None) -> str:
    if how == "base64":
        own = _NOT_BASE64.sub("", body)
        try:
            return _decode(base64.b64decode(own[: len(own) // 4 * 4] + (own[len(own) // 4 * 4 :] + "==")[: 4 if len(own) % 4 > 1 else 0]), charset)
        except (binascii.Error, ValueError):
            return body
    if how == "quoted-printable":
        if "=" not in body:
            return body
        return _decode(quopri.a2b_qp(body.encode("utf-8", "surrogatepass").replace(b"\r\n", b"\n")), charset)
    return body


def plain(markup: str) -> str:
    """HTML as text: hidden parts and tags dropped, blocks on lines of their own, entities read."""
    s = _HIDDEN.sub(" ", markup)
    s = _TAG.sub("", _BLOCK.sub("\n\n", s.replace("\r\n", " ").replace("\n", " ")))
    return html.unescape(s) if "&" in s else s


def text_parts(message: str | None) -> list[str]:
    """The readable text parts of a message, in order, however deep they are nested."""
    out: list[str] = []
    left = [(message, True)] if message else []
    while left:
        own, outer = left.pop()
        inner, texts = _opened(own, outer)
        out += texts
        left += [(p, False) for p in reversed(inner) if p]
    return out


def _opened(message: str, outer: bool) -> tuple[list[str], list[str]]:
    """The parts of a message or part, or its own text."""
    if outer and message.startswith(("From ", ">From ")) and "\n" in message:
        message = message.split("\n", 1)[1]
    m = _BREAK.search(message)
    head, body = (message[: m.start()], message[m.end() :]) if m else (message, "")
    if not outer and message[:1] in "\r\n":  # a part without headers
        head, body = "", message
    elif not _HEADER.match(head.lstrip()):
        head, body = "", message
    kind = _FIELD["content-type"].search(head)
    how = _FIELD["content-transfer-encoding"].search(head)
    of = kind.group(1) if kind else "text/plain"
    low = of.lower()
    if low.startswith("multipart/"):
        b = _BOUNDARY.search(of)
        if b:
            mark = "--" + (b.group(1) or b.group(2))
            parts = re.split(rf"(?:^|\r?\n){re.escape(mark)}(?:--)?[ \t]*(?=\r?\n|\Z)", body)
            if len(parts) > 1:
                return [p[1:] if p[:1] == "\n" else p[2:] if p[:2] == "\r\n" else p for p in parts[1:]], []
        return [], [body]
    if low.startswith("message/"):
        return [body], []
    if not low.startswith("text/"):
        return [], []
    charset = _CHARSET.search(of)
    body = _undo(body, how.group(1).strip().lower().strip('"') if how else "", charset.group(1) if charset else None)
    return [], ([plain(body) if low.startswith("text/html") else body] if body.strip() else [])


_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*|\n(?=-- ?\n)")
_END = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])")


def sentences(text: str) -> list[str]:
    """Sentences of one part, quoted passages included, their line breaks undone."""
    s = text.replace("\r\n", "\n").replace("\r", "\n")
    if ">" in s or "|" in s:
        s = _QUOTE.sub("", s)
    return [z for p in _PARAGRAPH.split(s) for z in _END.split(" ".join(p.split())) if z]
