"""Text and number functions as columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the inside of a regex class that Java and RE2 both read.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINE_BREAK = r"\r\n|\r|\n"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: str | Column) -> Column:
    """True for null, empty and white space only."""
    return col(c).isNull() | ~col(c).rlike(f"[^{SPACE}]")


def split_lines(c: str | Column) -> Column:
    return F.split(col(c), LINE_BREAK)


def trimmed_lines(c: str | Column) -> Column:
    """The trimmed lines of a text that aren't blank."""
    return F.filter(F.transform(split_lines(c), trim), lambda x: x != "")


def utf16_length(c: str | Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def string_key(c: str | Column) -> Column:
    """A key for distributions: the value, or what takes the place of null and blank text."""
    return F.when(col(c).isNull(), "_missing_").when(is_blank(c), "_empty_").otherwise(col(c))


def round_half_away(c: str | Column, digits: int = 2) -> Column:
    """Rounded half away from zero after scaling in binary, as double arithmetic does."""
    scale = float(10 ** min(max(digits, 0), 8))
    scaled = F.abs(col(c)) * F.lit(scale)
    return F.signum(col(c)) * F.floor(scaled + F.lit(0.5)) / F.lit(scale)


def number_text(c: str | Column) -> Column:
    """The shortest text of a number: no trailing .0, no exponent for everyday magnitudes."""
    d = col(c).cast("double")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", d), r"0+$", ""), r"\.$", "")
    return F.when(d.isNull(), None).when(d == 0, "0").when(F.abs(d) < 1e15, plain).otherwise(d.cast("string"))


def rounded_text(c: str | Column, digits: int = 2) -> Column:
    return number_text(round_half_away(c, digits))


def sequence_hash(values: Column) -> Column:
    """Upper-case SHA-256 over the values, each followed by the unit separator."""
    return F.upper(F.sha2(F.array_join(F.transform(values, lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit("\x1f"))), ""), 256))


def multiset_hash(values: Column) -> Column:
    return sequence_hash(F.array_sort(values))


def html_encode(c: str | Column) -> Column:
    """The five markup characters, then the letters from U+00A0 to U+00FF as numbers."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    high = F.transform(F.split(out, ""), lambda x: F.when(x.between("\u00a0", "\u00ff"), F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).otherwise(x))
    return F.when(out.rlike("[\\u00a0-\\u00ff]"), F.array_join(high, "")).otherwise(out)


def stem(path: str | Column) -> Column:
    name = F.regexp_extract(col(path), r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./\\]*)$", 1))


def slug(index: str | Column, path: str | Column) -> Column:
    """0007-some_name: the index in four digits, letters and digits of the stem, others as single underscores."""
    s = F.lower(F.regexp_replace(stem(path), r"[^\p{L}\p{Nd}]", "_"))
    s = F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), "^_+|_+$", "")
    return F.concat(F.lpad(col(index).cast("string"), 4, "0"), F.lit("-"), F.when(s == "", "document").otherwise(s))


def document_key(path: str | Column, run_id: str | Column, normalized: bool = True) -> Column:
    """The stem and the run; for page sources blanks and dots become underscores."""
    s = F.regexp_replace(stem(path), "[ .]", "_") if normalized else stem(path)
    return F.concat_ws("_", s, col(run_id))


def uri_part(c: str | Column, part: str) -> Column:
    """PROTOCOL or HOST of an absolute URI in lower case, or what takes its place."""
    found = F.try_parse_url(col(c), F.lit(part))
    absolute = F.try_parse_url(col(c), F.lit("PROTOCOL")).isNotNull()
    return F.when(col(c).isNull(), "_missing_").when(is_blank(c), "_empty_").when(~absolute, "_invalid_uri_").otherwise(F.coalesce(F.lower(found), F.lit("_empty_")))
