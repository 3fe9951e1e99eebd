"""Sources whose lines come from expressions alone: text, Markdown, CSV, LaTeX, XML.

Each takes a text column and gives an array of lines (text, font). Null text gives null, empty text no lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import col, is_blank, split_lines, trim, trimmed_lines
from pagewright.sources.layout import BODY, HEADING, line


def text_lines(text: str | Column) -> Column:
    return F.transform(trimmed_lines(text), lambda x: line(x, BODY))


def markdown_lines(text: str | Column) -> Column:
    """Leading # make a heading; then a bullet's mark is dropped. A line of # alone keeps its empty cell."""

    def one(x: Column) -> Column:
        heading = x.startswith("#")
        bare = F.when(heading, trim(F.regexp_replace(x, "^#+", ""))).otherwise(x)
        item = F.when(bare.startswith("* ") | bare.startswith("- "), trim(F.substring(bare, 3, 2**30))).otherwise(bare)
        return line(item, F.when(heading, HEADING).otherwise(BODY))

    return F.transform(trimmed_lines(text), one)


def csv_lines(text: str | Column) -> Column:
    """Commas part fields, whatever the extension; no quoting. Rows of blank fields are dropped."""
    rows = F.transform(split_lines(text), lambda x: F.transform(F.split(x, ",", -1), trim))
    kept = F.filter(rows, lambda r: F.exists(r, lambda f: f != ""))
    return F.transform(kept, lambda r: line(F.array_join(r, " \t ")))


#: What is taken out of LaTeX (fixed values): the bracket is literal, so commands stay.
LATEX_PATTERNS = (r"\[a-zA-Z]+\{.*?\}", r"\[a-zA-Z]+")
COMMANDS = (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\\[a-zA-Z]+\*?")


def latex_lines(text: str | Column, strip_commands: bool = False) -> Column:
    """strip_commands: take real commands out too, keeping their arguments."""
    c = col(text)
    for p in LATEX_PATTERNS:
        c = F.regexp_replace(c, p, "")
    if strip_commands:
        c = F.regexp_replace(F.regexp_replace(c, COMMANDS[0], "$1"), COMMANDS[1], "")
    return F.transform(F.filter(F.transform(F.split(c, "[\r\n]"), trim), lambda x: x != ""), lambda x: line(x))


def xml_lines(text: str | Column) -> Column:
    """All text nodes in document order; malformed XML fails."""
    nodes = F.filter(F.transform(F.xpath(col(text), F.lit("//text()")), trim), lambda x: ~is_blank(x))
    return F.transform(nodes, lambda x: line(x))
