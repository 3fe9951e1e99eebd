"""One consistent form for text whose characters differ although it looks the same.

A quick check by properties of the characters isolates the unstable segments of a text: what normalization could
change (its quick-check property is No or Maybe), invisible characters, special blanks, full- and half-width forms, and
words whose letters are not in one script. Each segment is widened to its boundary context (back to a starter, on to the
next stable character; for letters, the word and the scripts of its line), made canonical, and spliced into the text,
which is otherwise left as it is. Texts that pass the check never leave the JVM.

Defined results: null stays null, empty stays empty. Fractions, superscripts, ligatures, quotes, dashes, symbols and
joined emoji are kept. Joiners are kept between emoji and within Arabic and Indic words, where they show.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalikes import ALIEN_IN_HOST, ARMENIAN, CYRILLIC, GREEK, HOSTS, LATIN, script

#: Invisible characters (fixed values, as ranges): soft hyphen, grapheme joiner, fillers, zero-width and direction marks,
#: invisible operators, variation selectors, byte order mark, tags.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
#: Blanks other than the common one.
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Full- and half-width forms.
WIDTH = "！-\uff9fﾡ-ﾾￂ-ￜ￠-￦￨-￮"


@lru_cache(maxsize=1)
def unstable_class() -> str:
    """The inside of a regex class of all characters whose quick-check property for composition is No or Maybe."""
    found = []
    for o in range(0xC0, 0x110000):
        if 0xD800 <= o < 0xE000 or 0xAC00 <= o < 0xD7A4:
            continue
        c = chr(o)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<":
            if unicodedata.normalize("NFC", c) != c:
                found.append(o)
        elif unicodedata.combining(c):
            found.append(o)
    found += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    out, start, last = [], None, None
    for o in [*sorted(set(found)), None]:
        if start is not None and o != last + 1:
            out.append(f"{chr(start)}-{chr(last)}" if last > start else chr(start))
            start = None
        if start is None:
            start = o
        last = o
    return "".join(out)


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    loose = unstable_class() + INVISIBLE + BLANKS + WIDTH
    return re.compile(f"[^{loose}]?[{loose}]+"), re.compile(f"[{INVISIBLE}]")


#: Letters without digits or underscores; inner marks have been composed by then.
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile("[ɐ-ʯıͰ-֏ἀ-\u1fff]")


def _emoji(c: str) -> bool:
    o = ord(c)
    return 0x1F000 <= o <= 0x1FAFF or 0x2190 <= o <= 0x2BFF or o in (0xFE0F, 0x200D, 0x20E3) or 0xE0020 <= o <= 0xE007F


def _joins(text: str, i: int) -> bool:
    """Whether the invisible character at i shows its effect: within joined emoji, Arabic and Indic words."""
    c = text[i]
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if c == "\u200d" or "\ufe00" <= c <= "\ufe0f" or "\U000e0020" <= c <= "\U000e007f":
        if before and _emoji(before) and (c != "\u200d" or (after and _emoji(after))):
            return True
        if c == "\ufe0f" and before and (before in "#*0123456789©®‼⁉™" or unicodedata.category(before) == "So"):
            return True
    if c in "\u200c\u200d" and before and after:
        return 0x0600 <= ord(before) <= 0x0DFF and 0x0600 <= ord(after) <= 0x0DFF
    return False


def _loose(text: str) -> str:
    """The text with its unstable segments made canonical: what normalization, width, blanks and invisible characters
    concern, each with the stable character before it. Only these segments are normalized; the rest is spliced in as it is."""
    segment, hidden = _patterns()
    out, at = [], 0
    for m in segment.finditer(text):
        a, b = m.span()
        own = m.group()
        if hidden.search(own):
            own = "".join(c for i, c in enumerate(own, a) if not hidden.match(c) or _joins(text, i))
        folded = "".join(unicodedata.normalize("NFKC", c) if "！" <= c <= "￮" else " " if c in _BLANK else c for c in own)
        out += [text[at:a], unicodedata.normalize("NFC", folded)]
        at = b
    return "".join([*out, text[at:]]) if out else text


_BLANK = frozenset("\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def _fits(word: str, host: str) -> str | None:
    """The word in the host script, if every letter is of it or looks like one of its letters."""
    table, alien = HOSTS[host], ALIEN_IN_HOST[host]
    out = []
    for c in word:
        if script(c) == host and c not in alien:
            out.append(c)
        elif c in table:
            out.append(table[c])
        else:
            return None
    return "".join(out)


def _own(word: str, host: str) -> int:
    """Letters of the host script that look like none of the other scripts here."""
    return sum(script(c) == host and c not in _SHARED for c in word)


_SHARED = frozenset(c for table in HOSTS.values() for pair in table.items() for c in pair)


def _scripts(text: str) -> str:
    """Words in one script each, where letters of another only look like its own."""
    if not _MIXED.search(text):
        return text
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    kinds = [{s for s in map(script, w) if s} for _, _, w in words]
    host_of_line, looks = _line_script(words, kinds)
    out, at = [], 0
    for (a, b, w), k in zip(words, kinds):
        new = None
        if len(k) > 1 or (k == {LATIN} and set(w) & ALIEN_IN_HOST[LATIN] and not _phonetic(w)) or k == {ARMENIAN}:
            # a mixed word: the host that takes every letter, by letters only it has, then by the line
            fits = {h: f for h in (LATIN, CYRILLIC, GREEK) if (h in k or (k == {ARMENIAN} and h == host_of_line)) and (f := _fits(w, h)) is not None}
            if fits:
                host = max(fits, key=lambda h: (_own(w, h), h == host_of_line, sum(script(c) == h for c in w)))
                new = fits[host]
        elif looks and len(k) == 1 and k != {host_of_line}:
            # a whole word of look-alikes in a line otherwise in one script; not a unit, a sign or a code
            if not (text[a - 1 : a] in ("°", "&", "/", "@", "#", "_") and a) and not text[b : b + 1].isdigit() and not text[a - 1 : a].isdigit():
                new = _fits(w, host_of_line)
        if new is not None and new != w:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]]) if out else text


def _line_script(words: list[tuple[int, int, str]], kinds: list[set[str]]) -> tuple[str | None, bool]:
    """The script of most letters of the line, and whether the line's other words, each by itself, only look foreign:
    all their letters look like letters of that script, of which the line has twice as many."""
    letters = {s: sum(len(w) for (_, _, w), k in zip(words, kinds) if k == {s}) for s in (LATIN, CYRILLIC, GREEK)}
    line = max(letters, key=lambda s: letters[s]) if any(letters.values()) else None
    if line is None:
        return None, False
    foreign = [w for (_, _, w), k in zip(words, kinds) if len(k) == 1 and k != {line}]
    return line, bool(foreign) and letters[line] >= 2 * sum(map(len, foreign)) and all(_fits(w, line) is not None for w in foreign)


def _phonetic(word: str) -> bool:
    """Whether other phonetic letters show that the word is a transcription."""
    return any("ɐ" <= c <= "ʯ" and c not in "ɑɡ" for c in word)


def canonical(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    seen = set()
    while text not in seen:  # a letter put into another script may compose with its mark, until nothing changes
        seen.add(text)
        text = _scripts(_loose(text))
    return text


#: Ranges of characters that are stable, visible and of one width (fixed values); whatever lies outside is looked at closer.
STABLE = (
    "\\u0000-\\u009f\\u00a1-\\u00ac\\u00ae-\\u0130\\u0132-\\u024f\\u0370-\\u0373\\u0376-\\u037d\\u0384-\\u0386\\u0388-\\u03f1\\u03f3-\\u03f8\\u03fa-\\u0482\\u048a-\\u052f"
    "\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf\\u2100-\\u2125\\u2127-\\u2129\\u212c-\\u2328\\u232b-\\u2adb\\u3001-\\u3029\\u3030-\\u3098\\u309b-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3"
)


def may_change(text: str | Column) -> Column:
    """The quick check, in the JVM: false only for texts that are canonical. Each pattern takes one pass."""
    c = F.col(text) if isinstance(text, str) else text
    latin, greek, cyrillic = c.rlike("[A-Za-z\\u00c0-\\u024f]"), c.rlike("[\\u0370-\\u03ff]"), c.rlike("[\\u0400-\\u052f]")
    check = c.rlike(f"[^{STABLE}]") | (latin & c.rlike("[\\u0370-\\u052f]")) | (greek & cyrillic)
    return F.coalesce(c.rlike("[^\\x00-\\x7F]") & check, F.lit(False))


def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(canonical)


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """df with out, the consistent form of text, one row per row. No shuffle; only unstable texts go to Python."""
    df = df.drop(out)
    unstable = may_change(text)
    udf = F.pandas_udf(_canonical, "string")
    return df.where(unstable).withColumn(out, udf(F.col(text))).unionByName(df.where(~unstable).withColumn(out, F.col(text)))


def changed_cells(cells: DataFrame, id: str = "cell_id", text: str = "text") -> DataFrame:
    """id, text and canonical of the cells whose text differs from its consistent form; a redelivered cell counts once."""
    unstable = cells.select(id, text).where(may_change(text))
    return unstable.withColumn("canonical", F.pandas_udf(_canonical, "string")(F.col(text))).where(F.col("canonical") != F.col(text)).dropDuplicates([id, text])


__all__ = ["CYRILLIC", "GREEK", "canonical", "canonical_text", "changed_cells", "may_change"]
