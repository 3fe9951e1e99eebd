"""A small parsing-expression engine and the grammar of transcript segments.

    Segment  <- Spacing (Arrow / Mark / Label)* Item*
    Arrow    <- '>>' / '-->'                              turn marks
    Mark     <- Stamp / Note
    Stamp    <- '[' Clock ']' / '<' Clock '>' / '(' Clock ')' / LongClock '-->'?
    Label    <- '<v' Name '>' / '>>' Name ':' / '[' Name ']' ':'? / '(' Name '):' / Name ' -' / Name ':'
    Note     <- '((' (Note / !'))' .)* '))' / '[' (Note / !']' .)* ']' / '{' (Note / !'}' .)* '}'
              / '<' (Note / !'>' .)* '>' / '*' (!'*' .)+ '*' / '♪' (!'♪' .)* '♪' / '(' SoundWords ')' / &Apart '(' (![().] .)+ ')'
    Item     <- Mark / Filler / Speech / .
    Speech   <- (!Mark !Filler .)+

Apart is a place before the first word or after the end of a sentence: there, whatever stands in round brackets is a note.
Expressions take (text, position) and return (node, position) or None. A node is (kind, start, end, children).
Nested notes of any length and depth are found for all places of a text at once, from right to left, in linear time.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from typing import Any

Node = tuple[str, int, int, tuple]
Rule = Callable[[str, int], "tuple[Node, int] | None"]


def term(kind: str, pattern: str, flags: int = 0) -> Rule:
    match = re.compile(pattern, flags).match

    def rule(text: str, i: int) -> Any:
        m = match(text, i)
        return ((kind, i, m.end(), ()), m.end()) if m else None

    return rule


def choice(*rules: Rule) -> Rule:
    def rule(text: str, i: int) -> Any:
        for r in rules:
            got = r(text, i)
            if got is not None:
                return got
        return None

    return rule


_BRACKET = re.compile(r"[\[\](){}<>*♪]")
_CLOSING = (("((", "))"), ("[", "]"), ("{", "}"), ("<", ">"))


def _notes_of(text: str) -> dict[int, Node]:
    """By place, the note that starts there. A note is tried at every mark from right to left; what follows a place is
    known by then, so each rule looks one step ahead: for each kind of bracket, where a note that is open here would end."""
    places = [m.start() for m in _BRACKET.finditer(text)]
    notes: dict[int, Node] = {}
    n, head = len(places), _HEAD(text).end()
    ends = [[-1] * (n + 1) for _ in _CLOSING]  # the end of a note of this kind that is open just before the i-th mark
    nexts = [n] * (n + 1)  # the mark from which reading goes on behind the i-th: the next, or the first behind its note
    for i in range(n - 1, -1, -1):
        at = places[i]
        end = -1
        for (opening, _), own in zip(_CLOSING, ends):
            if text.startswith(opening, at):
                j = i + len(opening)
                if j <= n and own[j] >= 0:
                    end = own[j]
                    break
        if end < 0:
            c = text[at]
            if c == "*":
                m = _STARS(text, at)
                end = m.end() if m else -1
            elif c == "♪":
                end = _MUSIC(text, at).end()
            elif c == "(":
                m = _ROUND(text, at)
                if m and (is_sound([w.casefold() for w in WORD.findall(m.group(1))]) or (_ASIDE(m.group(1)) and _apart(text, at, head))):
                    end = m.end()
        nexts[i] = i + 1
        if end >= 0:
            children, j = [], i + 1
            while j < n and places[j] < end:
                inner = notes.get(places[j])
                if inner is not None and inner[2] <= end:
                    children.append(inner)
                j = nexts[j]
            notes[at] = ("note", at, end, tuple(children))
            nexts[i] = bisect.bisect_left(places, end, i + 1)
        for (_, closing), own in zip(_CLOSING, ends):
            own[i] = at + len(closing) if text.startswith(closing, at) else own[nexts[i]]
    return notes


_memo: list = [None, {}]


def note(text: str, i: int) -> Any:
    if _memo[0] is not text:
        _memo[0], _memo[1] = text, _notes_of(text)
    got = _memo[1].get(i)
    return (got, got[2]) if got is not None else None


#: Sounds that transcribers note, in the languages of the recordings: the words that make a round bracket a note.
SOUND_WORDS = frozenset(
    """music laughter laughs laughing laugh applause clapping typing static beep beeps cough coughs coughing sigh sighs sighing
    crosstalk inaudible unintelligible indistinct silence pause noise background door doors slams slam closes opens knock knocking
    chair scraping phone telephone ringing rings ring bell bells breathing breathes sneeze sneezes clears throat whispers whispering
    cheering cheers crowd chatter echo feedback footsteps wind rain rustling paper papers shuffling click clicks buzzing hum humming
    singing screaming crying sobbing gasps groans yawns sniffs overlapping speech
    rires rire rit musique applaudissements bruit toux soupir soupirs sonnerie téléphone porte grésillement
    risas risa ríe música aplausos ruido tos suspiro suspiros timbre teléfono puerta silencio
    gelächter lachen lacht musik applaus beifall geräusch husten hustet seufzt klingelt telefon tür rauschen stille unverständlich""".split()
)
_SMALL = frozenset("and in the of a on de la le les y en el und im der die das et".split())


def is_sound(words: list[str]) -> bool:
    return any(w in SOUND_WORDS for w in words) and all(w in SOUND_WORDS or w in _SMALL for w in words)


#: Hesitation: alone, or only where a comma, dots or an end set it off, as other languages have them as words.
_FREE = r"u+h+m*|u+m+|e+r+m+|u+h+u+m|h+m+|m+h+m+|m{2,}|mm+-?h+mm*|uh-huh|ä+h+m*|e+u+h+|öh+m*"
_SET_OFF = r"er+|eh+|em+|hm+|ben|bah|este|mm+|ah+|oh+|you know|i mean"

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLOCK = r"\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\s*"
_NAME = r"[^\W\d_][\w.'’\- ]*(?:, ?[\w.'’\- ]+)?"

stamp = choice(
    term("stamp", rf"\[{_CLOCK}\](?:\s*-->)?"),
    term("stamp", rf"<{_CLOCK}>(?:\s*-->)?"),
    term("stamp", rf"\({_CLOCK}\)(?:\s*-->)?"),
    term("stamp", r"\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?![\d:])(?:\s*-->(?:\s*\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)?)?"),
    term("stamp", r"\d{1,2}:\d{2}(?:[.,]\d{1,3})?\s*-->"),
)


_ROUND = re.compile(r"\(([^()]+)\)").match
_STARS = re.compile(r"\*[^*\n]+\*").match
_MUSIC = re.compile(r"♪[^♪]*♪|♪+").match
#: What may stand before the first word.
_HEAD = re.compile(r"(?:[^\W\d_][\w.'’\- ]*:(?=\s))?(?:\s+|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}|\([^()]*\)|\*[^*\n]*\*|♪|>>+|-->|\d+(?::\d+)+(?:[.,]\d+)?)*").match
_ASIDE = re.compile(r"[^\W\d][^\d.!?…:]*$").match


def _apart(text: str, at: int, head: int) -> bool:
    """Whether a place is before the first word or after the end of a sentence."""
    if at < head:
        return True
    while at and text[at - 1].isspace():
        at -= 1
    return at == 0 or text[at - 1] in "!?" or (text[at - 1] == "." and text[at - 2 : at - 1] != ".")


mark = choice(stamp, note)
label = choice(
    term("sure", r"<v[ .]\s*(?P<n>[^<>]+)>"),
    term("sure", rf">>\s*(?P<n>{_NAME}?)\s*:(?!\d)"),
    term("round", rf"\((?P<n>{_NAME})\)\s*:"),
    term("square", rf"\[(?P<n>{_NAME})\]\s*:?"),
    term("dash", rf"(?P<n>{_NAME}?)\s+[-–—]\s+"),
    term("colon", rf"(?P<n>{_NAME}?)\s?:(?=\s|$)"),
)
arrow = term("arrow", r">>+|-->")
space = term("space", r"\s+")
_FILLER = rf"(?<!\w)(?<!\w['’])(?i:(?=[aehimuäöby])(?:(?:{_FREE})(?!\w)(?:\s*(?:\.{{2,}}|…|,))?|(?:{_SET_OFF})(?!\w)\s*(?:\.{{2,}}|…|,|(?=[.!?]?\s*$))))"
#: where speech may end: at what may start a mark, or at hesitation
_STOP = re.compile(rf"[\[<({{*♪]|(?<![^\W_])\d{{1,2}}:\d|(?P<filler>{_FILLER})").search


def body(text: str, at: int) -> tuple[Node, int]:
    """Item*, each the first of mark / filler / speech / other."""
    found: list[Node] = []
    start, said = at, at
    while (m := _STOP(text, at)) is not None:
        i = m.start()
        if m.lastgroup is not None:
            got: Any = (("filler", i, m.end(), ()), m.end())
        else:
            got = stamp(text, i) if text[i].isdigit() else mark(text, i)
        if got is None:
            at = i + 1
            continue
        if i > said:
            found.append(("speech", said, i, ()))
        found.append(got[0])
        at = said = got[1]
    if len(text) > said:
        found.append(("speech", said, len(text), ()))
    return ("body", start, len(text), tuple(found)), len(text)


_name = re.compile(r"<v[ .]\s*|>>\s*|[(\[]|\s*(?:\)\s*:|\]\s*:?|\s[-–—]\s+|:|>)$")


def parse(text: str) -> tuple[list[Node], tuple[Node, str] | None, int]:
    """The head's marks, the head's label with its name if there may be one, and the place where the body starts."""
    at, head, found = 0, [], None
    while at < len(text):
        c = text[at]
        got = space(text, at) if c.isspace() else None
        if got is None and c in "[<({*♪0123456789":
            got = stamp(text, at)
        if got is None and found is None and (c in "[<(>" or c.isalpha()):
            got = label(text, at)
            if got is not None:
                name = _name.sub("", text[got[0][1] : got[0][2]]).strip()
                square = got[0][0] == "square"
                if square and is_sound([w.casefold() for w in WORD.findall(name)]):
                    got = None
                else:
                    found = (got[0], name)
                    at = got[1]
                    continue
        if got is None:
            got = mark(text, at) if c in "[<({*♪" else arrow(text, at) if c in ">-" else None
        if got is None:
            break
        head.append(got[0])
        at = got[1]
    return head, found, at
