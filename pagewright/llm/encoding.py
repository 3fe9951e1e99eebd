"""Text that was decoded with the wrong character encoding: found and restored through the corpus's own clean words.

Every distinct clean word of the corpus is garbled under all encoding chains; the tokens of the lines are hash-joined
against that table, and a verified match gives the original back. Verified means: the token doesn't look like a word
itself and its form has more characters than the original, or the corpus holds the original RARER times as often.
Letters are words of one character: their table serves single cells, and tokens that are made of garbled letters of one
chain, such as text without blanks or words that the corpus has nowhere in their clean form.

A chain writes text in one encoding and reads it in another, up to three times over. Chains of one step take all pairs;
further steps read UTF-8 as one of the common PAGES. Bytes that an encoding leaves undefined become C1 controls or U+FFFD.
Forms are made where they are used: a bitmap of fixed size of all pieces' hashes tells most forms that no token has, so
only the rest is shuffled.

A line's chain is the one that explains most of its garbled tokens. Where all its non-ASCII tokens are garbled the line
is decoded back whole; else its garbled tokens are replaced, each in its place.

Defined results: null and empty values are never found. Values with U+FFFD or C1 controls are found, restorable or not;
what can't be restored keeps its token. Redelivered cells count once. Texts are read whole. A cell of a single character
is found only by such evidence, as one letter in place of another shows in no other way.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalikes import script
from pagewright.session import broadcast_if_small, cut_lineage

#: Encodings that text was written in and was taken for; one byte a character but for UTF-8 and the Japanese ones.
WRITTEN = ("utf-8", "cp1252", "latin-1", "iso8859-2", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-5", "iso8859-7", "cp1253", "mac-roman", "mac-greek", "mac-cyrillic", "mac-latin2", "cp437", "cp850", "cp852", "cp737", "iso8859-9", "cp1254", "iso8859-15", "shift_jis", "euc_jp")
READ = ("cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp852", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "koi8-r", "cp866", "mac-cyrillic")
#: Encodings of several bytes a character that UTF-8 was taken for.
READ_WIDE = ("cp932", "gb18030", "big5", "euc_kr")
#: Pages that the second and third step of a chain read UTF-8 as, and encodings that such chains start with.
PAGES = ("cp1252", "latin-1", "cp1251", "cp1250", "mac-roman", "cp437", "cp850")
STARTS = ("cp1250", "cp1251", "iso8859-2", "iso8859-7", "koi8-r", "cp866")
#: A match that could be a word itself must be so many times rarer than its original.
RARER = 4
MAX_BROADCAST_ROWS = 200_000
#: Buckets of 32,768 bits of the bitmap: 4 MB.
BUCKETS = 1024

_PUNCTUATION = "“”‘’„‚–—…«»‹›€°§·•™×±№¿¡。、「」・"
_EVIDENCE = "[\\u0080-\\u0084\\u0086-\\u009f\\ufffd]"
_C1_OR_LOST = re.compile("[\u0080-\u0084\u0086-\u009f�]")
LOST = "�"


@lru_cache(maxsize=None)
def _table(encoding: str, undefined: str | None) -> str:
    """256 characters; bytes that the encoding leaves undefined are C1 controls or the replacement character."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(undefined or chr(b))
    return "".join(out)


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed([*enumerate(_table(encoding, None))])}


def _read(data: bytes, encoding: str, undefined: str | None = None) -> str:
    return codecs.charmap_decode(data, "strict", _table(encoding, undefined))[0]


@lru_cache(maxsize=1)
def chains() -> tuple[tuple[str, ...], ...]:
    """The chains that change each character by itself: the encoding it was written in, then the pages it was read as,
    with UTF-8 between them. ascii drops every byte over 127."""
    one = [(w, r) for w in WRITTEN for r in READ if w != r]
    one.insert(len(READ), ("utf-8", "ascii"))
    two = [(s, a, b) for s in ("utf-8", *STARTS) for a in (PAGES if s == "utf-8" else PAGES[:2]) for b in PAGES]
    three = [("utf-8", a, b, c) for a in PAGES for b in PAGES for c in PAGES]
    return (*one, *two, *three)


def name_of(chain: tuple[str, ...]) -> str:
    return ">".join([chain[0], *">utf-8>".join(chain[1:]).split(">")])


def _wide_script(c: str) -> bool:
    return c >= "⺀"


#: Stands for what an encoding can't write.
_NONE = "\0"


@lru_cache(maxsize=8192)
def _images(c: str) -> tuple[str, ...]:
    """What becomes of a character under each chain, twice: undefined bytes as C1 controls and as U+FFFD."""
    out: list[str] = []
    for undefined in (None, LOST):
        steps: dict[tuple[str, ...], str | None] = {}
        for written in WRITTEN:
            try:
                data = c.encode(written)
            except UnicodeEncodeError:
                data = None
            for read in READ:
                steps[written, read] = None if data is None else _read(data, read, undefined)
        steps["utf-8", "ascii"] = LOST * len(c.encode("utf-8"))
        for chain in chains():
            if chain not in steps:
                before = steps[chain[:-1]]
                steps[chain] = None if before is None else _read(before.encode("utf-8"), chain[-1], undefined)
            out.append(_NONE if steps[chain] is None else steps[chain])
    one = {x: x for x in out}
    return tuple(one[x] for x in out)


_PARTS = re.compile("[\x00-\x7f]+|[^\x00-\x7f]")


def _forms(word: str) -> list[str]:
    """The word under each chain, twice, in the order of _images; then what was written in any encoding but UTF-8 and
    read as UTF-8, and UTF-8 read as the wide ones, whose forms depend on the neighbours."""
    columns = [repeat(part) if part.isascii() else _images(part) for part in _PARTS.findall(word)]
    out = list(map("".join, zip(*columns)))
    for written in WRITTEN[1:]:
        try:
            out.append(word.encode(written).decode("utf-8", "replace"))
        except UnicodeEncodeError:
            out.append(_NONE)
    out += [word.encode("utf-8", "surrogatepass").decode(read, "replace") for read in READ_WIDE]
    return out


def _tells(form: str, word: str) -> bool:
    """Whether a form is one: forms of nothing but replacement characters tell nothing."""
    return form != word and not form.isascii() and _NONE not in form and bool(form.strip(LOST))


def garbled(word: str) -> dict[str, tuple[int, ...]]:
    """Every garbled form of a word, with the numbers of the chains that give it."""
    out: dict[str, list[int]] = {}
    if not word.isascii():
        n = len(chains())
        for i, form in enumerate(_forms(word)):
            out.setdefault(form, []).append(i % n if i < 2 * n else i - n)
    return {f: tuple(dict.fromkeys(c)) for f, c in out.items() if _tells(f, word)}


@lru_cache(maxsize=1)
def chain_names() -> tuple[str, ...]:
    return (*map(name_of, chains()), *(f"{w}>utf-8" for w in WRITTEN[1:]), *(f"utf-8>{r}" for r in READ_WIDE))


def undo(text: str, chain: int) -> str | None:
    """The text before the chain, if every character can be told."""
    steps = name_of(chains()[chain]).split(">") if chain < len(chains()) else chain_names()[chain].split(">")
    try:
        for read, written in zip(steps[-1::-2], steps[-2::-2]):
            if read in READ:
                own = _bytes_of(read)
                data = bytes([own[c] for c in text])
            else:
                data = text.encode(read)
            text = data.decode(written)
    except (KeyError, UnicodeError):
        return None
    return text


@lru_cache(maxsize=1)
def _marks() -> dict[str, str]:
    """Garbled forms of punctuation, and what they stand for; a form of one character is one that no text has."""
    out: dict[str, str] = {}
    for c in _PUNCTUATION:
        for form in garbled(c):
            if not form.isspace():
                out.setdefault(form, c)
    return out


@lru_cache(maxsize=1)
def _mark_sizes() -> tuple[int, ...]:
    return tuple(sorted({len(f) for f in _marks()} - {1}, reverse=True))


_CLEAN_MARK = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + _PUNCTUATION)
_CLEAN_ENDS = re.compile(f"^[!-/:-@\\[-`{{-~{_PUNCTUATION}\\d]+|[!-/:-@\\[-`{{-~{_PUNCTUATION}\\d]+$")
_ASCII_ENDS = re.compile(r"^[!-@\[-`{-~]+|[!-@\[-`{-~]+$")


def looks_clean(word: str) -> bool:
    """Letters of one script, in one of the usual cases."""
    if not word or not word.isalpha():
        return False
    kinds = {script(c) for c in word}
    if len(kinds) != 1:
        return False
    if any("＀" <= c <= "￯" for c in word):
        return False
    if kinds == {"OTHER"}:
        return all(0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or ord(c) > 0x0530 for c in word)
    rest = word[1:]
    return word.islower() or rest.islower() or rest == "" or all(c.isupper() or c == "ß" for c in word)


def _without_marks(token: str) -> tuple[str, str, str]:
    """What is left of a token without punctuation, clean or garbled, at its ends; and these."""
    marks, sizes = _marks(), _mark_sizes()
    a, b = 0, len(token)
    while a < b:
        n = next((n for n in sizes if a + n <= b and token[a : a + n] in marks), int(token[a] in _CLEAN_MARK))
        if not n:
            break
        a += n
    while b > a:
        n = next((n for n in sizes if b - n >= a and token[b - n : b] in marks), int(token[b - 1] in _CLEAN_MARK))
        if not n:
            break
        b -= n
    return token[:a], token[a:b], token[b:]


def _pieces(token: str) -> list[tuple[str, bool]]:
    """The token and what is left of it without punctuation, clean or garbled, at its ends, and garbled punctuation
    itself; each with whether it may be clean text as it is."""
    plain = _ASCII_ENDS.sub("", token)
    bare = _CLEAN_ENDS.sub("", token)
    head, inner, tail = _without_marks(token)
    out = [bare or token, plain, _CLEAN_ENDS.sub("", inner)]
    marks = _marks()
    out += [form for form in (_ASCII_ENDS.sub("", head), _ASCII_ENDS.sub("", tail)) if form in marks and (len(form) > 1 or _C1_OR_LOST.search(form))]
    if not looks_clean(plain):
        if plain[:1] in marks:
            out.append(plain[1:])
        if plain[-1:] in marks:
            out.append(plain[:-1])
    whole = (not bare or bare.isascii() or looks_clean(bare)) and set(head + tail) <= _CLEAN_MARK  # clean but for clean punctuation at its ends
    return [(p, looks_clean(p) or (whole and p in (plain, bare))) for p in dict.fromkeys(out) if p and not p.isascii()]


def _non_ascii(c: Column) -> Column:
    return c.rlike("[^\\x00-\\x7F]")


_BLANK = re.compile("([ \\t\\r\\n]+)")


def tokens_of(values: DataFrame, value: str) -> DataFrame:
    """values with token: its distinct non-ASCII tokens, parted at ASCII blanks only, as others may be garbled letters."""
    own = values.where(_non_ascii(F.col(value)))
    return own.withColumn("token", F.explode(F.array_distinct(F.split(value, "[ \\t\\r\\n]+")))).where(_non_ascii(F.col("token")))


def _split_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, n, p, clean, looks_clean(p)) for t, n in zip(pdf["token"], pdf["n"]) for p, clean in _pieces(t)]
        yield pd.DataFrame(rows, columns=["token", "n", "piece", "clean", "word"])


def clean_words(pieces: DataFrame) -> DataFrame:
    """word, n: the distinct clean words, in the cases they may take, and the distinct characters of clean words."""
    own = pieces.where("word").groupBy(F.col("piece").alias("word")).agg(F.sum("n").alias("n"))
    cased = own.select(F.explode(F.array_distinct(F.array("word", F.lower("word"), F.upper("word"), F.initcap("word")))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    letters = own.select(F.explode(F.array_distinct(F.split("word", ""))).alias("word"), "n").where(_non_ascii(F.col("word"))).groupBy("word").agg(F.sum("n").alias("n"))
    marks = pieces.sparkSession.createDataFrame([(c, 1 << 40) for c in _PUNCTUATION if not c.isascii()], "word string, n bigint")
    return cased.where(F.length("word") > 1).unionByName(letters).unionByName(marks)


def _hash_place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS * 32768)) + 1


def _bitmap(pieces: DataFrame) -> bytes:
    """A bit for the hash of every piece: of one fixed size for any number of pieces."""
    own = pieces.select(_hash_place(F.col("piece")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(BUCKETS * 4096)
    for b, bits in own.collect():
        out[(b - 1) * 4096 : b * 4096] = bits
    return bytes(out)


def forms_of(words: DataFrame, bitmap: bytes) -> DataFrame:
    """piece, word, nw, chains: the garbled forms of all words that may be a piece of a token."""
    shared = words.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, mask, digest, half = shared.value, BUCKETS * 32768 - 1, xxhash.xxh64_intdigest, len(chains())
        for pdf in batches:
            rows = []
            for w, n in zip(pdf["word"], pdf["n"]):
                if w.isascii():
                    continue
                forms = _forms(w)
                for form in set(forms):
                    at = digest(form.encode("utf-8", "replace"), 42) & mask
                    if bits[at >> 3] & (1 << (at & 7)) and _tells(form, w):
                        rows.append((form, w, n, list(dict.fromkeys(i % half if i < 2 * half else i - half for i, f in enumerate(forms) if f == form))))
            yield pd.DataFrame(rows, columns=["piece", "word", "nw", "chains"])

    spread = words.repartition(4 * max(1, words.sparkSession.sparkContext.defaultParallelism), "word")
    return spread.mapInPandas(make, "piece string, word string, nw bigint, chains array<int>")


@lru_cache(maxsize=2)
def _letter_forms(letters: tuple[str, ...]) -> tuple[dict[str, int], int]:
    """Garbled forms of single characters that have two or more, or are controls: a bit for each chain that gives them;
    and the longest. Wide scripts take the chains of one step or two."""
    masks: dict[str, int] = {}
    n = len(chains())
    short = [i for i, chain in enumerate(chains()) if len(chain) <= 3 and chain[0] in ("utf-8", "shift_jis", "euc_jp")]
    for c in [*letters, *_PUNCTUATION]:
        images = _images(c)
        own: dict[str, int] = {}
        for i in short if _wide_script(c) else range(n):
            own[images[i]] = own.get(images[i], 0) | (1 << i)
        for form, mask in own.items():
            if (len(form) > 1 or "\x80" <= form <= "\x9f") and LOST not in form:
                masks[form] = masks.get(form, 0) | mask
    return masks, max(map(len, masks), default=0)


@lru_cache(maxsize=64)
def _stands(letters: tuple[str, ...], chain: int) -> dict[str, str]:
    """What a letter's form under a chain stands for."""
    return {_images(c)[chain]: c for c in [*_PUNCTUATION, *letters]}


@lru_cache(maxsize=2)
def _single_forms(letters: tuple[str, ...]) -> dict[str, tuple[str, int]]:
    """What a cell of several characters, or of a control, stands for by the simplest chain, and that chain."""
    table: dict[str, tuple[str, int]] = {}
    for c in [*letters, *_PUNCTUATION]:
        for form, own in garbled(c).items() if not _wide_script(c) else ():
            if (len(form) > 1 or _C1_OR_LOST.search(form)) and (form not in table or min(own) < table[form][1]):
                table[form] = (c, min(own))
    return table


def _by_letters(token: str, letters: tuple[str, ...]) -> tuple[str, int] | None:
    """The original of a token all of whose non-ASCII characters belong to garbled letters of one chain, and the chain."""
    masks, longest = _letter_forms(letters)
    whole = (1 << len(chains())) - 1
    reach = [0] * (len(token) + 1)
    reach[0] = whole
    for i, c in enumerate(token):
        own = reach[i]
        if not own:
            continue
        if c.isascii():
            reach[i + 1] |= own
        for n in range(1, min(longest, len(token) - i) + 1):
            mask = masks.get(token[i : i + n])
            if mask:
                reach[i + n] |= own & mask
    if not reach[-1]:
        return None
    chain = (reach[-1] & -reach[-1]).bit_length() - 1
    stands = _stands(letters, chain)
    out, at = [], len(token)
    while at:
        if reach[at - 1] >> chain & 1 and token[at - 1].isascii():
            at -= 1
            out.append(token[at])
            continue
        for n in range(1, min(longest, at) + 1):
            form = token[at - n : at]
            if reach[at - n] >> chain & 1 and masks.get(form, 0) >> chain & 1:
                out.append(stands[form])
                at -= n
                break
        else:
            return None
    return "".join(reversed(out)), chain


def _wide(token: str, known: frozenset[str]) -> tuple[str, int] | None:
    """UTF-8 taken for an encoding of several bytes a character, whose forms depend on the neighbours: where that gives
    clean characters only."""
    for i in range(len(chain_names()) - len(READ_WIDE), len(chain_names())):
        back = undo(token, i)
        if back is not None and not back.isascii() and all(c.isascii() or c in known for c in back):
            return back, i
    return None


def garbled_tokens(token_counts: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """fixes: token, and its pieces with their originals and chains (null where they can't be had), for the tokens
    (token, n) that hold wrongly decoded text; materialised. And the corpus's clean characters."""
    pieces = cut_lineage(token_counts.mapInPandas(_split_pieces, "token string, n bigint, piece string, clean boolean, word boolean"))
    words = cut_lineage(clean_words(pieces))
    forms = forms_of(words, _bitmap(pieces))
    per_piece = pieces.groupBy("piece").agg(F.sum("n").alias("np"), F.bool_or("clean").alias("clean"))
    more = F.length("piece") > F.length("word")
    lost = F.col("piece").contains(LOST)
    plain = ~F.col("clean") & (more | lost | F.col("piece").rlike(_EVIDENCE))
    rarer = (F.length("piece") >= 2) & (F.length("word") >= 2) & (F.col("nw") >= RARER * F.col("np"))
    matched = per_piece.join(forms, "piece").where(((F.length("piece") > 1) | F.col("piece").rlike(_EVIDENCE)) & (plain | rarer))
    best = matched.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct((-F.col("nw")).alias("n"), F.col("word").alias("original"), "chains"))).alias("c"))
    found = pieces.select("token", "piece").join(best, "piece").select("token", "piece", F.transform("c", lambda x: F.struct(x["original"].alias("original"), x["chains"].alias("chains"))).alias("originals"))

    # tokens without blanks between words, and words that the corpus has nowhere in their clean form: by characters
    letters = tuple(sorted(r["word"] for r in words.where(F.length("word") == 1).select("word").collect()))  # bounded by Unicode

    def by_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(letters) | frozenset(_PUNCTUATION)
        for pdf in batches:
            rows = []
            for token in pdf["token"]:
                got = _by_letters(token, letters) or _wide(token, known)
                if got is not None:
                    rows.append((token, token, [{"original": got[0], "chains": [got[1]]}]))
                elif _C1_OR_LOST.search(token):
                    rows.append((token, token, []))
            yield pd.DataFrame(rows, columns=["token", "piece", "originals"])

    rest = pieces.groupBy("token").agg(F.bool_or("clean").alias("clean")).where(~F.col("clean") | F.col("token").rlike(_EVIDENCE)).select("token").join(found.select("token").distinct(), "token", "left_anti")
    others = rest.mapInPandas(by_letters, "token string, piece string, originals array<struct<original string, chains array<int>>>")
    fixes = found.unionByName(others).groupBy("token").agg(F.array_sort(F.collect_set(F.struct("piece", "originals"))).alias("fixes"))
    return cut_lineage(fixes), letters


def _restore_line(value: str, fixes: dict[str, list], known: frozenset[str]) -> tuple[str, str | None]:
    """The value with its garbled tokens restored, by the chain that explains most of them.
    fixes: by token, its pieces with their originals and the chains of each."""
    of_token = {token: sorted({c for _, originals in own for _, of in originals for c in of}) for token, own in fixes.items()}
    votes = Counter(c for own in of_token.values() for c in own)
    ranked = {c: i for i, (c, _) in enumerate(sorted(votes.items(), key=lambda x: (-x[1], x[0])))}
    if not ranked:
        return value, None
    fits = lambda s: s is not None and all(c.isascii() or c in known for c in s)
    parts = _BLANK.split(value)
    loose = {p for p in parts if not p.isascii() and p not in fixes and not any(clean for _, clean in _pieces(p))}
    if all(p in fixes or p in loose or p.isascii() for p in parts):
        for c in ranked:
            if votes[c] == max(votes.values()):
                back = undo(value, c)
                if fits(back) and back != value:
                    return back, chain_names()[c]
    used: Counter = Counter()
    for i, p in enumerate(parts):
        if p not in fixes and p not in loose:
            continue
        for c in ranked if p in loose else sorted(of_token[p], key=ranked.__getitem__):
            back = undo(p, c)
            if fits(back) and back != p:
                parts[i] = back
                used[c] += 1
                break
        else:
            for piece, originals in sorted(fixes.get(p, []), key=lambda f: -len(f[0])):
                if originals and piece in parts[i]:
                    original, of = min(originals, key=lambda o: min(map(ranked.__getitem__, o[1])))
                    parts[i] = parts[i].replace(piece, original, 1)
                    used[min(of, key=ranked.__getitem__)] += 1
    return "".join(parts), chain_names()[used.most_common(1)[0][0]] if used else None


def _one_character(text: str) -> bool:
    return len(unicodedata.normalize("NFC", text)) == 1


def garbled_cells(textlines: DataFrame, chars: DataFrame, restore: bool = True) -> DataFrame:
    """cell_kind, cell_id, value, restored, chain: the cells with wrongly decoded characters, once each.
    Without restore only cell_kind and cell_id."""
    lines = tokens_of(textlines.select("cell_id", "orig"), "orig")
    fixes, letters = garbled_tokens(lines.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    cells = chars.select("cell_id", "text").where(_non_ascii(F.col("text")) & ((F.length("text") > 1) | F.col("text").rlike(_EVIDENCE)))
    cells = cells.join(broadcast_if_small(_garbled_characters(cells.select("text").distinct(), letters), MAX_BROADCAST_ROWS), "text")
    if not restore:
        found = [lines.join(broadcast_if_small(fixes.select("token"), MAX_BROADCAST_ROWS), "token").select(F.lit("textline").alias("cell_kind"), "cell_id"), cells.select(F.lit("char"), "cell_id")]
        return found[0].union(found[1]).distinct()
    hit = lines.join(broadcast_if_small(fixes, MAX_BROADCAST_ROWS), "token").dropDuplicates(["cell_id", "orig", "token"])
    line = hit.groupBy("cell_id", "orig").agg(F.collect_list(F.struct("token", "fixes")).alias("own"))

    def restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frozenset(letters) | frozenset(_PUNCTUATION)
        for pdf in batches:
            rows = [_restore_line(v, {o["token"]: [(f["piece"], [(x["original"], x["chains"].tolist()) for x in f["originals"]]) for f in o["fixes"]] for o in own}, known) for v, own in zip(pdf["orig"], pdf["own"])]
            yield pd.DataFrame({"cell_kind": "textline", "cell_id": pdf["cell_id"], "value": pdf["orig"], "restored": [r for r, _ in rows], "chain": pd.Series([c for _, c in rows], dtype=object)})

    kind = textlines.schema["cell_id"].dataType.simpleString()
    schema = f"cell_kind string, cell_id {kind}, value string, restored string, chain string"
    lines_out = line.mapInPandas(restored, schema)

    chars_out = cells.dropDuplicates(["cell_id", "text"])
    return lines_out.unionByName(chars_out.select(F.lit("char").alias("cell_kind"), "cell_id", F.col("text").alias("value"), "restored", "chain"))


def _garbled_characters(texts: DataFrame, letters: tuple[str, ...]) -> DataFrame:
    """text, restored, chain of the distinct texts that are the garbled form of one character; materialised."""

    def by_letter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _single_forms(letters)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                got = None if _one_character(text) and not _C1_OR_LOST.search(text) else table.get(text) or _by_letters(text, letters)
                if got is not None:
                    rows.append((text, got[0], chain_names()[got[1]]))
                elif _C1_OR_LOST.search(text):
                    rows.append((text, text, None))
            yield pd.DataFrame(rows, columns=["text", "restored", "chain"])

    return cut_lineage(texts.mapInPandas(by_letter, "text string, restored string, chain string"))


__all__ = ["chain_names", "chains", "clean_words", "garbled", "garbled_cells", "garbled_tokens", "looks_clean", "tokens_of", "undo"]
