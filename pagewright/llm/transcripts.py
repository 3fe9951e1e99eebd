"""Transcript segments into clean, ordered speaker turns.

Every segment is parsed by the grammar of peg.py; the tree gives its spoken words, its cleaned utterance, its sound
notes and what may be a speaker label. A label that could also be speech ("Note:") counts only where its name is a
speaker of the recording. Turns are stretches of one speaker over the segments with words, in order of start time.

Defined results: segments with null audio_key, start_time or segment_id have no place in an order and give no turn.
A segment that stands in the table again at the same time counts once. Null, blank and wordless text belongs to no turn
and ends none.
Equal start times are ordered by segment_id. Words before any named speaker form turns whose speaker is null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import peg
from pagewright.llm.sequences import in_order
from pagewright.session import broadcast_if_small, cut_lineage, spread

MAX_BROADCAST_ROWS = 200_000

_TITLES = frozenset("the dr mr mrs ms miss prof professor sir herr frau m mme mlle monsieur madame sr sra srta don doña le la el der die".split())
_NUMBERED = re.compile(r"^(?:speaker|spkr|spk|s|sprecher|locuteur|intervenant|hablante|orador|participant|voice|channel)? ?0*(\d+)$")
#: Heads of sentences that look like labels.
_HEADS = frozenset("note nota hinweis question pregunta frage remarque observación achtung attention warning example punkt point punto item".split())
_ROLES = frozenset("interviewer guest moderator host chair chairman chairwoman chairperson operator agent caller customer client narrator presenter reporter doctor patient teacher student interviewee gast moderatorin kunde anrufer invité animateur entrevistador invitado moderador".split())


def speaker_key(name: str | None) -> str | None:
    """One key for all spellings of a name or number: case, blanks, titles, "Last, First", underscores, zeros."""
    if name is None:
        return None
    s = re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", name).casefold()).strip()
    if not s:
        return None
    if m := _NUMBERED.match(s):
        return f"#{m.group(1)}"
    words = [w for w in s.split() if w not in _TITLES] or s.split()
    return " ".join(sorted(words))


def _label(kind: str, name: str, rest: str) -> tuple[str | None, bool]:
    """The key, and whether the label is beyond doubt."""
    key = speaker_key(name)
    if key is None:
        return None, False
    words = [w for w in re.split(r"[\s_,]+", name) if w]
    low = [w.casefold().strip(".") for w in words]
    if kind in ("sure", "round") or key.startswith("#"):
        return key, True
    if any(w in _HEADS for w in low):
        return key, False
    if key in _ROLES:
        return key, True
    shouted = name.isupper() and not any(c.islower() for c in rest)  # then capitals tell nothing
    return key, len(words) >= 2 and all(w[0].isupper() for w in words) and not shouted


#: What read_segment gives where there is nothing to read.
_NOTHING = (None, False, "", "", "", "", "")


def read_segment(text: str | None) -> tuple[str | None, bool, str, str, str, str, str]:
    """label_key, label_sure, label_words, label_said of a label at the head; words, said, notes of what follows it.
    Words are joined by blanks, notes by tabs."""
    if text is None or not text.strip():
        return _NOTHING
    head, found, at = peg.parse(text)
    (_, _, end, nodes), _ = peg.body(text, at)
    assert end == len(text)
    words, notes, said = [], [], []
    for kind, a, b, _ in [*head, *nodes] if head else nodes:
        if kind == "speech":
            said.append(text[a:b])
            words += peg.WORD.findall(text, a, b)
        elif kind == "note":
            notes.append(_folded(" ".join(peg.WORD.findall(text, a, b))))
        elif kind in ("space", "filler", "stamp"):
            said.append(" ")
    key, sure, own, shown = None, False, "", ""
    if found is not None:
        key, sure = _label(found[0][0], found[1], text[at:])
        (_, a, b, _), shown = found
        spoken = " ".join(text[a + x : a + y] for kind, x, y, _ in peg.body(text[a:b], 0)[0][3] if kind in ("speech", "note"))
        own = _folded(" ".join(peg.WORD.findall(spoken)))
        if found[0][0] == "square" and not sure:  # a note, unless the recording has such a speaker
            notes, own = [own, *notes], ""
    clean = _TIGHT.sub(r"\1", " ".join("".join(said).split())).lstrip(",;:. ")
    return key, sure, own, shown, _folded(" ".join(words)), clean, "\t".join(n for n in notes if n)


def _folded(words: str) -> str:
    return words.lower() if words.isascii() else unicodedata.normalize("NFC", words).casefold()


_TIGHT = re.compile(r"\s+([,.;:!?…])")
_READ = "label_key string, label_sure boolean, label_words string, label_said string, words string, said string, notes string, voice_key string"
_NAMES = [c.split()[0] for c in _READ.split(", ")]


def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    voice_keys: dict = {None: None}
    for texts, voices in batches:
        if len(voice_keys) > 200_000:
            voice_keys = {None: None}
        keys = []
        for v in voices:
            if v not in voice_keys:
                voice_keys[v] = speaker_key(v)
            keys.append(voice_keys[v])
        columns = zip(*map(read_segment, texts)) if len(texts) else [()] * 7
        yield pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(_NAMES, [*columns, keys])})


def read_segments(df: DataFrame) -> DataFrame:
    """audio_key, segment_id, start_time, end_time, words, said, notes, speaker_key, speaker_name: one row per row of df
    that has a place in an order. words are joined by blanks, notes by tabs. Parsed once, into a table."""
    own = df.select("audio_key", "segment_id", "start_time", "end_time", "text", "voice").where("audio_key is not null and segment_id is not null and start_time is not null")
    read = cut_lineage(spread(own).withColumn("r", F.pandas_udf(_read, _READ)("text", "voice")).select("audio_key", "segment_id", "start_time", "end_time", F.trim("voice").alias("voice"), "r.*"))
    # a label that could be speech, where the recording has such a speaker: one row per recording and name
    name = ["audio_key", "label_key"]
    doubtful = read.where("label_key is not null and not label_sure").select(*name).distinct()
    sure = read.select("audio_key", F.explode(F.array(F.when(F.col("label_sure"), F.col("label_key")), F.col("voice_key"))).alias("label_key")).where("label_key is not null").distinct()
    known = broadcast_if_small(cut_lineage(doubtful.join(sure, name, "left_semi")).withColumn("label_known", F.lit(True)), MAX_BROADCAST_ROWS)
    read = read.join(known, name, "left").withColumn("labelled", F.coalesce(F.col("label_sure") | F.col("label_known"), F.lit(False)))
    return read.select(
        "audio_key",
        "segment_id",
        F.col("start_time").cast("double").alias("start_time"),
        F.col("end_time").cast("double").alias("end_time"),
        F.when(F.col("labelled"), F.col("words")).otherwise(F.trim(F.concat_ws(" ", "label_words", "words"))).alias("words"),
        F.when(F.col("labelled") | (F.col("label_words") == ""), F.col("said")).otherwise(F.concat_ws(": ", "label_said", "said")).alias("said"),
        "notes",
        F.coalesce("voice_key", F.when(F.col("labelled"), F.col("label_key"))).alias("speaker_key"),
        F.when(F.col("voice_key").isNotNull(), F.col("voice")).otherwise(F.when(F.col("labelled"), F.col("label_key"))).alias("speaker_name"),
    )


def usable_end() -> Column:
    return F.greatest(F.coalesce("end_time", "start_time"), F.col("start_time"))


def _turn_parts(rows: Iterator[tuple], partition: int) -> Iterator[tuple]:
    """The stretches of one speaker in a partition's rows. Those that may go on across the partition's edges are marked:
    its first, the one behind a first without a name, and its last. opens: whether it begins a turn whatever stands before."""
    part: list | None = None
    texts: list[str] = []
    key = who = name = last_id = last_start = None
    n = 0
    fresh = edge = False

    def closed(tail: bool) -> tuple:
        return (partition, n, key, edge or tail, fresh, who, name, *part, " ".join(t for t in texts if t))

    for k, start, sid, stop, speaker, shown, said, words in rows:
        if k == key and sid == last_id and start == last_start:
            continue  # delivered again
        if part is None or k != key or not (speaker is None or speaker == who):
            nameless_first = part is not None and n == 0 and who is None and k == key
            if part is not None:
                yield closed(False)
                n += 1
            fresh = part is not None and not nameless_first
            edge = part is None or nameless_first
            part, texts, key, who, name = [sid, sid, start, stop, 0, 0], [], k, speaker, shown
        elif name is None:
            name = shown
        last_id, last_start = sid, start
        part[1] = sid
        part[3] = max(part[3], stop)
        part[4] += 1
        part[5] += words
        texts.append(said)
    if part is not None:
        yield closed(True)


_PARTS = "partition int, n bigint, audio_key string, edge boolean, opens boolean, speaker_key string, name string, first_segment_id bigint, last_segment_id bigint, start_time double, end_time double, segments bigint, n_words bigint, text string"


def _join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edge parts of one recording, at most three a partition, put together into turns."""
    pdf = pdf.sort_values(["partition", "n"], kind="stable").astype(object).where(lambda x: x.notna(), None)
    turns: list[dict] = []
    for row in pdf.to_dict("records"):
        if turns and not row["opens"] and (row["speaker_key"] is None or row["speaker_key"] == turns[-1]["speaker_key"]):
            t = turns[-1]
            t["last_segment_id"] = row["last_segment_id"]
            t["end_time"] = max(t["end_time"], row["end_time"])
            t["segments"] += row["segments"]
            t["n_words"] += row["n_words"]
            t["name"] = row["name"] if t["name"] is None else t["name"]
            t["text"] = " ".join(x for x in (t["text"], row["text"]) if x)
        else:
            turns.append(row)
    return pd.DataFrame(turns, columns=pdf.columns)


def speaker_turns(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """audio_key, first_segment_id, last_segment_id, speaker_key, speaker, start_time, end_time, segments, n_words, text.
    end_time is the latest usable end of the turn's segments, at least the last start."""
    said = read_segments(df).where("words <> ''")
    n_words = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    rows = said.select("audio_key", "start_time", "segment_id", usable_end().alias("end_time"), "speaker_key", "speaker_name", "said", n_words.alias("n_words"))
    parts = cut_lineage(in_order(rows, ["audio_key", "start_time", "segment_id"], _turn_parts, _PARTS, partitions))
    turns = parts.where(~F.col("edge")).unionByName(parts.where("edge").groupBy("audio_key").applyInPandas(_join_parts, _PARTS))
    return turns.select("audio_key", "first_segment_id", "last_segment_id", "speaker_key", F.coalesce("name", "speaker_key").alias("speaker"), "start_time", "end_time", "segments", "n_words", "text")
