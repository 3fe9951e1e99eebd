import random
import time

import pytest

from pagewright.llm import peg
from pagewright.llm.runs import repeated_runs
from pagewright.llm.sequences import in_order
from pagewright.llm.transcripts import read_segment, speaker_key, speaker_turns

SCHEMA = "segment_id long, audio_key string, start_time double, end_time double, text string, voice string, speaker_key int"


@pytest.mark.parametrize(
    "names",
    [
        ("SPEAKER_01", "spk_1", "S1", "Spkr 1", "SPK-01", " speaker 1 ", "Speaker 1"),
        ("Dr. Ada Lovelace", "ada_lovelace", "ADA  LOVELACE", "Lovelace, Ada", "Ada Lovelace "),
        ("The Guest", "guest.", "GUEST"),
    ],
)
def test_spellings_of_a_speaker(names):
    assert len({speaker_key(n) for n in names}) == 1
    assert speaker_key("S1") != speaker_key("S2") and speaker_key(" ") is None and speaker_key(None) is None


@pytest.mark.parametrize(
    "text,label,words,notes",
    [
        ("[00:01:02] (SPEAKER_03): Um, so it is. (laughter)", "#3", "so it is", ["laughter"]),
        ("<v Ada Lovelace> at 9:15 the [loud [door] slams] train", "ada lovelace", "at 9 15 the train", ["loud door slams"]),
        (">> S2: well", "#2", "well", []),
        ("Ada Lovelace - 00:00:12 --> yes", "ada lovelace", "yes", []),
        ("She left it (the minor one) there", None, "she left it the minor one there", []),
        ("Uh, um...", None, "", []),
        ("((coughs)) ♪ music ♪", None, "", ["coughs", "music"]),
        ("I you know, left er... early", None, "i left early", []),
        (None, None, "", []),
        ("  ", None, "", []),
        ("[unclosed", None, "unclosed", []),
        ("[" * 500, None, "", []),
        ("[crowd noise ×12 " + "and more " * 40 + "] hello", None, "hello", [" ".join(["crowd noise 12"] + ["and more"] * 40)]),
        ("[" * 40 + "a" + "]" * 40 + " b", None, "b", ["a"]),
        ("*" + "far " * 30 + "* (" + "so " * 30 + "long) ♪" + "la " * 90 + "♪ yes", None, "yes", [" ".join(["far"] * 30), " ".join(["so"] * 30 + ["long"]), " ".join(["la"] * 90)]),
        ("(engine revving) hello", None, "hello", ["engine revving"]),
        ("We left. (engine revving) It was late.", None, "we left it was late", ["engine revving"]),
        ("She left um... (the old one) here", None, "she left the old one here", []),
        ("a [b (c] d) [[x]]", None, "a d", ["b c", "x"]),
        ("Ada Byron Augusta King Noel Lovelace: yes", "ada augusta byron king lovelace noel", "yes", []),
    ],
)
def test_grammar(text, label, words, notes):
    key, sure, _, _, spoken, _, noted = read_segment(text)
    assert (key if sure else None) == label
    assert spoken == words and [n for n in noted.split("\t") if n] == notes


def test_grammar_covers_every_text():
    r = random.Random(1)
    pool = "[]<>(){}*♪:-0123 .,abcü SPEAKER_1\n"
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 30)))
        read_segment(t)
        _, _, at = peg.parse(t)
        assert peg.body(t, at)[0][2] == len(t)


def test_marks_of_any_number_are_read_in_linear_time():
    for text in ("[" * 50_000, "[ " * 50_000 + "]", "((" * 25_000 + "))" * 25_000, "([{<" * 12_500 + ")" * 100, "* " * 50_000):
        t = time.perf_counter()
        read_segment(text)
        assert time.perf_counter() - t < 10


def test_heads_that_are_no_labels():
    for text in ("Note: the lamp is here.", "Two things: first this.", "TWO THINGS: FIRST THIS.", "I went home - then slept"):
        _, sure, own, *_ = read_segment(text)
        assert not sure and own


def turns(spark, rows, partitions=None):
    df = spark.createDataFrame([(i, "a", float(s), float(s) + 1, t, v, 0) for i, s, t, v in rows], SCHEMA)
    return [(r.first_segment_id, r.last_segment_id, r.speaker_key) for r in sorted(speaker_turns(df, partitions).collect(), key=lambda r: r.start_time)]


def test_turns(spark):
    rows = [(1, 0, "hello", None), (2, 5, "hi", "S1"), (3, 950, "[music]", "S2"), (4, 2000, "more", None), (5, 2001, "Um.", "S2"), (6, 2002, "SPEAKER_01 - yes", None), (7, 9000, "no", "spk_2"), (7, 9000, "no", "spk_2"), (8, 9001, "note: x", None), (9, 9002, None, None)]
    assert turns(spark, rows) == [(1, 1, None), (2, 6, "#1"), (7, 8, "#2")]


@pytest.mark.parametrize("partitions", [1, 3, 40, 300])
def test_turns_against_a_plain_walk(spark, partitions):
    r = random.Random(7)
    rows, at, expected, who, seen = [], 0.0, [], None, False
    for i in range(400):
        at += r.choice([1.0, 3.0, 700.0])
        v, t = r.choice([None, "S1", "spk_2", "Speaker 3"]), r.choice(["words here", "[beep]", "", None])
        rows.append((i, at, t, v))
        if t == "words here":
            now = speaker_key(v) or who
            if not seen or now != who:
                expected.append([i, i, now])
            expected[-1][1] = i
            who, seen = now, True
    r.shuffle(rows)
    assert turns(spark, rows, partitions) == [tuple(x) for x in expected]


def runs(spark, texts, gap=2.0, partitions=None):
    df = spark.createDataFrame([(i, "a", i * gap, i * gap + 1, t, None, 0) for i, t in enumerate(texts)], SCHEMA)
    return sorted((r.first_segment_id, r.last_segment_id, r["count"]) for r in repeated_runs(df, partitions=partitions).collect())


@pytest.mark.parametrize("partitions", [1, 2, 7, 60, 200])
def test_runs_against_a_plain_walk(spark, partitions):
    """Whatever the stretches are, down to one segment each: runs with and without slips, broken by other text."""
    r = random.Random(3)
    texts, expected = [], []
    for i in range(40):
        own = r.choice(["see the granite now", "[beep]", "please wait here", f"item {i}", None])
        n = r.choice([1, 1, 2, 3, 9])
        if own and n > 1:
            expected.append((len(texts), len(texts) + n - 1, n))
        slipped = [own.replace("granite", "grantie") if own and j % 3 == 1 else own for j in range(n)]
        texts += [*slipped, f"between {i} one"]
    assert runs(spark, texts + ["granite here"] * 1, partitions=partitions) == expected


def test_a_sequence_that_holds_all_rows_is_spread(spark):
    df = spark.range(8000).selectExpr("'a' AS k", "CAST(id % 4000 AS DOUBLE) AS t", "id")
    got = in_order(df, ["k", "t", "id"], lambda rows, p: iter([(p, sum(1 for _ in rows))]), "p int, n bigint", 16).collect()
    assert sum(r.n for r in got) == 8000 and max(r.n for r in got) <= 1000


def test_runs(spark):
    filler = ["lamp one", "barn two", "please wait there"] * 15
    texts = ["Please wait.", "please  WAIT!", "[00:01] Um, please wait", "S1: plaese wait", "please wiat", "Item 1", "Item 2", None, None, "x", None, "x", "[beep]", "(beep)", "<Beep>", "Hmm.", "Hmm.", "one lamp", "one barn"]
    assert runs(spark, texts + filler) == [(0, 4, 5), (12, 14, 3)]


def test_slips_at_any_frequency(spark):
    """One slip beside its word, which 1 to 1000 segments hold; words that also stand elsewhere, or are too far apart, are others."""
    words = {"granite": 1, "lantern": 5, "compass": 6, "cuelgue": 9, "violine": 10, "meadows": 1000}
    texts, expected = [], []
    for w, n in words.items():
        expected.append((len(texts), len(texts) + 1, 2))
        texts += [f"hold the {w}", f"hold the {w[:2]}{w[3]}{w[2]}{w[4:]}"] + [f"{w} {x}" for x in range(n - 1)]
    expected.append((len(texts), len(texts) + 1, 2))
    texts += ["see maedows now", "see meadosw now"]
    texts += ["near camión", "near cañón", *[x for i in range(6) for x in (f"{i} camión up", f"{i} down cañón here")], "ask señal", "ask sesión", "end"]
    assert runs(spark, texts) == expected


def test_runs_far_apart(spark):
    assert runs(spark, ["a b c"] * 7 + ["d"] + ["a b c"] * 2, gap=800.0) == [(0, 6, 7), (8, 9, 2)]


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a", 1.0, 1.0, "x", None, 0), (1, None, 1.0, 1.0, "x", None, 0), (2, "a", None, 1.0, "x", None, 0), (3, "a", 1.0, None, "x", None, 0), (4, "a", 1.0, -5.0, "x", None, 0)], SCHEMA)
    got = repeated_runs(df).collect()
    assert [(r.first_segment_id, r.last_segment_id, r.start_time, r.end_time, r.duration) for r in got] == [(3, 4, 1.0, 1.0, 0.0)]
    assert speaker_turns(df).count() == 1 and speaker_turns(df.limit(0)).count() == 0 and repeated_runs(df.limit(0)).count() == 0
