import random
import unicodedata

import pytest

from pagewright.llm.canonical import canonical, canonical_text, changed_cells, may_change, unstable_class
from pagewright.llm.encoding import chain_names, garbled, garbled_cells, looks_clean, undo

CASES = [
    ("аttіc", "attic"),  # Cyrillic in a Latin word
    ("рrogram near", "program near"),
    ("Дoрога", "Дорога"),
    ("cɑfe", "cafe"),
    ("ﬁne ½ x² “q” – ™", "ﬁne ½ x² “q” – ™"),
    ("a\u200bb\u00adc\u2060", "abc"),
    ("a\u00a0b\u202fc\u3000d", "a b c d"),
    ("Ｎｅａｒ １２，ａ", "Near 12,a"),
    ("ｸ\uff9eﾗﾌ", "グラフ"),
    ("cafe\u0301 A\u0328D", "café ĄD"),
    ("e\u200b\u0301", "é"),
    ("x\u0304 = 3, ŷ", "x\u0304 = 3, ŷ"),
    ("\U0001f469\u200d\U0001f4bb ok", "\U0001f469\u200d\U0001f4bb ok"),
    ("сборка v4025 запущена", "сборка v4025 запущена"),
    ("Δt = 15 s", "Δt = 15 s"),
    ("дорога – 14 °C.", "дорога – 14 °C."),
    ("K", "K"),
    ("می\u200cروم", "می\u200cروم"),
    ("The сор near", "The cop near"),
    ("Новый договор cop и pacce готов", "Новый договор сор и рассе готов"),
    ("Да OK", "Да OK"),
    ("Новый договор cop и windows готов", "Новый договор cop и windows готов"),
    ("е\u0301tude", "étude"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_canonical(text, expected):
    assert canonical(text) == expected


def test_stable_stretches_are_not_normalized(monkeypatch):
    seen = []

    class Recorder:
        def __getattr__(self, name):
            return getattr(unicodedata, name)

        def normalize(self, form, text):
            seen.append(text)
            return unicodedata.normalize(form, text)

    monkeypatch.setattr("pagewright.llm.canonical.unicodedata", Recorder())
    text = "é stable " * 2000 + "cafe\u0301 Ａ" + " more stable ß" * 2000
    assert canonical(text) == "é stable " * 2000 + "café A" + " more stable ß" * 2000
    assert max(map(len, seen)) <= 3


def test_canonical_is_stable_and_composed():
    r = random.Random(2)
    pool = "aeo éàüß\u0301\u0308\u200b\u00a0Ａ１аоебвгλμν\u3000각가\U0001f469\u200dÅ"
    for _ in range(3000):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        once = canonical(s)
        assert canonical(once) == once and unicodedata.normalize("NFC", once) == once


def test_quick_check_lets_nothing_slip(spark):
    r = random.Random(4)
    pool = "abc éñ\u0301\u200b\u00a0Ａабαλա漢かが\u2009\ufeffıϲɑ"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 6))) for _ in range(3000)] + [chr(o) + "x" for o in range(0x80, 0x3100) if unicodedata.category(chr(o)) != "Cs"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    passed = [x.t for x in rows.where(~may_change("t")).collect()]
    assert passed and all(canonical(t) == t for t in passed)
    assert len(unstable_class()) > 100


def test_canonical_frame(spark):
    df = spark.createDataFrame([(1, "a\u200b", 1), (1, "a\u200b", 1), (2, None, 1), (3, "plain", 1), (None, "b\u00a0", 1)], "cell_id long, text string, canonical int")
    got = sorted((x.cell_id or 0, x.text or "", x.canonical or "") for x in canonical_text(df).collect())
    assert got == [(0, "b\u00a0", "b "), (1, "a\u200b", "a"), (1, "a\u200b", "a"), (2, "", ""), (3, "plain", "plain")]
    assert sorted((x.cell_id or 0) for x in changed_cells(df).collect()) == [0, 1]
    assert changed_cells(df.limit(0)).count() == 0


def test_garbled_forms():
    names = lambda word, form: [chain_names()[i] for i in garbled(word)[form]]
    assert names("é", "Ã©")[0] == "utf-8>cp1252" and "√©" in garbled("é") and "ÃƒÂ©" in garbled("é")
    assert "F�r" in garbled("Für") and garbled("plain") == {} and "�" not in garbled("é")
    assert looks_clean("Évêque") and looks_clean("ÉVÊQUE") and not looks_clean("ÃlÃ©") and not looks_clean("a½") and not looks_clean("")


def test_chains_of_two_and_three_steps():
    twice = "für".encode().decode("cp1252").encode().decode("cp1251")
    thrice = "für"
    for _ in range(3):
        thrice = thrice.encode().decode("cp1252")
    for form in (twice, thrice, "für".encode().decode("latin-1").encode().decode("cp437")):
        chain = garbled("für")[form][0]
        assert undo(form, chain) == "für"
    long = "übermäßig" * 9
    assert long.encode().decode("cp1252") in garbled(long)


def _tables(spark, lines, chars):
    t = spark.createDataFrame([(i, x, 0) for i, x in lines], "cell_id long, orig string, token int")
    c = spark.createDataFrame([("d", 1, i, i, x) for i, x in enumerate(chars)], "doc_key string, page_no int, cell_index long, cell_id long, text string")
    return t, c


def test_garbled_cells(spark):
    clean = [(i, x) for i, x in enumerate(["Für größere Brücke", "młąka świt żółw", "новый отчёт для", "“Tür” – Öffnung", "√2 ≈ π", "Þingið í", None, "", "Evening in town"] * 5)]
    bad = ["Für größere".encode().decode("cp1252"), "Brücke".encode("cp1252").decode("utf-8", "replace"), "świt żółw".encode("iso8859-2").decode("latin-1"), "отчёт".encode("cp1251").decode("cp1252"), "“Tür”".encode().decode("cp1252", "replace"), "Öffnung".encode("cp1252").decode("mac-roman"), "größere".encode().decode("cp1252").encode().decode("cp1252")]
    lines = clean + [(100 + i, x) for i, x in enumerate(bad)] + [(100, bad[0])]
    chars = list("Für Brücke") + [" "] + ["F", "Ã¼", "r", " ", "ﬁ", None, "½", "x", "Ðµ", "e\u0301", "ffi"]
    got = {(r.cell_kind, r.cell_id): r for r in garbled_cells(*_tables(spark, lines + [(200, "е ёж")], chars)).collect()}
    assert {i for k, i in got if k == "textline"} == {100 + i for i in range(len(bad))}
    assert got["textline", 100].restored == "Für größere" and got["textline", 102].restored == "świt żółw" and got["textline", 103].restored == "отчёт"
    assert got["textline", 106].restored == "größere" and got["textline", 105].restored == "Öffnung"
    assert {i for k, i in got if k == "char"} == {12, 19} and got["char", 12].restored == "ü" and got["char", 19].restored == "е"


def test_planted_lines_are_found_and_restored(spark):
    """Lines of a vocabulary, a tenth of them garbled, whole or in single words; quotes and units stay what they are."""
    r = random.Random(5)
    vocabulary = {
        "de": "für größere Brücke Straße Öffnung Prüfung über Wärme nötige schließt Zähler Kündigung Vorrat Lager".split(),
        "fr": "côté théâtre précède élève forêt crèche légère réseau hôtel facture de la".split(),
        "ru": "новый отчёт для прежний бюджет склад подтвердил журнал площадь и".split(),
        "pl": "żółty źródło świt mąka gęś późny książka łódź umowa przed".split(),
    }
    plain = [" ".join(r.choice(w) for _ in range(6)) for w in vocabulary.values() for _ in range(500)]
    plain = [f"“{x}”." if i % 4 == 0 else f"{x} – {i} °C" if i % 4 == 1 else x for i, x in enumerate(plain)]
    lines, true = [], {}
    for i, x in enumerate(plain):
        y = x
        if i % 10 == 0:
            chain = r.choice([("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "cp437")])
            for a, b in zip(chain[::2], chain[1::2]):
                data = y.encode(a)
                y = "".join(bytes([c]).decode(b, "replace").replace("\ufffd", chr(c)) for c in data)
        elif i % 10 == 1 and i % 4 > 1:
            words = x.split(" ")
            words = [w.encode().decode("latin-1") if j % 2 else w for j, w in enumerate(words)]
            y = " ".join(words)
        lines.append((i, y))
        if y != x:
            true[i] = x
    got = {x.cell_id: x.restored for x in garbled_cells(*_tables(spark, lines, [])).collect()}
    both = got.keys() & true.keys()
    assert len(both) >= 0.97 * len(true) and len(both) >= 0.97 * len(got)
    assert sum(got[i] == true[i] for i in both) >= 0.95 * len(true)


def test_inner_marks_and_words_that_stand_nowhere_else(spark):
    lines = [(1, "the tenant\x92s panel"), (2, "\x93The lamp\x94."), (3, "xÃ¼zÃ¼q"), (4, "ünique one"), (5, "Ã¼")] + [(10 + i, "ü z") for i in range(9)]
    got = {x.cell_id: x.restored for x in garbled_cells(*_tables(spark, lines, [])).collect()}
    assert got == {1: "the tenant’s panel", 2: "“The lamp”.", 3: "xüzüq", 5: "ü"}


def test_no_cells(spark):
    t, c = _tables(spark, [(1, "x")], ["a", "é", " ", None, "ü", "ü"])
    assert garbled_cells(t, c).count() == 0 and garbled_cells(t.limit(0), c.limit(0)).count() == 0
