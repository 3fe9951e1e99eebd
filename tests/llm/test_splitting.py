import random

import pytest

from pagewright.llm.splitting import cut_points, split_texts


def greedy(text, limit, overlap):
    """One cut after the other, over every position."""
    import re

    word = {m.end() for m in re.finditer(r"\s+|[、，・]|(?<=\w)[-–—/](?=\w)", text)}
    strong = {m.end() for m in re.finditer(r"[.!?…;:]+[\"'”’»)\]]*\s+|[。！？；]+[」』）”]*|\n+", text)}
    natural = {0} | word | strong | {len(text)}
    out, start, end = [], 0, 0
    while True:
        stop = start + limit
        if stop >= len(text):
            return [*out, (start, len(text))]
        far = [x for x in strong if end < x <= stop and x - start >= limit // 2] or [x for x in natural if end < x <= stop] or [stop]
        end_ = max(far)
        out.append((start, end_))
        inside = [x for x in natural if end_ - overlap <= x < end_]
        start, end = (min(inside) if inside else end_ - overlap), end_


@pytest.mark.parametrize("seed", range(40))
def test_against_one_cut_after_the_other(seed):
    r = random.Random(seed)
    alphabet = "abcdefg" + " " * r.choice([0, 1, 3]) + r.choice(["", ".,\n", "。、é"])
    text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 900)))
    limit = r.choice([40, 100, 320])
    assert [x[:2] for x in cut_points(text, limit, 12)] == greedy(text, limit, 12)


def test_pieces_cover_the_text_and_overlap():
    text = ("word " * 50 + "end. ") * 7 + "x" * 900 + " tail"
    cuts = cut_points(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(cuts, cuts[1:]):
        assert 0 < e - s <= 320 and e - 40 <= s2 < e < e2


def test_marks_stay_with_their_letter():
    cuts = cut_points("é" * 400)
    assert all(e % 2 == 0 for _, e, _ in cuts)


def test_frame(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "short", 7), (4, "ab " * 200, 7), (4, "ab " * 200, 7), (5, "𝒳" * 321, 7)]
    df = spark.createDataFrame(rows, "id int, text string, piece int")
    got = split_texts(df).collect()
    by = lambda i: sorted((x for x in got if x.id == i), key=lambda x: x.piece_no)
    assert [x.piece for x in by(1)] == [None] and [x.piece for x in by(2)] == [""] and [x.piece for x in by(3)] == ["short"]
    assert len(by(4)) == 6 and by(4)[0].piece == "ab " * 106
    assert len(by(5)) == 2 and len(by(5)[0].piece) == 320
    assert split_texts(df.limit(0)).count() == 0
