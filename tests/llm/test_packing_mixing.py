import itertools
import os
import random

import pytest

from pagewright.llm.mixing import mix
from pagewright.llm.packing import containers, differencing, pack
from pagewright.llm.tokens import VOCABULARY, encoder

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def test_two_windows_known_case():
    assert sorted(sorted([4, 5, 6, 7, 8][i] for i in w) for w in differencing([4, 5, 6, 7, 8], 2)) == [[4, 5, 7], [6, 8]]


@pytest.mark.parametrize("seed", range(25))
def test_pack_keeps_all_within_capacity_and_near_the_least(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, r.randint(1, 100), r.randint(30, 60)]) for _ in range(r.randint(0, 60))]
    found = pack(sizes, 100)
    assert sorted(itertools.chain(*found)) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in found)
    fit: list[int] = []
    for s in sorted(sizes, reverse=True):  # first fit
        at = next((i for i, x in enumerate(fit) if x + s <= 100), None)
        if at is None:
            fit.append(s)
        else:
            fit[at] += s
    assert len(found) <= len(fit) * 1.25 + 1


@needs_vocabulary
def test_containers(spark):
    long = "many words stand here " * 1500
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "short text", 0), (4, "short text", 0), (None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    got = containers(df).collect()
    n = len(encoder()(long))
    mine = sorted((x for x in got if x.doc_id == 3), key=lambda x: x.piece_no)
    assert [x.token_start for x in mine] == list(range(0, n, 2048)) and mine[-1].token_end == n
    assert len(got) == 5 + len(mine) and sum(x.n_tokens for x in got if x.doc_id == 4) == 2 * len(encoder()("short text"))
    per = {}
    for x in got:
        per[x.container_id] = per.get(x.container_id, 0) + x.n_tokens
    assert max(per.values()) <= 2048
    assert containers(df.limit(0)).count() == 0


@needs_vocabulary
def test_mix_shares_and_repeats(spark):
    r = random.Random(5)
    rows = [(i, s, "word " * r.randint(1, 40)) for i, s in enumerate(r.choices(["big", "small", "none", None], [70, 10, 10, 10], k=4000))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, targets)
    rep = {x.source: x for x in report.collect()}
    assert abs(rep["big"].actual_share - 0.5) < 0.005 and abs(rep["small"].actual_share - 0.5) < 0.005
    assert rep["absent"].used_tokens == 0
    uses = {x.doc_id: x.uses for x in chosen.collect()}
    assert max(uses.values()) <= 3 and all(rows[i][1] in ("big", "small") for i in uses)
    assert rep["small"].used_tokens >= 2.99 * rep["small"].tokens  # the binding source is used up
    fewer = {x.source: x for x in mix(df, targets, mix_tokens=3000)[1].collect()}
    assert abs(fewer["big"].used_tokens - 1500) < 45
    assert mix(df.limit(0), targets)[0].count() == 0
