"""Documents into containers of fixed capacity by Karmarkar-Karp multiway differencing.

Documents are spread by hash over blocks of about BLOCK items. In a block every item begins as a partial partition of
k windows, one of which holds it; the two partitions of greatest imbalance merge again and again, the fullest windows
of one with the emptiest of the other, until one is left. k starts at what the block's tokens need at least and rises
while windows over the capacity, taken apart together with the emptiest, can't be filled again within it. Only documents over the capacity are cut, into full pieces and a last one; a full
piece has a container of its own, the last one is packed like a document.

Defined results: null and empty texts have 0 tokens and are packed too. Repeated doc_ids are items of their own.
Items of equal size are ordered by doc_id, so the result doesn't depend on the order of rows. An empty table gives none.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import VOCABULARY, token_sizes
from pagewright.session import by_key, cut_lineage

CAPACITY, BLOCK = 2048, 256


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The items (by index) of each of so many windows, with sums as equal as differencing makes them."""
    if not sizes:
        return [[] for _ in range(windows)]
    heap: list[tuple] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        heap.append((-sizes[i], i, [sizes[i]] + [0] * (windows - 1), [[i]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        merged = [(x + y, j) for j, (x, y) in enumerate(zip(a, reversed(b)))]  # both are in falling order
        merged.sort(key=lambda m: -m[0])
        low = merged[-1][0]
        last = windows - 1
        items = [ia[j] + ib[last - j] for _, j in merged]
        heapq.heappush(heap, (low - merged[0][0], at, [s for s, _ in merged], items))
        at += 1
    return heap[0][3]


def _settle(sizes: list[int], found: list[list[int]], capacity: int) -> list[list[int]] | None:
    """The windows, where those over the capacity and as many of the emptiest are taken apart and their items put, the
    largest first, where they fit best; None if an item fits nowhere."""
    sums = [sum(sizes[i] for i in w) for w in found]
    over = sum(n > capacity for n in sums)
    if not over:
        return found
    order = sorted(range(len(found)), key=lambda w: -sums[w])
    loose = {*order[:over], *order[-over:]}
    windows = [[] if w in loose else own for w, own in enumerate(found)]
    room = sorted((capacity - (0 if w in loose else n), w) for w, n in enumerate(sums))
    for i in sorted((i for w in loose for i in found[w]), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            return None
        left, w = room.pop(at)
        windows[w] = [*windows[w], i]
        bisect.insort(room, (left - sizes[i], w))
    return windows


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most the capacity; every size must be at most that."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        settled = _settle(sizes, found, capacity)
        if settled is not None:
            return [w for w in settled if w]
        windows += 1


def pieces_of(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece_no, token_start, token_end, n_tokens: documents, and the pieces of those over the capacity."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(capacity).cast("bigint"))
    e = sized.select("doc_id", F.col("n_tokens").alias("_all"), F.posexplode(starts).alias("piece_no", "token_start"))
    end = F.least(F.col("_all"), F.col("token_start") + capacity)
    return e.select("doc_id", "piece_no", "token_start", end.alias("token_end"), (end - F.col("token_start")).alias("n_tokens"))


def containers(documents: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, vocabulary: str = VOCABULARY) -> DataFrame:
    """container_id, doc_id, piece_no, token_start, token_end, n_tokens: one row per document or piece.
    One shuffle, of the ids and sizes only."""
    sized = cut_lineage(token_sizes(documents, vocabulary=vocabulary))  # ids and sizes: texts are read and tokenized once
    blocks = max(1, -(-sized.count() // block))
    pieces = pieces_of(sized, capacity)
    pieces = pieces.withColumn("block", F.when(F.col("n_tokens") < capacity, F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks))))
    full = pieces.where("block is null").select(F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no", "token_start", "token_end", "n_tokens")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        name = [""] * len(pdf)
        for w, items in enumerate(pack(pdf["n_tokens"].tolist(), capacity)):
            for i in items:
                name[i] = f"{pdf['block'].iat[0]}-{w}"
        return pdf.drop(columns="block").assign(container_id=name)[["container_id", "doc_id", "piece_no", "token_start", "token_end", "n_tokens"]]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    rest = by_key(pieces.where("block is not null"), "block").groupBy("block").applyInPandas(fill, f"container_id string, doc_id {kind}, piece_no int, token_start bigint, token_end bigint, n_tokens bigint")
    return full.unionByName(rest)
