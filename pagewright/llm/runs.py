"""Repeated consecutive segments collapsed into one row per run.

Two neighbours say the same if their words are equal after the transcript grammar has taken off speaker names,
hesitation, time marks and sound notes, or differ only by slips. Without words, the same sound notes are the same.
Numbers must be equal.

Two words up to two edits apart are a slip and its word if the rarer hardly stands anywhere but beside the other: the
segments that hold it elsewhere are at most RARE_SHARE of those that hold the other, whatever the size of the corpus.
Two words up to four edits apart are two slips of one word of the corpus, from which each is one letter dropped, added,
changed or swapped apart, if both hardly stand anywhere but beside such words.

Segments are walked in order, in stretches of the order of all segments (sequences.py). What is equal to the one before
is collapsed on the way, and a boundary tells the place where each run starts. Where slips must decide, the walk marks
the two parts and their different words; the marks, a few percent of the segments, are decided by joins on words.

Defined results: null, blank and merely hesitant segments are never in a run and end one. Segments with null
audio_key, start_time or segment_id are left out; a segment that stands in the table again at
the same time counts once. Equal start
times are ordered by segment_id. The end of a run is the latest usable end_time of its segments, its last start at least.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.sequences import in_order
from pagewright.llm.transcripts import read_segments, usable_end
from pagewright.session import cut_lineage

#: The segments that hold a slip away from the word it stands for are at most this share of those that hold the word.
RARE_SHARE = 0.1
#: What a pair of words may be apart at most: two slips of one word, of two letters each.
_MOST = 4


def _distance(x: str, y: str, most: int = _MOST) -> int:
    """Edits between two words, or more than most."""
    if abs(len(x) - len(y)) > most:
        return most + 1
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        if min(row) > most:
            return most + 1
    return row[-1]


def _near(a: str | None, b: str | None) -> list[tuple[str, str]] | None:
    """The pairs of different words of two texts if these may be slips; None where the texts can't be the same."""
    if not a or not b:
        return None
    if a == b:
        return []
    if a[0] == "♪" or b[0] == "♪" or abs(len(a) - len(b)) > 2 * _MOST:
        return None
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return None
    pairs = [(v, w) for v, w in zip(x, y) if v != w]
    if len(pairs) > 2:
        return None
    for v, w in pairs:
        if min(len(v), len(w)) < 3 or any(c.isdigit() for c in v + w) or _distance(v, w) > _MOST:
            return None
    return pairs


def _pairs(found: list | None, at_x: int, at_y: int) -> list[dict] | None:
    return None if found is None else [{"x": x, "y": y, "at_x": at_x, "at_y": at_y} for x, y in found]


def _links(now: tuple, one: tuple | None, two: tuple | None) -> tuple:
    """sure, d1, d2, d12 of a segment (sig, id) after one, after two before it: whether it is equal to the one before,
    and the differences of which slips decide. False and all None: it starts anew."""
    d1 = _near(now[0], one[0]) if one else None
    if d1 == []:
        return True, None, None, None
    d2 = _near(now[0], two[0]) if two else None
    d12 = _near(one[0], two[0]) if d2 is not None else None
    if d12 is None:
        d2 = None
    return False, _pairs(d1, now[1], one and one[1]), _pairs(d2, now[1], two and two[1]), _pairs(d12, one and one[1], two and two[1])


_SAME = "array<struct<x string, y string, at_x bigint, at_y bigint>>"
_LINKS = f"sure boolean, d1 {_SAME}, d2 {_SAME}, d12 {_SAME}"
_PARTS = f"partition int, n bigint, stretch bigint, kind string, head int, tail boolean, audio_key string, first_segment_id bigint, last_segment_id bigint, start_time double, end_time double, count bigint, text string, sig_1 string, sig_2 string, id_2 bigint, {_LINKS}"


def _run_parts(rows: Iterator[tuple], partition: int) -> Iterator[tuple]:
    """Parts: neighbours in a partition that are surely the same. kind is run for a whole run, part for one whose
    neighbours in its stretch may belong to it, edge for what stands at the partition's edges. The first two segments of
    the partition's first recording are parts of their own (head), as they may go on from the partition before."""
    part: list | None = None  # key, first id, last id, start, end, count, text
    link: tuple = ()
    key = first_key = last_id = last_start = None
    n = stretch = in_stretch = at = 0
    head: int | None = None
    one: tuple | None = None
    two: tuple | None = None
    firsts: list[tuple] = []

    def closed(tail: bool, alone: bool) -> tuple:
        whole = alone and in_stretch == 1 and head is None and not tail
        return (partition, n, stretch, "run" if whole else "part", head, tail, *part, None, None, None, *link)

    for k, start, sid, stop, said, sig in rows:
        if k == key and sid == last_id and start == last_start:
            continue  # delivered again
        last_id, last_start = sid, start
        if k != key:
            one = two = None
            at = 0
            if key is None:
                first_key = k
        now = (sig, sid)
        mine = at if k == first_key and at < 2 else None
        if mine is not None:
            firsts.append(now)
        new = _links(now, one, two)
        if part is not None and new[0] and mine is None and head is None:
            part[2] = sid
            part[4] = max(part[4], stop)
            part[5] += 1
        else:
            apart = k != key or (mine != 1 and not new[0] and new[1] is None and new[2] is None)
            if part is not None:
                row = closed(False, apart)
                if row[3] == "part" or part[5] > 1:
                    yield row
                n += 1
            if apart:
                stretch += 1
                in_stretch = 0
            in_stretch += 1
            part, link, head = [k, sid, sid, start, stop, 1, said], new, mine
        key = k
        at += 1
        one, two = now, one
    if part is not None:
        yield closed(True, False)

        def edge(end: int, k: str, count: int, a: tuple, b: tuple) -> tuple:
            return (partition, n + 1, stretch, "edge", end, None, k, a[1], None, None, None, count, None, a[0], b[0], b[1], False, None, None, None)

        yield edge(0, first_key, len(firsts), *[*firsts, (None, None)][:2])
        yield edge(1, key, min(at, 2), one, two or (None, None))


def _across(rows: Iterator[tuple], _: int) -> Iterator[tuple]:
    """partition, head and links of the first segments of each partition's first recording, after the last ones of the
    partitions before. rows: two a partition, in order."""
    known, before, first, first_key = None, [], [], None
    for partition, end, key, id_1, count, sig_1, sig_2, id_2 in rows:
        own = [(sig_1, id_1), (sig_2, id_2)][:count]
        if end == 0:
            first, first_key = own, key
            seen = list(before) if known == key else []  # the latest first
            if seen:
                for i, now in enumerate(own):
                    yield (partition, i, *_links(now, *[*seen, None][:2]))
                    seen = [now, *seen]
        else:
            before = [*own, *before][:2] if known == key == first_key and len(first) < 2 else own
            known = key


def _variants(w: str) -> Column:
    """The word, and the word without each of its letters: words one letter dropped, added, changed or swapped apart share one."""
    c = F.col(w)
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))


def _slips(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """a, b: the asked pairs that are a slip and its word, or two slips of one word.

    asked: audio_key, a, b, at_a, at_b, the words of a pair and the segments they stand in; counts: w, n."""
    beside = asked.groupBy("a", "b").agg(F.count_distinct("audio_key", "at_a").alias("ca"), F.count_distinct("audio_key", "at_b").alias("cb"))
    pairs = beside.join(counts.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b")
    rare = ((F.col("na") <= F.col("nb")) & (F.col("na") - F.col("ca") <= F.col("nb") * RARE_SHARE)) | ((F.col("nb") <= F.col("na")) & (F.col("nb") - F.col("cb") <= F.col("na") * RARE_SHARE))
    pairs = cut_lineage(pairs.select("a", "b", ((F.levenshtein("a", "b") <= 2) & rare).alias("one")))
    # what isn't a slip beside its word may be two slips of one
    rest = pairs.where(~F.col("one")).select("a", "b")
    stands = asked.select("audio_key", F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("at_a").alias("at")), F.struct(F.col("b").alias("w"), F.col("at_b").alias("at")))).alias("s")).select("audio_key", "s.*")
    free = counts.join(stands.groupBy("w").agg(F.count_distinct("audio_key", "at").alias("c")), "w").select("w", (F.col("n") - F.col("c")).alias("free"))
    words = rest.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    lengths = words.select(F.explode(F.array(*[F.length("w") + i for i in (-1, 0, 1)])).alias("length")).distinct()
    known = counts.withColumn("length", F.length("w")).join(lengths, "length", "left_semi").select(F.col("w").alias("word"), "n", F.explode(_variants("w")).alias("v"))
    near = words.join(free, "w").withColumn("v", F.explode(_variants("w"))).join(known, "v").where("w <> word").where(F.col("free") <= F.col("n") * RARE_SHARE).select("w", "word").distinct()
    two = rest.join(near.withColumnRenamed("w", "a"), "a").join(near.withColumnRenamed("w", "b"), ["b", "word"]).select("a", "b")
    return pairs.where("one").select("a", "b").unionByName(two).distinct()


_ROW = ("audio_key", "start_time", "segment_id", "end_time", "said", "sig")


def repeated_runs(df: DataFrame, least: int = 2, partitions: int | None = None) -> DataFrame:
    """audio_key, first_segment_id, last_segment_id, text, count, start_time, end_time, duration of runs of at least so many segments."""
    said = read_segments(df)
    words, notes = F.col("words") != "", F.col("notes") != ""
    sig = F.when(words, F.col("words")).when(notes, F.concat(F.lit("♪"), "notes"))
    label = F.when(words, F.col("said")).otherwise(F.replace("notes", F.lit("\t"), F.lit(", ")))
    rows = said.withColumns({"end_time": usable_end(), "said": label, "sig": sig}).select(*_ROW)
    # the segments of all words tell which differences are slips
    counts = cut_lineage(said.where(words).select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    return _collapsed(rows, counts, least, partitions)


def exact_runs(df: DataFrame, least: int = 2, partitions: int | None = None) -> DataFrame:
    """As repeated_runs, of segments whose text is the same to the letter; null and blank text is never in a run."""
    own = df.where("audio_key is not null and segment_id is not null and start_time is not null")
    own = own.withColumns({c: F.col(c).cast("double") for c in ("start_time", "end_time")})
    sig = F.when(F.trim("text") != "", F.concat(F.lit("♪"), "text"))
    rows = own.withColumns({"end_time": usable_end(), "said": F.col("text"), "sig": sig}).select(*_ROW)
    return _collapsed(rows, df.sparkSession.createDataFrame([], "w string, n bigint"), least, partitions)


def _collapsed(rows: DataFrame, counts: DataFrame, least: int, partitions: int | None) -> DataFrame:
    """The runs of rows (_ROW), in which words are slips by the number of segments that hold them (w, n)."""
    walked = cut_lineage(in_order(rows, ["audio_key", "start_time", "segment_id"], _run_parts, _PARTS, partitions))
    edges = walked.where("kind = 'edge'").select("partition", "head", "audio_key", "first_segment_id", "count", "sig_1", "sig_2", "id_2")
    across = cut_lineage(in_order(edges, ["partition", "head"], _across, f"partition int, head int, {_LINKS}", 1))  # two rows a partition
    parts = walked.where("kind = 'part'").drop("kind", "sig_1", "sig_2", "id_2").join(F.broadcast(across.select("partition", "head", F.struct("sure", "d1", "d2", "d12").alias("across"))), ["partition", "head"], "left")
    parts = parts.withColumns({c: F.when(F.col("across").isNotNull(), F.col(f"across.{c}")).otherwise(F.col(c)) for c in ("sure", "d1", "d2", "d12")}).drop("across")

    def placed(p: Column) -> Column:
        """A difference in one order of its words, with the segments these stand in."""
        turned = p["x"] > p["y"]
        pick = lambda a, b, name: F.when(turned, p[b]).otherwise(p[a]).alias(name)
        return F.struct(F.struct(p["x"].alias("x"), p["y"].alias("y")).alias("p"), pick("x", "y", "a"), pick("y", "x", "b"), pick("at_x", "at_y", "at_a"), pick("at_y", "at_x", "at_b"))

    every = F.flatten(F.array_compact(F.array("d1", "d2", "d12")))
    asked = cut_lineage(parts.select("audio_key", "partition", "n", F.explode(F.transform(every, placed)).alias("q")).select("audio_key", "partition", "n", "q.*"))
    slips = asked.join(_slips(asked, counts), ["a", "b"]).groupBy("partition", "n").agg(F.collect_set("p").alias("slips"))
    is_slip = lambda p: F.exists("slips", lambda q: (q["x"] == p["x"]) & (q["y"] == p["y"]))
    same = {c: F.coalesce((F.size(c) == 0) | F.forall(c, is_slip), F.lit(False)) for c in ("d1", "d2", "d12")}
    # a stretch lies in one partition; its parts make runs, of which the first may go on from another and the last into one
    linked = parts.join(slips, ["partition", "n"], "left").withColumn("linked", F.col("sure") | same["d1"] | (same["d2"] & same["d12"]))
    linked = linked.withColumn("run", F.sum((~F.col("linked")).cast("int")).over(Window.partitionBy("partition", "stretch").orderBy("n")))

    def put_together(df: DataFrame, *by: str) -> DataFrame:
        """One row per group, from rows in the order of partition and n."""
        place = F.struct("partition", "n")
        firsts = [F.min_by(c, place).alias(c) for c in ("first_segment_id", "start_time", "text", "linked", "head")]
        lasts = [F.max_by("last_segment_id", place).alias("last_segment_id"), F.max("end_time").alias("end_time"), F.sum("count").alias("count"), F.bool_or("tail").alias("tail")]
        return df.groupBy("audio_key", *by).agg(*firsts, *lasts, F.min("n").alias("n"))

    runs = cut_lineage(put_together(linked, "partition", "stretch", "run"))
    goes_on = (F.col("linked") & (F.col("head") == 0)).eqNullSafe(True)
    edge = goes_on | F.col("tail")
    # at most two rows a partition: what goes on from the one before belongs to the last that doesn't
    opened = F.sum((~goes_on).cast("int")).over(Window.partitionBy("audio_key").orderBy("partition", "n"))
    over = put_together(runs.where(edge).withColumn("run", opened), "run")
    columns = ["audio_key", "first_segment_id", "last_segment_id", "text", "count", "start_time", "end_time"]
    found = walked.where("kind = 'run'").select(*columns).unionByName(runs.where(~edge).select(*columns)).unionByName(over.select(*columns)).where(F.col("count") >= least)
    return found.withColumn("duration", F.col("end_time") - F.col("start_time"))
