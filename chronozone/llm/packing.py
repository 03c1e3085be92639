"""Packing documents into sequences by minimum bin slack.

A document of more than ``WIDTH`` ids fills whole sequences of its own; what remains of it, or a shorter document whole, is a
remainder of 1 to ``WIDTH - 1`` ids.  Only how many remainders of each length there are matters for the plan, and that histogram
has ``WIDTH - 1`` entries whatever the size of the corpus, so the driver plans alone and exactly:

* the longest remaining length opens a window; a bitset subset-sum over the multiset of the other lengths (one bit
  for each fill, lengths in binary multiples of their counts) finds the fill closest to ``WIDTH``;
* the counts of each length are backtracked through the kept bitsets, and the window is repeated as often as the counts
  last, so a plan has a number of patterns bounded by the lengths rather than by the documents;
* windows that can't be filled (near the end, when lengths run out) are cut at powers of two, which need no padding.

A remainder's place follows from its rank among those of its length by arithmetic: no document moves in a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, shared_dir, stored, table, texts
from .tokens import encoder

WIDTH, END_ID = 2048, 1
#: Rows of four numbers that may be broadcast (about 20 MB): a row of each length and task. With more tasks the rows are joined by a shuffle.
BROADCAST_ROWS = 500_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to ``room`` from below: length to count."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    goal = 1 << room
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not reach & goal:
            k_now = min(k, left)
            steps.append((length, k_now, reach))
            reach |= (reach << (length * k_now)) & full
            left, k = left - k_now, k * 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, dict[int, int]]]:
    """Windows as (times, {length: count}) that use every remainder of the histogram just once."""
    counts, made = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = best_fill(counts, width - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        made.append((times, used))
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return made


class Places:
    """Where the r-th remainder of each length goes."""

    def __init__(self, windows: list[tuple[int, dict[int, int]]], first: int, width: int = WIDTH):
        slots: dict[int, list[tuple[int, ...]]] = {}
        sequence = first
        for times, used in windows:
            fill = sum(k * v for k, v in used.items())
            cuts = [0, fill] if fill == width else [0, *np.cumsum([1 << b for b in range(fill.bit_length() - 1, -1, -1) if fill >> b & 1]).tolist()]
            offset = 0
            for length in sorted(used, reverse=True):
                own = slots.setdefault(length, [])
                taken = own[-1][0] + own[-1][1] if own else 0
                own.append((taken, times * used[length], used[length], sequence, offset, cuts))
                offset += length * used[length]
            sequence += times * (len(cuts) - 1)
        self.slots = slots
        self.begin = {k: np.array([x[0] for x in v], np.int64) for k, v in slots.items()}
        self.sequences = sequence

    def find(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces of a remainder: (start in it, length, sequence, offset)."""
        taken, _, each, sequence, offset, cuts = self.slots[length][int(np.searchsorted(self.begin[length], rank, "right")) - 1]
        turn, k = divmod(rank - taken, each)
        at, out = offset + k * length, []
        base = sequence + turn * (len(cuts) - 1)
        for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            s, e = max(lo, at), min(hi, at + length)
            if s < e:
                out.append((s - at, e - s, base + j, s - lo))
        return out


def encoded(docs: DataFrame, vocabulary: str, end_id: int, width: int, folder: str) -> DataFrame:
    """Each document's ids with what the plan needs, stored: its task, the rank of its remainder in the task, and full windows before."""

    def run(batches):
        enc, part, end = encoder(vocabulary), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        ranks, windows = {}, 0
        for batch in parts(batches, "text", 4 << 20):
            rows = {k: [] for k in ("ids", "n", "rest", "rank", "windows")}
            for text in texts(batch):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                rest = n % width
                for k, v in (("ids", ids), ("n", n), ("rest", rest), ("rank", ranks.get(rest, 0)), ("windows", windows)):
                    rows[k].append(v)
                ranks[rest] = ranks.get(rest, 0) + 1
                windows += n // width
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(rows["ids"], pa.binary()), *[pa.array(rows[k], pa.int64()) for k in ("n", "rest", "rank", "windows")]], ["doc_id", "part", "ids", "doc_tokens", "rest", "rank", "windows"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, ids binary, doc_tokens long, rest long, rank long, windows long"), f"{folder}/encoded")


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, width: int = WIDTH, folder: str | None = None, digest: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of all documents; ``ids`` are the piece's ids as bytes
    (with ``digest`` there is ``ids_crc32`` instead).

    Null text is empty and has the end id alone; repeated rows are packed as documents of their own; other columns of ``docs``
    are ignored.  Sequences hold ``width`` ids or a power of two, so nothing is padded.
    """
    if width & (width - 1):
        raise ValueError("width is a power of two")
    folder = folder or shared_dir(docs.sparkSession)
    ids = encoded(docs, vocabulary, end_id, width, folder)
    # at most width counts of each task; their running sums by length give each task the rank of its first remainder
    counts = ids.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"doc_tokens div {width}")).alias("w"))
    counts = stored(counts, f"{folder}/counts")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("part").agg(F.sum("w").alias("w")).withColumn("first_window", F.coalesce(F.sum("w").over(upto), F.lit(0))).select("part", "first_window")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = stored(ranked.join(bases, "part").select("part", "rest", "first_rank", "first_window"), f"{folder}/starts")
    totals = counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # width rows at most
    full = sum(r.w or 0 for r in totals)
    places = docs.sparkSession.sparkContext.broadcast(Places(plan({r.rest: r.n for r in totals if r.rest}, width), full, width))
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    names = ["doc_id", "start", "length", last, "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        where = places.value
        for batch in parts(batches, "ids", 4 << 20):
            out = {k: [] for k in names}
            for doc_id, raw, n, rest, rank, windows in zip(*[batch.column(k).to_pylist() for k in ("doc_id", "ids", "doc_tokens", "rest", "rank", "windows")]):
                whole = n // width
                pieces = [(j * width, width, windows + j, 0) for j in range(whole)]
                if rest:
                    pieces += [(whole * width + s, size, q, o) for s, size, q, o in where.find(rest, rank)]
                for start, size, sequence, offset in pieces:
                    own = raw[4 * start : 4 * (start + size)]
                    for k, v in zip(names, (doc_id, start, size, zlib.crc32(own) if digest else own, n, sequence, offset)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.binary() if k == "ids" else pa.int64()) for k in names], names)

    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = ids.join(starts, ["part", "rest"]).select("doc_id", "ids", "doc_tokens", "rest", (F.col("rank") + F.col("first_rank")).alias("rank"), (F.col("windows") + F.col("first_window")).alias("windows"))
    return placed.mapInArrow(run, f"doc_id long, start long, length long, {last} {kind}, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every piece of every document with its place."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)
