"""SimHash near-duplicates with pivot distance tables.

Fingerprints that differ in at most ``bits`` of 64 bits are linked.  The work is on distinct fingerprints only:

1. The pivot table has a row for each fingerprint: its Hamming distances to ``PIVOTS`` reference fingerprints.  By the
   triangle inequality pairs whose coordinates differ by more than ``bits`` anywhere can't be linked.  Rows are ordered by their first
   coordinate, so only pairs within reach there are formed; the other coordinates discard all but a few, and
   those are verified by the Hamming distance itself.
2. Coordinates alone don't part a large table: a distance to a reference has some twenty usual values.  So tables are made for
   buckets: of three blocks of the 64 bits linked fingerprints have one in common, and each block's hash, cut so that a bucket has
   about ``BUCKET`` fingerprints whatever their number, is a key.  Every link lies within a bucket of some block.
3. Buckets of more than ``DENSE`` fingerprints are never compared pairwise.  Their members go to an exact form without
   pairs: two fingerprints are within two bits just if some value is within one bit of both, so each emits itself and its 64
   one-bit neighbours, and those that meet in a value are linked.  A value meets 65 fingerprints at most, whatever the skew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, stored, table, texts
from .components import components

SHINGLE, BITS, PIVOTS, BUCKET, DENSE = 3, 2, 16, 128, 1024
#: First bit and length of the blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
_PIVOTS = np.random.default_rng(6).integers(0, 2**64, PIVOTS, np.uint64)
#: Pairs that are held at once.
FORMED = 1 << 18
_ONES = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 for a text without words.

    Words are what white space separates, A-Z lower-cased; fewer words than a shingle make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(_ONES[counts * 2 > len(starts)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long with the same bits."""

    def run(batch):
        fps = np.fromiter((fingerprint(x, shingle) for x in texts(batch)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def pivot_links(fps: np.ndarray, bits: int = BITS, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``bits`` of one another among distinct fingerprints, by a pivot table.

    ``counts`` gets the pairs formed by the first coordinate, those that all coordinates let pass, and those linked.
    """
    coords = np.bitwise_count(fps[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order]
    stop = np.searchsorted(coords[:, 0], coords[:, 0] + bits, "right")
    width = np.maximum(stop - np.arange(len(fps)) - 1, 0)
    lefts, rights, formed, passed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    ends = np.cumsum(width)
    at = 0
    while at < len(fps):  # in slices of bounded size
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FORMED, "right")))
        n = width[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        formed += len(left)
        for k in range(1, coords.shape[1]):
            keep = np.abs(coords[left, k] - coords[right, k]) <= bits
            left, right = left[keep], right[keep]
        passed += len(left)
        keep = np.bitwise_count(fps[left] ^ fps[right]) <= bits
        lefts.append(left[keep]), rights.append(right[keep])
        at = to
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if counts is not None:
        for name, n in (("formed", formed), ("passed", passed), ("linked", len(left))):
            counts[name] = counts.get(name, 0) + n
    return order[left], order[right]


def links(distinct: DataFrame, bits: int = BITS, dense: int = DENSE, width: int | None = None) -> DataFrame:
    """Links ``a, b`` between the ``node`` values of distinct fingerprints (``fp, node``): the pairs within ``bits`` (at most 2).

    ``width`` is the bits of a bucket's key (by the number of fingerprints if not given).  From a bucket of more than ``dense``
    fingerprints come links of stars with the same components instead of all pairs.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits is 0, 1 or 2")
    if width is None:
        width = min(21, max(0, (distinct.count() // BUCKET).bit_length()))
    block = lambda at, size: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1))
    keys = F.array(*[F.lit(k << width) + F.pmod(F.xxhash64(block(*x)), F.lit(1 << width)) for k, x in enumerate(BLOCKS)])
    keyed = distinct.select("fp", "node", F.explode(keys).alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("bucket")

    def pairs(parts):
        left = None
        for part in parts:
            x = pa.Table.from_batches([part]) if left is None else pa.concat_tables([left, pa.Table.from_batches([part])])
            bucket = x["bucket"].to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            left = x.slice(last)
            yield from solve(x.slice(0, last))
        if left is not None:
            yield from solve(left)

    def solve(x):
        if not x.num_rows:
            return
        bucket, fps, nodes = x["bucket"].to_numpy(), x["fp"].to_numpy().view(np.uint64), x["node"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        a, b = [], []
        for s, e in zip(cuts, cuts[1:]):
            i, j = pivot_links(fps[s:e], bits)
            a.append(nodes[s:e][i]), b.append(nodes[s:e][j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    # distinct fingerprints of one bucket, dense at most: whole buckets meet in sorted runs of a task
    thin = keyed.join(crowded, "bucket", "left_anti").select("bucket", "fp", "node").repartition("bucket").sortWithinPartitions("bucket")
    found = thin.mapInArrow(pairs, "a long, b long")
    if bits == 0:
        return found
    crowd = keyed.join(crowded, "bucket", "left_semi").select("fp", "node").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(int(np.int64(np.uint64(1 << k).view(np.int64)))).cast("long")) for k in range(64)])
    met = crowd.select("fp", "node", F.posexplode(flips).alias("k", "value"))
    if bits == 1:  # a fingerprint and its neighbour meet in the neighbour itself
        hub = crowd.select(F.col("fp").alias("value"), F.col("node").alias("b"))
        return found.union(met.where("k > 0").join(hub, "value").select(F.col("node").alias("a"), "b"))
    hub = met.groupBy("value").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).where(F.size("all") > 1)
    return found.union(hub.select("a", F.explode("all").alias("b")).where("a <> b").distinct())


def near_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, dense: int = DENSE, folder: str | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for every document.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the document itself included.  Null and empty texts
    have fingerprint zero and are linked like any other.  Repeated rows each get a row; a document with a null id
    gets the component of its fingerprint (null only if no member has an id).  Other columns of ``docs`` are ignored.
    """
    folder = folder or shared_dir(docs.sparkSession)
    prints = stored(fingerprints(docs, shingle), f"{folder}/prints")
    # a node is the smallest id of a distinct fingerprint
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), f"{folder}/distinct")
    nodes = distinct.select("fp", F.col("doc_id").alias("node")).where("node is not null")
    near = components(links(nodes, bits, dense), f"{folder}/cc")
    named = nodes.join(near, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; of repeated rows with that id one stays.

    Documents without an id can't be named by a group and stay.
    """
    folder = how.pop("folder", None) or shared_dir(docs.sparkSession)
    groups = stored(near_groups(docs, folder=folder, **how), f"{folder}/groups")
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    once = docs.join(first.where("n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    if not first.where("n > 1").limit(1).count() and not groups.where("doc_id is null").limit(1).count():
        return once
    again = docs.join(first.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
