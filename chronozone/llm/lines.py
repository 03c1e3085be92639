"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under ``LEAST`` code points never count.  A
key held by at least ``MIN_DOCS`` documents loses all its lines but those in the largest ``doc_id`` that holds it.  Keys
travel as 128-bit XXH3 digests.  Each row is one document: repeated rows count each, a null id is below all others, and
of rows that share the largest id all keep their lines.  Null text is empty, and an empty text is one empty line.

``dedup_lines`` works on a whole table at once; ``LineIndex`` keeps the same state between batches, so documents can be
inserted and deleted and the decisions follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, stored, table, texts, unused
from .cuckoo import CuckooFilter, build

LEAST, MIN_DOCS = 20, 3
#: Keys of a filter shard at most on average, and bytes of filters that may be broadcast; beyond that the exact join does it all.
SHARD_KEYS, FILTER_BYTES = 1 << 18, 64 << 20
_digest = xxhash.xxh3_128_digest


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """Digest of a lower-cased UTF-8 line's key; None if the key is too short to count."""
    key = line.strip()
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return _digest(key)


def _keys(text: str, least: int) -> list[bytes | None]:
    return [line_key(x, least) for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def holders(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, key``: each key that counts, once for each row."""

    def run(batch):
        found = [set(_keys(x, least)) - {None} for x in texts(batch)]
        ids = np.repeat(np.arange(len(found)), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).take(pa.array(ids)), pa.array([k for x in found for k in x], pa.binary())], ["doc_id", "key"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, key binary")


def _words(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)


def _shard(shards: int):
    """Shard of a key, from bits that the filter doesn't use."""
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def filter_shards(refs: DataFrame, shards: int) -> DataFrame:
    """``shard, filter``: a cuckoo filter over each shard of the distinct keys of ``refs``."""

    def make(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group["shard"].slice(0, 1), "filter": pa.array([build(_words(group["key"])).to_bytes()], pa.binary())})

    return refs.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(make, "shard int, filter binary")


def probed(held: DataFrame, filters: dict[int, bytes], shards: int) -> DataFrame:
    """The rows of ``doc_id, key`` whose key may be in the filters."""
    sent = held.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        made = {k: CuckooFilter(data=v) for k, v in sent.value.items()}
        for batch in batches:
            shard, keys, maybe = batch.column("shard").to_numpy(), _words(batch.column("key")), np.zeros(batch.num_rows, bool)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (known := made.get(int(shard[part[0]]))):
                    maybe[part] = known.contains(keys[part])
            yield batch.select(["doc_id", "key"]).filter(pa.array(maybe))

    return held.select("doc_id", "key", _shard(shards).alias("shard")).mapInArrow(run, "doc_id long, key binary")


def drops(held: DataFrame, refs: DataFrame) -> DataFrame:
    """``doc_id, keys``: what each document loses, by the exact table ``key, top`` of keys held often enough."""
    lost = held.join(refs.select("key", "top"), "key").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def decided(docs: DataFrame, lost: DataFrame, name: str = "__lost") -> DataFrame:
    """``docs`` with a column of the keys to drop."""
    own = f"{name}_id"
    lost = lost.select(F.col("doc_id").alias(own), F.col("keys").alias(name)).hint("shuffle_hash")
    return docs.join(lost, docs.doc_id.eqNullSafe(F.col(own)), "left").drop(own)


def cut(text: str, lost: list[bytes] | None, least: int = LEAST) -> tuple[str, int, int]:
    """The text without its lost lines, its lines before, and the lines dropped."""
    if not lost:
        return text, text.count("\n") + 1, 0
    gone, lines = set(lost), text.split("\n")
    kept = [x for x, k in zip(lines, _keys(text, least)) if k not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def find_drops(docs: DataFrame, folder: str, least: int = LEAST, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, keys`` to drop from a whole table."""
    held = stored(holders(docs, least), f"{folder}/held")
    refs = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs)
    refs = stored(refs, f"{folder}/refs")
    shards = 1 << max(0, (refs.count() // SHARD_KEYS).bit_length())
    filters = stored(filter_shards(refs, shards), f"{folder}/filters")
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= FILTER_BYTES:
        held = probed(held, {r.shard: bytes(r.filter) for r in filters.collect()}, shards)
    return drops(held, refs)


def dedup_lines(docs: DataFrame, least: int = LEAST, min_docs: int = MIN_DOCS, folder: str | None = None) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``; ``n_chars``, where there is one, follows the new text."""
    folder = folder or shared_dir(docs.sparkSession)
    columns, name = docs.columns, unused(docs, "__lost")
    marked = decided(docs, find_drops(docs, folder, least, min_docs), name)

    def run(batch):
        rows = zip(batch.column("text").to_pylist(), batch.column(name).to_pylist())
        new = [x if not lost else cut(x, lost, least)[0] for x, lost in rows]
        out = batch.select(columns).set_column(columns.index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in columns:
            old, k = batch.column("n_chars"), columns.index("n_chars")
            sizes = [n if not lost else len(x) for n, x, lost in zip(old.to_pylist(), new, batch.column(name).to_pylist())]
            out = out.set_column(k, "n_chars", pa.array(sizes, old.type))
        return out

    return map_arrow(marked, run, docs.schema)


class LineIndex:
    """The state of line dedup between batches, as versioned tables below ``path``.

    ``holders/v=N`` has the keys of the documents inserted in version N, ``gone/v=N`` the documents deleted then,
    ``refs/v=N`` the new exact state ``n, top`` of each key that version N touched (the latest holds), and ``filters/v=N`` the
    cuckoo filters after it.  A version counts once its row is in ``versions``, so a run that died leaves nothing half
    done.  On insertion the filters tell which keys may be known; only those are looked up in the exact table.
    Deleting a document restores the state that it had changed.  Ids are unique among live documents.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, least: int = LEAST):
        self.spark, self.path, self.shards, self.least = spark, path, shards, least
        try:
            self.version = spark.read.parquet(f"{path}/versions").agg(F.max("done")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            self.version = 0

    def _read(self, name: str, schema: str) -> DataFrame:
        """All versions of a table up to the current one."""
        if not self.version:
            return self.spark.createDataFrame([], f"{schema}, v int")
        found = self.spark.read.schema(f"{schema}, v int").option("mergeSchema", "false")
        try:
            return found.parquet(f"{self.path}/{name}").where(F.col("v") <= self.version)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{schema}, v int")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, f"{self.path}/{name}/v={self.version + 1}")

    def _commit(self) -> None:
        self.version += 1
        self.spark.createDataFrame([(self.version,)], "done int").write.mode("append").parquet(f"{self.path}/versions")

    def refs(self) -> DataFrame:
        """``key, n, top`` of every key that some live document holds."""
        rows = self._read("refs", "key binary, n long, top long")
        return rows.groupBy("key").agg(F.max_by(F.struct("n", "top"), "v").alias("s")).select("key", "s.n", "s.top").where("n > 0")

    def live(self) -> DataFrame:
        """``doc_id, key`` of live documents."""
        gone = self._read("gone", "doc_id long").groupBy("doc_id").agg(F.max("v").alias("left"))
        return self._read("holders", "doc_id long, key binary").join(gone, "doc_id", "left").where("left is null or v > left").select("doc_id", "key")

    def filters(self) -> DataFrame:
        rows = self._read("filters", "shard int, filter binary")
        return rows.groupBy("shard").agg(F.max_by("filter", "v").alias("filter"))

    def _together(self, keys: DataFrame, fn, schema: str) -> DataFrame:
        keys = keys.withColumn("shard", _shard(self.shards))
        return keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(fn, schema)

    def insert(self, docs: DataFrame) -> None:
        held = self._write(holders(docs, self.least), "holders")
        fresh = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))

        def probe(group: pa.Table, old: pa.Table) -> pa.Table:
            known = CuckooFilter(data=old["filter"][0].as_py()).contains(_words(group["key"])) if old.num_rows and group.num_rows else np.zeros(group.num_rows, bool)
            return group.select(["key", "n", "top"]).append_column("seen", pa.array(known))

        tried = stored(self._together(fresh, probe, "key binary, n long, top long, seen boolean"), f"{self.path}/tried/v={self.version + 1}")
        seen = tried.where("seen").drop("seen").join(self.refs().select("key", F.col("n").alias("n0"), F.col("top").alias("top0")), "key", "left")
        new = seen.select("key", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("top", "top0").alias("top"), F.col("n0").isNull().alias("first"))
        new = stored(new.union(tried.where("not seen").select("key", "n", "top", F.lit(True))), f"{self.path}/new/v={self.version + 1}")
        all_keys = self.refs()  # a filter that overflows is built anew from the exact table

        def add(group: pa.Table, old: pa.Table) -> pa.Table:
            if not group.num_rows:
                return old.select(["shard", "filter"])
            keys, first = _words(group["key"]), group["first"].to_numpy()
            made = CuckooFilter(data=old["filter"][0].as_py()) if old.num_rows else None
            if made is None or not made.insert(keys[first]):
                made = build(keys)  # all keys of the shard are here then
            return pa.table({"shard": group["shard"].slice(0, 1), "filter": pa.array([made.to_bytes()], pa.binary())})

        # the keys of shards whose filter might overflow go along whole
        load = self.filters().select("shard", (F.length("filter") / 2 * 0.7).alias("room"))
        count = all_keys.groupBy(_shard(self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("old")).join(new.where("first").groupBy(_shard(self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("more")), "shard", "full")
        full = count.join(load, "shard", "left").where("coalesce(old, 0) + coalesce(more, 0) > coalesce(room, 0)").select("shard")
        rest = all_keys.withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").select("key", F.lit(False).alias("first"))
        keys = new.where("first").select("key", "first").union(rest)

        def renew(group: pa.Table, old: pa.Table) -> pa.Table:
            if group.num_rows and not group["first"].to_numpy().all():
                return pa.table({"shard": group["shard"].slice(0, 1), "filter": pa.array([build(_words(group["key"])).to_bytes()], pa.binary())})
            return add(group, old)

        self._write(new.drop("first"), "refs")
        self._write(self._together(keys, renew, "shard int, filter binary"), "filters")
        self._commit()

    def delete(self, ids: DataFrame) -> None:
        """Take documents (``doc_id``) out again; ids that aren't there change nothing."""
        gone = self._write(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone")
        live = self.live()
        touched = live.join(gone, "doc_id", "left_semi").select("key").distinct()
        left = live.join(gone, "doc_id", "left_anti").join(touched, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        new = self._write(touched.join(left, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "top"), "refs")

        def take(group: pa.Table, old: pa.Table) -> pa.Table:
            if not old.num_rows:
                return old.select(["shard", "filter"])
            made = CuckooFilter(data=old["filter"][0].as_py())
            made.delete(_words(group["key"]))
            return pa.table({"shard": old["shard"], "filter": pa.array([made.to_bytes()], pa.binary())})

        self._write(self._together(new.where("n = 0").select("key"), take, "shard int, filter binary"), "filters")
        self._commit()

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``doc_id, keys``: what live documents lose now."""
        return drops(self.live(), self.refs().where(F.col("n") >= min_docs))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: lines before, lines dropped and the digest of the kept text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decided(docs, find_drops(docs, shared_dir(spark)))

    def run(batch):
        made = [cut(x, lost) for x, lost in zip(texts(batch), batch.column("__lost").to_pylist())]
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x, _, _ in made]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n, _ in made], pa.int64()), pa.array([n for _, _, n in made], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_arrow(marked, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The kept text by DuckDB; ``translate`` lower-cases A-Z alone.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, i, line, often.k IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
