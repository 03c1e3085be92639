"""Benchmark decontamination with training suffix arrays.

Training texts become shards of word ids (the benchmark's vocabulary; any other word is 0 and matches nothing).  Each shard
gets the suffix array of those suffixes that can start a match at all, that is whose first words are all in the vocabulary;
every distinct window that starts a suffix of a benchmark item is then binary-searched in each shard, once however many items
share it.  A range of equal prefixes gives the occurrences of a window with their locations; a list of the items of each window
gives their names.  The longest verbatim match of a document follows from the starts of its maximal matches alone: each is
extended word by word over the items that still agree, so a text that holds an item verbatim costs its length.

The benchmark is the stated query set.  It is read in blocks of at most ``BLOCK_CHARS`` characters.  A benchmark of one block is
broadcast and each row decided where it is read.  Of a larger one the blocks are searched one after the other, each released once
its rows with hits are stored, and those merge by the number of the row: neither driver nor executors ever hold two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, shared_dir, stored, table, texts, unused

WINDOW, MIN_ITEMS, BLOCK_CHARS, SHARD_WORDS = 8, 2, 4 << 20, 1 << 20
#: Windows that are searched at once, words that are compared at once, and runs whose longest match a task remembers.
SEARCHED, COMPARED, REMEMBERED = 1 << 16, 1 << 20, 10_000
#: Bytes to bytes: A-Z lower-cased, ASCII other than letters and digits to a space; all else is part of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _named(codes: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the pairs of each code with that ``step`` further on (0 beyond the end): equal for equal pairs."""
    ahead = np.concatenate([codes[step:], np.zeros(min(step, len(codes)), codes.dtype)])
    return np.unique(codes.astype(np.int64) << 32 | ahead, return_inverse=True)[1].astype(np.int64)


class Items:
    """A block of benchmark items: vocabulary, all word ids in one array with zeros around each item, and the distinct windows.

    Window ``u`` is ``width[u]`` words from ``places[begin[u]]`` on; ``places[begin[u]:begin[u + 1]]`` are all its positions and
    ``holders[held[u]:held[u + 1]]`` the names (indexes of ``names``) of the items that hold it.  Items with equal ids, null
    too, share a name.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window, named, sizes, names, runs = window, {}, [], [], [np.zeros(window, np.int32)]
        for name, text in items:
            if found := words(text):
                names.append(named.setdefault(None if name is None else str(name), len(named)))
                sizes.append(len(found))
                runs += [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found], np.int32), np.zeros(window, np.int32)]
        self.names, self.ids = list(named), np.concatenate(runs)
        size = np.array(sizes, np.int64)
        self.least = int(size.clip(max=window).min()) if len(size) else window
        # a start of each suffix that holds a whole window; an item shorter than the window has one
        count = np.maximum(size - window + 1, 1) if len(size) else size
        first = window + np.cumsum(size + window) - (size + window)
        starts = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        code = np.zeros(len(self.ids), np.int64)
        if len(starts):  # ids of a window as one number: beyond a short item there are zeros
            code, reach = self.ids.astype(np.int64), 1
            while reach * 2 <= window:
                code, reach = _named(code, reach), reach * 2
            if reach < window:
                code = _named(code, window - reach)
        order = np.argsort(code[starts], kind="stable")
        ranked = code[starts][order]
        fresh = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(order) else np.zeros(0, np.int64)
        self.places, self.begin = starts[order], np.append(fresh, len(order))
        self.width = np.repeat(size.clip(max=window), count)[order][fresh]
        own = np.repeat(np.array(names, np.int64), count)[order]
        pairs = np.unique(np.repeat(np.arange(len(fresh)), np.diff(self.begin)) * max(1, len(named)) + own)
        self.holders, self.held = pairs % max(1, len(named)), np.searchsorted(pairs // max(1, len(named)), np.arange(len(fresh) + 1))
        self.owner = np.zeros(len(self.ids), np.int32)
        self.owner[self.places] = own

    def patterns(self, low: int, high: int) -> np.ndarray:
        """The windows ``low`` to ``high`` as rows; -1 ends one that is shorter."""
        high = min(high, len(self.width))
        reach, width = np.arange(self.window)[None, :], self.width[low:high, None]
        return np.where(reach < width, self.ids[self.places[self.begin[low:high]][:, None] + reach], -1)

    def of(self, windows: np.ndarray) -> list[str | None]:
        """The names of the items that hold any of the windows, sorted; a null name is last."""
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *[self.holders[self.held[u] : self.held[u + 1]] for u in np.unique(windows).tolist()]]))
        return sorted((self.names[k] for k in found.tolist()), key=lambda x: (x is None, x or ""))

    def agreed(self, own: np.ndarray, places: np.ndarray, ahead: bool) -> tuple[int, int]:
        """How many words from ``own``'s start on (or back from its end) the best of ``places`` agrees with, and that place."""
        size, step = 0, 16
        while size < len(own):
            n = max(1, min(step, len(own) - size, COMPARED // len(places)))
            reach = np.arange(size, size + n)[None, :] if ahead else -np.arange(size, size + n)[None, :]
            word = own[size : size + n] if ahead else own[::-1][size : size + n]
            same = self.ids[np.clip(places[:, None] + reach, 0, len(self.ids) - 1)] == word
            agree = np.where(same.all(1), n, same.argmin(1))
            top = int(agree.max())
            places, size, step = places[agree == top], size + top, min(step * 2, 1 << 14)
            if top < n:
                break
        return size, int(places[0])

    def longest(self, ids: np.ndarray, windows: np.ndarray) -> tuple[int, str | None, int]:
        """The longest verbatim match in a run of words whose every window occurs: its words, item, and place in the run."""
        w, last, best, at = self.window, len(windows) - 1, (0, None, 0), 0
        places = lambda k: self.places[self.begin[windows[k]] : self.begin[windows[k] + 1]]
        while at <= last and last - at + w > best[0]:
            size, place = self.agreed(ids[at:], places(at), True)
            if size > best[0]:
                best = size, self.names[self.owner[place]], at
            end = at + size - w + 1  # the window that ends with the first word beyond the match
            if end > last:
                break
            back, _ = self.agreed(ids[at:end], places(end) - 1, False)
            at = end - back
        return best


def _less(rows: np.ndarray, pattern: np.ndarray, upper: bool) -> np.ndarray:
    """Whether each row sorts below its pattern (with ``upper``: below or as a prefix match); -1 in a pattern ends it."""
    differ = (rows != pattern) & (pattern >= 0)
    first = differ.argmax(1)
    pick = np.arange(len(rows))
    return np.where(differ.any(1), rows[pick, first] < pattern[pick, first], upper)


class Shard:
    """The suffix array of one run of word ids (each document's ids followed by a zero)."""

    def __init__(self, ids: np.ndarray, least: int, window: int):
        self.ids, self.window = np.concatenate([ids, np.zeros(window, ids.dtype)]), window
        known = np.concatenate([ids != 0, [False]])
        ends = np.flatnonzero(~known)
        run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))  # words known from here on
        at = np.flatnonzero(run >= least)
        keys = self.ids[at[:, None] + np.arange(window)[None, :]]
        order = np.lexsort(keys.T[::-1]) if len(at) else np.zeros(0, np.int64)
        self.suffix, self.keys = at[order], keys[order]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of the suffix array that starts with it, by binary search of all at once."""
        both = []
        for upper in (False, True):
            low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.suffix), np.int64)
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                below = _less(self.keys[mid], patterns[open_], upper)
                low[open_[below]], high[open_[~below]] = mid[below] + 1, mid[~below]
            both.append(low)
        return both[0], both[1]


def occurrences(texts_: list[str | None], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: words of each, all word ids (a zero after each text), where each begins there, and every occurrence's
    position there with its window.  A position has a window of each width at most, however many items share it."""
    get, rows, sizes = items.vocab.get, [], []
    for x in texts_:
        found = words(x)
        sizes.append(len(found))
        rows.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
        rows.append(np.zeros(1, np.int32))
    sizes = np.array(sizes, np.int64)
    shard = Shard(np.concatenate(rows) if rows else np.zeros(0, np.int32), items.least, items.window)
    at, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(items.width) if len(shard.suffix) else 0, SEARCHED):
        low, high = shard.ranges(items.patterns(a, a + SEARCHED))
        n = high - low
        if total := int(n.sum()):
            window.append(a + np.repeat(np.arange(len(n)), n))
            at.append(shard.suffix[np.repeat(low, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)])
    return sizes, shard.ids, np.concatenate(([0], np.cumsum(sizes + 1))), np.concatenate(at), np.concatenate(window)


class Finding:
    """What one text holds of the benchmark: words inside occurrences, their word ranges, items, and the longest match."""

    __slots__ = ("best", "hit", "items", "spans")

    def __init__(self, items: Items, ids: np.ndarray, size: int, at: np.ndarray, windows: np.ndarray, known: dict):
        """``ids`` begin with the text's ``size`` word ids; ``at`` are sorted positions in it."""
        edge, width = np.zeros(size + 1, np.int64), items.width[windows]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        cover = np.cumsum(edge)[:-1] > 0
        self.hit, self.items = int(cover.sum()), items.of(windows)
        self.spans = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8))).reshape(-1, 2)
        short = int(np.argmax(width))
        self.best = int(width[short]), items.names[items.owner[items.places[items.begin[windows[short]]]]], int(at[short])
        whole = width == items.window
        at, windows = at[whole], windows[whole]
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []:
            if len(run) + items.window - 1 <= self.best[0]:
                continue
            a, own = int(at[run[0]]), windows[run]
            if (key := own.tobytes()) not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = items.longest(ids[a : a + len(run) + items.window - 1], own)
            size_, name, place = known[key]
            if size_ > self.best[0]:
                self.best = size_, name, a + place


def findings(texts_: list[str | None], items: Items, known: dict | None = None) -> tuple[np.ndarray, dict[int, Finding]]:
    """Words of each text, and of those with an occurrence, by index, what was found."""
    sizes, ids, begin, at, window = occurrences(texts_, items)
    doc = np.searchsorted(begin, at, "right") - 1
    order, out, known = np.lexsort((at, doc)), {}, {} if known is None else known
    for own in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
        k = int(doc[own[0]])
        out[k] = Finding(items, ids[begin[k] :], int(sizes[k]), at[own] - begin[k], window[own], known)
    return sizes, out


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """A batch in runs of about ``SHARD_WORDS`` words (a longer text is a run of its own)."""
    run, size, start = [], 0, 0
    for k, x in enumerate(texts(batch)):
        run.append(x)
        size += len(x) // 4
        if size >= SHARD_WORDS:
            yield start, run
            run, size, start = [], 0, k + 1
    if run:
        yield start, run


def blocks(benchmark: DataFrame, most_chars: int = BLOCK_CHARS, window: int = WINDOW) -> Iterator[Items]:
    """The benchmark's items in blocks; an item alone may exceed the bound."""
    rows, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if rows and size + len(row.text) > most_chars:
            yield Items(rows, window)
            rows, size = [], 0
        rows.append((row.item_id, row.text))
        size += len(row.text)
    yield Items(rows, window)


_FOUND = "n_words long, n_hit long, spans binary, items array<string>, longest long, longest_item string, longest_at long"


def _scan(docs: DataFrame, sent: Broadcast, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: its ``keys``, words, covered word ranges as one binary, items, the longest match with its item and word position."""

    def run(batches):
        items, known = sent.value, {}
        for batch in parts(batches):
            for start, part in _shards(batch):
                sizes, found = findings(part, items, known)
                own = [found.get(k) for k in range(len(part))]
                best = [x.best if x else (None, None, None) for x in own]
                columns = [
                    pa.array(sizes),
                    pa.array([x.hit if x else 0 for x in own], pa.int64()),
                    pa.array([x.spans.astype("<i8").tobytes() if x else b"" for x in own], pa.binary()),
                    pa.array([x.items if x else [] for x in own], pa.list_(pa.string())),
                    *[pa.array([b[j] for b in best], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64()))],
                ]
                named = [batch.column(c).slice(start, len(part)).cast(pa.int64()) for c in keys]
                yield pa.RecordBatch.from_arrays([*named, *columns], [*keys, *[x.split()[0] for x in _FOUND.split(", ")]])

    return docs.select(*keys, "text").mapInArrow(run, "".join(f"{c} long, " for c in keys) + _FOUND)


def _merge(rows: DataFrame) -> DataFrame:
    """One row of each ``row`` key from those of the blocks; a key has as many as the benchmark has blocks."""

    def run(batches):
        for batch in batches:
            hits, items = [], []
            for pieces, names in zip(batch.column("parts").to_pylist(), batch.column("names").to_pylist()):
                spans = sorted((int(s), int(e)) for p in pieces for s, e in np.frombuffer(p, "<i8").reshape(-1, 2))
                total, end = 0, 0
                for s, e in spans:
                    total += max(0, e - max(s, end))
                    end = max(end, e)
                hits.append(total)
                items.append(sorted({n for own in names for n in own}, key=lambda x: (x is None, x or "")))
            keep = ["row", "doc_id", "n_words", "longest", "longest_item", "longest_at"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))], [*keep, "n_hit", "items"])

    best = F.max(F.struct("longest", F.col("longest_item").alias("i"), F.col("longest_at").alias("a")))
    grouped = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("parts"), F.collect_list("items").alias("names"), best.alias("b"))
    flat = grouped.select("row", "doc_id", "n_words", "parts", "names", F.col("b.longest").alias("longest"), F.col("b.i").alias("longest_item"), F.col("b.a").alias("longest_at"))
    return flat.mapInArrow(run, "row long, doc_id long, n_words long, longest long, longest_item string, longest_at long, n_hit long, items array<string>")


def _in_blocks(numbered: DataFrame, found: Iterator[Items], folder: str, every: bool) -> DataFrame:
    """The merged findings of several blocks, searched one after the other; with ``every`` for rows without hits too."""
    made = []
    for k, items in enumerate(found):
        sent = numbered.sparkSession.sparkContext.broadcast(items)
        rows = _scan(numbered, sent, ("row", "doc_id"))
        made.append(stored(rows if every and not k else rows.where("n_hit > 0"), f"{folder}/block{k}"))
        sent.destroy()
    return _merge(reduce(DataFrame.union, made))


def _chain(first: Items, second: Items, rest: Iterator[Items]) -> Iterator[Items]:
    yield first
    yield second
    yield from rest


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """What of the benchmark each document holds.

    ``doc_id, n_words, n_hit, items, longest, longest_item, longest_at``: words inside occurrences of windows, the
    items with occurring windows, and the longest verbatim match with its item and word position (null without any; of equally
    long ones any).  A window is ``window`` consecutive words of an item, or a shorter item whole.  Null and empty texts have no
    words, items without words never occur, repeated items count by their id, and items without an id count as one item with a
    null name.  Each row of ``docs`` gets a row, whatever its id; for a benchmark of several blocks the rows are numbered
    and stored once in the shared folder, and merge by their number.  Texts may be of any length; other columns are ignored.
    """
    found = blocks(benchmark, most_chars, window)
    first, second = next(found), next(found, None)
    if second is None:
        return _scan(docs, docs.sparkSession.sparkContext.broadcast(first)).drop("spans")
    folder = shared_dir(docs.sparkSession)
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), f"{folder}/rows")
    rows = _in_blocks(numbered, _chain(first, second, found), folder, True)
    return rows.select("doc_id", "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def remove(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, window: int = WINDOW, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold windows of ``min_items`` items or more.

    Each row is judged by its own text, whatever its id, null too; null and empty texts stay.  With a benchmark of one block
    rows are dropped where they are read, without a shuffle.  With several, the numbers of the affected rows are taken out of the
    numbered and stored rows by a join, which Spark broadcasts if they are few.
    """
    found = blocks(benchmark, most_chars, window)
    first, second = next(found), next(found, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            items, known = sent.value, {}
            for batch in parts(batches):
                keep = np.ones(batch.num_rows, bool)
                for start, part in _shards(batch):
                    for k, x in findings(part, items, known)[1].items():
                        keep[start + k] = len(x.items) < min_items
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    folder, row = shared_dir(docs.sparkSession), unused(docs, "__row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/rows")
    bad = _in_blocks(numbered.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), _chain(first, second, found), folder, False)
    bad = stored(bad.where(F.size("items") >= min_items).select(F.col("row").alias(row)), f"{folder}/bad")
    return numbered.join(bad, row, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: hit words and items of every document, null and empty texts and repeated rows included; see ``matches``."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= MIN_ITEMS).alias("contaminated"))


#: The same by DuckDB: every window of a document against every window of an item of the same width.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS k FROM (SELECT item_id, w, least(8, len(w)) AS width, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, width, array_to_string(w[i:i + width - 1], ' ') AS k FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM bw))
), m AS (
  SELECT rid, i, width, item_id FROM dw JOIN bw USING (width, k)
), hit AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest(range(width)) AS o FROM m) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def brute(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, int]:
    """n_words, n_hit, n_items, items_sha256 and the longest match by comparing every window with every position; for tests."""
    own, hit, names, longest = words(text), set(), set(), 0
    for name, x in items:
        seq = words(x)
        width = min(window, len(seq))
        for j in range(len(seq) - width + 1 if width else 0):
            for i in range(len(own) - width + 1):
                if own[i : i + width] == seq[j : j + width]:
                    hit |= set(range(i, i + width))
                    names.add(None if name is None else str(name))
                    n = width
                    while own[i : i + n + 1] == seq[j : j + n + 1] and i + n < len(own) and j + n < len(seq):
                        n += 1
                    longest = max(longest, n)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), longest
