import random

import numpy as np
from corpus_cases import odd_rows

from chronozone.llm import lines
from chronozone.llm.cuckoo import CuckooFilter, build


def brute(rows, least=20, min_docs=3):
    """Kept texts and dropped lines by comparing whole keys; rows are (doc_id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append((-(2**63) if i is None else i, n))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(held.get(key(x), [])) < min_docs or max(held[key(x)])[0] == (-(2**63) if i is None else i)]
        out.append((i, "\n".join(kept), len(own) - len(kept)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    pool = ["  A line that many texts share, number %d " % k for k in range(12)] + ["short", "", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ", "exactly twenty chars", "nineteen characters"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {rng.random()} of this text" for _ in range(rng.randint(0, 9)))) for i in range(n)]


def test_cuckoo_filters():
    rng = np.random.default_rng(3)
    keys, others = rng.integers(0, 2**64, (50_000, 2), np.uint64), rng.integers(0, 2**64, (50_000, 2), np.uint64)
    made = build(keys)
    assert made.contains(keys).all() and made.contains(others).mean() < 0.001
    again = CuckooFilter(data=made.to_bytes())
    assert again.delete(keys[:20_000]) == 20_000
    assert again.contains(keys[20_000:]).all() and again.contains(keys[:20_000]).mean() < 0.001
    assert again.insert(keys[:20_000]) and again.contains(keys).all()
    small = CuckooFilter(8)
    before = small.to_bytes()
    assert not small.insert(keys[:5000], rounds=20) and small.to_bytes() == before
    assert not build(keys[:0]).contains(keys[:5]).any()


def test_against_brute_force(spark):
    rows = corpus(1, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert got == {i: t for i, t, _ in brute(rows)}


def test_without_filters_the_exact_table_decides(spark, monkeypatch):
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    rows = corpus(2, 100)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for i, t, _ in brute(rows)}


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    rows = corpus(3, 200)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for i, t, _ in brute(rows)}


def test_odd_rows(odd, none):
    out = lines.dedup_lines(odd)
    assert out.schema.names == odd.schema.names and none.transform(lines.dedup_lines).count() == 0
    want = sorted(((i, t) for i, t, _ in brute([r[:2] for r in odd_rows()])), key=str)
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == want


def test_index_is_reversible(spark, tmp_path):
    path = tmp_path.as_uri()
    rows = corpus(4, 90)
    df = lambda own: spark.createDataFrame(own, "doc_id long, text string")
    dropped = lambda index: {r.doc_id: sorted(map(bytes, r["keys"])) for r in index.drops().collect()}
    index = lines.LineIndex(spark, path, shards=3)
    index.insert(df(rows[:40]))
    first, refs = dropped(index), sorted(map(str, index.refs().collect()))
    index.insert(df(rows[40:]))
    whole = lines.LineIndex(spark, path, shards=3)
    assert whole.version == 2
    want = {i for i, _, n in brute(rows) if n}
    assert set(dropped(whole)) == want
    whole.delete(df(rows[40:]).select("doc_id"))
    assert dropped(whole) == first and sorted(map(str, whole.refs().collect())) == refs
    whole.insert(df(rows[40:]))
    assert set(dropped(whole)) == want
    live = [bytes(r.key) for r in whole.refs().select("key").collect()]
    filters = {r.shard: CuckooFilter(data=bytes(r.filter)) for r in whole.filters().collect()}
    by_shard = {}
    for r in whole.refs().select("key", lines._shard(3).alias("shard")).collect():
        by_shard.setdefault(r.shard, []).append(bytes(r.key))
    for shard, keys in by_shard.items():
        assert filters[shard].contains(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)).all()
    assert len(live) == sum(map(len, by_shard.values()))
