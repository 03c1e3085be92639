import random

import numpy as np
import xxhash
from corpus_cases import odd_rows, prose

from chronozone.llm import simhash
from chronozone.llm.common import shared_dir
from chronozone.llm.components import components


def slow_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    own = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """The smallest id reachable over links of at most two bits; fps is a list of (id, fingerprint)."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    own = {}
    for i, f in fps:
        own[f] = min(i, own.get(f, i))
    distinct = list(own)
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(own[a]), root(own[b])))
                parent[y] = x
    return {i: root(own[f]) for i, f in fps}


def test_fingerprints():
    for text in [None, "", " \n", "One", "one two", "ONE two three", "É é ß İ x y z", prose(1, 500), prose(2, 41)]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_spark_gives_the_same_hash(spark):
    df = spark.createDataFrame([("a b c",)], "text string").selectExpr("xxhash64(text) as h")
    assert df.first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42) == simhash.fingerprint("A b\tc")


def near(seed, n):
    """Fingerprints in crowds a few bits apart, and others."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            out.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out))


def test_pivots_discard_and_lose_nothing():
    """Without buckets: all pairs of a table, of which coordinates let few pass and none that is linked is lost."""
    rng, fps = random.Random(8), near(9, 40)
    fps = np.array(list(dict.fromkeys(fps + [rng.getrandbits(64) for _ in range(3000)])), np.uint64)
    counts = {}
    i, j = simhash.pivot_links(fps, 2, counts)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(apart <= 2))) if a < b}
    assert got == want and len(got) == len(i) == counts["linked"] > 50
    every = len(fps) * (len(fps) - 1) // 2
    assert counts["passed"] < 1.1 * counts["linked"] + every / 10_000 and counts["formed"] < every / 2


def linked(spark, fps, **how):
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    found = components(simhash.links(df, **how), shared_dir(spark))
    return {i: i for i in range(len(fps))} | {r.node: r.label for r in found.collect()}


def test_links_by_pivots_and_by_neighbours(spark):
    fps = near(5, 25)
    want = brute_groups(list(enumerate(fps)))
    assert linked(spark, fps) == want
    for how in ({"dense": 4}, {"width": 0}, {"width": 21}):
        assert linked(spark, fps, **how) == want


def test_one_bit_and_no_bits(spark):
    fps = near(6, 12)
    for bits in (0, 1):
        pairs = {(min(a, b), max(a, b)) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits}
        want = components(spark.createDataFrame(list(pairs) or [(0, 0)], "a long, b long"), shared_dir(spark))
        assert linked(spark, fps, bits=bits, dense=3) == {i: i for i in range(len(fps))} | {r.node: r.label for r in want.collect()}


def test_components_of_a_long_chain(spark, tmp_path):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (None, 5), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), tmp_path.as_uri()).collect()}
    assert found == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def test_groups_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.query(spark, sf).collect()}
    want = brute_groups(fps)
    assert got == {i: (f, want[i]) for i, f in fps}


def test_odd_rows(odd, none):
    found = simhash.near_groups(odd).collect()
    assert len(found) == len(odd_rows()) and simhash.near_groups(none).count() == 0
    by = {r.doc_id: r for r in found}
    assert by[2].fp == by[3].fp == by[9].fp == 0 and by[9].component_id == by[3].component_id == 2
    assert by[7].component_id == 1
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in found if r.doc_id is not None}) and ids.count(None) == 2
    assert simhash.keep_one(none).count() == 0
