import re
from collections import Counter

import corpus_pipeline
import numpy as np
from test_decontaminate import d
from test_lines import brute as brute_lines
from test_simhash import brute_groups, slow_fingerprint
from test_tokens import check_packed

from chronozone.llm import quality
from chronozone.llm.common import stored


def middle(x):
    return np.quantile(x, 0.5, axis=0, method="inverted_cdf")


def mcd(points):
    """Mean and covariance of the half with the least determinant, by numpy."""
    n, p = points.shape
    half, guard = (n + p + 1) // 2, np.eye(p) * quality.GUARD**2
    spread = np.maximum(middle(np.abs(points)) * 1.4826, quality.GUARD)
    z = points / spread
    signs = z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]
    found = []
    for start in (np.eye(p), signs.T @ signs / n * p, np.cov(np.tanh(z).T, bias=True)):
        mean, cov, best = np.zeros(p), start * np.outer(spread, spread) + guard, np.inf
        while True:
            d2 = np.round((np.linalg.solve(np.linalg.cholesky(cov), (points - mean).T) ** 2).sum(0), 6)
            bucket = np.floor(np.log(d2 + 1e-6) * quality.FINE)
            weight = np.zeros(n)
            for k in np.unique(bucket):
                own, below = bucket == k, (bucket < k).sum()
                weight[own] = min(1.0, max(0.0, (half - below) / own.sum()))
            mean = weight @ points / half
            cov = (points * weight[:, None]).T @ points / half - np.outer(mean, mean) + guard
            now = np.linalg.slogdet(cov)[1]
            if not now < best - quality.FALL:
                break
            best, last = now, (mean, cov)
        found.append((best, *last))
    return min(found, key=lambda x: round(x[0], 6))[1:]


def verdicts(rows):
    """Base rules, and the outlier rule by numpy: doc_ids that stay."""
    own = []
    for r in rows:
        t = r.text
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        keys = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(keys)
        cover = len({i + j for i, k in enumerate(keys) if n[k] > 1 for j in range(5)})
        if len(words) < 10 or 100 * cover > 20 * len(words):
            continue
        chars, size = sum(map(len, words)), len(words)
        shares = [(chars, size, 200), (len(re.findall(r"[!-/:-@\[-`{-~]", t)), chars, 1000), (len(re.findall("[A-Z]", t)), chars, 1000), (sum(len(w) <= 2 for w in words), size, 200), (len(set(words)), size, 200)]
        own.append((r.doc_id, r.lang, r.source, [(a / b) ** 0.5 for a, b, _ in shares], [(b / (b + k)) ** 0.5 for _, b, k in shares]))
    size = Counter((lang, src) for _, lang, src, _, _ in own)
    rest = Counter()
    for (lang, _), n in size.items():
        rest[lang] += n if n < quality.GROUP_ROWS else 0
    groups = {}
    for i, lang, src, r, w in own:
        g = (lang, src) if size[lang, src] >= quality.GROUP_ROWS else (lang, "*") if rest[lang] >= quality.GROUP_ROWS else "*"
        groups.setdefault(g, []).append((i, r, w))
    kept = set()
    for rows_ in groups.values():
        r, w = (np.round(np.array([x[k] for x in rows_]), 9) for k in (1, 2))
        x = np.round((r - middle(r)) * w, 6)
        points = np.unique(x, axis=0)

        def scaled(at, mean, cov, points=points):
            far = lambda y: (np.linalg.solve(np.linalg.cholesky(cov), (y - mean).T) ** 2).sum(0)
            return far(at) * quality.CHI_MEDIAN / middle(far(points))

        near = points[scaled(points, *mcd(points)) <= quality.CHI_NEAR]
        last = near.mean(0), np.cov(near.T, bias=True) + np.eye(5) * quality.GUARD**2
        kept |= {i for (i, _, _), far in zip(rows_, scaled(x, *last)) if far <= quality.CUTOFF}
    return kept


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {n: f for n, f in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    good = stored(kept["quality rules"](spark, docs, sf), f"{tmp_path.as_uri()}/1")
    assert {r.doc_id for r in good.collect()} == verdicts(docs.collect()) and good.columns == docs.columns

    lines = stored(kept["line dedup"](spark, good, sf), f"{tmp_path.as_uri()}/2")
    want = {i: t for i, t, _ in brute_lines([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == docs.columns

    near = stored(kept["SimHash near-dedup"](spark, lines, sf), f"{tmp_path.as_uri()}/3")
    groups = brute_groups([(i, slow_fingerprint(t)) for i, t in want.items()])
    assert {r.doc_id: r.text for r in near.collect()} == {i: want[i] for i in set(groups.values())} and near.columns == docs.columns

    clean = stored(kept["benchmark decontamination"](spark, near, sf), f"{tmp_path.as_uri()}/4")
    held = {r.doc_id: d.brute(r.text, bench)[2] for r in near.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, n in held.items() if not n} and clean.columns == docs.columns
    assert any(held.values())  # the stage has something to do

    packed = kept["packing"](spark, clean, sf).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in clean.collect()])
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()} == {(r.doc_id, r.doc_tokens) for r in packed}


def test_odd_rows(spark, sf, odd, none, tmp_path):
    for k, df in enumerate((odd, none)):
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES[k:]):  # test_quality has the first with no rows
            df = stored(stage(spark, df, sf), f"{tmp_path.as_uri()}/{k}-{j}")
