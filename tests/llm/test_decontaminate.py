import random

from corpus_cases import odd_rows, prose

from chronozone.llm import decontaminate as d


def cases(seed, n):
    rng = random.Random(seed)
    items = [(k, prose(50 + k, rng.choice([3, 8, 9, 30]))) for k in range(12)] + [(90, None), (91, "  ."), (92, "thunder"), (93, "Bread, WINTER")]
    docs = []
    for i in range(n):
        parts = [prose(5000 + i, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(own) - 1))
            parts += [" ".join(own[a : a + rng.randint(1, 20)]).upper(), prose(rng.random(), rng.randint(0, 5))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases(1, 120)
    items += [(None, prose(50, 9)), (None, prose(700, 9)), (4, prose(57, 30))]  # items without an id, and an id twice
    docs += [(500 + k, f"x {prose(700, 9)} {prose(50 + k, 30)} y {prose(57, 30)}") for k in range(4)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {i: d.brute(t, items) for i, t in docs}
    assert sum(w[2] > 1 for w in want.values()) > 20 and sum(w[4] > 9 for w in want.values()) > 20
    for most in (d.BLOCK_CHARS, 400):  # one block, and several
        rows = d.matches(df, bench, most_chars=most).selectExpr("*", "sha2(array_join(items, ','), 256) as sha").collect()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r.items), r.sha, r.longest or 0) for r in rows} == want
        for least in (1, 2):
            stay = {r.doc_id for r in d.remove(df, bench, least, most_chars=most).collect()}
            assert stay == {i for i, w in want.items() if w[2] < least}


def test_longest_of_overlapping_and_shared_items():
    rng = random.Random(5)
    for _ in range(60):
        alphabet = [f"w{k}" for k in range(rng.choice([2, 3, 40]))]
        some = lambda n: [rng.choice(alphabet) for _ in range(n)]
        base = some(60)
        items = [(k, " ".join(base[a : a + rng.randint(6, 30)])) for k, a in enumerate(rng.sample(range(50), 8))]
        text = " ".join([*some(5), *base[rng.randint(0, 10) : rng.randint(30, 60)], "zzz", *base[20:45], *some(8)])
        sizes, found = d.findings([text], d.Items(items))
        n_words, n_hit, n_items, _, longest = d.brute(text, items)
        got = found.get(0)
        assert (int(sizes[0]), got.hit if got else 0, len(got.items) if got else 0, got.best[0] if got else 0) == (n_words, n_hit, n_items, longest)
        if got:  # the match is where it is said to be
            own, at = d.words(text), got.best[2]
            seq = d.words(dict((str(k), x) for k, x in items)[got.best[1]])
            assert any(own[at : at + longest] == seq[j : j + longest] for j in range(len(seq)))


def test_shared_windows_are_searched_once():
    shared = prose(77, 40)
    items = d.Items([(k, f"{shared} {prose(1000 + k, 12)} tail{k}") for k in range(400)])
    _, _, _, at, _ = d.occurrences([f"{shared} stop " * 200], items)
    assert len(at) == 200 * 33  # a position has one window, not one for each item
    _, found = d.findings([f"{shared} stop " * 200], items)
    assert len(found[0].items) == 400 and found[0].best[0] == 40 and found[0].hit == 200 * 40


def test_rows_with_equal_or_no_ids_over_blocks(spark):
    a, b = prose(11, 12), prose(12, 12)
    docs = [(1, a), (1, b), (1, b), (None, a), (None, b), (None, "other"), (2, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    one, many = (sorted(map(repr, d.matches(df, bench, most_chars=most).collect())) for most in (d.BLOCK_CHARS, 40))
    assert many == one and len(many) == len(docs)


def test_longest_match_and_place(spark):
    item = prose(3, 30).split()
    docs = [(1, "nothing " * 5 + " ".join(item[4:25]) + " nothing"), (2, " ".join(item[:7]))]
    rows = {r.doc_id: r for r in d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(8, " ".join(item))], "item_id long, text string")).collect()}
    assert (rows[1].longest, rows[1].longest_item, rows[1].longest_at) == (21, "8", 5)
    assert rows[2].longest is None and rows[2].n_hit == 0


def test_removal(spark):
    a, b = prose(11, 12), prose(12, 12)
    docs = spark.createDataFrame([(1, a), (2, f"{a} x {b}"), (None, f"{a} x {b}"), (3, None), (4, prose(13, 12)), (4, a), (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    for most in (d.BLOCK_CHARS, 40):
        assert sorted((str(r.doc_id), r.text) for r in d.remove(docs, bench, most_chars=most).collect()) == [("3", None), ("4", prose(13, 12)), ("None", "clean")]
        assert sorted(str(r.doc_id) for r in d.remove(docs, bench, 2, most_chars=most).collect()) == ["1", "3", "4", "4", "None"]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, prose(1, 9))], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.matches(odd, bench).count() == d.matches(odd, empty).count() == len(odd_rows())
    assert d.matches(none, bench).count() == 0 and d.remove(odd, bench).columns == odd.columns
    assert {r.doc_id for r in d.matches(odd, bench).where("n_hit > 0").collect()} == {1, 5, 7}
