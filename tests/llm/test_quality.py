import random
import re
from collections import Counter

from corpus_cases import odd_rows, prose

from chronozone.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(5)}
    counts = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return (*counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0])


def test_statistics(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "c d", " ", "\n", "\t", "\x0b", "#", "a b c d e ", "é", "😀", "\u0085"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a " * 3000, "\n".join(["same line"] * 50), prose(1, 20_000)]
    rows = list(enumerate(texts))
    df = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}
    assert [(i, got[i]) for i, t in rows if got[i] != brute(t)] == []


def test_outliers_go_and_clean_texts_stay(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        text = "\n".join(prose(1000 * i + k, rng.randint(5, 40)) for k in range(rng.randint(2, 12)))
        if i % 10 == 0:
            text = " ".join(w + rng.choice(["###", "&&&", "|"]) for w in text.split())
        elif i % 10 == 1:
            text = " ".join((w.upper() + "!!") for w in text.split())
        rows.append((i, text, "en", f"src{i % 3 if i % 4 else 9 + i}"))
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in got if i % 10 < 2)
    clean = [got[i] for i in got if i % 10 > 1 and not brute(rows[i][1])[-1]]
    assert sum(clean) > 0.97 * len(clean)


def test_a_group_with_much_junk(spark):
    rng, rows = random.Random(6), []
    for i in range(300):
        text = "\n".join(prose(1000 * i + k, rng.randint(5, 40)) for k in range(rng.randint(4, 12)))
        if i % 10 < 4:
            text = " ".join(w + rng.choice(["#", "&&", "|", ""]) for w in text.split())
        rows.append((i, text, "en", "spam"))
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in got if i % 10 < 4) == 0
    clean = [got[i] for i in got if i % 10 > 3 and not brute(rows[i][1])[-1]]
    assert sum(clean) > 0.97 * len(clean)


def test_copies_are_not_the_bulk_of_a_group(spark):
    """Half the rows are copies of one text: the others stay."""
    rng, rows = random.Random(7), []
    for i in range(300):
        k = 5 if i % 2 else i
        rows.append((i, "\n".join(prose(1000 * k + j, 5 + (k * 7 + j) % 36) for j in range(4 + k % 9)), "en", "s"))
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    other = [got[i] for i in got if i % 2 == 0 and not brute(rows[i][1])[-1]]
    assert sum(other) > 0.95 * len(other)


def test_groups_whose_names_run_together(spark):
    rows = [(i, "en/x" if i % 2 else "en", "s" if i % 2 else "x/s") for i in range(300)] + [(300 + i, None, None) for i in range(10)]
    found = quality.grouped(spark.createDataFrame(rows, "n long, lang string, source string")).collect()
    assert len({r.g for r in found}) == len(found) == 3


def test_many_groups_are_dealt_to_parts(spark):
    """Rows meet the same estimates by a broadcast and by parts of each group."""
    rows = spark.createDataFrame([(k, "en" if k % 3 else None, k / 7) for k in range(200)], "n long, lang string, by double")
    groups = spark.createDataFrame([("en", 1), (None, 2)], "l2 string, e int")
    met = [sorted((r.n, r.e) for r in quality._Meeting(n)(rows, groups, {"lang": "l2"}, "by").collect()) for n in (2, 10**9)]
    assert met[0] == met[1] == [(k, 1 if k % 3 else 2) for k in range(200)]


def test_plan_is_native(spark):
    df = quality.statistics(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_odd_rows(odd, none):
    assert quality.judged(odd).count() == len(odd_rows()) and quality.judged(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2, 3, 4, 9, 10}.isdisjoint(ids)


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(i // 2, prose(i, 60) if i % 2 else prose(i, 60).upper().replace(" ", "!! "), "en", "s", i) for i in range(0, 400) if i % 2 or i % 20 == 0]
    rows += [(None, prose(9001, 60), "en", "s", 9001), (None, "!! " * 60, "en", "s", 9002)]
    kept = {r.n for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")).collect()}
    assert not any(n % 20 == 0 or n == 9002 for n in kept) and 9001 in kept and len(kept) > 190
