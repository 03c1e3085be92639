from corpus_cases import odd_rows, prose

from chronozone.llm import licenses
from chronozone.llm.license_table import PROSE, TEMPLATES


def test_held_out_accuracy():
    found = licenses.model().held_out
    assert found["accuracy"] >= 0.93 and found["precision"] >= 0.95 and found["recall"] >= 0.9


def test_templates_and_prose():
    own = licenses.model()
    wrong = [(f, x) for f, notices in TEMPLATES.items() for x in notices if own.predict(licenses._clean(x))[0] != f]
    assert len(wrong) <= 3, wrong
    assert [x for x in PROSE if own.predict(licenses._clean(x))[0] != licenses.UNKNOWN] == []


def test_paragraphs_against_scoring_every_line():
    own = licenses.model()
    lines = [x for notices in TEMPLATES.values() for x in notices][::3] + PROSE + [prose(k, 12) for k in range(30)] + ["", "  ", "!!!"]
    text = "\n".join(lines)
    n, found = own.paragraphs(text)
    assert n == sum(bool(licenses._clean(x)) for x in lines)
    want = [x for x in lines if licenses._clean(x) and len(licenses._clean(x)) <= licenses.SPAN and own.predict(licenses._clean(x))[0] != licenses.UNKNOWN]
    assert [text[s:e] for _, s, e, _, _ in found if len(licenses._clean(text[s:e])) < licenses.SPAN] == want


def test_a_notice_within_a_long_line_is_found():
    text = f"{prose(1, 200)} {TEMPLATES['Apache-2.0'][1]} {prose(2, 200)}"
    assert {f for f, *_ in licenses.model().paragraphs(text)[1]} == {"Apache-2.0"}


def test_places_are_code_points():
    text = "é😀\n  Released under the MIT License.  \nend"
    (family, s, e, p, agree), = licenses.model().paragraphs(text)[1]
    assert family == "MIT" and text[s:e] == "Released under the MIT License." and p > 0.5 and agree == 1


def test_odd_rows(odd, none):
    found = {(r.doc_id, r.n_paragraphs, len(r.notices)) for r in licenses.scan(odd).collect()}
    assert (2, 0, 0) in found and (3, 0, 0) in found and (10, 2, 0) in found
    assert licenses.scan(odd).count() == len(odd_rows()) and licenses.scan(none).count() == 0


def test_op1(spark, sf):
    rows = {r.doc_id: r for r in licenses.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
        want = sorted({f for x, f in known.items() if x in d.text.split("\n")})
        assert rows[d.doc_id].families == ",".join(want)
