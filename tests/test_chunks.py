"""Chunks rebuild their texts, stay within budgets and sections, and know the headings above them."""

import random

import pytest

from millrace.errors import InvalidInput
from millrace.operators.chunks import _opening, _unit, chunks, cut

PAGE = "<title>t</title>\n<h1>One <b>big</b></h1> a b c d <script>var x='<h2>no</h2>'</script><!-- <h2>no</h2> --> e<h2 id=x>Two</h2>f g<h2>Three</h2>h<h1>Four</h1>i"


@pytest.mark.parametrize("budget, overlap", [(1, 0), (3, 1), (8, 4), (50, 0)])
def test_texts_are_rebuilt(spark, budget, overlap):
    r = random.Random(budget)
    parts = ["word ", "  ", "<p>", "<h1>", "</h1>", "<H3 x='1'>", "\n", "# Title\n", "## b", "<", "字", "<script>", "</script >", "😀 ", "<!--", "-->", "#\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 40))), "x") for i in range(120)] + [(120, None, None), (121, "w " * 5000, "x"), (121, "w " * 5000, "x")]
    got = chunks(spark.createDataFrame(rows, "id int, body string, no string"), "body", ["id", "no"], budget=budget, overlap=overlap)
    by_row = {}
    for x in got.collect():
        by_row.setdefault(x.id, []).append(x.chunk)
    for i, text, _ in rows:
        mine = sorted(by_row.get(i, []), key=lambda c: c.no)
        if i == 121:
            assert len(mine) % 2 == 0
            mine = mine[::2]
        assert [c.no for c in mine] == list(range(len(mine)))
        assert "".join(c.text[c.lead :] for c in mine) == (text or "")
        for c in mine:
            assert text[c.start - c.lead : c.start - c.lead + len(c.text)] == c.text and 0 < c.units <= budget
            # A lone < may be read otherwise without what stood behind it.
            assert "<" in c.text or c.units == len(_unit.findall(c.text))
            assert not any(_opening.match(u) for u in _unit.findall(c.text)[1:])


def test_headings():
    whole = [(c[4], c[5]) for c in cut(PAGE, 50, 0)]
    assert whole == [("", "<title>t</title>\n"), ("One big", PAGE[17 : PAGE.index("<h2 id")]), ("One big > Two", "<h2 id=x>Two</h2>f g"),
                     ("One big > Three", "<h2>Three</h2>h"), ("Four", "<h1>Four</h1>i")]
    assert [(c[4], c[5]) for c in cut("x\n# A b\ntext # no\n### C\n## D", 50, 0)] == [("", "x\n"), ("A b", "# A b\ntext # no\n"), ("A b > C", "### C\n"), ("A b > D", "## D")]
    assert [c[4] for c in cut("<h1>never closed " + "w " * 20, 8, 2)] == [""] * 4
    assert [(c[1], c[2], c[5]) for c in cut("a b c d e", 3, 1)] == [(0, 0, "a b c "), (6, 2, "c d e")]


def test_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    for wrong in (dict(budget=0, overlap=0), dict(budget=3, overlap=2), dict(overlap=-1), dict(name="ID")):
        with pytest.raises(InvalidInput):
            chunks(df, "text", ["id"], **wrong)
    assert chunks(df.limit(0), "text", ["id"]).count() == 0
