import pytest

from docweave.llm.truncation import ending, find_truncated, kinds_open, open_at_end, truncation_rates, without_marks, words_of

WHOLE = ["We trained the model on field data. It works well.", "본 논문에서는 새 방법을 제시한다.", "Done here.\n- Ferrin Nethercote", "That is all.\n- Elsin V. Ravensholt", "끝난다.\n2018. 4. 3.", "It ends.\n* joint study (2020)", "Both agree 본 논문에서는 새 방법을 제시합니다..."]
CUT = ["We trained the model on field data and it [...]", "본 논문에서는 새 방법을 제시한다. 두 번째 과제에서는 자료를…", "방법을 제시한다. 성능을 높이는 것이 이�", "It costs 3 &amp; 4 &am", "He wrote \\u00e"]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert ending(text) is None


@pytest.mark.parametrize("text", CUT)
def test_sure(text):
    assert ending(text)["sure"]


def test_stack():
    assert open_at_end("a (b [c] d") == [("(", 2)]
    assert open_at_end("a (b) “c”") == []
    assert open_at_end("(a [b) c") == []
    assert open_at_end('x 5" pipe and "both" ends') == []
    assert open_at_end("one <br> <p> two <div>three</div>") == []


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("The parser reads (a list of\nitems and their ends.", ["bracket"]),
        ('She said "this is the end of the long.', ["quote"]),
        ("Run this:\n```\nx = (1\ny = 2.", ["fence"]),
        ("<div><p>Hello there. All is fine.", ["element"]),
        ("See <a href='x", ["tag"]),
        ('An old "opening.\n\nA new paragraph.', []),
        ("``` not a fence.", ["fence"]),
        ("a < b and c > d.", []),
    ],
)
def test_what_is_open(text, kinds):
    assert kinds_open(text) == kinds


def test_marks_and_words():
    assert without_marks("a b ... [...] \n") == ("a b", "[...]")
    assert without_marks("x" + " [more]" * 3_000)[0] == "x"  # no bound on their number
    assert words_of("Contact ann.b@x.example now", 3) == ["Contact", "@", "now"]
    assert words_of("The Ilcoten lab team", 3) == ["The", "W", "lab"]
    assert words_of("我们课题组", 3) == ["我", "们", "课"]


def found(spark, rows):
    return sorted({r["doc_id"] for r in find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()})


def test_baseline_decides(spark):
    rows = [(i, f"Recent work combines topic {i} with another.\nRecent work goes on.\nFine.\n\nThe Orla lab team", "a") for i in range(8)]
    rows += [(20, "Fine.\nRecent work combi", "a"), (21, "Fine.\nThe Bela lab team", "b"), (22, None, "a"), (23, "", None), (24, WHOLE[0], None), (25, CUT[0], None), (26, CUT[0], "b"), (26, CUT[0], "b"), (None, CUT[0], "b"), (27, "Fine. It wor", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, fragment string")
    got = sorted(r["doc_id"] for r in find_truncated(df, "doc_id", "text", "source").collect())
    assert got == [20, 25, 26, 27]
    rates = {r["source"]: (r["docs"], r["truncated"]) for r in truncation_rates(df.filter("doc_id IS NOT NULL"), "doc_id", "text", "source").collect()}
    assert rates == {"a": (11, 2), "b": (2, 1), "": (3, 1)}
    assert find_truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_open_ends_against_their_source(spark):
    tidy = [(i, f"Item {i} is whole (as are all).\nIt ends here.", "tidy") for i in range(8)]
    sloppy = [(100 + i, f"Item {i} is left (as are all.\nIt ends here.", "sloppy") for i in range(8)]
    odd = "The parser reads (a list of\nthree lines up\nand items and their ends."
    assert found(spark, [*tidy, *sloppy, (50, odd, "tidy"), (150, odd, "sloppy"), (51, 'She said "this is the end of the long.', "tidy"), (52, "<div><p>Hello there. All is fine.", "tidy")]) == [50, 51, 52]


def test_ends_on_purpose_are_no_certain_cases(spark):
    tidy = [(i, f"Item {i} is whole. It ends here.", "s") for i in range(8)]
    assert found(spark, [*tidy, (50, "We thank the reviewers. Kind regards, Anna Lee", "s"), (51, "Visit us soon. Building 7, Room 12", "s"), (52, "Visit us soon. The rig was held at 19.5 degrees on commodity h", "s")]) == [52]


def test_long_ends_are_seen_whole(spark):
    tidy = [(i, f"Item {i} is whole. It ends here.", "s") for i in range(8)]
    long = "Write to a@b.example " + "and go on " * 200 + "until it bre"
    assert found(spark, [*tidy, (60, "Fine. " + long, "s")]) == [60]
