import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docweave.operators.packed import split_batch, split_packed


def items(text):
    return split_batch(pa.array([text], pa.string()))[2].to_pylist()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a, b; c", ["a", "b", "c"]),
        ("C/C++; TCP/IP; F#", ["C/C++", "TCP/IP", "F#"]),
        ("Objective-C//회로 설계/C#/R", ["Objective-C", "회로 설계", "C#", "R"]),
        ("R / Node.js|Loop / \"HTML/CSS\"，Java", ["R", "Node.js", "Loop", "HTML/CSS", "Java"]),
        ("\"OQM, Tier 2\" 및 기사", ["OQM, Tier 2", "기사"]),
        ('["Java", "Objective-C"]', ["Java", "Objective-C"]),
        ('["TQB \\"Gold\\"", "X"]', ['TQB "Gold"', "X"]),
        ('Lunfabo상，"Lunfabo ""지식"" 상"', ["Lunfabo상", 'Lunfabo "지식" 상']),
        ("“Best, X”，상", ["Best, X", "상"]),
        ("(1) a (2) b, c (3) d", ["a", "b, c", "d"]),
        ("1. Qt (5, 6)\n2. b", ["Qt (5, 6)", "b"]),
        ("* Best Poster, X\n* 상", ["Best Poster, X", "상"]),
        ("#NSX-F1 #품질", ["NSX-F1", "품질"]),
        ("3,000인 대회 1위 / 상(팀, 4인)", ["3,000인 대회 1위", "상(팀, 4인)"]),
        ("대상 (2021, 2022)·상", ["대상 (2021, 2022)", "상"]),
        (" a ,, a ,", ["a", "a"]),
        ("없음", []),
        ("N/A", []),
        ("", []),
        (None, []),
        ('broken "quote, b', ['broken "quote', "b"]),
        ("open (bracket, b", ["open (bracket", "b"]),
    ],
)
def test_cases(text, expected):
    assert items(text) == expected


def test_rows_positions_and_odd_input(spark):
    rows = [(1, "a, b", None, "extra"), (1, "a, b", None, "extra"), (2, "없음", " ", "x"), (3, None, "p|q|p", "y"), (None, "z, y", None, "w"), (4, "Git Java", "Git, Java; Scala", "v")]
    df = spark.createDataFrame(rows, "id long, f string, g string, item_value string")
    got = sorted(tuple(r) for r in split_packed(df, "id", ["f", "g"]).collect())
    assert got == [(1, "f", 1, "a"), (1, "f", 2, "b"), (3, "g", 1, "p"), (3, "g", 2, "q"), (3, "g", 3, "p"), (4, "f", 1, "Git Java"), (4, "g", 1, "Git"), (4, "g", 2, "Java"), (4, "g", 3, "Scala")]
    assert split_packed(df.limit(0), "id", ["f", "g"]).count() == 0


def test_spaces_separate_known_words(spark):
    df = spark.createDataFrame([(1, "Git Java"), (2, "Git, Java"), (3, "Spring Boot")], "id long, f string")
    got = sorted(tuple(r) for r in split_packed(df, "id", ["f"]).collect())
    assert got == [(1, "f", 1, "Git"), (1, "f", 2, "Java"), (2, "f", 1, "Git"), (2, "f", 2, "Java"), (3, "f", 1, "Spring Boot")]


@given(st.lists(st.text("abcXYZ가나 .", min_size=1, max_size=8).filter(lambda s: s.strip() and s.strip(".") == s.strip()), min_size=2, max_size=6))
def test_round_trip(entries):
    entries = [" ".join(e.split()) for e in entries]
    assert items("|".join(entries)) == entries


def test_batches_do_not_mix():
    parents, glued, values = split_batch(pa.array(["a,b", None, '"open', "c", "d/e"], pa.string()).slice(0))
    assert list(zip(parents.tolist(), glued.tolist(), values.to_pylist())) == [(0, False, "a"), (0, False, "b"), (2, False, '"open'), (3, False, "c"), (4, False, "d"), (4, True, "e")]
    assert split_batch(pa.array(["x", "a,b", "c"]).slice(1))[2].to_pylist() == ["a", "b", "c"]


def test_terms_with_a_slash_are_learned(spark):
    rows = [(i, f"Client/Server, {x}") for i, x in enumerate(["Java", "Go", "R", "C#"])] + [(10, "Go/Java"), (11, "Java/Go/R"), (12, "R/C#"), (13, "C#/Go"), (14, "Client/Server/Go"), (15, "AC/DC 변환기, Go"), (16, "Zig/Ada")]
    got = {}
    for r in split_packed(spark.createDataFrame(rows, "id long, f string"), "id", ["f"]).orderBy("id", "item_pos").collect():
        got.setdefault(r["id"], []).append(r["item_value"])
    assert got[0] == ["Client/Server", "Java"] and got[10] == ["Go", "Java"] and got[11] == ["Java", "Go", "R"]
    assert got[14] == ["Client/Server", "Go"] and got[15] == ["AC/DC 변환기", "Go"] and got[16] == ["Zig", "Ada"]


def test_one_value_in_nearly_every_row(spark):
    df = spark.range(4_000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'Git Java' ELSE 'Git, Java; Client/Server' END AS f")
    assert split_packed(df, "id", ["f"]).count() == 3_600 * 2 + 400 * 3
