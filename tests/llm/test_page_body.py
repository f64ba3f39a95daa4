import random
import tracemalloc

import numpy as np
import pytest

from docweave.llm.page_body import body_only, even, find_furniture, furniture_of, grow, line_of, match_nodes, nodes_of, role_of, tree_of

BODY = ["We applied the method to field data and examined where it fails.", "- Practice in low-light imaging", "professor: Ga-on Kim", "OmriTrack | 장면 이해 | 1.3% | 2022", "쿠키 추적을 막는 기법도 연구의 한 갈래이다.", "Copyright concerns led us to replace 2015 logs with synthetic material. It worked.", "About the library of Alexandria", "Research on turtles", "Cookies were found by probes in 2019."]


@pytest.mark.parametrize(
    "line, role",
    [
        ("홈 | 강의 | 논문 | Nafafa", "menu"), ("Home &gt; Faculty &gt; The Orlo-GAN project", "path"), ("Skip to content | People", "tool"), ("« 9 · 16 »", "pager"), ("다음 글 ▼ 2020년 성과", "neighbour"),
        ("Related stories (3)", "list_head"), ("▸ 지식 그래프 소개 ›", "link"), ("작성자: 운영자 (X) · 등록일 2024.11.22 · 조회 976", "byline"), ("최종 수정일 2024/11/24 / 편집부", "stamp"),
        ("Copyright (c) 2023 X Lab. All rights reserved.", "legal"), ("This site uses cookies to count visits.", "consent"), ("태그: 가, 나", "tags"), ("첨부파일 35개 내려받기 (X.zip)", "download"), ("댓글 3개 | 의견", "comment"),
        ("Bookmark this article", "tool"), ("Accept all | Reject all", "consent"), ("Cookies help us deliver our services", "consent"), ("Mentions légales", "legal"), ("Impressum | Datenschutz", "legal"), ("Share on Facebook", "share"), ("Read next: The second part", "neighbour"), ("5 min read", "stamp"),
    ],
)
def test_roles(line, role):
    assert role_of(line) == role


def test_body_has_no_furniture_role():
    assert [r for _, r, *_ in tree_of("\n".join(BODY)) if r not in ("item", "prose", "other")] == []


def test_nodes():
    label, fields = nodes_of("Home > Faculty > The Orlo-GAN project")
    assert label == "# > # > the # project" and fields == ["home", "faculty", "the # project"]
    assert nodes_of("Publications") == ("publications", [])
    assert nodes_of("12 | 13%")[1] == []


def best(w):
    t = [[0.0] * (w.shape[1] + 1) for _ in range(w.shape[0] + 1)]
    for i in range(w.shape[0]):
        for j in range(w.shape[1]):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + w[i, j])
    return t[-1][-1]


def test_tree_matching_is_maximal_and_in_order():
    rng = random.Random(5)
    for _ in range(200):
        w = np.array([[rng.choice([0, 0, 1, 2]) for _ in range(rng.randint(1, 9))]], dtype=np.float32)
        w = np.array([[rng.choice([0, 0, 1, 2]) for _ in range(w.shape[1])] for _ in range(rng.randint(1, 9))], dtype=np.float32)
        pairs = match_nodes(w)
        assert sum(w[i, j] for i, j in pairs) == best(w)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])) and all(w[i, j] > 0 for i, j in pairs)


def test_pages_of_many_lines_are_matched_without_a_table_of_all_pairs():
    pages = [[(n, []) for n in range(8_000) if n % 7 != k] for k in range(3)]
    tracemalloc.start()
    met = grow(pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met[3] == 3 and met[7] == 2 and most < 60e6  # a table of four bytes a pair takes 190 MB


def test_of_equal_ways_the_earliest_rows_are_taken():
    assert match_nodes(np.ones((3, 2), dtype=np.float32)) == [(0, 0), (1, 1)]
    assert match_nodes(np.array([[0, 2, 0], [1, 0, 0], [0, 1, 0]], dtype=np.float32)) == [(0, 1)]


@pytest.mark.parametrize("line", ["Home | News", "About 12/13: a & b", "a &gt; b  c\td", "Home\u00a0>  News", "in\u200bvisible", "We renewed more of it.", "소개 더보기", "이용약관 및 &nbsp; 안내", "x" * 20])
def test_short_cuts_for_even_lines_change_nothing(line):
    role, label, fields = line_of(line)
    assert (role, len(fields)) == (role_of(line), len(nodes_of(line)[1]))
    if even(line) == line:
        assert nodes_of(line, True) == nodes_of(line) and role_of(line, True) == role_of(line)


def test_template_grows_over_pages():
    pages = [[(1, []), (10 + k, []), (2, [7, 8])] for k in range(4)] + [[(2, [7, 9])], [(1, []), (3, []), (2, [7])], [(3, [])]]
    met = grow(pages)
    assert met[1] == 5 and met[2] == 6 and met[7] == 6 and met[3] == 2 and 10 not in met


def test_slots_of_a_furniture_list():
    lines, roles = [1, 2, 3, 4, 6], ["list_head", "link", "other", "prose", "other"]
    args = (lines, roles, [0] * 5, [[]] * 5)
    assert furniture_of(*args, set(), set(), set()) == [1, 2, 3]
    assert furniture_of(*args, set(), set(), {"list_head", "link"}) == []


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    return {(r["doc_id"], r["line_no"]) for r in find_furniture(df, "doc_id", "text", "url").collect()}


WORDS = "amber birch cedar delta ember fjord grove haven inlet joker knoll larch maple night ocean prism".split()


def own(i):
    return f"Sentence about {WORDS[i % 16]} and {WORDS[i // 16 % 16]} is here to be told apart."


def test_unseen_phrases_of_a_host(spark):
    pages = [(i, f"Zut alors | Quoi | Bof\n{own(i)}\nNagyon fontos, hogy ezt a sort minden oldalon ugyanúgy olvassa mindenki, aki erre a kis helyre jár, és soha ne felejtse el, kérjük szépen, amíg csak lehet", "https://h.test/x") for i in range(16)]
    assert found(spark, pages) == {(i, n) for i in range(16) for n in (1, 3)}  # the notice has more than 140 characters


def test_host_of_five_pages(spark):
    pages = [(i, f"Ein fester Satz steht oben auf jeder Seite\n{own(i)}", "https://five.test/x") for i in range(5)]
    assert found(spark, pages) == {(i, 1) for i in range(5)}


def test_alignment_overrules_roles(spark):
    pages = [(i, own(i) + "\n" + own(i + 31), "https://big.test/x") for i in range(700)]
    pages[3] = (3, own(3) + "\nWelcome to our new members", "https://big.test/x")
    small = [(1000 + i, own(i) + "\nWelcome to our new members", "https://small.test/x") for i in range(2)]
    got = found(spark, [*pages, *small])
    assert (3, 2) not in got and {(1000, 2), (1001, 2)} <= got


def test_wrapper_of_unknown_lines_and_odd_rows(spark):
    pages = [(i, f"Our own banner number {i}\n{own(i)}\nHome | News | People", f"https://h.test/{i}") for i in range(16)]
    rows = [*pages, pages[0], (50, None, "https://h.test/50"), (51, "", None), (52, "Home | News", "no url"), (None, "Home | News", "https://h.test/x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, url string, line_no int")
    got = {(r["doc_id"], r["line_no"]) for r in find_furniture(df, "doc_id", "text", "url").collect()}
    assert {(i, 3) for i in range(16)} | {(i, 1) for i in range(16)} | {(52, 1)} == got
    bodies = {r["doc_id"]: r["body"] for r in body_only(df.filter("doc_id IS NOT NULL"), "doc_id", "text", "url").collect()}
    assert bodies[3].startswith("Sentence about delta") and bodies[3].count("\n") == 0 and bodies[50] is None and bodies[51] == ""
    assert find_furniture(df.limit(0), "doc_id", "text", "url").count() == 0
