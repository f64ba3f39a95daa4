import pytest

from docweave.llm.pii import find_pii, mask, mentions, name_key, valid_number


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("문의처yuldam_kang@cs.naru.example에서", "email", "yuldam_kang@cs.naru.example"),
        ("write to a.b [at] x [dot] example.", "email", "a.b [at] x [dot] example"),
        ("to wes@x.example으로", "email", "wes@x.example"),
        ("전화 (010) 0149-1041 | x", "phone", "(010) 0149-1041"),
        ("phone 02)0646-4914.", "phone", "02)0646-4914"),
        ("Tel +82-31-0458-8367, x", "phone", "+82-31-0458-8367"),
        ("전화 ０１０－０６１５－５８７０ |", "phone", "０１０－０６１５－５８７０"),
        ("| (09246) 나루시 물레구 물빛로 18 | 전화", "street_address", "(09246) 나루시 물레구 물빛로 18"),
        ("택배는 다온시 느티구 물빛로 468, 117동 241호로 보내", "street_address", "다온시 느티구 물빛로 468, 117동 241호"),
        ("at 336 Osterley Lane, Apt 23, Norvale and", "street_address", "336 Osterley Lane, Apt 23, Norvale"),
        ("주소 서울시 강남구 테헤란로 152 강남파이낸스센터 12층 입니다", "street_address", "서울시 강남구 테헤란로 152 강남파이낸스센터 12층"),
        ("write " + "a" * 90 + "@x.example", "email", "a" * 90 + "@x.example"),
        ("an jürgen.müller@büro.example senden", "email", "jürgen.müller@büro.example"),
        ("mail ann at lab dot example now", "email", "ann at lab dot example"),
        ("call 555-010-9999 now", "phone", "555-010-9999"),
        ("at 12 rue de la Paix, 75002 Paris.", "street_address", "12 rue de la Paix, 75002 Paris"),
        ("at 221B Baker Street.", "street_address", "221B Baker Street"),
        ("in Hauptstraße 12, 10115 Berlin.", "street_address", "Hauptstraße 12, 10115 Berlin"),
        ("SSN 123-45-6789.", "id_number", "123-45-6789"),
        ("und José García kam", "person_name", "José García"),
        ("von Müller Jürgen.", "person_name", "Müller Jürgen"),
        ("by Pat O'Brien-Smith.", "person_name", "Pat O'Brien-Smith"),
    ],
)
def test_shapes(text, kind, value):
    found = [(k, text[a:b]) for a, b, k, *_ in mentions(text) if k == kind]
    assert found == [(kind, value)]


@pytest.mark.parametrize("text", ["계정 @Kugilan_lab 에서", "일련번호는 768905-6044820이며", "특허 10-2015-0096449", "ISSN 2572-9700", "release 21.55.0-2016", "표본만으로 37.0배 빠르게", "주행로 97호"])
def test_decoys(text):
    assert [m for m in mentions(text) if m[2] in ("email", "phone", "street_address") and m[5] == 2] == []


@pytest.mark.parametrize("text", ["Ann lists student ID no. 12227072 as", "(student ID 12168095) last", "제출자의 학번는 12167759)의", "학번: 12171288로", "학번\n12171288로"])
def test_labels_of_numbers(text):
    (label,) = [m[4].split("\t")[1] for m in mentions(text) if m[2] == "id_number"]
    assert "학번" in label or "studentid" in label


def values(spark, texts, seeds=()):
    rows = [("t", i, t) for i, t in enumerate(texts)]
    found = find_pii(spark.createDataFrame(rows, "table_name string, doc_id long, text string"), spark.createDataFrame([(x,) for x in seeds], "name string"))
    return {(r["pii_kind"], texts[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in found.collect()}


def test_patterns_of_full_forms_lead_to_loose_ones(spark):
    texts = [f"You may phone 010-0149-104{i} today. Serial 32{i}-110-777{i} is stamped. Visitors come to 33{i} Osterley Lane, Norvale on Monday." for i in range(6)]
    texts += ["You may phone 555-010-9999 today. Serial 555-010-8888 is stamped.", "Visitors come to 221B Baker Street on Monday. We own 12 Best Poster awards.", "Visitors come to 12 rue de la Paix, 75002 Paris on Monday."]
    texts += [f"Mail goes to ann{i}@lab.example soon." for i in range(4)] + ["Mail goes to bea at lab dot example soon.", "It is at lab dot com level."]
    got = values(spark, texts)
    assert {v for k, v in got if k == "phone"} == {f"010-0149-104{i}" for i in range(6)} | {"555-010-9999"}
    assert {v for k, v in got if k == "street_address"} == {f"33{i} Osterley Lane, Norvale" for i in range(6)} | {"221B Baker Street", "12 rue de la Paix, 75002 Paris"}
    assert {v for k, v in got if k == "email"} == {f"ann{i}@lab.example" for i in range(4)} | {"bea at lab dot example"}
    assert not {v for k, v in got if k == "person_name"}


def test_full_forms_under_a_label_of_other_things_are_left(spark):
    texts = [f"Part {300 + i}-{100 + i}-{7000 + i} fits." for i in range(60)] + ["Part 010-0149-1041 fits.", "Call 010-0149-1042 now."]
    assert values(spark, texts) == {("phone", "010-0149-1042")}


def test_known_numbers_lead_to_further_labels(spark):
    texts = [f"Passport M1234567{i} was seen." for i in range(4)] + [f"Reisepass M1234567{i} liegt vor." for i in range(4)] + ["Reisepass M99999999 liegt vor.", "Bauteil M55555555 liegt vor.", "Her SSN 123-45-6789 is on file."]
    assert {v for _, v in values(spark, texts)} == {f"M1234567{i}" for i in range(4)} | {"M99999999", "123-45-6789"}


def test_names_with_marks_are_discovered(spark):
    people = ["José García", "Ann Lee", "Bo Berg", "Müller Jürgen", "Cid Dahl", "Zoë Brontë"]
    got = values(spark, [f"The desk was given to {p} after the meeting." for p in people], ["Ann Lee", "Bo Berg", "Cid Dahl"])
    assert got == {("person_name", p) for p in people}


def test_keys_and_dates():
    assert name_key("KWON Dan-byeol") == name_key("Dan-byeol Kwon") == "danbyeolkwon"
    assert name_key("남궁 해담") == "남궁해담" and name_key("Ishko A. Velmark") == "ishkovelmark"
    assert valid_number("850318 - 2557890") and not valid_number("835050-6913944")


def test_bootstrapping_finds_unseen_names(spark):
    people = ["임해담", "홍루솔", "안별새", "서겸찬", "강결담", "김찬빈"]
    rows = [("t", i, f"행사 사진은 {p} 학생이 모으고 있다. 정밀한 결과를 얻었다. 이러한 접근은 좋다.") for i, p in enumerate(people)]
    rows += [("t", 20 + i, f"담당자는 {p} 교수이며 바쁘다. 장비 일련번호는 83505{i}-6913944이다. 제출자 주민번호 85031{i}-2557890로 확인.") for i, p in enumerate(people[1:])]
    rows += [("t", 90, None), ("t", 91, ""), ("t", None, "담당자는 임해담 교수이며"), ("u", 0, "담당자는 송온빈 교수이며 한다."), ("u", 0, "담당자는 송온빈 교수이며 한다.")]
    texts = spark.createDataFrame([(*r, "x") for r in rows], "table_name string, doc_id long, text string, pii_kind string")
    seeds = spark.createDataFrame([("임해담 교수",), ("홍루솔",), ("안별새(책임)",), (None,), ("서겸찬",)], "name string")
    found = find_pii(texts, seeds)
    text_of = {(a, b): c for a, b, c in rows}
    got = {(r["table_name"], r["doc_id"], text_of[r["table_name"], r["doc_id"]][r["start_pos"] : r["end_pos"]], r["pii_kind"]) for r in found.collect()}
    names = {g[2] for g in got if g[3] == "person_name"}
    assert names == {*people, "송온빈"}
    assert {g[2] for g in got if g[3] == "id_number"} == {f"85031{i}-2557890" for i in range(5)}
    masked = {(r["table_name"], r["doc_id"]): (r["text"], r["has_pii"]) for r in mask(texts.filter("doc_id IS NOT NULL"), found).collect()}
    assert masked["u", 0] == ("담당자는 [PERSON_NAME] 교수이며 한다.", True)
    assert masked["t", 90] == (None, False) and masked["t", 91] == ("", False)
    assert find_pii(texts.limit(0), seeds).count() == 0
    assert find_pii(texts, seeds.limit(0)).filter("pii_kind = 'id_number'").count() == 5


def test_one_pattern_of_nearly_all_rows(spark):
    texts = [f"Passport M{10000000 + i} was seen." for i in range(400)] + ["Passport M99999999 was lost."]
    assert len(values(spark, texts)) == 401


def test_ten_copies_give_the_same_spans(spark):
    people = ["임해담", "홍루솔", "안별새", "서겸찬", "강결담", "김찬빈"]
    rows = [(i, f"행사 사진은 {p} 학생이 모으고 있다. 정밀한 결과를 얻었다.") for i, p in enumerate(people)]
    rows += [(20 + i, f"담당자는 {p} 교수이며 바쁘다. 장비 일련번호는 83505{i}-6913944이다.") for i, p in enumerate(people[1:])]
    seeds = spark.createDataFrame([(p,) for p in people[:4]], "name string")

    def spans(copies):
        texts = spark.createDataFrame([("t", 1000 * c + i, t) for c in range(copies) for i, t in rows], "table_name string, doc_id long, text string")
        return {(r["doc_id"], r["start_pos"], r["end_pos"], r["pii_kind"]) for r in find_pii(texts, seeds).collect()}

    once = spans(1)
    assert len(once) == 11 and {k for *_, k in once} == {"person_name"}
    assert spans(10) == {(1000 * c + d, *rest) for c in range(10) for d, *rest in once}
