import random

from docweave.llm.language import Identifier, automaton, code_of, fold, identify, find_wrong_labels, main_sentences, pieces

EN = ["The group studies the flow of heat in small devices.", "We trained the model on weather data from the station.", "Students join a weekly seminar and review the code together."]
DE = ["Die Gruppe untersucht den Fluss der Waerme in kleinen Geraeten.", "Wir haben das Modell mit Wetterdaten der Station trainiert.", "Die Studierenden nehmen jede Woche an einem Seminar teil."]
KO = ["우리 연구실은 작은 장치의 열 흐름을 연구합니다.", "기상 관측치를 이용해 모델을 학습하였다.", "학생들은 매주 세미나에 참여하고 코드를 함께 검토합니다."]


def brute_pieces(text, corpus):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in corpus:
            j += 1
        n, i = n + 1, j
    return n


def test_automaton_parses_like_substring_search():
    rng = random.Random(3)
    for _ in range(200):
        corpus = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 20)))
        assert pieces(text, automaton(corpus), 10**6) == brute_pieces(text, corpus)


def test_pruning_changes_no_winner():
    ident = Identifier({"en": " ".join(EN), "de": " ".join(DE), "ko": " ".join(KO)})
    for s in EN + DE + KO:
        counts = {k: pieces(fold(s), r, 10**6) for k, r in ident.roots.items()}
        for first in (None, "en", "ko"):
            assert ident.of(s, first)[0] == min(counts, key=counts.get)


def test_labels():
    assert [code_of(x) for x in ("ko-KR", "Korean", "ENG", "zh_CN", "und", "", None, "N/A", "Mixed")] == ["ko", "ko", "en", "zh", None, None, None, None, "mixed"]


def test_furniture_and_wrapped_lines():
    whole, _ = main_sentences("Home | People | News\nThe group studies the flow\nof heat in devices.\nCopyright © 2020 X Lab. All rights reserved.\n- item")
    assert whole == ["The group studies the flow of heat in devices."]


def test_rows(spark):
    train = [(i, " ".join(x), k) for k, x in (("en", EN), ("de", DE), ("ko", KO)) for i in range(3)]
    train = spark.createDataFrame([(n, t, k) for n, (_, t, k) in enumerate(train)], "doc_id long, text string, lang string")
    rows = [
        (1, EN[0] + " " + EN[1], "en"), (2, EN[0] + " " + EN[2], "Korean"), (3, KO[0] + " " + KO[1] + "\n" + EN[1] + " " + EN[2], "mixed"), (4, KO[0], None), (5, None, "en"), (6, "", "en"), (7, "12 34 .", None),
        (8, DE[0] + " " + DE[2], "deu"), (8, DE[0] + " " + DE[2], "deu"), (9, EN[0] + " " + EN[1] + " " + KO[0] + " " + KO[2] + " " + EN[2], "en"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, seg_no string")
    got = sorted((r["doc_id"], r["seg_no"], r["lang_found"]) for r in find_wrong_labels(df, "doc_id", "text", "lang", train).collect())
    assert got == [(2, 0, "en"), (3, 1, "ko"), (3, 2, "en"), (4, 0, "ko"), (9, 0, "mixed"), (9, 1, "en"), (9, 2, "ko"), (9, 3, "en")]
    assert all(0 <= r["confidence"] <= 1 for r in identify(df, "doc_id", "text", "lang", train).collect())
    assert find_wrong_labels(df.limit(0), "doc_id", "text", "lang", train).count() == 0
    assert find_wrong_labels(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang IN ('ko', 'en', 'ja', 'zh', 'de', 'fr')")
    found = identify(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "lang", docs.filter("doc_id % 2 = 1")).filter("seg_no = 0").collect()
    right = sum(r["lang_found"] == r["label"] for r in found)
    assert right >= 0.9 * len(found)
