import random
from collections import defaultdict

import pytest

from docweave.llm.packing import broken_rules, encoder, fill_rates, first_fit, pack
from docweave.llm.queries import TOKENIZER


def naive(sizes, capacity):
    free, out = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(capacity)
        free[k] -= s
        out.append(k)
    return out


def test_tree_equals_scan():
    rng = random.Random(7)
    for _ in range(300):
        sizes = sorted((rng.randint(0, 20) for _ in range(rng.randint(0, 40))), reverse=True)
        assert first_fit(sizes, 20) == naive(sizes, 20)


def test_nothing_is_lost_or_overfull(spark):
    try:
        enc = encoder(TOKENIZER)
    except OSError:
        pytest.skip("the vocabulary is not here")
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["연구", "data", "flow", "가나다"]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(500, "word " * 400), (501, None), (502, ""), (503, "same"), (503, "same"), (None, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(4)
    specs = spark.createDataFrame([(1, 64), (2, 300)], "pack_id long, capacity_tokens int")
    got = pack(df, "doc_id", "text", specs, TOKENIZER, group_docs=50).collect()
    size = {d: len(enc.encode_ordinary(t or "")) for d, t in rows if d is not None}
    for pack_id, capacity in ((1, 64), (2, 300)):
        used, tokens, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
        for r in got:
            if r["pack_id"] == pack_id:
                used[r["group_no"], r["container_no"]] += r["n_tokens"]
                tokens[r["doc_id"]] += r["n_tokens"]
                pieces[r["doc_id"]].append(r["piece_no"])
        assert max(used.values()) <= capacity
        assert tokens == {d: n * (2 if d == 503 else 1) for d, n in size.items()}
        assert all(len(p) == max(1, -(-size[d] // capacity)) for d, p in pieces.items() if d != 503)
    rates = {r["pack_id"]: r["fill"] for r in fill_rates(pack(df, "doc_id", "text", specs, TOKENIZER, group_docs=50), specs).collect()}
    assert rates[1] > 0.8
    assert pack(df.limit(0), "doc_id", "text", specs, TOKENIZER).count() == 0
