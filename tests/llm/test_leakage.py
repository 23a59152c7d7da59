import random

from kbspark.llm import leakage
from kbspark.llm.leakage import LEAST_TOKENS, MISS, SHARE, WIDTH, candidates, item_shingles, leaked_items, size_class
from kbspark.llm.shingles import shingle_hashes, tokens


def brute(items, docs):
    out = set()
    for i, a in items:
        t = tokens(a or "")
        if len(t) < LEAST_TOKENS:
            continue
        for d, x in docs:
            if d is None:
                continue
            b = tokens(x or "")
            held = {tuple(b[k : k + WIDTH]) for k in range(len(b) - WIDTH + 1)}
            inside = {j for k in range(len(t) - WIDTH + 1) if tuple(t[k : k + WIDTH]) in held for j in range(k, k + WIDTH)}
            if len(inside) >= SHARE * len(t):
                out.add((i, d))
    return out


def make(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["中", "文", "Pump", "valve", "naïve", "x_1", "42", "ß", *(f"w{k}" for k in range(400))])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(draw.choice([10, 30, 33, 60, 90, 300, 1500]))) for i in range(25)] + [(99, None), (98, "")]
    docs = []
    for d in range(150):
        body = text(draw.choice([0, 5, 50, 200, 2000])).split(" ")
        if draw.random() < 0.6:
            piece = draw.choice(items)[1] or ""
            words = piece.split(" ")
            size = int(len(words) * draw.choice([0.3, 0.49, 0.5, 0.55, 0.8, 1.0]))
            a = draw.randrange(len(words) - size + 1)
            at = draw.randrange(len(body) + 1)
            body[at:at] = [w.upper() if draw.random() < 0.5 else w for w in words[a : a + size]]
        docs.append((d, " ".join(body)))
    return items, [*docs, (None, docs[4][1]), (900, None), (901, ""), (902, docs[3][1])]


def test_pairs_equal_brute_force(spark):
    items, docs = make(1)
    a = spark.createDataFrame([(*r, "x") for r in items + items[:3]], "item_id long, text string, doc_id string")
    b = spark.createDataFrame([(*r, 1) for r in [*docs, docs[7]]], "doc_id long, text string, item_id int").repartition(3)
    expected = brute(items, docs)
    found = leaked_items(a, b).collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == expected and len(found) == len(expected) > 20
    assert leaked_items(a.limit(0), b).count() == 0 and leaked_items(a, b.limit(0)).count() == 0


def test_hashes_stand_for_shingles():
    texts = ["A b, c_d 12 中文ab", "", "x", "中 文 AB a-B C_D 12", "b c"]
    hashes, owner = shingle_hashes(texts, 2)
    held = [(tuple(tokens(t)[k : k + 2]), i) for i, t in enumerate(texts) for k in range(len(tokens(t)) - 1)]
    assert [i for _, i in held] == owner.tolist()
    assert len({s for s, _ in held}) == len(set(hashes.tolist()))


def test_pairs_by_join_alone(spark, monkeypatch):
    """What is found where the sketches are too large to be sent."""
    monkeypatch.setattr(leakage, "SENT", 0)
    monkeypatch.setattr(leakage, "SENT_IDS", 0)
    monkeypatch.setattr(leakage, "CHARS", 500)
    items, docs = make(2)
    a, b = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leaked_items(a, b).collect()} == brute(items, docs)


def test_coverage_is_exact(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:25])), (3, " ".join([*words[:10], "x", *words[30:]])), (4, " ".join(words[:19])), (5, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["coverage"] for r in leaked_items(items, docs).collect()} == {1: 1.0, 2: 0.5, 3: 0.5}


def test_stock_sentences_make_no_candidates(spark):
    """Every item and every document has the same ten tokens."""
    draw = random.Random(3)
    stock = " ".join(f"stock{k}" for k in range(10))
    body = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    items = [(i, f"{body(15)} {stock} {body(n)}") for i, n in enumerate([10, 30, 60, 90, 400] * 8)]
    docs = [(d, f"{body(60)} {stock} {body(40)} {items[d % 40][1] if d % 4 == 0 else ''}") for d in range(400)]
    a, b = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    true = {(d % 40, d) for d in range(0, 400, 4)}
    assert candidates(item_shingles(a).cache(), b).count() <= 2 * len(true)
    assert {(r["item_id"], r["doc_id"]) for r in leaked_items(a, b).collect()} == true


def test_size_classes():
    assert [size_class(n).fewest for n in (30, 59, 60, 120, 480)] == [2, 2, 3, 6, 24]
    assert size_class(100).rate == 1 and size_class(100).need == size_class(100).fewest
    long = size_class(10_000)
    assert long.rate < 0.05 and 2 <= long.need < 16
    draw = random.Random(1)
    missed = sum(sum(draw.random() < long.rate for _ in range(long.fewest)) < long.need for _ in range(3000))
    assert missed <= 3000 * MISS + 3


def test_long_items_and_items_that_repeat_themselves(spark):
    draw = random.Random(9)
    long = [f"v{draw.randrange(10**6)}" for _ in range(4000)]
    # The weakest case: runs of ten tokens, each apart.
    weak = " ".join(" ".join([*long[k : k + 10], f"gap{k}"]) for k in range(0, 4000, 20))
    items = [(1, " ".join(long)), (2, "a b " * 400), (3, "c " * 600)]
    docs = [(1, weak), (2, " ".join(long[:2000])), (3, " ".join(long[:1990])), (4, "a b " * 20), (5, "c " * 10), (6, "c " * 9), (7, "z")]
    a, b = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    kept = item_shingles(a).filter("item_id = 1").selectExpr("avg(cast(kept AS int))").first()[0]
    assert kept < 0.2
    assert {(r["item_id"], r["doc_id"]) for r in leaked_items(a, b).collect()} == {(1, 1), (1, 2), (2, 4), (3, 5)}


def test_short_chinese_documents_hold_half_of_an_item(spark):
    item = "".join(chr(0x4E00 + 7 * k) for k in range(32))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item[:16]), (2, item[4:21]), (3, item[:15]), (4, item[:9])], "doc_id long, text string")
    assert {r["doc_id"] for r in leaked_items(items, docs).collect()} == {1, 2}
