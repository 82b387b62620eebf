import math
import random
import re
import unicodedata

from lavra.llm import leakage


def words(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


def brute(docs, items, skips):
    out = set()
    for i, text in items.items():
        w = words(text)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        body = w[skips.get(i, 0) :]
        need, span = math.ceil(0.75 * len(body) - 1e-9), int(1.3 * len(body) + 1e-9)
        for d, t in docs.items():
            x = words(t or "")
            hit = any(tuple(x[k : k + 12]) in grams for k in range(len(x) - 11))
            for a in range(len(x)) if not hit and body else ():
                y, row = x[a : a + span], [0] * (len(body) + 1)
                for p in y:
                    prev = 0
                    for j, q in enumerate(body, 1):
                        prev, row[j] = row[j], max(row[j], row[j - 1], prev + (p == q))
                if row[-1] >= need:
                    hit = True
                    break
            if hit:
                out.add((d, i))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(k, v, "x", 1) for k, v in docs.items()], "doc_id bigint, text string, term string, pos int")
    i = spark.createDataFrame([(k, v, "x") for k, v in items.items()], "item_id bigint, text string, words string")
    return {(r.doc_id, r.item_id) for r in leakage.search(leakage.build_index(d), d, leakage.prepare_items(i)).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["de", "o"] * 10
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {100 + k: "Leia com calma. " * (k < 3) + " ".join(say(rng.randint(14, 30))) for k in range(8)}
    docs = {}
    for k in range(60):
        text = say(rng.randint(0, 60))
        src = words(rng.choice(list(items.values())))
        kind = k % 5
        if kind == 0:
            a = rng.randint(0, len(src) - 12)
            text[5:5] = src[a : a + rng.choice([11, 12, 13])]
        elif kind == 1:
            copy = [w for w in src if rng.random() > 0.2]
            for _ in range(rng.randint(0, 4)):
                copy.insert(rng.randrange(len(copy)), "novo")
            text[3:3] = copy
        elif kind == 2:
            text += src * 2
        docs[k] = " ".join(text).upper() if k % 2 else " ".join(text)
    docs[90], docs[91] = None, ""
    assert run(spark, docs, items) == brute(docs, items, {100: 3, 101: 3, 102: 3})


def test_accents_case_and_copies(spark):
    item = "A guia 353 de março traz 56 unidades da câmera termal vindas de Ilha Grauna ao 69º Batalhão"
    docs = {1: item.upper(), 2: "x " + item, 3: "nada disso", 4: "a guia 353 de marco traz 56 unidades da camera termal vindas de ilha grauna ao 69o batalhao", 5: item}
    assert run(spark, docs, {7: item}) == {(d, 7) for d in (1, 2, 4, 5)}


def test_empty_tables(spark):
    assert run(spark, {}, {1: "a b c"}) == set() and run(spark, {1: "a b c"}, {}) == set() and run(spark, {1: None}, {1: None}) == set()


def test_short_items_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(k % 8 + 1)) for k in range(1, 25)}
    docs = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for k in range(60)} | {100 + k: v for k, v in items.items()}
    assert run(spark, docs, items) == brute(docs, items, {})


def test_an_index_is_opened_again_and_long_documents_are_judged_by_stretches(spark, tmp_path):
    rng = random.Random(4)
    item = " ".join(f"t{rng.randint(0, 300)}" for _ in range(60))
    noise = " ".join(f"t{rng.randint(0, 300)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, noise), (2, noise[:100_000] + " " + item + " " + noise[100_000:]), (None, item)], "doc_id bigint, text string")
    built = leakage.build_index(docs, path=f"file://{tmp_path}/index")
    assert built.dictionary.agg({"n": "sum"}).first()[0] == built.postings.count()
    again = leakage.open_index(spark, f"file://{tmp_path}/index")
    asked = leakage.prepare_items(spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in leakage.search(again, docs, asked).collect()} == {(2, 7)}
