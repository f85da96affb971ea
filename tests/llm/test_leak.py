import random

import pytest

from tidemark.llm import leak

DOCS = "doc_id long, text string, item_id string, n_removed string"
ITEM = "Der Fluß trägt, im Mai, 4363 kleine Boote über den Rand hinaus (weit) fort."
WORDS = ITEM.replace(",", "").replace("(", "").replace(")", "").replace(".", "").split()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


def items(spark, *texts):
    return spark.createDataFrame([(i + 1, t, "de") for i, t in enumerate(texts)], "item_id long, text string, lang string")


HITS = [
    ITEM,
    "so: " + " ".join(WORDS[2:10]),
    "x " + " ".join(WORDS[:8]).upper() + "!",  # ß becomes SS
    "-".join(WORDS[3:11]),
    " ".join(WORDS[3:11]).replace("4363", "４３６３").replace("e", "е"),
    "\n\t".join(WORDS[1:9]).replace("ä", "ä").replace("Mai", "M​ai"),
]
MISSES = [
    " ".join(WORDS[2:9]),  # seven words
    " ".join(WORDS[:5] + ["neu"] + WORDS[5:]).replace("hinaus", "hinein"),
    " ".join(WORDS[2:10]).replace("über", "uber"),  # another accent
    " ".join(WORDS[2:10]).replace("4363", "436³"),
    " ".join(WORDS[2:10]).replace("Mai", "May"),
    "",
    None,
    "...",
]


@pytest.mark.parametrize("limit", [leak.ROUND_HASHES, 4])
def test_what_leaks(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(leak, "ROUND_HASHES", limit)  # 4: several rounds
    found = leak.leaks(docs(spark, HITS + MISSES), items(spark, ITEM, "too short to leak", None, ITEM + " noch mehr"))
    assert rows(found) == sorted([(i, d) for d in range(len(HITS)) for i in (1, 4)], key=repr)
    assert rows(leak.leaks(docs(spark, []), items(spark, ITEM))) == []
    assert rows(leak.leaks(docs(spark, HITS), items(spark, ITEM).limit(0))) == []


def test_case_and_shape_together(spark, rows):
    # A Latin capital in a Cyrillic word of capitals reads as the lower-case Cyrillic letter.
    word = "новый свет время река поле лес небо вода"
    found = leak.leaks(docs(spark, [word.upper().replace("Н", "H").replace("В", "B"), word.replace("в", "b"), "δεν " * 8, "ΔEN " * 8, "δεn " * 8]), items(spark, word, "δεν " * 8))
    assert rows(found) == [(1, 0), (2, 2), (2, 3)]


def test_random_against_brute_force(spark, rows):
    r = random.Random(8)
    vocabulary = ["no", "nо", "Pay", "РАУ", "x", "vine", "fi", "ﬁ"]
    its = [" ".join(r.choices(vocabulary[:6:2], k=12)) for _ in range(6)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(40))) for _ in range(60)]
    low = lambda t: [{"nо": "no", "Pay": "pay", "РАУ": "pay", "ﬁ": "fi"}.get(w, w.lower()) for w in t.split()]
    grams = lambda ws: {tuple(ws[k : k + 8]) for k in range(len(ws) - 7)}
    want = [(i + 1, d) for i, it in enumerate(its) for d, t in enumerate(texts) if grams(low(it)) & grams(low(t))]
    assert rows(leak.leaks(docs(spark, texts), items(spark, *its))) == sorted(want, key=repr)


def test_repeated_and_null_ids(spark, rows):
    its = spark.createDataFrame([(1, ITEM), (1, "ganz andere Wörter stehen hier in diesem zweiten Text"), (1, ITEM), (None, ITEM)], "item_id long, text string")
    ds = spark.createDataFrame([(None, ITEM), (7, "Ganz andere Wörter stehen hier in diesem zweiten"), (7, ITEM)], "doc_id long, text string")
    assert rows(leak.leaks(ds, its)) == sorted([(1, None), (None, None), (1, 7), (None, 7)], key=repr)


def test_spans_are_cut(spark, rows):
    long = "w " * 50_000
    texts = ["vor " + HITS[4] + " nach", ITEM, "nichts", None, "", long + ITEM]
    got = {d: (t, n) for d, t, n in rows(leak.cleaned(docs(spark, texts), items(spark, ITEM)))}
    assert got == {0: ("vor  nach", 1), 1: (".", 1), 2: ("nichts", 0), 3: (None, 0), 4: ("", 0), 5: (long + ".", 1)}
    twice = " ".join(WORDS[:8]) + " und " + " ".join(WORDS[4:13])
    assert rows(leak.cleaned(docs(spark, [twice]), items(spark, ITEM))) == [(0, " und " + " ".join(WORDS[13:13]), 2)]


def test_spans_are_cut_alike_in_rounds(spark, rows, monkeypatch):
    r = random.Random(9)
    texts = [*HITS, *MISSES, "vor " + ITEM + " mitten " + ITEM + " nach", ITEM, ITEM] + [" ".join(r.choices(WORDS[:2], k=3) + WORDS[r.randrange(5) :] + WORDS) for _ in range(20)]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(0, "anders " + ITEM, "x", "y"), (None, ITEM, "x", "y")], DOCS))
    its = items(spark, ITEM, "too short to leak", None, ITEM + " noch mehr", " ".join(WORDS[2:]))
    sent = rows(leak.cleaned(df, its))
    monkeypatch.setattr(leak, "ROUND_HASHES", 3)
    monkeypatch.setattr(leak, "CHUNK_WORDS", 20)
    joined = leak.cleaned(df, its)
    assert rows(joined) == sent and joined.columns == ["doc_id", "text", "n_removed"] and sum(n for *_, n in sent) > 30
    assert rows(leak.cleaned(df, its.where("text IS NULL"))) == rows(df.selectExpr("doc_id", "text", "0"))
