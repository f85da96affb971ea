import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lookalike
from tidemark.llm.lookalike import Transducer, _form

SAME = [
    ("Hurno 4363, bari!", "Hurno ４３６３，　bari！"),
    ("café", "café"),
    ("café", "саfе́"),  # Cyrillic letters, combining accent
    ("fine flow", "ﬁne ﬂow"),
    ("soft word", "so­ft wo​rd﻿"),
    ("a b", "a b"),
    ("a b", "a\tb"),
    ("ёлка", "ёлка"),
    ("Βύτριγο", "Bύτριγο"),
    ("δεν", "δεv"),
    ("ｶﾞ", "ガ"),
    ("한국", "한국"),
    ("a\nb", "a\r\nb"),
    ("q̣̇", "q̣̇"),  # order of marks
    ("é", "e​́"),
]
OTHER = [("cafe", "café"), ("É", "È"), ("word", "Word"), ("x2", "x²"), ("a.b", "a,b"), ("a b", "ab"), ("word", "words"), ("a  b", "a b"), ("a\nb", "a b"), ("в", "b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert Transducer.shared().form(a) == Transducer.shared().form(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b):
    assert Transducer.shared().form(a) != Transducer.shared().form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"], max_codepoint=0x1FFFF), st.sampled_from("aеοȩ́́​ ﬁＡ가")), max_size=30))
def test_form_is_its_own_form(text):
    form = Transducer.shared().form
    once = form(text)
    assert form(once) == once
    assert form(unicodedata.normalize("NFD", text)) == form(unicodedata.normalize("NFC", text))
    if "\r" not in text and not set(text) & set(lookalike.LINE_ENDS):
        assert once == _form(text)  # the table gives what the rules give


def test_conflicts_are_found(monkeypatch):
    with pytest.raises(ValueError):
        lookalike.check_table({"x": "а"})
    monkeypatch.setattr(lookalike, "SAME_SHAPE", {"a": "а", "e": "а"})
    with pytest.raises(ValueError):
        lookalike.check_table({})


def variants(r, text):
    swap = {"a": "аａ", "e": "еｅ", "o": "оο", "p": "рｐ", " ": "  ", "c": "с"}
    return "".join(r.choice(swap[c]) if c in swap and r.random() < 0.4 else c + ("‍" if r.random() < 0.05 else "") for c in text)


def test_pairs_against_brute_force(spark, rows):
    r = random.Random(6)
    texts = [" ".join(r.choice(["ape", "cope", "poe", "café"]) for _ in range(3)) for _ in range(12)]
    docs = [(i, variants(r, t) if r.random() < 0.7 else t) for i, t in enumerate(r.choice(texts) for _ in range(150))]
    docs += [(900, None), (901, None), (902, ""), (903, "​"), (904, ""), (905, "x" * 200_000), (906, "х" + "x" * 199_999)]
    df = spark.createDataFrame([(i, t, "f", "raw", 3) for i, t in docs], "doc_id long, text string, form string, raw string, salt int")
    known = {i: _form(t) for i, t in docs if t is not None}
    text = dict(docs)
    want = [(a, b) for a in known for b in known if a < b and known[a] == known[b] and text[a] != text[b]]
    assert rows(lookalike.equal_looking(df)) == sorted(want, key=repr) and (902, 903) in want and (905, 906) in want
    got = {d: (c, n) for d, c, n in rows(lookalike.classes(df))}
    for d, f in known.items():
        alike = [x for x in known if known[x] == f]
        assert got[d] == (min(alike), len({text[x] for x in alike}))
    assert set(got) == set(known)
    assert dict(rows(lookalike.forms(df), "doc_id", "form"))[900] is None
    assert rows(lookalike.equal_looking(df.limit(0))) == [] and rows(lookalike.classes(df.limit(0))) == []


def test_compatibility_ideographs():
    form = Transducer.shared().form
    alike = [chr(i) for i in (*range(0xF900, 0xFB00), *range(0x20000, 0x30000)) if unicodedata.normalize("NFC", chr(i)) != chr(i)]
    assert sum(c >= "\U00020000" for c in alike) == 542
    assert all(form(f"x{c}y") == "x" + unicodedata.normalize("NFC", c) + "y" for c in alike)
