import random
import time

import pytest

from weft.operators import intents, patterns


def test_all_strings_of_each_text_are_found(spark, monkeypatch):
    monkeypatch.setattr(patterns, "SLICE_CHARS", 60)
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abé😀 ") for _ in range(r.randrange(n)))
    strings = sorted({t for t in (text(5) for _ in range(60)) if t}) + ["a", "abab", "b"]
    rows = [(i, r.choice([text(40), None, ""]), "x") for i in range(200)] + [(900, "a" * 500, "x")]
    df = spark.createDataFrame(rows, "id int, t string, found string")
    got = {x.id: x.hits for x in patterns.with_found(df, "t", strings, "hits").collect()}
    assert got == {i: [n for n, p in enumerate(strings) if t and p in t] for i, t, _ in rows}
    assert patterns.with_found(df.limit(0), "t", strings).count() == 0
    with pytest.raises(ValueError):
        patterns.compiled(["a", ""])


def test_work_does_not_follow_the_number_of_strings():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    texts = [" ".join(word() for _ in range(60)) for _ in range(2000)]
    took = {}
    for n in (100, 10000):
        automaton = patterns.compiled([word() for _ in range(n)])
        began = time.perf_counter()
        patterns.found(automaton, texts)
        took[n] = time.perf_counter() - began
    assert took[10000] < 6 * took[100] + 0.5


def test_classes_equal_those_of_the_columns(spark):
    r = random.Random(3)
    words = intents.CODE_INDICATORS + intents.RUNTIME_INDICATORS + intents.GENERAL_INDICATORS + ["x", "Error", "LOG"] * 4
    rows = [(i, " ".join(r.choices(words, k=r.randrange(12))) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    a = {x.doc_id: x.doc_class for x in intents.classify_documents(df).collect()}
    assert {x.doc_id: x.doc_class for x in intents.classify_by_automaton(df).collect()} == a and len(set(a.values())) == 3
