import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import documents, prose
from weft.llm import bpe, catalog, jaccard_join, lang_id, license_scan, secret_scan, substring_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EMPTY = "doc_id long, text string, lang string"


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("head", [1 << 19, 20, 0])
def test_bpe_is_the_tokenizers_library(spark, head):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = documents(spark)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = bpe.decode(bpe.encode(df, catalog.tokenizer_json(), head), catalog.tokenizer_json())
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False))] += 1
    assert rows_of(got.selectExpr("doc_id", "n_tokens", "cast(ids as binary) ids", "text"), "doc_id", "n_tokens", "ids", "text") == Counter(
        {(a, b, bytes(c), d): n for (a, b, c, d), n in want.items()})
    again = bpe.encode_and_decode(df, catalog.tokenizer_json(), head).selectExpr("doc_id", "n_tokens", "cast(ids as binary) ids", "text")
    assert rows_of(again, "doc_id", "n_tokens", "ids", "text") == want


def test_long_texts_are_cut_between_words(monkeypatch, spark):
    from weft.llm import textvec

    text = prose(5, 900)
    whole = next(textvec.word_hashes([text.encode()]))
    monkeypatch.setattr(textvec, "GROUP_BYTES", 100)
    monkeypatch.setattr(bpe, "_GROUP_BYTES", 100)
    assert (next(textvec.word_hashes([text.encode()])) == whole).all()
    assert b"".join(bpe._pieces(text.encode())) == text.encode() and len(bpe._pieces(text.encode())) > 10


def test_regular_words_have_fingerprints_of_their_own():
    from weft.llm import textvec

    morse = [0]
    while len(morse) < 2048:
        morse += [1 - x for x in morse]
    a = "".join("ab"[x] for x in morse).encode()
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    x, y, z = next(textvec.word_hashes([a + b" " + b + b" " + a]))
    assert x == z and x != y
    words = np.array([5, 9], np.uint64)[np.array(morse + [1 - x for x in morse] + morse)]
    n = len(morse)
    one, two, three = textvec.range_hashes(words, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert one == three and one != two
    rows = {}
    for w in {prose(k, 1)[:k % 23 + 1] for k in range(3000)}:
        rows.setdefault(int(next(textvec.word_hashes([("pad " * (len(w) % 5) + w).encode()]))[-1]), set()).add(w.split()[-1] if w.split() else w)
    assert all(len(v) == 1 for v in rows.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], EMPTY)
    tok = catalog.tokenizer_json()
    assert bpe.decode(bpe.encode(none, tok), tok).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.one_per_class(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert secret_scan.scan(none, *catalog.tiktoken_vocabulary()).count() == 0
    assert lang_id.learn(none) == {} and lang_id.predict(none, {}).count() == 0


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(rows, n, percent):
    """Brute force over all pairs."""
    s = [sets(t, n) for _, t in rows]
    cls = list(range(len(rows)))

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                cls[root(i)] = root(j)
    return s, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize(("n", "percent", "n2", "k2"), [(3, 90, 3, 1), (5, 80, 3, 1), (5, 80, 1, 0)])
def test_jaccard_components(spark, n, percent, n2, k2):
    rows, _ = documents(spark)
    for k in range(40):  # a chain of near copies, and copies that differ too much
        w = prose(77, 150).split(" ")
        for j in range(k * 3 % 11):
            w[(k * 17 + j * 29) % 150] = f"new{k}{j}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s, cls = classes(rows, n, percent)
    least = {}
    for (i, _), c in zip(rows, cls, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, len(x), i if not x else least.get(c)) for (i, _), x, c in zip(rows, s, cls, strict=True))
    got = jaccard_join.jaccard_components(df, n, percent, n2, k2)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.one_per_class(df, n, percent, n2, k2).collect()
    assert len(kept) == len({c for c, x in zip(cls, s, strict=True) if x}) + len({r for r, x in zip(rows, s, strict=True) if not x})


def test_sketches_bound_the_difference():
    r = np.random.default_rng(4)
    for size in (1, 3, 9, 60, 700, 5000):
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        for share in (0.0, 0.1, 0.5):
            b = np.unique(np.concatenate([a[r.random(len(a)) >= share], r.integers(0, 1 << 63, 1 + int(size * share * 2), dtype=np.uint64)]))
            x = jaccard_join._sketches([jaccard_join._sketch(a), jaccard_join._sketch(b)])
            apart, true = jaccard_join._differ(x[:1], x[1:])[0], len(np.setxor1d(a, b))
            assert apart <= true and (size < 60 or size > 1000 or share != 0.1 or apart > 0.9 * true)


def test_one_per_class_keeps_columns_with_its_own_names(spark):
    rows = [(i, prose(1, 50) if i < 3 else prose(i, 40), i, f"k{i}", "x") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int, _key string, _id string")
    out = jaccard_join.one_per_class(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.copies, r._key) for r in out.collect()) == [(i, i, f"k{i}") for i in (0, 3, 4, 5)]


def test_signatures_are_shared_by_similar_sets():
    r = np.random.default_rng(1)
    for percent, n2, k2 in ((90, 3, 1), (80, 1, 0), (80, 3, 1)):
        for size in [*range(1, 40), 55, 80, 133, 200, 410, 900]:
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            for _ in range(6):
                # drop and add so that the similarity is just enough
                drop = r.integers(0, size + 1)
                b = a[np.sort(r.permutation(size)[drop:])]
                b = np.unique(np.concatenate([b, r.integers(0, 1 << 63, r.integers(0, size // 4 + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    assert np.intersect1d(jaccard_join.signatures(a, percent, n2, k2), jaccard_join.signatures(b, percent, n2, k2)).size


def test_substring_dedup(spark):
    rows, df = documents(spark)
    rows = rows + [(30 + k, prose(50 + k, 30) + " " + prose(99, 25 + k) + " " + prose(60 + k, 9)) for k in range(12)] + [(50, "r " * 40 + prose(9, 20)), (51, prose(8, 20) + " r" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    big = 1 << 62
    first = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for j in range(len(w) - 12):
            g = tuple(w[j:j + 13])
            first[g] = min(first.get(g, big), big if i is None else i)
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        drop = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < (big if i is None else i):
                drop.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in drop)
        want[(i, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert rows_of(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want)


PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def test_license_scan(spark):
    rows, df = documents(spark)
    texts = [
        "Licensed under the Apache License, Version 2.0.", "MIT License MIT license mit\nLICENSE", "cc-by CC BY cc by", "GNU General Public\tLicense", "apache  licenses",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is granted, to any person obtaining copy of software", "filler " * 100 + "Licensed under CC BY-NC 4.0." + " filler" * 50, "éapache license", "mit license" * 2,
    ]
    rows = rows + [(100 + i, t) for i, t in enumerate(texts)]
    out = {}
    got = rows_of(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        at = [(j, lab) for p, lab in PHRASES.items() for j in range(len(w)) if tuple(w[j:j + len(p)]) == p]
        want[(i, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at})))] += 1
    assert got == want
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[105].labels == "mit" and out[105].score == 1.0 and out[106].labels == ""
    assert out[107].labels == "cc-by,cc-by-nc" and out[100].labels == "apache" and out[5].score == 0.0


def test_license_notices_at_any_place(spark):
    notice = dict(license_scan.NOTICES)["mit"].split()
    spread = [w for i, x in enumerate(notice) for w in ([x, "and"] if i % 2 else [x])][:40]
    rows = [(i, "filler " * i + " ".join(spread) + " more" * 70) for i in range(60)] + [(100, " ".join(spread[:12] + ["x"] * 40 + spread[12:]))]
    out = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == "mit" for i in range(60)) and out[100] == ""


def test_license_scan_is_brute_force(spark):
    import random

    r = random.Random(4)
    words = sorted({w for _, t in license_scan.NOTICES for w in t.split()})
    rows = []
    for i in range(80):
        t = []
        for _ in range(r.randrange(1, 5)):
            w = r.choice(license_scan.NOTICES)[1].split()
            t += [x for x in w if r.random() < 0.95] + r.choices(words + ["filler"] * 60, k=r.randrange(60))
        rows.append((i, " ".join(t)))
    best = {}
    for i, t in rows:
        w = t.split()
        for label, n in license_scan.NOTICES:
            n = set(n.split())
            top = max(len(n & set(w[a:a + license_scan.BLOCK])) for a in range(max(1, len(w))))
            if top >= 0.9 * len(n) - 1e-9:
                best.setdefault(i, {})[label] = max(best.get(i, {}).get(label, 0), top / len(n))
    for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = best.get(x.doc_id, {})
        assert set(x.labels.split(",")) - {""} == set(want) | (set(x.base_labels.split(",")) - {""})
        if not x.n_base:
            assert x.score == pytest.approx(max(want.values(), default=0.0))


def test_secret_rules():
    spans = secret_scan.base_spans
    assert spans('Password = "hunter2hunter2"') == [(0, 0, 26)]
    assert spans("secret: token: abcdefghij") == []  # the short match takes the second keyword with it
    assert spans("api_key=abcdefgh APIKEY:'x'") == [(0, 0, 16)]
    assert spans("ſecret=abcdefghij") == []
    assert spans("é AKIA" + "A" * 12) == [(2, 1, 18)] and spans("AKIA" + "A" * 11) == []
    assert spans("0" * 31) == [] and spans("g" + "0f" * 20 + "G") == [(1, 2, 41)]


def test_secret_scan(spark):
    rows, df = documents(spark)
    texts = ["key zQ7vT2kX9mB4nR8wL1pY6sJ3 end", "commit d41d8cd98f00b204e9800998ecf8427e", "id 123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_in_snake_case", "internationalisationandlocalisation", "token=zQ7vT2kX9mB4nR8wL1pY6sJ3"]
    rows = rows + [(100 + i, t) for i, t in enumerate(texts)]
    full = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, spans string, n_hex int")
    vocabulary = catalog.tiktoken_vocabulary()
    out = secret_scan.scan(full, *vocabulary).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        base = secret_scan.base_spans(t or "")
        line = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        if i is not None and i >= 100:
            assert by[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert by[100].spans == "random:4:28" and by[101].spans == "hex:7:39" and [by[i].spans for i in (102, 103, 104)] == ["", "", ""]
    assert by[105].spans == "assign:0:30" and by[5].n_hex == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(full, *vocabulary).collect()}
    assert clean[100] == "key [SECRET] end" and clean[105] == "[SECRET]" and clean[5] is None and clean[6] == ""


def test_language_id(spark):
    en = "the quick brown fox jumps over the lazy dog and then it runs away from the angry farmer ".split()
    de = "der schnelle braune fuchs springt über den faulen hund und läuft dann vor dem bauern davon ".split()
    import random

    r = random.Random(2)
    rows = [(i, " ".join(r.choices(en if i % 2 else de, k=60)), "en" if i % 2 else "de") for i in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 -- !! ½ ² Ⅷ", None), (None, "the quick brown fox jumps over the lazy dog again and again", "en"), (503, "the the fox " * 20000, None)]
    df = spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, lang string, lang_pred string")
    model = lang_id.learn(df.select("doc_id", "text", "lang"))
    assert set(model) == {"en", "de"} and all(len(v) <= lang_id.DICT_BYTES for v in model.values())
    out = {r.doc_id: r for r in lang_id.predict(df, model).collect()}
    assert len(out) == len(rows)
    assert sum(out[i].lang_pred == lang for i, _, lang in rows[:120]) >= 118
    assert [(out[i].lang_pred, out[i].score, out[i].rejected) for i in (500, 501, 502)] == [("und", 0.0, True)] * 3
    assert out[503].lang_pred == "en" and 0 <= out[503].score <= 1
    kept = lang_id.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.rejected}
    # the held-out third is never learned from
    import zlib

    held = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows[:120]], EMPTY)
    assert set(lang_id.learn(held)) == {"en", "de"}


def test_short_texts_keep_their_language(spark):
    import random

    en = "the quick brown fox jumps over the lazy dog and then it runs away from the angry farmer".split()
    de = "der schnelle braune fuchs springt über den faulen hund und läuft dann vor dem bauern davon".split()
    r = random.Random(2)
    learned = [(i, " ".join(r.choices(en if i % 2 else de, k=60)), "en" if i % 2 else "de") for i in range(120)]
    model = lang_id.learn(spark.createDataFrame(learned, EMPTY))
    short = [(i, " ".join(r.choices(en if i % 2 else de, k=1 + i % 5)).capitalize() + ".", "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(short, EMPTY)
    assert [(p.doc_id, p.lang_pred, p.rejected) for p in lang_id.predict(df, model).orderBy("doc_id").collect()] == [
        (i, lang, False) for i, _, lang in short]
    assert lang_id.accepted(df, model).count() == 60
    # what both languages hold alike is still a narrow margin
    both = {"a": b"same words in both", "b": b"same words in both"}
    assert lang_id.accepted(spark.createDataFrame([(1, "same", None)], EMPTY), both).count() == 0
