import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, prose
from weft.llm import catalog, ppm, runs, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- operator 11

def trie_of(texts):
    trie = defaultdict(Counter)  # context -> next symbol
    for t in texts:
        s = b"\xff" * 4 + (t or "").translate(LOW).encode() + b"\xff"
        for i in range(4, len(s)):
            for k in range(5):
                trie[s[i - k:i]][s[i]] += 1
    return trie


def symbol(trie, context, byte):
    """Probability of a byte: escape method C with exclusion, written without vectors."""
    p, out = Fraction(1), set()
    for k in range(4, -1, -1):
        seen = {s: n for s, n in trie.get(context[4 - k:], {}).items() if s not in out}
        if not seen:
            continue
        total = sum(seen.values()) + len(seen)
        if byte in seen:
            return p * Fraction(seen[byte], total)
        p *= Fraction(len(seen), total)
        out |= set(seen)
    return p * Fraction(1, 256 - len(out))


def logp(trie, text):
    s = b"\xff" * 4 + (text or "").translate(LOW).encode() + b"\xff"
    return sum(math.log10(symbol(trie, s[i - 4:i], s[i])) for i in range(4, len(s)))


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 500])
def test_scores_are_brute_force(spark, bucket_bytes, monkeypatch):
    monkeypatch.setattr(ppm, "SLICE_BYTES", 3000)
    rows, _ = documents(spark)
    rows = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in rows] + [(70, "Ärger über ÄÖ Ünseen Zeichen ☃"), (71, "€" * 30)]
    held = {3, 4, 70, 71, 17}
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, n_tokens string, bucket int, gram int")
    got = Counter((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in ppm.score(df, ~F.col("doc_id").isin(*held), bucket_bytes).collect())
    # a null condition is not learned from
    train = [t for i, t in rows if i is not None and i not in held]
    trie = trie_of(train)
    count = Counter(w for t in train for w in [*WORD.findall((t or "").translate(LOW)), ""])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(LOW)), ""]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[(i, i is not None and i not in held, len(w), sum(x in count for x in w), n, round(base, 6), round(logp(trie, t), 6))] += 1
    assert {k[:5] for k in got} == {k[:5] for k in want}
    key = lambda k: (k[0] is None, k[0] or 0, k[1:])
    for a, b in zip(sorted(got.elements(), key=key), sorted(want.elements(), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)


def test_probabilities_sum_to_one():
    trie = trie_of(["the cat sat on the mat", "a dog and a cat", ""])
    grams = Counter()
    for t in ["the cat sat on the mat", "a dog and a cat", ""]:
        s = b"\xff" * 4 + t.encode() + b"\xff"
        grams.update(int.from_bytes(s[i - 4:i + 1], "big") for i in range(4, len(s)))
    pairs = np.zeros((256, 256), np.int64)
    for g, n in grams.items():
        pairs[g >> 8 & 255, g & 255] += n
    for context in (b"the ", b" cat", b"qqqq", b"xthe", b"\xff\xff\xff\xff", b"zzat"):
        tail = int.from_bytes(context[2:], "big")
        asked = {int.from_bytes(context, "big") << 8 | s: 0 for s in range(256)}
        group = {g: n for g, n in grams.items() if g >> 8 & 65535 == tail}
        both = asked | group
        g = np.array(sorted(both))
        cost = dict(zip(g.tolist(), ppm.costs_of(g, np.array([both[x] for x in g.tolist()]), pairs), strict=True))
        assert sum(10 ** cost[x] for x in asked) == pytest.approx(1)
        assert all(10 ** cost[x] == pytest.approx(float(symbol(trie, context, x & 255))) for x in asked)


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.score(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([("a", "xy"), (None, None)], "doc_id string, text string")
    out = {r.doc_id: r for r in ppm.score(one, F.lit(False)).collect()}
    assert out["a"].score == pytest.approx(3 * math.log10(1 / 256)) and out["a"].train_tokens == 0 and out["a"].n_known == 0
    assert out[None].n_tokens == 1 and out[None].base_score == 0.0


# ---- operator 12

def brute_runs(w, min_length=24, copies=3):
    n, found = len(w), {}
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, copies * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("group", [1 << 18, 40])
def test_runs_are_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", group)
    r = random.Random(5)
    rows, _ = documents(spark)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in rows]
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    extra = ["a " * 23, "a " * 24, "a\t" * 300, " ".join(fib[-1]), " ".join(("ab" * 20 + "c") * 7), " ".join("abc" * 8 + "abd" * 9 + "x" + "abd" * 8), "a b " * 12 + "a", "a b " * 11 + "a"]
    extra += [" ".join(r.choice("ab") for _ in range(r.randrange(200))) for _ in range(30)]
    extra += [" ".join(x * r.randrange(1, 30) for x in ("ab ", "cab ", "aab ", "b ")) for _ in range(20)]
    rows += [(100 + i, t) for i, t in enumerate(extra)] + [(200, extra[3]), (201, extra[3])]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, runs int, n_words string")
    got = Counter((x.doc_id, x.n_words, tuple(tuple(y) for y in x.runs), x.collapsed_text) for x in runs.periodic_runs(df).collect())
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        found = brute_runs(w)
        want[(i, len(w), tuple(found), collapsed(w, found))] += 1
    assert got == want
    assert sum(len(k[2]) for k in want) > 60
    few = runs.periodic_runs(df, min_length=4, min_copies=2).collect()
    assert {(x.doc_id, tuple(tuple(y) for y in x.runs)) for x in few if (x.doc_id or 0) >= 100} == {
        (i, tuple(brute_runs(WORD.findall(t), 4, 2))) for i, t in rows if (i or 0) >= 100}


def test_runs_query_is_the_contract(spark, tmp_path):
    rows, _ = documents(spark)
    rows = [x for x in rows if x[1] is None or len(x[1]) < 9000] + [(1000 + i, prose(i, 5 + i * 3)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(x) for x in catalog.op12_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        w = planted(i, w) if i is not None else w
        found = brute_runs(w)
        top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
              sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(w, found)))] += 1
    assert got == want and sum(k[1] > 0 for k in want) > 5


def test_runs_of_nothing(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = runs.periodic_runs(spark.createDataFrame([("k", "z " * 200000)], "doc_id string, text string")).first()
    assert [tuple(x) for x in one.runs] == [(0, 200000, 1)] and one.collapsed_text == "z"


# ---- operator 13

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])


def brute_variants(rows, modulus, min_length=6, min_count=5, ratio=5):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            if i is not None and modulus and not (h := zlib.crc32(f"{i}:{w}".encode())) % modulus:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        top = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top and words[top] >= ratio * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("modulus", [None, 7, 199])
def test_variants_are_brute_force(spark, modulus, monkeypatch):
    monkeypatch.setattr(spelling, "_HELD_WORDS", 50)
    r = random.Random(8)
    letters = "abéßÀ"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(5, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababababab", "bababababa", "aaaaaab"]
    rows, _ = documents(spark)
    rows = [x for x in rows if x[1] is None or len(x[1]) < 20000]
    for i in range(150):
        text = []
        for w in r.choices(base, k=80):
            if r.random() < 0.2:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at + 1:], w[:at] + r.choice(letters) + w[at:]])
            text += [r.choice([w, w.capitalize(), w.upper()])] * r.choice([1, 1, 1, 30 if w in base[:9] else 2])
        rows.append((100 + i, " ".join(text)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {tuple(x) for x in spelling.spelling_variants(df, typo_modulus=modulus).collect()}
    want = brute_variants(rows, modulus)
    assert got == want and sum(x[1] is not None for x in want) > 5


def test_pivots_are_the_rarest_disjoint_pair():
    r = random.Random(3)
    for _ in range(300):
        grams = [(p, r.randrange(9)) for p in r.sample(range(9), r.randrange(3, 7))]
        got = spelling.pivots(grams)
        assert got[1][0] - got[0][0] >= 2
        assert sum(c for _, c in got) == min(a[1] + b[1] for a in grams for b in grams if b[0] - a[0] >= 2)


def test_chains_and_ties_of_variants(spark):
    rows = [("abcdefg", 3125), ("abcdefgh", 625), ("abcdefghi", 125), ("abcdefghij", 25), ("abcdefghijk", 5), ("zbcdefg", 3125), ("bbcdefg", 600), ("lonely", 9)]
    got = {x.word: x for x in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(got[w].root == "abcdefg" for w, _ in rows[:5]) and got["abcdefghijk"].form == "abcdefghij"
    assert got["bbcdefg"].form == "abcdefg" and got["bbcdefg"].form_n == 3125 and got["bbcdefg"].n_near == 2  # of two equal counts the smaller word
    assert got["lonely"].root == "lonely" and got["lonely"].n_near == 0 and got["abcdefg"].form is None


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).count() == 0
