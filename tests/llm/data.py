"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

import random

WORDS = "alpha beta gamma delta the of and Éclair straße naïve 42 x7 foo_bar don't it's end. (yes) 日本語 emoji😀 tab\tsep".split(" ")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, extra: str = ""):
    base = prose(1, 120)
    changed = base.split(" ")
    changed[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(changed)), (4, prose(4, 300)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "ONE"), (10, "one two"),
        (11, prose(11, 60) + " " + base), (12, "same same same " * 30), (13, "same " * 200), (13, "another text with the id 13"),
        (14, prose(14, 20000)), (None, "text without an id that is long enough to be compared with others here"),
        (None, None), (15, "x" * 3000), (16, prose(16, 50)), (16, prose(16, 50)), (2, base), (17, "a  b   c\n\n d   e f  <|endoftext|> g<|endoftext|>  h "),
    ]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2.0) for i, t in rows], "doc_id long, text string, n_tokens string, node int, label string, _key double")
    return rows, df


def vectors(spark):
    r = random.Random(3)

    def near(v, e):
        return [x + r.gauss(0, e) for x in v]

    a, b = [r.gauss(0, 1) for _ in range(16)], [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, near(a, 0.05), 1) for i in range(1, 30)]
    rows += [(100 + i, near(b, 0.02), 1 if i % 2 else 2) for i in range(12)]
    rows += [(200 + i, [r.gauss(0, 1) for _ in range(16)], i % 3) for i in range(150)]
    rows += [(400, list(a), 1), (401, list(a), 1), (402, list(a), 2), (403, list(a), None), (404, [2 * x for x in a], 1), (401, list(a), 1)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + a[1:], 1), (503, [float("nan")] + a[1:], 1), (504, [float("inf")] + a[1:], 1), (505, a[:8], 1), (None, list(b), 1)]
    return rows, spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, node string")
