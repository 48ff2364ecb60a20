"""Section analysis, truncation, formats, pages and streams on micro fixtures."""

import re

from pyspark.sql import functions as F

from tests.conftest import make_items
from weft.operators import analyze as A
from weft.operators import formats as FM
from weft.operators import pages as P
from weft.operators import render as R


def test_truncate_smart_cases(spark):
    # max 600: a break point counts when it ends before 500 and starts after 300
    cases = [
        ("short text stays", "short text stays"),
        ("a" * 3000, ""),                                         # one word: the last word is dropped
        (("word " * 300) + ". " + "z" * 2000, " ".join(["word"] * 119)),  # no break point before 500
        ("x. " * 1000, ("x. " * 166).strip()),                   # last '. ' ending inside the limit
        ("p" * 350 + "\n\n" + "q" * 400 + " more words here" * 20, "p" * 350),  # paragraph break
        ("a" * 300 + ". " + "b" * 400, "a" * 300 + "."),          # break exactly at max/2 is not taken
    ]
    df = spark.createDataFrame(cases, "text string, want string")
    for r in df.select("want", R.truncate_smart(F.col("text"), 600).alias("t")).collect():
        assert r.t == r.want


def test_sections_headers_and_crlf(spark):
    text = "pre\n## A\nbody a\n## B\n## C\nbody c\r\n## Empty\n   \n## D\nlast"
    df = spark.createDataFrame([(1, "## First\nignored\n" + text)], "doc_id long, text string")
    got = [(r.header, r.content) for r in A.split_sections(df).orderBy("pos").collect()]
    assert got == [("A", "body a"), ("B", "## C\nbody c"), ("D", "last")]


def test_categorize_compat_and_intended(spark):
    df = spark.createDataFrame([("Core Philosophy",), ("Workflow Steps",), ("Crisis Prevention Protocol",), ("Notes",),
                                ("Conversation Examples",)], "h string")
    got = [(r.c, r.i) for r in df.select(A.categorize(F.col("h"), "compat").alias("c"),
                                         A.categorize(F.col("h"), "intended").alias("i")).collect()]
    assert got == [("philosophy", "philosophy"), ("process", "process"), ("process", "crisis"),
                   ("methodology", "methodology"), ("examples", "conversation")]


def test_step_extraction(spark):
    df = spark.createDataFrame([("1. first\n- second\n**Bold** third\n---\nplain",)], "c string")
    assert df.select(A.extract_steps(F.col("c"))).first()[0] == ["first", "second", "*Bold** third", "--"]


def test_concept_context_overlap(spark):
    content = "\n".join(f"line {i}" for i in range(8)) + "\nthe KEY here\nmore\nkey again"
    df = spark.createDataFrame([(content,)], "c string")
    got = df.select(A.concept_context(F.col("c"), F.lit("key"))).first()[0]
    # windows of lines 6-10 (around line 8) and 8-10 (around line 10), overlaps repeated
    assert got == "line 6\nline 7\nthe KEY here\nmore\nkey again\nthe KEY here\nmore\nkey again"


def test_conversation_items_intended_mode(spark):
    md = ('intro\n## Conversation Examples\n**Human:** "How do I start?"\n**Assistant:** "Break it down."\n'
          '**Human:** "And then?"\n')
    items = A.analyze_corpus(spark.createDataFrame([(1, md)], "doc_id long, text string"), "intended").collect()
    assert [(i.instruction, i.output, i.category) for i in items] == [("How do I start?", "Break it down.", "conversation")]


def test_render_formats_and_round_trips(spark, items_schema):
    items = make_items(spark, [(1, "Explain the thing in detail please", "some context", "o" * 80, "process",
                                ["a,b", "c"], "advanced", "sec"),
                               (2, "Another instruction here", "", "p" * 80, "", [], "", "")], items_schema)
    chat = R.render_corpus(items, "chatml").orderBy("item_id").first().text
    assert chat.startswith("<|system|>\n" + R.CATEGORY_PROMPTS["process"] + " Context: some context<|end|>\n<|user|>")
    custom = R.render_corpus(items, "custom", template="{instruction}|{category}|{tags}|{output}").orderBy("item_id").first()
    assert custom is None or custom.text.startswith("Explain")
    back = FM.from_sharegpt(FM.to_sharegpt(items)).orderBy("item_id").collect()
    assert [(b.instruction, b.context) for b in back] == [("Explain the thing in detail please", "some context"),
                                                         ("Another instruction here", "")]
    flat = FM.from_flat(FM.to_flat(items)).orderBy("item_id").first()
    assert flat.tags == ["a", "b", "c"]


def test_page_extraction(spark):
    html = ('<html><head><title>T &amp; U</title><script>var t="</p>";</script></head><body><nav>menu</nav>'
            '<div class="x content y"><p>Hello <b>big</b>\n world</p><!-- c --></div><a href="/about">About us page</a>'
            '</body></html>')
    pages = spark.createDataFrame([(1, "https://site.example.com/a/b", html), (2, "http://e.example.org/", "<body><main>"
                                   "</main><p>fallback body</p></body>")], "page_id long, url string, html string")
    got = {r.page_id: r.content for r in P.with_content(pages).collect()}
    assert got == {1: "Hello big world", 2: "fallback body"}
    rec = P.page_record(pages).orderBy("page_id").first()
    assert (rec.title, rec.snippet) == ("T & U", "Hello big world")
    links = P.harvest_links(pages, 5).collect()
    assert [(x.link_url, x.title) for x in links] == [("https://site.example.com/about", "About us page")]


def test_stream_late_rows_dropped(spark, tmp_path):
    import datetime as dt
    import time

    from weft.streaming import streams as K

    src = tmp_path / "src"
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, value double"
    # three files in arrival order; the last one is behind the watermark by then
    for name, hours in (("a", (1, 30, 50)), ("c", (60,)), ("b", (2,))):
        rows = [(i, t0 + dt.timedelta(hours=h), 7, 1.0) for i, h in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(str(src))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    K.run_available_now(K.stream_user_activity(stream), out, ck)
    got = sorted((r.window_start.day, r.events) for r in spark.read.parquet(out).collect())
    # day 1 keeps its single on-time event: the 02:00 row arrives after the watermark passed it
    assert got == [(1, 1), (2, 1)]


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() >= 0 and "prompt" in df.columns
    assert re.match(r"^[a-l]\d+_", sorted(e.queries())[0])


def test_anchor_passages(spark):
    tron = "**TRON Contribution:** vision and\nstrategy\n**AI Contribution:** execution **bold** tail"
    cases = [
        ("Intro\nThe 42 idea\nmeans FOR TWO, always.\n\nNext paragraph", "42 idea means FOR TWO, always."),
        ("no anchor here", A.CORE_EXPLANATION_FALLBACK),
        ("x 42 y for two z\n# heading", "42 y for two z"),
    ]
    df = spark.createDataFrame([(c, w) for c, w in cases], "c string, want string")
    for r in df.select("want", A.core_explanation(F.col("c")).alias("got")).collect():
        assert r.got == r.want
    p = spark.createDataFrame([(tron,), ("**tron contribution** only\n\nrest",)], "c string")
    got = [r[0] for r in p.select(A.collaborative_protocol(F.col("c"))).collect()]
    assert got == [A.PROTOCOL_PREFIX + "**TRON Contribution:** vision and\nstrategy\n\n**AI Contribution:\n\n"
                   + A.PROTOCOL_SUFFIX,
                   A.PROTOCOL_PREFIX + "**tron contribution** only\n\n" + A.PROTOCOL_SUFFIX]
    steps = spark.createDataFrame([("1. one\n\n   2. two\n-\n* star\n12. twelve\n- \n",)], "c string")
    # a bare marker line takes the next line as its text; a trailing empty bullet yields nothing
    assert steps.select(A.extract_steps(F.col("c"))).first()[0] == ["one", "two", "* star", "twelve"]
    crisis = spark.createDataFrame([("STOP. Breathe.\nThink\n\nlater",), ("calm",)], "c string")
    got = [r[0] for r in crisis.select(A.crisis_protocol(F.col("c"))).collect()]
    assert got == [A.CRISIS_PREFIX + "STOP. Breathe.\nThink" + A.CRISIS_SUFFIX, A.CRISIS_FALLBACK]


def test_fit_length_and_conforms(spark):
    df = spark.createDataFrame([("short",), ("x" * 60,), (" " * 40 + "y" * 20,)], "t string")
    got = [r[0] for r in df.select(R.fit_length(F.col("t"), 2048)).collect()]
    assert got == [None, "x" * 60, None]
    js = spark.createDataFrame([('{"instruction": "a", "output": "b"}',), ('{"conversations": {"a": 1}}',),
                                ('[1, 2]',), ('{"messages": []}',)], "j string")
    got = [tuple(r) for r in js.select(FM.conforms(F.col("j"), "alpaca"), FM.conforms(F.col("j"), "sharegpt"),
                                        FM.conforms(F.col("j"), "openai"), FM.conforms(F.col("j"), "other")).collect()]
    assert got == [(True, False, False, True), (False, False, False, True), (False, False, False, True),
                   (False, False, True, True)]


def test_conversation_ids_beyond_a_thousand_turns(spark, tmp_path):
    import json

    from weft.sources import io as IO

    turns = [{"from": "human" if t % 2 == 0 else "assistant", "value": f"turn {t}"} for t in range(2600)]
    (tmp_path / "c.json").write_text(json.dumps([{"item_id": 1, "conversations": turns}, {"item_id": 2, "conversations": turns}]))
    got = IO.read_items_json(spark, str(tmp_path)).select("item_id", "conv_id", "turn").collect()
    assert len(got) == 2600 and len({r.item_id for r in got}) == 2600
