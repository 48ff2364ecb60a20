"""Registered jobs of the document-analysis family (E), on the derived markdown corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import analyze as A
from weft.plans.oracle_views import with_views
from weft.plans.sqlfrag import WS, strip
from weft.sources import tables


def _md(spark, sf):
    return tables.markdown_view(spark, sf)


def q_split_sections(spark, sf):
    s = A.split_sections(_md(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "header", "content")


def q_categorize(spark, sf):
    s = A.split_sections(_md(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"),
                    A.categorize(F.col("header"), "compat").alias("compat_category"),
                    A.categorize(F.col("header"), "intended").alias("intended_category"))


def q_key_concepts(spark, sf):
    s = A.split_sections(_md(spark, sf))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"),
                    F.array_join(A.key_concepts(F.col("content")), "|").alias("concepts"))


def q_extract_steps(spark, sf):
    s = A.split_sections(_md(spark, sf))
    st = A.extract_steps(F.col("content"))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(st).cast("long").alias("n_steps"),
                    A.render_steps(st, F.col("header")).alias("rendered"))


def _items_out(df):
    return df.select("doc_id", F.col("category_order").cast("long").alias("category_order"),
                     F.col("pos").cast("long").alias("pos"), F.col("sub").cast("long").alias("sub"),
                     "instruction", "context", "output", "category", F.array_join("tags", "|").alias("tags"),
                     "difficulty", "source_section")


def q_analyze_corpus(spark, sf):
    return _items_out(A.analyze_corpus(_md(spark, sf), "compat"))


def q_analyze_intended(spark, sf):
    return _items_out(A.analyze_corpus(_md(spark, sf), "intended"))


def q_clean_content(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", A.clean_content(F.col("text")).alias("cleaned"))


# ---------------------------------------------------------------- DuckDB side

_N = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SECTIONS = f""",
d AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', {_N}, 'g') AS t FROM markdown_docs),
parts AS (SELECT doc_id, regexp_split_to_array(t, '\\n## (.+?)\\n') AS bodies,
                 regexp_extract_all(t, '\\n## (.+?)\\n', 1) AS heads FROM d),
raw AS (SELECT doc_id, i - 1 AS pos, heads[i] AS h, bodies[i + 1] AS b
        FROM (SELECT doc_id, heads, bodies, unnest(generate_series(1, len(heads))) AS i FROM parts)),
sections AS (SELECT doc_id, pos, {strip('h')} AS header, {strip('b')} AS content FROM raw
             WHERE {strip('h')} <> '' AND {strip('b')} <> '')
"""


def _categorize(mode: str) -> str:
    target = "lower(header)" if mode == "compat" else "('## ' || lower(header))"
    whens = [f"WHEN regexp_matches({target}, {_q(p)}) THEN '{c}'" for c, p in A.SECTION_PATTERNS]
    for c, kws in A.KEYWORD_GROUPS:
        cond = " OR ".join(f"contains(lower(header), '{k}')" for k in kws)
        whens.append(f"WHEN {cond} THEN '{c}'")
    return "CASE " + " ".join(whens) + f" ELSE '{A.DEFAULT_CATEGORY}' END"


_CONCEPTS = ("list_concat(regexp_extract_all(content, '\"([^\"]+)\"', 1), "
             "regexp_extract_all(content, '\\*\\*([^*]+)\\*\\*', 1), "
             "CASE WHEN contains(content, '42 = FOR TWO') THEN ['42 = FOR TWO'] ELSE []::VARCHAR[] END, "
             "CASE WHEN contains(lower(content), 'collaborative intelligence') THEN ['collaborative intelligence'] "
             "ELSE []::VARCHAR[] END)")


def _distinct_ordered(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


_STEP_RE = f"(?m)(?:^|\\n)[{WS}]*(?:\\p{{Nd}}+\\.|\\*|-)[{WS}]*(.+?)$"
_STEPS = (f"list_filter(list_transform(regexp_extract_all(content, {_q(_STEP_RE)}, 1), lambda s: {strip('s')}), "
          "lambda s: s <> '')")


def _render_steps(steps: str, name: str) -> str:
    return strip(f"('Here''s the ' || {name} || ' step by step:' || {_N} || {_N} || "
                 f"array_to_string(list_transform({steps}, lambda s, i: CAST(i AS VARCHAR) || '. ' || s), {_N}))")


def _clean(c: str) -> str:
    x = f"regexp_replace({c}, '\\n[{WS}]*\\n[{WS}]*\\n', {_N} || {_N}, 'g')"
    x = f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    return strip(x)


def _context(k: str) -> str:
    """E4 in DuckDB (0-based line numbers i, 1-based list access)."""
    lines = f"string_split(content, {_N})"
    n = f"len({lines})"
    idx = f"list_filter(range(0, {n}), lambda i: contains(lower({lines}[i + 1]), lower({k})))"
    around = (f"flatten(list_transform({idx}, lambda i: {lines}[greatest(0, i - 2) + 1 : least({n}, i + 5)]))")
    first = strip(f"array_to_string({around}, {_N})")
    cwords = f"list_filter(regexp_split_to_array(lower({k}), '[{WS}]+'), lambda w: w <> '')"
    hit = (f"list_filter(range(0, {n}), lambda i: len(list_filter({cwords}, "
           f"lambda w: contains(lower({lines}[i + 1]), w))) > 0)")
    j = f"({hit})[1]"
    second = strip(f"array_to_string({lines}[greatest(0, {j} - 1) + 1 : least({n}, {j} + 3)], {_N})")
    p0 = f"split_part(content, {_N} || {_N}, 1)"
    third = f"CASE WHEN length({p0}) > 500 THEN substr({p0}, 1, 500) || '...' ELSE {p0} END"
    return f"CASE WHEN len({idx}) > 0 THEN {first} WHEN len({hit}) > 0 THEN {second} ELSE {third} END"


def _item(instr, ctx, out, cat, tags, diff) -> str:
    return (f"{{'instruction': {instr}, 'context': {ctx}, 'output': {out}, 'category': {cat}, "
            f"'tags': {tags}, 'difficulty': {diff}, 'source_section': header}}")


_CORE_RX = r"(?is)(42.*?FOR TWO.*?)(?:\n\n|\n#|\n?\z)"
_CORE_SQUASHED = strip(f"regexp_replace(regexp_extract(content, {_q(_CORE_RX)}, 1), '[{WS}]+', ' ', 'g')")
_CORE = (f"CASE WHEN regexp_matches(content, '(?is)42.*?FOR TWO') THEN {_CORE_SQUASHED} "
         f"ELSE {_q(A.CORE_EXPLANATION_FALLBACK)} END")
_TRON = "regexp_extract(content, '(?is)(\\*\\*TRON Contribution.*?)(?:\\*\\*AI Contribution|\\n\\n|\\n?\\z)', 1)"
_AI = "regexp_extract(content, '(?is)(\\*\\*AI Contribution.*?)(?:\\*\\*|\\n?\\z)', 1)"
_PROTOCOL = (f"({_q(A.PROTOCOL_PREFIX)} || CASE WHEN {_TRON} <> '' THEN {strip(_TRON)} || {_N} || {_N} ELSE '' END"
             f" || CASE WHEN {_AI} <> '' THEN {strip(_AI)} || {_N} || {_N} ELSE '' END || {_q(A.PROTOCOL_SUFFIX)})")
_STOP = "CASE WHEN position('\U0001F6D1' IN content) > 0 THEN position('\U0001F6D1' IN content) ELSE position('STOP' IN content) END"
_CRISIS = (f"CASE WHEN {_STOP} > 0 THEN {_q(A.CRISIS_PREFIX)} || split_part(substr(content, {_STOP}), {_N} || {_N}, 1)"
           f" || {_q(A.CRISIS_SUFFIX)} ELSE {_q(A.CRISIS_FALLBACK)} END")
_PNAME = strip("replace(header, '## ', '')")
_HUM = f"regexp_extract_all(content, '(?i)\\*\\*Human:\\*\\*[{WS}]*\"([^\"]+)\"', 1)"
_ASST = f"regexp_extract_all(content, '(?i)\\*\\*(?:Assistant|TRON Response):\\*\\*[{WS}]*\"([^\"]+)\"', 1)"


def _items_sql(mode: str) -> str:
    concepts = _distinct_ordered(_CONCEPTS)
    phil = (f"list_filter(list_transform({concepts}, lambda k: "
            + _item("'Explain the philosophy behind ' || k", _q("User needs to understand the foundational philosophy"),
                    _context("k"), "'philosophy'", "['philosophy', '42', 'collaboration', replace(lower(k), ' ', '-')]",
                    "'foundational'")
            + "), lambda it: it.output IS NOT NULL AND it.output <> '')")
    core = (f"CASE WHEN contains(content, '42') AND contains(content, 'FOR TWO') THEN ["
            + _item(_q("What does '42 = FOR TWO' mean in practice?"),
                    _q("User learning collaborative intelligence methodology"), _CORE, "'core_principle'",
                    "['42', 'collaboration', 'methodology', 'core-principle']", "'foundational'")
            + "] ELSE [] END")
    proto = ("CASE WHEN contains(content, 'TRON Contribution') AND contains(content, 'AI Contribution') THEN ["
             + _item(_q("Explain the collaborative intelligence protocol"), _q("User needs systematic methodology guidance"),
                     _PROTOCOL, "'methodology'", "['collaboration', 'protocol', 'systematic-approach']", "'intermediate'")
             + "] ELSE [] END")
    cleaned = _clean("content")
    impl = ("CASE WHEN contains(lower(header), 'framework') OR contains(lower(header), 'protocol') THEN ["
            + _item("'How do I implement the ' || lower(header) || '?'", _q("User needs implementation guidance"),
                    f"CASE WHEN starts_with({cleaned}, 'To implement') THEN {cleaned} ELSE "
                    f"'To implement this methodology:' || {_N} || {_N} || {cleaned} END",
                    "'implementation'", "['methodology', 'framework', 'implementation']", "'intermediate'")
            + "] ELSE [] END")
    steps = ("CASE WHEN len(" + _STEPS + ") > 0 THEN ["
             + _item("'Walk me through the ' || " + _PNAME + " || ' step by step'",
                     _q("User needs systematic process guidance"), _render_steps(_STEPS, _PNAME), "'process'",
                     "['process', 'systematic', 'steps']", "'intermediate'")
             + "] ELSE [] END")
    crisis = ("CASE WHEN contains(lower(header), 'crisis') OR contains(lower(header), 'prevention') THEN ["
              + _item(_q("What should I do when I'm overwhelmed by a complex problem?"),
                      _q("User facing complex problem and feeling panicked"), _CRISIS, "'crisis_management'",
                      "['42', 'crisis-prevention', 'collaboration', 'systematic-approach']", "'intermediate'")
              + "] ELSE [] END")
    example = ("[" + _item("'Provide an example of ' || lower(" + _PNAME + ")",
                           _q("User needs concrete implementation example"),
                           f"CASE WHEN starts_with({cleaned}, 'Here''s a practical example') THEN {cleaned} ELSE "
                           f"'Here''s a practical example:' || {_N} || {_N} || {cleaned} END",
                           "'example'", "['example', 'practical', 'implementation']", "'intermediate'") + "]")
    conv = (f"list_transform(range(1, least(len({_HUM}), len({_ASST})) + 1), lambda i: "
            + _item(f"({_HUM})[i]", _q("User interaction following collaborative methodology"), f"({_ASST})[i]",
                    "'conversation'", "['conversation', 'interaction', 'collaborative']", "'intermediate'") + ")")
    general = ("[" + _item("'Tell me about ' || lower(" + _PNAME + ")", "'User learning about ' || cat", cleaned,
                           "cat", "[cat, 'methodology']", "'intermediate'") + "]")
    order = "[" + ", ".join(f"'{c}'" for c in A.CATEGORY_ORDER) + "]"
    return f""",
cs AS (SELECT *, {_categorize(mode)} AS cat FROM sections),
arr AS (SELECT doc_id, pos, cat,
          CASE cat WHEN 'philosophy' THEN list_concat({phil}, {core})
                   WHEN 'methodology' THEN list_concat({proto}, {impl})
                   WHEN 'process' THEN list_concat({steps}, {crisis})
                   WHEN 'examples' THEN {example}
                   WHEN 'conversation' THEN {conv}
                   ELSE {general} END AS items
        FROM cs),
ex AS (SELECT doc_id, pos, cat, unnest(generate_series(0, len(items) - 1)) AS sub, unnest(items) AS it FROM arr
       WHERE len(items) > 0)
SELECT doc_id, CAST(list_position({order}, cat) AS BIGINT) AS category_order, CAST(pos AS BIGINT) AS pos,
       CAST(sub AS BIGINT) AS sub, it.instruction AS instruction, it.context AS context, it.output AS output,
       it.category AS category, array_to_string(it.tags, '|') AS tags, it.difficulty AS difficulty,
       it.source_section AS source_section
FROM ex"""


SQL = {
    "e1_split_sections": with_views(["markdown_docs"], _SECTIONS + """
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, header, content FROM sections"""),
    "e2_categorize": with_views(["markdown_docs"], _SECTIONS + f"""
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_categorize('compat')} AS compat_category,
               {_categorize('intended')} AS intended_category FROM sections"""),
    "e3_key_concepts": with_views(["markdown_docs"], _SECTIONS + f"""
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, array_to_string({_distinct_ordered(_CONCEPTS)}, '|') AS concepts
        FROM sections"""),
    "e8_extract_steps": with_views(["markdown_docs"], _SECTIONS + f"""
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(len({_STEPS}) AS BIGINT) AS n_steps,
               {_render_steps(_STEPS, 'header')} AS rendered FROM sections"""),
    "e13_clean_content": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "e14_analyze_corpus": with_views(["markdown_docs"], _SECTIONS + _items_sql("compat")),
    "e14_analyze_intended": with_views(["markdown_docs"], _SECTIONS + _items_sql("intended")),
}

QUERIES = {
    "e1_split_sections": q_split_sections,
    "e2_categorize": q_categorize,
    "e3_key_concepts": q_key_concepts,
    "e8_extract_steps": q_extract_steps,
    "e13_clean_content": q_clean_content,
    "e14_analyze_corpus": q_analyze_corpus,
    "e14_analyze_intended": q_analyze_intended,
}


def q_pattern_summary(spark, sf):
    s = A.split_sections(_md(spark, sf))
    return A.pattern_summary(s, 5).select("kind", "header", F.col("sections").cast("long").alias("sections"),
                                          F.col("rank").cast("long").alias("rank"))


_KIND = ("CASE " + " ".join(f"WHEN cat IN ({', '.join(repr(c) for c in cats)}) THEN '{k}'"
                            for k, cats in A.PATTERN_KINDS.items()) + " END")

SQL["b16_pattern_summary"] = with_views(["markdown_docs"], _SECTIONS + f""",
    cs AS (SELECT header, {_categorize('compat')} AS cat FROM sections),
    k AS (SELECT {_KIND} AS kind, header FROM cs),
    c AS (SELECT kind, header, count(*) AS sections FROM k WHERE kind IS NOT NULL GROUP BY kind, header),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sections DESC, header) AS rank FROM c)
    SELECT kind, header, CAST(sections AS BIGINT) AS sections, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")
QUERIES["b16_pattern_summary"] = q_pattern_summary


def q_concept_context(spark, sf):
    s = A.split_sections(_md(spark, sf))
    c = s.select("doc_id", "pos", "content", F.posexplode(A.key_concepts(F.col("content"))).alias("cpos", "concept"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("cpos").cast("long").alias("cpos"),
                    "concept", A.concept_context(F.col("content"), F.col("concept")).alias("context_text"))


SQL["e4_concept_context"] = with_views(["markdown_docs"], _SECTIONS + f""",
    cc AS (SELECT doc_id, pos, content, {_distinct_ordered(_CONCEPTS)} AS concepts FROM sections),
    ex AS (SELECT doc_id, pos, content, unnest(generate_series(0, len(concepts) - 1)) AS cpos, unnest(concepts) AS k
           FROM cc WHERE len(concepts) > 0)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(cpos AS BIGINT) AS cpos, k AS concept,
           {_context('k')} AS context_text FROM ex""")
QUERIES["e4_concept_context"] = q_concept_context


def q_conversation_items(spark, sf):
    """E10 on documents that hold the turns of the conversations table."""
    return _items_out(A.analyze_corpus(tables.dialogue_markdown_view(spark, sf), "intended"))


def q_anchor_items(spark, sf):
    """E12 on documents whose sections hold the anchors."""
    return _items_out(A.analyze_corpus(tables.anchor_markdown_view(spark, sf), "compat"))


SQL["e10_conversation_items"] = with_views(["dialogue_docs"], _SECTIONS + _items_sql("intended"))
SQL["e12_anchor_items"] = with_views(["anchor_docs"], _SECTIONS + _items_sql("compat"))
QUERIES["e10_conversation_items"] = q_conversation_items
QUERIES["e12_anchor_items"] = q_anchor_items
