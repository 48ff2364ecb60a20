"""Registered jobs of the rendering (H) and format-conversion (I) families."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import formats as FM
from weft.operators import render as R
from weft.plans.oracle_views import with_views
from weft.plans.sqlfrag import WS, present, strip
from weft.sources import tables


def _items(spark, sf):
    return tables.items_view(spark, sf)


def _rendered(fmt):
    def run(spark, sf):
        r = R.render_corpus(_items(spark, sf), fmt, 2048)
        return r.select("item_id", "text", F.col("metadata.original_length").cast("long").alias("original_length"),
                        F.col("metadata.processed_length").cast("long").alias("processed_length"),
                        F.col("metadata.format").alias("format"))

    return run


def q_system_prompt(spark, sf):
    return _items(spark, sf).select("item_id", R.system_prompt(True).alias("system_prompt"))


def q_truncate_smart(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", R.truncate_smart(F.col("text"), 2048).alias("truncated"))


def q_rendered_stats(spark, sf):
    s = R.rendered_stats(R.render_corpus(_items(spark, sf), "chatml", 2048))
    return s.select("total_items", "format", "text_length_min", "text_length_max",
                    F.round("text_length_avg", 6).alias("text_length_avg"),
                    F.col("text_length_median").cast("long").alias("text_length_median"),
                    F.round("avg_compression_ratio", 6).alias("avg_compression_ratio"),
                    "category_distribution", "difficulty_distribution")


def q_to_alpaca(spark, sf):
    a = FM.to_alpaca(_items(spark, sf))
    return a.select("item_id", "alpaca.instruction", "alpaca.input", "alpaca.output", "alpaca.category",
                    F.array_join("alpaca.tags", "|").alias("tags"), "alpaca.difficulty")


def _item_cols(df):
    return df.select("item_id", "instruction", "context", "output", "category",
                     F.array_join("tags", "|").alias("tags"), "difficulty", "source_section")


def q_alpaca_roundtrip(spark, sf):
    j = FM.to_alpaca(_items(spark, sf)).select("item_id", F.to_json("alpaca").alias("js"))
    back = j.select("item_id", F.from_json("js", FM.ALPACA_SCHEMA).alias("alpaca"))
    return _item_cols(FM.from_alpaca(back))


def q_to_sharegpt(spark, sf):
    s = FM.to_sharegpt(_items(spark, sf))
    conv = F.col("sharegpt.conversations")
    return s.select("item_id", F.array_join(F.transform(conv, lambda m: m["from"]), ",").alias("roles"),
                    F.try_element_at(conv, F.lit(-1))["value"].alias("last_value"),
                    F.col("sharegpt.metadata.category").alias("category"))


def q_sharegpt_roundtrip(spark, sf):
    j = FM.to_sharegpt(_items(spark, sf)).select("item_id", F.to_json("sharegpt").alias("js"))
    back = j.select("item_id", F.from_json("js", FM.SHAREGPT_SCHEMA).alias("sharegpt"))
    return _item_cols(FM.from_sharegpt(back))


def q_to_openai(spark, sf):
    o = FM.to_openai(_items(spark, sf))
    m = F.col("openai.messages")
    return o.select("item_id", m[0]["content"].alias("system"), m[1]["content"].alias("user"),
                    m[2]["content"].alias("assistant"))


def q_openai_roundtrip(spark, sf):
    j = FM.to_openai(_items(spark, sf)).select("item_id", F.to_json("openai").alias("js"))
    back = j.select("item_id", F.from_json("js", FM.OPENAI_SCHEMA).alias("openai"))
    return _item_cols(FM.from_openai(back))


def q_columnar_roundtrip(spark, sf):
    items = _items(spark, sf).withColumn("chunk", F.floor(F.col("item_id") / 100))
    cols = FM.to_columnar(items).columns
    # per-field lists for bounded chunks of 100 items (the exchange layout is lists per field)
    def field_of(c):
        return lambda x: x[c]

    packed = items.groupBy("chunk").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_id"),
        *[F.transform(F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("_k"), c))), field_of(c)).alias(c)
          for c in cols])
    return _item_cols(FM.from_columnar(packed, carry=("item_id",)))


def q_to_flat(spark, sf):
    return FM.to_flat(_items(spark, sf))


def q_flat_roundtrip(spark, sf):
    return _item_cols(FM.from_flat(FM.to_flat(_items(spark, sf))))


def q_from_generic(spark, sf):
    b = tables.read(spark, sf, "benchmark").select("item_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"))
    return _item_cols(FM.from_generic(b))


def q_conforms(spark, sf):
    items = _items(spark, sf)
    a = FM.to_alpaca(items).select("item_id", F.to_json("alpaca").alias("a"))
    s = FM.to_sharegpt(items).select("item_id", F.to_json("sharegpt").alias("s"))
    o = FM.to_openai(items).select("item_id", F.to_json("openai").alias("o"))
    j = a.join(s, "item_id").join(o, "item_id")
    out = [F.col("item_id")]
    for src in ("a", "s", "o"):
        for lay in ("alpaca", "sharegpt", "openai"):
            out.append(FM.conforms(F.col(src), lay).alias(f"{src}_{lay}"))
    return j.select(*out)


# ---------------------------------------------------------------- DuckDB side

_N = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sp() -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in R.CATEGORY_PROMPTS.items())
    base = f"(CASE category {whens} ELSE {_q(R.DEFAULT_PROMPT)} END)"
    return f"(CASE WHEN {present('context')} THEN {base} || ' Context: ' || context ELSE {base} END)"


_SP = _sp()


def _raw(fmt: str) -> str:
    if fmt == "chatml":
        return (f"concat_ws({_N}, CASE WHEN {present(_SP)} THEN {_q(R.SYSTEM_TOKEN)} || {_N} || {_SP} || {_q(R.END_TOKEN)} END, "
                f"{_q(R.USER_TOKEN)} || {_N} || instruction || {_q(R.END_TOKEN)}, "
                f"{_q(R.ASSISTANT_TOKEN)} || {_N} || output || {_q(R.END_TOKEN)})")
    if fmt == "vicuna":
        return (f"concat_ws({_N} || {_N}, CASE WHEN {present(_SP)} THEN 'SYSTEM: ' || {_SP} END, "
                f"'USER: ' || instruction, 'ASSISTANT: ' || output)")
    if fmt == "codellama":
        return (f"concat_ws({_N}, CASE WHEN {present(_SP)} THEN '# System' || {_N} || {_SP} || {_N} END, "
                f"CASE WHEN {present('category')} THEN '# Category: ' || category END, "
                f"CASE WHEN coalesce(len(tags), 0) > 0 THEN '# Tags: ' || array_to_string(tags, ', ') END, "
                f"CASE WHEN {present('difficulty')} THEN '# Difficulty: ' || difficulty END, "
                f"{_N} || '# Instruction' || {_N} || instruction || {_N}, "
                f"CASE WHEN {present('context')} THEN '# Context' || {_N} || context || {_N} END, "
                f"'# Response' || {_N} || output)")
    if fmt == "alpaca":
        inp = (f"(CASE WHEN {present(_SP)} AND {present('context')} THEN 'System: ' || {_SP} || {_N} || {_N} || 'Context: ' || context "
               f"WHEN {present(_SP)} THEN 'System: ' || {_SP} ELSE coalesce(context, '') END)")
        return (f"({_q(R.ALPACA_HEAD)} || CASE WHEN {present(inp)} THEN {_q(R.ALPACA_INPUT_DESC)} ELSE '' END || "
                f"{_q(R.ALPACA_TAIL)} || {_N} || {_N} || '### Instruction:' || {_N} || instruction || {_N} || "
                f"CASE WHEN {present(inp)} THEN {_N} || '### Input:' || {_N} || {inp} || {_N} ELSE '' END || "
                f"{_N} || '### Response:' || {_N} || output)")
    if fmt == "custom":
        return ("('System: ' || " + _SP + " || " + _N + " || " + _N + " || 'Category: ' || coalesce(category, '') || " + _N
                + " || 'Tags: ' || CASE WHEN coalesce(len(tags), 0) > 0 THEN array_to_string(tags, ', ') ELSE '' END || " + _N
                + " || 'Difficulty: ' || coalesce(difficulty, '') || " + _N + " || " + _N
                + " || 'Instruction: ' || instruction || " + _N + " || 'Context: ' || coalesce(context, '') || " + _N
                + " || " + _N + " || 'Response: ' || output)")
    raise ValueError(fmt)


def _rfind(t: str, bp: str, end: int) -> str:
    p = f"substr({t}, 1, {end})"
    i = f"instr(reverse({p}), reverse({_q(bp)}))"
    return f"(CASE WHEN {i} = 0 THEN -1 ELSE length({p}) - {i} - {len(bp)} + 1 END)"


def _truncate(t: str, m: int) -> str:
    whens = []
    for bp in [". ", "\n\n", "\n", ". "]:
        bps = bp.replace("\n", "' || chr(10) || '")
        bpsql = f"('{bps}')"
        pos = _rfind(t, bp, m - 100).replace(f"reverse({_q(bp)})", f"reverse({bpsql})")
        whens.append(f"WHEN {pos} > {m // 2} THEN {strip(f'substr({t}, 1, {pos} + {len(bp)})')}")
    ws = f"list_filter(regexp_split_to_array(substr({t}, 1, {m}), '[{WS}]+'), lambda w: w <> '')"
    fallback = f"array_to_string(({ws})[1:len({ws}) - 1], ' ')"
    return f"(CASE WHEN length({t}) <= {m} THEN {t} " + " ".join(whens) + f" ELSE {fallback} END)"


def _render_sql(fmt: str) -> str:
    return f""",
r AS (SELECT item_id, instruction, output, {_raw(fmt)} AS raw FROM items WHERE {present('instruction')} AND {present('output')}),
t AS (SELECT *, CASE WHEN length(raw) > 2048 THEN {_truncate('raw', 2048)} ELSE raw END AS cut FROM r),
f AS (SELECT *, CASE WHEN {present('raw')} AND length({strip('raw')}) >= 50 AND length({strip('cut')}) >= 50 THEN cut END AS text FROM t)
SELECT item_id, text, CAST(length(instruction) + length(output) AS BIGINT) AS original_length,
       CAST(length(text) AS BIGINT) AS processed_length, '{fmt}' AS format FROM f WHERE text IS NOT NULL"""


def _items_back(instr, ctx, out, cat, tags, diff, src, where="TRUE") -> str:
    return (f"SELECT item_id, {instr} AS instruction, {ctx} AS context, {out} AS output, {cat} AS category, "
            f"{tags} AS tags, {diff} AS difficulty, {src} AS source_section FROM items WHERE {where}")


_OPENAI_SYS = ("(CASE coalesce(category, '') " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in FM.OPENAI_SYSTEM.items())
               + f" ELSE {_q(FM.OPENAI_DEFAULT)} END)")

SQL = {
    "h1_system_prompt": with_views(["items"], f"SELECT item_id, {_SP} AS system_prompt FROM items"),
    "h8_truncate_smart": f"SELECT doc_id, {_truncate('text', 2048)} AS truncated FROM documents",
    "h2_render_chatml": with_views(["items"], _render_sql("chatml")),
    "h3_render_alpaca": with_views(["items"], _render_sql("alpaca")),
    "h4_render_vicuna": with_views(["items"], _render_sql("vicuna")),
    "h5_render_codellama": with_views(["items"], _render_sql("codellama")),
    "h6_render_custom": with_views(["items"], _render_sql("custom")),
    "h9_render_corpus": with_views(["items"], _render_sql("chatml")),
    "h10_rendered_stats": with_views(["items"], _render_sql("chatml").replace(
        "SELECT item_id, text, CAST(length(instruction)", ", rc AS (SELECT item_id, text, CAST(length(instruction)", 1)
        .replace("FROM f WHERE text IS NOT NULL", "FROM f WHERE text IS NOT NULL)", 1) + f""",
        j AS (SELECT rc.*, i.category, i.difficulty FROM rc JOIN items i USING (item_id))
        SELECT count(*) AS total_items, 'chatml' AS format, min(length(text)) AS text_length_min,
               max(length(text)) AS text_length_max, round(avg(length(text)), 6) AS text_length_avg,
               (SELECT CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY length(text) DESC) AS BIGINT) FROM rc) AS text_length_median,
               round(coalesce(avg(CASE WHEN original_length > 0 THEN processed_length / original_length END), 1.0), 6) AS avg_compression_ratio,
               (SELECT string_agg(k || '=' || CAST(c AS VARCHAR), ';' ORDER BY k) FROM
                  (SELECT coalesce(category, 'unknown') AS k, count(*) AS c FROM j GROUP BY 1)) AS category_distribution,
               (SELECT string_agg(k || '=' || CAST(c AS VARCHAR), ';' ORDER BY k) FROM
                  (SELECT coalesce(difficulty, 'unknown') AS k, count(*) AS c FROM j GROUP BY 1)) AS difficulty_distribution
        FROM j"""),
    "i1_to_alpaca": with_views(["items"], f"""
        SELECT item_id, instruction, coalesce(context, '') AS input, output,
               CASE WHEN {present('category')} THEN category END AS category,
               CASE WHEN coalesce(len(tags), 0) > 0 THEN array_to_string(tags, '|') END AS tags,
               CASE WHEN {present('difficulty')} THEN difficulty END AS difficulty FROM items"""),
    "i2_alpaca_roundtrip": with_views(["items"], _items_back(
        "instruction", "coalesce(context, '')", "output",
        f"CASE WHEN {present('category')} THEN category ELSE 'general' END", "array_to_string(tags, '|')",
        f"CASE WHEN {present('difficulty')} THEN difficulty ELSE 'intermediate' END", "''")),
    "i3_to_sharegpt": with_views(["items"], f"""
        SELECT item_id, CASE WHEN {present('context')} THEN 'system,human,gpt' ELSE 'human,gpt' END AS roles,
               output AS last_value, category FROM items"""),
    "i4_sharegpt_roundtrip": with_views(["items"], _items_back(
        "instruction", f"CASE WHEN {present('context')} THEN context ELSE '' END", "output", "category",
        "array_to_string(tags, '|')", "difficulty", "source_section",
        f"{present('instruction')} AND {present('output')}")),
    "i5_to_openai": with_views(["items"], f"""
        SELECT item_id, {_OPENAI_SYS} AS system, instruction AS user, output AS assistant FROM items"""),
    "i6_openai_roundtrip": with_views(["items"], _items_back(
        "instruction", _OPENAI_SYS, "output", "category", "array_to_string(tags, '|')", "difficulty", "''",
        f"{present('instruction')} AND {present('output')}")),
    "i8_columnar_roundtrip": with_views(["items"], _items_back(
        "coalesce(instruction, '')", "coalesce(context, '')", "coalesce(output, '')", "category",
        "array_to_string(tags, '|')", "difficulty", "coalesce(source_section, '')")),
    "i9_to_flat": with_views(["items"], """
        SELECT item_id, instruction, coalesce(context, '') AS context, output, category,
               CASE WHEN coalesce(len(tags), 0) > 0 THEN array_to_string(tags, ',') ELSE '' END AS tags,
               difficulty, coalesce(source_section, '') AS source_section FROM items"""),
    "i10_flat_roundtrip": with_views(["items"], _items_back(
        "coalesce(instruction, '')", "coalesce(context, '')", "coalesce(output, '')", "coalesce(category, 'general')",
        f"array_to_string(list_filter(list_transform(string_split(array_to_string(tags, ','), ','), lambda t: {strip('t')}), lambda t: t <> ''), '|')",
        "coalesce(difficulty, 'intermediate')", "coalesce(source_section, '')")),
    "i11_from_generic": """
        SELECT item_id, split_part(text, chr(10), 1) AS instruction, '' AS context, '' AS output,
               'general' AS category, '' AS tags, 'intermediate' AS difficulty, '' AS source_section FROM benchmark""",
    "i12_conforms": with_views(["items"], """
        SELECT item_id, true AS a_alpaca, false AS a_sharegpt, false AS a_openai,
               false AS s_alpaca, true AS s_sharegpt, false AS s_openai,
               false AS o_alpaca, false AS o_sharegpt, true AS o_openai FROM items"""),
}

QUERIES = {
    "h1_system_prompt": q_system_prompt,
    "h2_render_chatml": _rendered("chatml"),
    "h3_render_alpaca": _rendered("alpaca"),
    "h4_render_vicuna": _rendered("vicuna"),
    "h5_render_codellama": _rendered("codellama"),
    "h6_render_custom": _rendered("custom"),
    "h8_truncate_smart": q_truncate_smart,
    "h9_render_corpus": _rendered("chatml"),
    "h10_rendered_stats": q_rendered_stats,
    "i1_to_alpaca": q_to_alpaca,
    "i2_alpaca_roundtrip": q_alpaca_roundtrip,
    "i3_to_sharegpt": q_to_sharegpt,
    "i4_sharegpt_roundtrip": q_sharegpt_roundtrip,
    "i5_to_openai": q_to_openai,
    "i6_openai_roundtrip": q_openai_roundtrip,
    "i8_columnar_roundtrip": q_columnar_roundtrip,
    "i9_to_flat": q_to_flat,
    "i10_flat_roundtrip": q_flat_roundtrip,
    "i11_from_generic": q_from_generic,
    "i12_conforms": q_conforms,
}
