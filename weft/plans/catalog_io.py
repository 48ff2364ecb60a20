"""Registered jobs of the sources/sinks family (A): write, read back, compare.

Each job writes the derived table below the session's checkpoint folder and
reads it back through the reader under test, so the check covers both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import formats as FM
from weft.operators import prepare
from weft.operators import render as R
from weft.plans import catalog_render as CR
from weft.plans.oracle_views import with_views
from weft.plans.sqlfrag import present, strip
from weft.sources import io as IO
from weft.sources import tables


def _items(spark, sf):
    return tables.items_view(spark, sf)


def _cols(df):
    return df.select("item_id", "instruction", "context", "output", "category",
                     F.array_join("tags", "|").alias("tags"), "difficulty", "source_section")


def q_json_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "items-json")
    IO.write_items_array(_items(spark, sf), path, one_array=True)
    return _cols(IO.read_items_json(spark, path, one_array=True))


def q_conversation_json(spark, sf):
    conv = tables.conversations(spark, sf)
    role = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    recs = conv.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", role.alias("r"), "text"))),
                                                   lambda x: F.struct(x["r"].alias("from"), x["text"].alias("value")))
                                       .alias("conversations"))
    path = IO.scratch_path(spark, "conv-json")
    IO.write_items_array(recs.withColumnRenamed("conv_id", "item_id"), path)
    got = IO.read_items_json(spark, path)
    return got.select("conv_id", "instruction", "output", "category")


def q_jsonl_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "items-jsonl")
    IO.write_items(_items(spark, sf), path, "jsonl")
    return _cols(IO.read_items_jsonl(spark, path))


def q_csv_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "items-csv")
    FM.to_flat(_items(spark, sf)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return _cols(IO.read_items_csv(spark, path))


def q_route_formats(spark, sf):
    docs = tables.read(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".txt").when(
        F.col("lang") == "fr", ".jsonl").otherwise(".csv")
    files = docs.select("doc_id", F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                                           ext).alias("path"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"))
    return files.select("doc_id", "path", IO.route_format(F.col("path"), F.col("first_line")).alias("format"))


def q_export_import(spark, sf):
    path = IO.scratch_path(spark, "export-sharegpt")
    IO.export_items(_items(spark, sf), "sharegpt", path)
    return _cols(IO.import_items(spark, path, "sharegpt"))


def q_export_import_csv(spark, sf):
    path = IO.scratch_path(spark, "export-csv")
    IO.export_items(_items(spark, sf), "csv", path)
    return _cols(IO.import_items(spark, path, "csv"))


def q_dataset_catalog(spark, sf):
    base = IO.scratch_path(spark, "catalog")
    split = prepare.stratified_split(_items(spark, sf), "category", 0.8, 42)
    for part in ("train", "validation"):
        IO.register_dataset(spark, base, f"items_{part}", split.where(F.col("split") == part).drop("split"))
    names = [r[0] for r in IO.list_datasets(spark, base).collect()]
    out = None
    for n in names:
        df = IO.load_dataset(spark, base, n).agg(F.count(F.lit(1)).alias("items"), F.sum("item_id").alias("id_sum"))
        df = df.select(F.lit(n).alias("name"), "items", "id_sum")
        out = df if out is None else out.unionByName(df)
    return out


def q_read_corpus(spark, sf):
    path = IO.scratch_path(spark, "corpus")
    tables.read(spark, sf, "documents").select("source", "text").write.mode("overwrite").partitionBy("source").text(path)
    c = IO.read_corpus(spark, path)
    return c.select(F.regexp_extract("path", r"source=([^/]+)", 1).alias("source"), F.length("text").alias("n")) \
        .groupBy("source").agg(F.sum("n").cast("long").alias("chars"))


def q_write_rendered_txt(spark, sf):
    path = IO.scratch_path(spark, "rendered-txt")
    R.write_rendered(R.render_corpus(_items(spark, sf), "chatml"), path, "txt")
    t = IO.read_corpus(spark, path)
    heads = t.select(F.explode(F.regexp_extract_all("text", F.lit(r"=== Training Example (\d+) ==="), 1)).alias("n"))
    return heads.agg(F.count(F.lit(1)).alias("examples"), F.max(F.col("n").cast("long")).alias("max_n"),
                     F.sum(F.col("n").cast("long")).alias("n_sum"))


_BACK = """SELECT item_id, {instr} AS instruction, {ctx} AS context, {out} AS output, {cat} AS category,
          {tags} AS tags, {diff} AS difficulty, {src} AS source_section FROM items {where}"""

SQL = {
    "a1_json_roundtrip": with_views(["items"], _BACK.format(
        instr="instruction", ctx="context", out="output", cat="category", tags="array_to_string(tags, '|')",
        diff="difficulty", src="source_section", where="")),
    "a2_conversation_json": """
        WITH t AS (SELECT *, CASE WHEN role = 'user' THEN 'human' ELSE role END AS r FROM conversations
                   WHERE role IN ('user', 'assistant', 'gpt')),
        l AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn) AS pr,
                        lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM t)
        SELECT conv_id, pt AS instruction, text AS output, 'conversation' AS category FROM l
        WHERE r IN ('assistant', 'gpt') AND pr = 'human' AND pt IS NOT NULL AND pt <> ''""",
    "a3_jsonl_roundtrip": with_views(["items"], _BACK.format(
        instr="instruction", ctx="context", out="output", cat="category", tags="array_to_string(tags, '|')",
        diff="difficulty", src="''", where="")),
    "a4_csv_roundtrip": with_views(["items"], _BACK.format(
        instr="coalesce(instruction, '')", ctx="coalesce(context, '')", out="coalesce(output, '')",
        cat=f"CASE WHEN {present('category')} THEN category ELSE 'general' END",
        tags="CASE WHEN coalesce(len(tags), 0) > 0 THEN array_to_string(tags, '|') ELSE '' END",
        diff="coalesce(difficulty, 'intermediate')", src="''", where="")),
    "a6_route_formats": """
        SELECT doc_id, path,
               CASE ext WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' WHEN '.jsonl' THEN 'jsonl'
                        WHEN '.csv' THEN 'csv'
                        WHEN '.txt' THEN CASE WHEN starts_with(regexp_replace(first_line, '^[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ''), '{') THEN 'jsonl' ELSE 'markdown' END
               END AS format
        FROM (SELECT doc_id, 'corpus/' || source || '/' || CAST(doc_id AS VARCHAR) || ext AS path, ext,
                     split_part(text, chr(10), 1) AS first_line
              FROM (SELECT *, CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.txt' WHEN 'fr' THEN '.jsonl' ELSE '.csv' END AS ext
                    FROM documents))""",
    "a10_export_import": with_views(["items"], _BACK.format(
        instr="instruction", ctx=f"CASE WHEN {present('context')} THEN context ELSE '' END", out="output",
        cat="category", tags="array_to_string(tags, '|')", diff="difficulty", src="source_section",
        where=f"WHERE {present('instruction')} AND {present('output')}")),
    "a10_export_import_csv": with_views(["items"], _BACK.format(
        instr="coalesce(instruction, '')", ctx="coalesce(context, '')", out="coalesce(output, '')",
        cat=f"CASE WHEN {present('category')} THEN category ELSE 'general' END",
        tags=f"array_to_string(list_filter(list_transform(string_split(array_to_string(tags, ','), ','), lambda t: {strip('t')}), lambda t: t <> ''), '|')",
        diff="coalesce(difficulty, 'intermediate')", src="coalesce(source_section, '')", where="")),
    "a8_dataset_catalog": with_views(["items"], """,
        s AS (SELECT item_id,
                CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5(concat('42|', CAST(item_id AS VARCHAR))))
                          <= floor(count(*) OVER (PARTITION BY category) * CAST(0.8 AS DOUBLE))
                     THEN 'train' ELSE 'validation' END AS split FROM items)
        SELECT 'items_' || split AS name, count(*) AS items, sum(item_id) AS id_sum FROM s GROUP BY split"""),
    "a9_write_rendered_txt": "SELECT count(*) AS examples, CAST(count(*) AS BIGINT) AS max_n, "
                             "CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS n_sum FROM ("
                             + with_views(["items"], CR._render_sql("chatml")) + ")",
    "a5_read_corpus": """
        SELECT source, CAST(sum(length(text)) + count(*) AS BIGINT) AS chars FROM documents GROUP BY source""",
}

QUERIES = {
    "a1_json_roundtrip": q_json_roundtrip,
    "a2_conversation_json": q_conversation_json,
    "a3_jsonl_roundtrip": q_jsonl_roundtrip,
    "a4_csv_roundtrip": q_csv_roundtrip,
    "a5_read_corpus": q_read_corpus,
    "a6_route_formats": q_route_formats,
    "a8_dataset_catalog": q_dataset_catalog,
    "a9_write_rendered_txt": q_write_rendered_txt,
    "a10_export_import": q_export_import,
    "a10_export_import_csv": q_export_import_csv,
}


def q_read_pages(spark, sf):
    return tables.pages(spark, sf).select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


SQL["a12_read_pages"] = "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages"
QUERIES["a12_read_pages"] = q_read_pages
