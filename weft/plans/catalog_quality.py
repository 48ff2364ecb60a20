"""Registered jobs of the validation (F) and preparation (G) families."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import bloom, prepare, quality
from weft.plans.oracle_views import with_views
from weft.plans.sqlfrag import present, present_arr, rmatch, strip
from weft.sources import tables
from weft.sources.io import scratch_path

# ---------------------------------------------------------------- Spark side


def _items(spark, sf):
    return tables.items_view(spark, sf)


def q_item_issues(spark, sf):
    return quality.item_issues(_items(spark, sf)).select("item_id", "issue_type", "severity")


def q_valid_items(spark, sf):
    return quality.valid_items(_items(spark, sf)).select("item_id", "category")


def q_item_quality(spark, sf):
    return _items(spark, sf).select("item_id", F.round(quality.item_quality(), 6).alias("quality"))


def q_duplicate_instructions(spark, sf):
    return quality.duplicate_instructions(_items(spark, sf)).select("first_item_id", "item_id")


def q_dataset_issues(spark, sf):
    return quality.dataset_issues(_items(spark, sf)).select("item_index", "issue_type", "severity")


def q_dataset_quality(spark, sf):
    d = quality.dataset_quality(_items(spark, sf))
    return d.select("total_items", F.round("diversity_bonus", 6).alias("diversity_bonus"),
                    F.round("completeness_bonus", 6).alias("completeness_bonus"), "quality_score")


def _dist(df, key):
    c = df.groupBy(key).count()
    return c.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "count"))),
                                          lambda x: F.concat(x[key], F.lit("="), x["count"].cast("string"))),
                              ";").alias(f"{key}_distribution"))


def q_item_stats(spark, sf):
    items = _items(spark, sf)
    s = quality.item_stats(items)
    return s.select(
        "total_items", "instruction_min", "instruction_max", F.round("instruction_avg", 6).alias("instruction_avg"),
        F.col("instruction_median").cast("long").alias("instruction_median"),
        "output_min", "output_max", F.round("output_avg", 6).alias("output_avg"),
        F.col("output_median").cast("long").alias("output_median"),
        F.round("has_context", 6).alias("has_context"), F.round("has_tags", 6).alias("has_tags"),
        F.round("has_source", 6).alias("has_source"),
    ).transform(lambda d: quality._one_row_join(d, _dist(items.where("category <> ''"), "category"),
                                                 _dist(items.where("difficulty <> ''"), "difficulty")))


def q_validation_report(spark, sf):
    return quality.validate(_items(spark, sf))


def q_quality_filter(spark, sf):
    return quality.quality_filter(_items(spark, sf), 0.7).select("item_id")


def q_stratified_split(spark, sf):
    return prepare.stratified_split(_items(spark, sf), "category", 0.8, 42).select("item_id", "category", "split")


def q_random_split(spark, sf):
    return prepare.random_split(_items(spark, sf), 0.8, 42).select("item_id", "split")


def q_split_by_difficulty(spark, sf):
    return prepare.train_validation_split(_items(spark, sf), 0.7, "difficulty", 7).select(
        "item_id", "difficulty", "split")


def q_tag_frequency(spark, sf):
    return prepare.tag_frequency(_items(spark, sf)).select("tag", "frequency", "first_item_id", "first_pos")


def q_dataset_info(spark, sf):
    d = prepare.dataset_info(_items(spark, sf))
    return d.select("total_items", "train_items", "validation_items", "n_categories",
                    F.round("avg_instruction_length", 6).alias("avg_instruction_length"),
                    F.round("avg_output_length", 6).alias("avg_output_length"),
                    "instruction_length_min", "instruction_length_max", "output_length_min",
                    "output_length_max", "quality_score")


def q_dedup_against_benchmark(spark, sf):
    items = _items(spark, sf)
    bench = tables.read(spark, sf, "benchmark").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"))
    # existing side: the benchmark passages' first lines and the items' own first lines of
    # documents that quote them; new side: all items.
    return prepare.dedup_against(items, bench).select("item_id")


def q_dedup_stored_filter(spark, sf):
    """G6 with a stored filter of the existing side: what it excludes skips the exact comparison."""
    items = _items(spark, sf)
    bench = tables.read(spark, sf, "benchmark").select(
        prepare.instruction_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("key"))
    path = scratch_path(spark, "bloom")
    bloom.store(bloom.build(bench, "key"), path)
    return bloom.new_rows(items, prepare.instruction_key(), bench, "key", bloom.load(spark, path)).select("item_id")


def q_update_items(spark, sf):
    items = _items(spark, sf)
    bench = tables.read(spark, sf, "benchmark").select(
        (F.col("item_id") + F.lit(10_000_000)).alias("item_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"))
    return prepare.update_items(bench, items.select("item_id", "instruction")).select("item_id")


def q_conversation_pairs(spark, sf):
    return prepare.conversation_pairs(tables.conversations(spark, sf)).select(
        "conv_id", "turn", "instruction", "output", "category")


# ---------------------------------------------------------------- DuckDB side

_SI, _SO = strip("instruction"), strip("output")
_POOR_I = " OR ".join(rmatch(_SI, p) for p in quality.POOR_INSTRUCTION_PATTERNS)
_POOR_O = " OR ".join(rmatch(_SO, p) for p in quality.POOR_OUTPUT_PATTERNS)
_VALID_CATS = ", ".join(f"'{c}'" for c in quality.VALID_CATEGORIES)
_VALID_DIFFS = ", ".join(f"'{c}'" for c in quality.VALID_DIFFICULTIES)

_ISSUES_BODY = f""",
f AS (
  SELECT *, {_SI} AS si, {_SO} AS so, length(instruction) AS il, length(output) AS ol,
         coalesce(len(tags), 0) AS nt,
         len(list_filter(coalesce(tags, []::VARCHAR[]), lambda t: length({strip('t')}) < 3)) AS nshort,
         ({present('instruction')} AND ({_POOR_I})) AS poor_i,
         ({present('output')} AND ({_POOR_O})) AS poor_o
  FROM items),
issues AS (
  SELECT item_id, 'missing_instruction' AS issue_type, 'error' AS severity FROM f WHERE NOT {present('si')}
  UNION ALL SELECT item_id, 'missing_output', 'error' FROM f WHERE NOT {present('so')}
  UNION ALL SELECT item_id, 'missing_category', 'warning' FROM f WHERE NOT {present(strip('category'))}
  UNION ALL SELECT item_id, 'instruction_too_short', 'warning' FROM f WHERE {present('instruction')} AND il < 10
  UNION ALL SELECT item_id, 'instruction_too_long', 'warning' FROM f WHERE {present('instruction')} AND il > 2000
  UNION ALL SELECT item_id, 'output_too_short', 'warning' FROM f WHERE {present('output')} AND ol < 20
  UNION ALL SELECT item_id, 'output_too_long', 'warning' FROM f WHERE {present('output')} AND ol > 8000
  UNION ALL SELECT item_id, 'poor_instruction_quality', 'warning' FROM f WHERE poor_i
  UNION ALL SELECT item_id, 'poor_output_quality', 'warning' FROM f WHERE poor_o
  UNION ALL SELECT item_id, 'invalid_category', 'info' FROM f WHERE {present('category')} AND category NOT IN ({_VALID_CATS})
  UNION ALL SELECT item_id, 'invalid_difficulty', 'info' FROM f WHERE {present('difficulty')} AND difficulty NOT IN ({_VALID_DIFFS})
  UNION ALL SELECT item_id, 'too_many_tags', 'info' FROM f WHERE nt > 10
  UNION ALL SELECT item_id, 'short_tags', 'info' FROM f WHERE nt > 0 AND nshort > 0)
"""

_QUALITY_EXPR = f"""greatest(0.0, least(1.0, CAST(1.0 AS DOUBLE)
   - CASE WHEN NOT {present('instruction')} THEN 0.5 WHEN length(instruction) < 10 THEN 0.2
          WHEN length(instruction) > 2000 THEN 0.1 ELSE 0.0 END
   - CASE WHEN NOT {present('output')} THEN 0.5 WHEN length(output) < 20 THEN 0.3
          WHEN length(output) > 8000 THEN 0.1 ELSE 0.0 END
   - CASE WHEN {present('instruction')} AND ({_POOR_I}) THEN 0.2 ELSE 0.0 END
   - CASE WHEN {present('output')} AND ({_POOR_O}) THEN 0.3 ELSE 0.0 END
   + CASE WHEN {present('category')} THEN 0.05 ELSE 0.0 END
   + CASE WHEN {present_arr('tags')} THEN 0.05 ELSE 0.0 END
   + CASE WHEN {present('context')} THEN 0.05 ELSE 0.0 END
   + CASE WHEN {present('source_section')} THEN 0.05 ELSE 0.0 END))"""

_SUMMARY = f""",
agg AS (
  SELECT count(*) AS n, avg({_QUALITY_EXPR}) AS mq,
         count(DISTINCT CASE WHEN {present('category')} THEN category END) AS ncat,
         count(DISTINCT CASE WHEN {present('difficulty')} THEN difficulty END) AS ndiff,
         avg(CASE WHEN {present('context')} THEN 1.0::DOUBLE ELSE 0.0 END) AS cr,
         avg(CASE WHEN {present_arr('tags')} THEN 1.0::DOUBLE ELSE 0.0 END) AS tr,
         avg(CASE WHEN {present('source_section')} THEN 1.0::DOUBLE ELSE 0.0 END) AS sr,
         sum(CASE WHEN category = 'conversation' THEN 1 ELSE 0 END) AS nconv,
         sum(CASE WHEN category = 'conversation' AND NOT {present('context')} THEN 1 ELSE 0 END) AS nconv_noctx
  FROM items),
tagagg AS (SELECT count(DISTINCT t) AS ntags FROM (SELECT unnest(tags) AS t FROM items)),
catagg AS (SELECT count(*) AS ncatv, max(c) AS maxc, min(c) AS minc
           FROM (SELECT category, count(*) AS c FROM items WHERE {present('category')} GROUP BY category)),
dupagg AS (SELECT coalesce(sum(c - 1), 0) AS ndup
           FROM (SELECT lower({_SI}) AS k, count(*) AS c FROM items WHERE {present('instruction')} GROUP BY 1)),
summary AS (
  SELECT *, CAST(least(0.1, ncat * 0.02) + least(0.05, ntags * 0.005) + least(0.05, ndiff * 0.02) AS DOUBLE) AS div,
         (cr + tr + sr) / 3 * 0.1 AS comp
  FROM agg, tagagg, catagg, dupagg),
scored AS (SELECT *, CASE WHEN n > 0 THEN round(least(1.0, mq + div + comp), 3) ELSE 0.0::DOUBLE END AS quality_score
           FROM summary),
dsissues AS (
  SELECT -1 AS item_index, 'dataset_too_small' AS issue_type, 'warning' AS severity FROM scored WHERE n < 5
  UNION ALL SELECT -1, 'duplicate_instructions', 'warning' FROM scored WHERE ndup > 0
  UNION ALL SELECT -1, 'single_category', 'info' FROM scored WHERE ncatv = 1
  UNION ALL SELECT -1, 'imbalanced_categories', 'info' FROM scored WHERE maxc > minc * 10
  UNION ALL SELECT -1, 'missing_conversation_context', 'info' FROM scored
            WHERE nconv_noctx > 0 AND nconv_noctx > nconv * 0.5)
"""


def _dist_sql(key):
    return (f"(SELECT string_agg({key} || '=' || CAST(c AS VARCHAR), ';' ORDER BY {key}) AS {key}_distribution "
            f"FROM (SELECT {key}, count(*) AS c FROM items WHERE {key} <> '' GROUP BY {key}))")


def _median_sql(col):
    return (f"(SELECT CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY length({col}) DESC) AS BIGINT) "
            f"FROM items WHERE {present(col)})")


SQL = {
    "f1_item_issues": with_views(["items"], _ISSUES_BODY + "SELECT item_id, issue_type, severity FROM issues"),
    "f2_valid_items": with_views(["items"], _ISSUES_BODY + """
        SELECT item_id, category FROM items
        WHERE item_id NOT IN (SELECT item_id FROM issues WHERE severity = 'error')"""),
    "f5_item_quality": with_views(["items"], f"SELECT item_id, round({_QUALITY_EXPR}, 6) AS quality FROM items"),
    "f4_duplicate_instructions": with_views(["items"], f"""
        , k AS (SELECT item_id, lower({_SI}) AS key FROM items WHERE {present('instruction')})
        SELECT first_item_id, item_id FROM (
          SELECT item_id, min(item_id) OVER (PARTITION BY key) AS first_item_id FROM k)
        WHERE item_id <> first_item_id"""),
    "f3_dataset_issues": with_views(["items"], _SUMMARY + "SELECT item_index, issue_type, severity FROM dsissues"),
    "f8_dataset_quality": with_views(["items"], _SUMMARY + """
        SELECT n AS total_items, round(div, 6) AS diversity_bonus, round(comp, 6) AS completeness_bonus,
               quality_score FROM scored"""),
    "f9_item_stats": with_views(["items"], f"""
        SELECT count(*) AS total_items,
               min(CASE WHEN {present('instruction')} THEN length(instruction) END) AS instruction_min,
               max(CASE WHEN {present('instruction')} THEN length(instruction) END) AS instruction_max,
               round(avg(CASE WHEN {present('instruction')} THEN length(instruction) END), 6) AS instruction_avg,
               {_median_sql('instruction')} AS instruction_median,
               min(CASE WHEN {present('output')} THEN length(output) END) AS output_min,
               max(CASE WHEN {present('output')} THEN length(output) END) AS output_max,
               round(avg(CASE WHEN {present('output')} THEN length(output) END), 6) AS output_avg,
               {_median_sql('output')} AS output_median,
               round(avg(CASE WHEN {present('context')} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS has_context,
               round(avg(CASE WHEN {present_arr('tags')} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS has_tags,
               round(avg(CASE WHEN {present('source_section')} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS has_source,
               {_dist_sql('category')} AS category_distribution,
               {_dist_sql('difficulty')} AS difficulty_distribution
        FROM items"""),
    "f11_validation_report": with_views(["items"], _ISSUES_BODY + _SUMMARY + """,
        cnt AS (SELECT
          (SELECT count(*) FROM items WHERE item_id NOT IN (SELECT item_id FROM issues WHERE severity='error')) AS valid_items,
          (SELECT count(*) FROM issues WHERE severity='error') + (SELECT count(*) FROM dsissues WHERE severity='error') AS error_count,
          (SELECT count(*) FROM issues WHERE severity='warning') + (SELECT count(*) FROM dsissues WHERE severity='warning') AS warning_count,
          (SELECT count(*) FROM issues WHERE severity='info') + (SELECT count(*) FROM dsissues WHERE severity='info') AS info_count,
          (SELECT coalesce(string_agg(issue_type, ',' ORDER BY pos), '') FROM
             (SELECT issue_type, CASE issue_type WHEN 'dataset_too_small' THEN 1 WHEN 'duplicate_instructions' THEN 2
                     WHEN 'single_category' THEN 3 WHEN 'imbalanced_categories' THEN 4 ELSE 5 END AS pos FROM dsissues)) AS dataset_issue_types)
        SELECT n AS total_items, valid_items, error_count, warning_count, info_count, dataset_issue_types, quality_score,
          concat_ws(' | ',
            CASE WHEN error_count > 0 THEN 'Fix ' || error_count || ' critical errors before using this dataset for training' END,
            CASE WHEN warning_count > n * 0.3 THEN 'Consider improving data quality - many items have quality issues' END,
            CASE WHEN n < 20 THEN 'Dataset is quite small. Consider adding more examples for better training results'
                 WHEN n < 100 THEN 'Dataset size is moderate. Adding more examples could improve model performance' END,
            CASE WHEN maxc > minc * 5 THEN 'Consider balancing category distribution for more robust training' END,
            CASE WHEN quality_score < 0.7 THEN 'Overall quality score is low. Focus on improving instruction and output quality'
                 WHEN quality_score < 0.8 THEN 'Good quality dataset. Small improvements could enhance training effectiveness'
                 ELSE 'High quality dataset ready for training!' END) AS recommendations
        FROM scored, cnt"""),
    "f12_quality_filter": with_views(["items"], _ISSUES_BODY + f"""
        SELECT item_id FROM items
        WHERE item_id NOT IN (SELECT item_id FROM issues WHERE severity = 'error') AND {_QUALITY_EXPR} >= 0.7"""),
    "g1_stratified_split": with_views(["items"], """
        SELECT item_id, category,
          CASE WHEN row_number() OVER (PARTITION BY category ORDER BY md5(concat('42|', CAST(item_id AS VARCHAR))))
                    <= floor(count(*) OVER (PARTITION BY category) * CAST(0.8 AS DOUBLE))
               THEN 'train' ELSE 'validation' END AS split
        FROM items"""),
    "g2_random_split": with_views(["items"], """
        SELECT item_id,
          CASE WHEN row_number() OVER (ORDER BY md5(concat('42|', CAST(item_id AS VARCHAR))))
                    <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
               THEN 'train' ELSE 'validation' END AS split
        FROM items"""),
    "g3_split_by_difficulty": with_views(["items"], """
        SELECT item_id, difficulty,
          CASE WHEN row_number() OVER (PARTITION BY difficulty ORDER BY md5(concat('7|', CAST(item_id AS VARCHAR))))
                    <= floor(count(*) OVER (PARTITION BY difficulty) * CAST(0.7 AS DOUBLE))
               THEN 'train' ELSE 'validation' END AS split
        FROM items"""),
    "g5_tag_frequency": with_views(["items"], """
        SELECT tag, count(*) AS frequency, arg_min(item_id, item_id * 1000 + pos) AS first_item_id,
               arg_min(pos, item_id * 1000 + pos) AS first_pos
        FROM (SELECT item_id, unnest(tags) AS tag, unnest(range(0, len(tags))) AS pos FROM items)
        GROUP BY tag"""),
    "g4_dataset_info": with_views(["items"], _SUMMARY + """
        SELECT count(*) AS total_items, CAST(floor(count(*) * 0.8) AS BIGINT) AS train_items,
               CAST(floor(count(*) * 0.2) AS BIGINT) AS validation_items,
               count(DISTINCT coalesce(category, '')) AS n_categories,
               round(avg(coalesce(length(instruction), 0)), 6) AS avg_instruction_length,
               round(avg(coalesce(length(output), 0)), 6) AS avg_output_length,
               min(coalesce(length(instruction), 0)) AS instruction_length_min,
               max(coalesce(length(instruction), 0)) AS instruction_length_max,
               min(coalesce(length(output), 0)) AS output_length_min,
               max(coalesce(length(output), 0)) AS output_length_max,
               (SELECT quality_score FROM scored) AS quality_score
        FROM items"""),
    "g6_dedup_against_benchmark": with_views(["items"], f"""
        SELECT item_id FROM items
        WHERE lower({_SI}) NOT IN (SELECT lower({strip("split_part(text, chr(10), 1)")}) FROM benchmark)
           OR instruction IS NULL"""),
    "g8_update_items": with_views(["items"], f"""
        SELECT item_id + 10000000 AS item_id FROM benchmark
        UNION ALL
        SELECT item_id FROM items
        WHERE lower({_SI}) NOT IN (SELECT lower({strip("split_part(text, chr(10), 1)")}) FROM benchmark)
           OR instruction IS NULL"""),
    "g7_conversation_pairs": """
        WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prole,
                          lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ptext
                   FROM conversations WHERE role IN ('user', 'human', 'assistant', 'gpt'))
        SELECT conv_id, turn, ptext AS instruction, text AS output, 'conversation' AS category
        FROM t WHERE role IN ('assistant', 'gpt') AND prole IN ('user', 'human') AND ptext IS NOT NULL AND ptext <> ''""",
}

SQL["g6_dedup_stored_filter"] = SQL["g6_dedup_against_benchmark"]

QUERIES = {
    "f1_item_issues": q_item_issues,
    "f2_valid_items": q_valid_items,
    "f3_dataset_issues": q_dataset_issues,
    "f4_duplicate_instructions": q_duplicate_instructions,
    "f5_item_quality": q_item_quality,
    "f8_dataset_quality": q_dataset_quality,
    "f9_item_stats": q_item_stats,
    "f11_validation_report": q_validation_report,
    "f12_quality_filter": q_quality_filter,
    "g1_stratified_split": q_stratified_split,
    "g2_random_split": q_random_split,
    "g3_split_by_difficulty": q_split_by_difficulty,
    "g4_dataset_info": q_dataset_info,
    "g5_tag_frequency": q_tag_frequency,
    "g6_dedup_against_benchmark": q_dedup_against_benchmark,
    "g6_dedup_stored_filter": q_dedup_stored_filter,
    "g7_conversation_pairs": q_conversation_pairs,
    "g8_update_items": q_update_items,
}


# ---------------------------------------------------------------- items generated from the collection


def q_generate_items(spark, sf):
    from weft.sources import tables as T

    q = T.queries_view(spark, sf)
    coll = T.collection_view(spark, sf)
    existing = T.read(spark, sf, "benchmark").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("instruction"))
    g = prepare.generate_items(q, coll, existing, per_query=5, min_similarity=0.7, min_quality=0.7,
                               filters={"filter_label": "label"})
    return g.select("query_id", "doc_id")


def _generated_sql() -> str:
    from weft.plans.oracle_views import COLLECTION, QUERIES as QV

    cos = ("list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / "
           "(sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * "
           "sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))))")
    return f"""WITH {QV}, {COLLECTION},
s AS (SELECT q.query_id, c.doc_id, {cos} AS score FROM queries q, collection c
      WHERE c.label = q.filter_label AND {cos} >= 0.7),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
items AS (SELECT r.query_id * 1000000 + r.doc_id AS item_id, r.query_id, r.doc_id, q.text AS instruction,
                 '' AS context, c.text AS output, 'general' AS category, []::VARCHAR[] AS tags,
                 'intermediate' AS difficulty, 'doc:' || CAST(r.doc_id AS VARCHAR) AS source_section
          FROM r JOIN queries q USING (query_id) JOIN collection c ON c.doc_id = r.doc_id WHERE r.rank <= 5)
{_ISSUES_BODY}
SELECT query_id, doc_id FROM items
WHERE item_id NOT IN (SELECT item_id FROM issues WHERE severity = 'error') AND {_QUALITY_EXPR} >= 0.7
  AND (instruction IS NULL OR lower({_SI}) NOT IN (SELECT lower({strip("split_part(text, chr(10), 1)")}) FROM benchmark))"""


SQL["g9_generate_items"] = _generated_sql()
QUERIES["g9_generate_items"] = q_generate_items
