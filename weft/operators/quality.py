"""Validation and quality of training items.

All rules are native column expressions evaluated in one scan of the items
table; dataset-level figures are partial (map-side) aggregates, so nothing is
gathered into one task beyond fixed-size aggregate buffers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.rows import select_where
from weft.functions.text import present, present_arr, strip

# Fixed values that must equal the reference's rules.
MIN_INSTRUCTION_LENGTH = 10
MAX_INSTRUCTION_LENGTH = 2000
MIN_OUTPUT_LENGTH = 20
MAX_OUTPUT_LENGTH = 8000
POOR_INSTRUCTION_PATTERNS = [
    r"^(what|how|why|when|where)\?*$",
    r"^(yes|no|ok|sure)\.?$",
    r"^.{1,5}$",
]
POOR_OUTPUT_PATTERNS = [
    r"^(yes|no|ok|sure)\.?$",
    r"^.{1,10}$",
    r"^(i don't know|not sure|maybe)\.?$",
]
VALID_DIFFICULTIES = ["foundational", "intermediate", "advanced"]
VALID_CATEGORIES = [
    "philosophy",
    "methodology",
    "process",
    "example",
    "conversation",
    "crisis_management",
    "implementation",
    "core_principle",
    "general",
]

# Java regex flags: (?i) ignore case, (?d) only '\n' ends a line (as in Python).
_FLAGS = "(?id)"


def _or(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def poor_instruction(c: Column) -> Column:
    return present(c) & _or([strip(c).rlike(_FLAGS + p) for p in POOR_INSTRUCTION_PATTERNS])


def poor_output(c: Column) -> Column:
    return present(c) & _or([strip(c).rlike(_FLAGS + p) for p in POOR_OUTPUT_PATTERNS])


def _issue(cond: Column, issue_type: str, severity: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(issue_type).alias("issue_type"), F.lit(severity).alias("severity"),
                                 message.alias("message")))


def issue_array(items: DataFrame | None = None) -> Column:
    """Per-item ``array<struct<issue_type, severity, message>>`` (F1 rules, in order)."""
    ins, out, cat, diff, tags = (F.col(c) for c in ("instruction", "output", "category", "difficulty", "tags"))
    ilen, olen = F.length(ins), F.length(out)
    n_tags = F.coalesce(F.size(tags), F.lit(0))
    short_tags = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.length(strip(t)) < 3)
    checks = [
        _issue(~present(strip(ins)), "missing_instruction", "error", F.lit("Instruction is empty or missing")),
        _issue(~present(strip(out)), "missing_output", "error", F.lit("Output is empty or missing")),
        _issue(~present(strip(cat)), "missing_category", "warning", F.lit("Category is empty or missing")),
        _issue(present(ins) & (ilen < MIN_INSTRUCTION_LENGTH), "instruction_too_short", "warning",
               F.format_string("Instruction too short (%d chars, min: %d)", ilen, F.lit(MIN_INSTRUCTION_LENGTH))),
        _issue(present(ins) & (ilen > MAX_INSTRUCTION_LENGTH), "instruction_too_long", "warning",
               F.format_string("Instruction too long (%d chars, max: %d)", ilen, F.lit(MAX_INSTRUCTION_LENGTH))),
        _issue(present(out) & (olen < MIN_OUTPUT_LENGTH), "output_too_short", "warning",
               F.format_string("Output too short (%d chars, min: %d)", olen, F.lit(MIN_OUTPUT_LENGTH))),
        _issue(present(out) & (olen > MAX_OUTPUT_LENGTH), "output_too_long", "warning",
               F.format_string("Output too long (%d chars, max: %d)", olen, F.lit(MAX_OUTPUT_LENGTH))),
        _issue(poor_instruction(ins), "poor_instruction_quality", "warning",
               F.lit("Instruction appears too simple or generic")),
        _issue(poor_output(out), "poor_output_quality", "warning",
               F.lit("Output appears too simple or unhelpful")),
        _issue(present(cat) & ~cat.isin(VALID_CATEGORIES), "invalid_category", "info",
               F.concat(F.lit("Unknown category: "), cat)),
        _issue(present(diff) & ~diff.isin(VALID_DIFFICULTIES), "invalid_difficulty", "info",
               F.concat(F.lit("Unknown difficulty: "), diff)),
        _issue(n_tags > 10, "too_many_tags", "info",
               F.format_string("Too many tags (%d), consider reducing", n_tags)),
        _issue((n_tags > 0) & (F.size(short_tags) > 0), "short_tags", "info",
               F.concat(F.lit("Very short tags found: "), F.array_join(short_tags, ", "))),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def item_issues(items: DataFrame) -> DataFrame:
    """one row per item issue (item_id, position, issue_type, severity, message)."""
    return items.select("item_id", F.posexplode(issue_array()).alias("position", "issue")).select(
        "item_id", "position", "issue.issue_type", "issue.severity", "issue.message"
    )


def has_error(issues: Column) -> Column:
    return F.exists(issues, lambda x: x["severity"] == F.lit("error"))


def valid_items(items: DataFrame) -> DataFrame:
    """items without an error issue (predicate on the issue array, no join).

    The rules are evaluated once per item (``select_where``), not once in a
    pushed-down filter and again in the projection below it.
    """
    cols = [F.col(c) for c in items.columns]
    kept = select_where(items, cols + [issue_array().alias("_iss")], lambda r: ~has_error(r["_iss"]))
    return kept.drop("_iss")


def item_quality(ins: Column | None = None, out: Column | None = None) -> Column:
    """per-item quality score in [0, 1]."""
    ins = F.col("instruction") if ins is None else ins
    out = F.col("output") if out is None else out
    ilen, olen = F.length(ins), F.length(out)
    s = F.lit(1.0)
    s = s - F.when(~present(ins), 0.5).when(ilen < MIN_INSTRUCTION_LENGTH, 0.2).when(
        ilen > MAX_INSTRUCTION_LENGTH, 0.1).otherwise(0.0)
    s = s - F.when(~present(out), 0.5).when(olen < MIN_OUTPUT_LENGTH, 0.3).when(
        olen > MAX_OUTPUT_LENGTH, 0.1).otherwise(0.0)
    s = s - F.when(poor_instruction(ins), 0.2).otherwise(0.0)
    s = s - F.when(poor_output(out), 0.3).otherwise(0.0)
    s = s + F.when(present("category"), 0.05).otherwise(0.0)
    s = s + F.when(present_arr("tags"), 0.05).otherwise(0.0)
    s = s + F.when(present("context"), 0.05).otherwise(0.0)
    s = s + F.when(present("source_section"), 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def with_quality(items: DataFrame) -> DataFrame:
    return items.withColumn("quality", item_quality())


def quality_filter(items: DataFrame, min_score: float = 0.7) -> DataFrame:
    """keep valid items whose score reaches ``min_score`` (rules evaluated once per item)."""
    cols = [F.col(c) for c in items.columns]
    kept = select_where(items, cols + [issue_array().alias("_iss"), item_quality().alias("_score")],
                        lambda r: ~has_error(r["_iss"]) & (r["_score"] >= F.lit(min_score)))
    return kept.drop("_iss", "_score")


def _keyed_counts(items: DataFrame) -> DataFrame:
    """One scan of the items: every item emits an ``all`` row carrying its measures plus one
    row per grouping it belongs to (category, difficulty, tag, normalised instruction).
    A single partial aggregation over (kind, key) then yields all dataset figures."""
    staged = items.select("*", issue_array().alias("_iss"))  # built once, read by four counts
    iss = F.col("_iss")
    per = staged.select(
        item_quality().alias("_q"),
        F.when(~has_error(iss), 1).otherwise(0).alias("_valid"),
        F.size(F.filter(iss, lambda x: x["severity"] == "error")).alias("_err"),
        F.size(F.filter(iss, lambda x: x["severity"] == "warning")).alias("_warn"),
        F.size(F.filter(iss, lambda x: x["severity"] == "info")).alias("_info"),
        F.when(present("context"), 1.0).otherwise(0.0).alias("_ctx"),
        F.when(present_arr("tags"), 1.0).otherwise(0.0).alias("_tags"),
        F.when(present("source_section"), 1.0).otherwise(0.0).alias("_src"),
        F.when(F.col("category") == "conversation", 1).otherwise(0).alias("_conv"),
        F.when((F.col("category") == "conversation") & ~present("context"), 1).otherwise(0).alias("_conv_noctx"),
        F.col("category"), F.col("difficulty"), F.col("tags"),
        F.when(present("instruction"), F.lower(strip("instruction"))).alias("_dup"),
    )

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    none = F.array().cast("array<struct<kind:string,key:string>>")
    keys = F.concat(
        F.array(key("all", F.lit(""))),
        F.when(present("category"), F.array(key("cat", F.col("category")))).otherwise(none),
        F.when(present("difficulty"), F.array(key("diff", F.col("difficulty")))).otherwise(none),
        F.when(F.col("_dup").isNotNull(), F.array(key("dup", F.col("_dup")))).otherwise(none),
        F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: key("tag", t)),
    )
    measures = ["_q", "_valid", "_err", "_warn", "_info", "_ctx", "_tags", "_src", "_conv", "_conv_noctx"]
    x = per.select(F.explode(keys).alias("k"), *measures)
    is_all = F.col("k.kind") == "all"
    return x.groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(F.when(is_all, F.col(m))).alias(m) for m in measures])


def _dataset_figures(items: DataFrame) -> DataFrame:
    g = _keyed_counts(items)
    kind = F.col("kind")
    is_all = kind == "all"
    n = F.sum(F.when(is_all, F.col("cnt")))
    return g.agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(is_all, F.col("_valid"))), F.lit(0)).alias("valid_items"),
        F.coalesce(F.sum(F.when(is_all, F.col("_err"))), F.lit(0)).alias("item_errors"),
        F.coalesce(F.sum(F.when(is_all, F.col("_warn"))), F.lit(0)).alias("item_warnings"),
        F.coalesce(F.sum(F.when(is_all, F.col("_info"))), F.lit(0)).alias("item_infos"),
        F.try_divide(F.sum(F.when(is_all, F.col("_q"))), n).alias("mean_item_quality"),
        F.try_divide(F.sum(F.when(is_all, F.col("_ctx"))), n).alias("context_rate"),
        F.try_divide(F.sum(F.when(is_all, F.col("_tags"))), n).alias("tags_rate"),
        F.try_divide(F.sum(F.when(is_all, F.col("_src"))), n).alias("source_rate"),
        F.coalesce(F.sum(F.when(is_all, F.col("_conv"))), F.lit(0)).alias("n_conversation"),
        F.coalesce(F.sum(F.when(is_all, F.col("_conv_noctx"))), F.lit(0)).alias("n_conversation_no_context"),
        F.count(F.when(kind == "cat", 1)).alias("n_categories"),
        F.count(F.when(kind == "cat", 1)).alias("n_cat_values"),
        F.max(F.when(kind == "cat", F.col("cnt"))).alias("max_cat"),
        F.min(F.when(kind == "cat", F.col("cnt"))).alias("min_cat"),
        F.count(F.when(kind == "diff", 1)).alias("n_difficulties"),
        F.count(F.when(kind == "tag", 1)).alias("n_tags"),
        F.coalesce(F.sum(F.when(kind == "dup", F.col("cnt") - 1)), F.lit(0)).alias("n_duplicates"),
    )


def duplicate_instructions(items: DataFrame) -> DataFrame:
    """(first_item_id, item_id) for every later item whose normalised instruction repeats.

    The first id per key is a partial aggregate (skew-safe); the join back is an
    equi-join that AQE splits when one key is hot. Each item appears at most once.
    """
    keyed = items.where(present("instruction")).select(
        "item_id", F.lower(strip("instruction")).alias("dup_key"))
    firsts = keyed.groupBy("dup_key").agg(F.min("item_id").alias("first_item_id"))
    return keyed.join(firsts, "dup_key").where(F.col("item_id") != F.col("first_item_id")).select(
        "first_item_id", "item_id", "dup_key")


def _one_row_join(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join: stack them (missing columns
    NULL) and take each column's one non-NULL value."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def diversity_bonus(n_categories: Column, n_tags: Column, n_difficulties: Column) -> Column:
    return (F.least(F.lit(0.1), n_categories * 0.02) + F.least(F.lit(0.05), n_tags * 0.005)
            + F.least(F.lit(0.05), n_difficulties * 0.02))


def dataset_summary(items: DataFrame) -> DataFrame:
    """One row with every dataset-level figure (F3, F6-F8, F10 inputs)."""
    s = _dataset_figures(items)
    div = diversity_bonus(F.col("n_categories"), F.col("n_tags"), F.col("n_difficulties"))
    comp = (F.col("context_rate") + F.col("tags_rate") + F.col("source_rate")) / 3 * 0.1
    raw = F.least(F.lit(1.0), F.col("mean_item_quality") + div + comp)
    return s.withColumn("diversity_bonus", div).withColumn("completeness_bonus", comp).withColumn(
        "quality_score", F.when(F.col("n") > 0, F.round(raw, 3)).otherwise(F.lit(0.0)))


def dataset_issue_array() -> Column:
    """F3 rules over the one-row summary, in the reference's order."""
    return F.filter(F.array(
        F.when(F.col("n") < 5, F.struct(F.lit("dataset_too_small").alias("issue_type"),
                                        F.lit("warning").alias("severity"))),
        F.when(F.col("n_duplicates") > 0, F.struct(F.lit("duplicate_instructions").alias("issue_type"),
                                                   F.lit("warning").alias("severity"))),
        F.when(F.col("n_cat_values") == 1, F.struct(F.lit("single_category").alias("issue_type"),
                                                    F.lit("info").alias("severity"))),
        F.when(F.col("max_cat") > F.col("min_cat") * 10,
               F.struct(F.lit("imbalanced_categories").alias("issue_type"), F.lit("info").alias("severity"))),
        F.when((F.col("n_conversation_no_context") > 0)
               & (F.col("n_conversation_no_context") > F.col("n_conversation") * 0.5),
               F.struct(F.lit("missing_conversation_context").alias("issue_type"),
                        F.lit("info").alias("severity"))),
    ), lambda x: x.isNotNull())


def dataset_issues(items: DataFrame) -> DataFrame:
    """one row per dataset-level issue (item index -1)."""
    return dataset_summary(items).select(F.posexplode(dataset_issue_array()).alias("position", "i")).select(
        F.lit(-1).alias("item_index"), "position", "i.issue_type", "i.severity")


def dataset_quality(items: DataFrame) -> DataFrame:
    """F8: one row with the rounded dataset quality score (0 for an empty table)."""
    return dataset_summary(items).select(
        F.col("n").alias("total_items"), "diversity_bonus", "completeness_bonus", "quality_score")


def recommendation_array() -> Column:
    """F10 rule list over the report row (errors / warnings include dataset issues)."""
    n = F.col("n")
    return F.filter(F.array(
        F.when(F.col("error_count") > 0, F.format_string(
            "Fix %d critical errors before using this dataset for training", F.col("error_count"))),
        F.when(F.col("warning_count") > n * 0.3,
               F.lit("Consider improving data quality - many items have quality issues")),
        F.when(n < 20, F.lit("Dataset is quite small. Consider adding more examples for better training results"))
        .when(n < 100, F.lit("Dataset size is moderate. Adding more examples could improve model performance")),
        F.when(F.col("max_cat") > F.col("min_cat") * 5,
               F.lit("Consider balancing category distribution for more robust training")),
        F.when(F.col("quality_score") < 0.7,
               F.lit("Overall quality score is low. Focus on improving instruction and output quality"))
        .when(F.col("quality_score") < 0.8,
              F.lit("Good quality dataset. Small improvements could enhance training effectiveness"))
        .otherwise(F.lit("High quality dataset ready for training!")),
    ), lambda x: x.isNotNull())


def _median_of_lengths(items: DataFrame, col: str, alias: str) -> DataFrame:
    """Upper median ``sorted(x)[n // 2]`` of present lengths, exact and skew-safe.

    A histogram of lengths (partial aggregate, one row per distinct length)
    replaces a per-group sort; the running count runs over that small table.
    """
    hist = items.where(present(col)).groupBy(F.length(col).alias("len")).count()
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select("len", "count", F.sum("count").over(w).alias("cum"),
                      F.sum("count").over(Window.partitionBy()).alias("tot"))
    med = cum.where((F.col("cum") - F.col("count") <= F.floor(F.col("tot") / 2))
                    & (F.col("cum") > F.floor(F.col("tot") / 2)))
    return med.agg(F.max("len").alias(alias))


def item_stats(items: DataFrame) -> DataFrame:
    """statistics row (lengths, distributions as JSON text, completeness)."""
    base = items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.min(F.when(present("instruction"), F.length("instruction"))).alias("instruction_min"),
        F.max(F.when(present("instruction"), F.length("instruction"))).alias("instruction_max"),
        F.avg(F.when(present("instruction"), F.length("instruction"))).alias("instruction_avg"),
        F.min(F.when(present("output"), F.length("output"))).alias("output_min"),
        F.max(F.when(present("output"), F.length("output"))).alias("output_max"),
        F.avg(F.when(present("output"), F.length("output"))).alias("output_avg"),
        F.avg(F.when(present("context"), 1.0).otherwise(0.0)).alias("has_context"),
        F.avg(F.when(present_arr("tags"), 1.0).otherwise(0.0)).alias("has_tags"),
        F.avg(F.when(present("source_section"), 1.0).otherwise(0.0)).alias("has_source"),
    )
    cat = items.where(present("category")).groupBy("category").count().agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count"))))).alias(
            "category_distribution"))
    dif = items.where(present("difficulty")).groupBy("difficulty").count().agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("difficulty", "count"))))).alias(
            "difficulty_distribution"))
    return _one_row_join(base, _median_of_lengths(items, "instruction", "instruction_median"),
                         _median_of_lengths(items, "output", "output_median"), cat, dif)


def validate(items: DataFrame) -> DataFrame:
    """the validation report as one row.

    Counts of errors/warnings/infos include the dataset-level issues; an empty
    table gives the special empty-dataset report (one error, score 0).
    """
    s = dataset_summary(items)
    ds = dataset_issue_array()
    s = s.select(
        "*",
        F.size(ds).alias("n_dataset_issues"),
        (F.col("item_errors") + F.size(F.filter(ds, lambda x: x["severity"] == "error"))).alias("error_count"),
        (F.col("item_warnings") + F.size(F.filter(ds, lambda x: x["severity"] == "warning"))).alias(
            "warning_count"),
        (F.col("item_infos") + F.size(F.filter(ds, lambda x: x["severity"] == "info"))).alias("info_count"),
        F.array_join(F.transform(ds, lambda x: x["issue_type"]), ",").alias("dataset_issue_types"),
    )
    empty = F.col("n") == 0
    return s.select(
        F.col("n").alias("total_items"),
        F.when(empty, 0).otherwise(F.col("valid_items")).alias("valid_items"),
        F.when(empty, 1).otherwise(F.col("error_count")).alias("error_count"),
        F.when(empty, 0).otherwise(F.col("warning_count")).alias("warning_count"),
        F.when(empty, 0).otherwise(F.col("info_count")).alias("info_count"),
        F.when(empty, "empty_dataset").otherwise(F.col("dataset_issue_types")).alias("dataset_issue_types"),
        F.col("quality_score"),
        F.when(empty, F.lit("Add training data to the dataset")).otherwise(
            F.array_join(recommendation_array(), " | ")).alias("recommendations"),
    )
