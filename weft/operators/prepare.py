"""Dataset preparation (G1-G9): splits, dataset info, tag ranking, dedup, pairing.

The stratified split is exact and skew-safe: instead of ranking a whole stratum
inside one task, rows are ranked by a seeded hash and the per-stratum cut is
found from a bucket histogram (partial aggregate), so the only ranking runs
over the rows of one boundary bucket per stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.text import present, strip
from weft.operators import quality

# Number of hash buckets used to locate each stratum's cut (16 bits of md5).
_BUCKET_HEX = 4
# Strata whose boundary travels to the rows, at most.
CARRIED_STRATA = 1 << 14


def split_key(id_col: Column, seed: int) -> Column:
    """Seeded, cluster-stable shuffle order: md5 of ``seed|id`` (hex string)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def stratified_split(items: DataFrame, by: str | None = "category", ratio: float = 0.8, seed: int = 42,
                     id_col: str = "item_id") -> DataFrame:
    """G1: adds ``split`` ('train' / 'validation').

    Per stratum the first ``int(n * ratio)`` rows in seeded hash order are train.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError("train_ratio must be between 0.0 and 1.0")
    stratum = F.coalesce(F.col(by).cast("string"), F.lit("\u0000null")) if by else F.lit("")
    keyed = items.withColumn("_s", stratum).withColumn("_k", split_key(F.col(id_col), seed)).withColumn(
        "_b", F.substring("_k", 1, _BUCKET_HEX))
    # 1) histogram per (stratum, bucket) -- partial aggregation, bounded output
    hist = keyed.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select("_s", "_b", "_c", F.sum("_c").over(w).alias("_cum"),
                       F.sum("_c").over(Window.partitionBy("_s")).alias("_n"))
    hist = hist.withColumn("_m", F.floor(F.col("_n") * F.lit(float(ratio))).cast("long"))
    # 2) boundary bucket per stratum: where the running count first reaches m (one row per stratum)
    bounds = hist.where((F.col("_cum") - F.col("_c") < F.col("_m")) & (F.col("_cum") >= F.col("_m"))).select(
        "_s", F.col("_b").alias("_bb"), (F.col("_m") - (F.col("_cum") - F.col("_c"))).alias("_need"))
    bounds = bounds.checkpoint()
    # few strata travel to the rows; dealt by stratum, all rows of one would meet in one task
    placed = keyed.join(F.broadcast(bounds) if bounds.count() <= CARRIED_STRATA else bounds, "_s", "left")
    # 3) exact rank only inside the boundary bucket of each stratum; rows that repeat an id are
    # told apart by their digest, and equal rows by their count
    at_edge = F.coalesce(F.col("_b") == F.col("_bb"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_k", F.xxhash64(*items.columns)))
    edge = placed.where(at_edge).withColumn("_rn", rank)
    edge = edge.withColumn("split", F.when(F.col("_rn") <= F.col("_need"), "train").otherwise("validation"))
    rest = placed.where(~at_edge).withColumn(
        "split", F.when(F.col("_b") < F.col("_bb"), "train").otherwise("validation"))
    return edge.select(*items.columns, "split").unionByName(rest.select(*items.columns, "split"))


def random_split(items: DataFrame, ratio: float = 0.8, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """The same rule over the whole table (one stratum)."""
    return stratified_split(items, None, ratio, seed, id_col)


def train_validation_split(items: DataFrame, ratio: float = 0.8, stratify_by: str | None = "category",
                           seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """Stratify only when asked for and the table has more than 10 rows."""
    if not 0.0 < ratio < 1.0:
        raise ValueError("train_ratio must be between 0.0 and 1.0")
    if stratify_by and items.limit(11).count() > 10:
        return stratified_split(items, stratify_by, ratio, seed, id_col)
    return random_split(items, ratio, seed, id_col)


def write_split(df: DataFrame, path: str) -> None:
    """Persist both parts in one pass, partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def tag_frequency(items: DataFrame) -> DataFrame:
    """Tag counts, descending; ties by first appearance (item order, position)."""
    t = items.select("item_id", F.posexplode("tags").alias("pos", "tag"))
    return t.groupBy("tag").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(F.struct("item_id", "pos")).alias("_first"),
    ).select("tag", "frequency", F.col("_first.item_id").alias("first_item_id"),
             F.col("_first.pos").alias("first_pos"))


def _distribution(items: DataFrame, column: str) -> DataFrame:
    """Counts by value as one JSON object (missing counts as the empty value)."""
    counts = items.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "count"))))).alias(f"{column}_distribution"))


def dataset_info(items: DataFrame) -> DataFrame:
    """One-row dataset info (counts, default split sizes, averages, ranges)."""
    base = items.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.countDistinct(F.coalesce(F.col("category"), F.lit(""))).alias("n_categories"),
        F.avg(F.coalesce(F.length("instruction"), F.lit(0))).alias("avg_instruction_length"),
        F.avg(F.coalesce(F.length("output"), F.lit(0))).alias("avg_output_length"),
        F.min(F.coalesce(F.length("instruction"), F.lit(0))).alias("instruction_length_min"),
        F.max(F.coalesce(F.length("instruction"), F.lit(0))).alias("instruction_length_max"),
        F.min(F.coalesce(F.length("output"), F.lit(0))).alias("output_length_min"),
        F.max(F.coalesce(F.length("output"), F.lit(0))).alias("output_length_max"),
    )
    base = base.withColumn("train_items", F.floor(F.col("total_items") * F.lit(0.8)).cast("long")).withColumn(
        "validation_items", F.floor(F.col("total_items") * F.lit(0.2)).cast("long"))
    cats = _distribution(items, "category")
    diffs = _distribution(items, "difficulty")
    q = quality.dataset_quality(items).select("quality_score")
    return quality._one_row_join(base, cats, diffs, q)


def instruction_key(c: Column | str = "instruction") -> Column:
    """Normalised instruction used for duplicate detection (F4 key)."""
    return F.lower(strip(c))


def dedup_against(new: DataFrame, existing: DataFrame, existing_col: str = "instruction") -> DataFrame:
    """Drop new items whose normalised instruction already exists.

    A left-anti equi-join: both sides shuffle on the key, or the existing side
    is broadcast by the planner when its statistics say it is small.
    """
    ex = existing.select(instruction_key(existing_col).alias("_key")).distinct()
    return new.withColumn("_key", instruction_key("instruction")).join(ex, "_key", "left_anti").drop("_key")


def update_items(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Existing items plus the candidates that are not duplicates of them."""
    return existing.unionByName(dedup_against(candidates, existing), allowMissingColumns=True)


def conversation_pairs(turns: DataFrame, human_roles=("user", "human"), assistant_roles=("assistant", "gpt"),
                       skew_safe: bool = True) -> DataFrame:
    """Pair each assistant turn with the latest unconsumed, non-empty human turn.

    Only human/assistant turns take part; within a conversation an assistant
    turn pairs when the previous such turn is a human turn with text.

    ``skew_safe`` numbers the kept turns over the whole table in (conversation,
    turn) order with a range partitioning and joins every turn to the row
    numbered one before it: an equi-join on a unique number, so a conversation
    holding a large share of all turns is spread over many tasks. Without it a
    ``lag`` window per conversation is used (one task per conversation).
    """
    from weft.operators.ordering import global_row_number

    roles = list(human_roles) + list(assistant_roles)
    t = turns.where(F.col("role").isin(roles)).select("conv_id", "turn", "role", "text")
    if skew_safe:
        num = global_row_number(t, ["conv_id", "turn"], "_n")
        prev = num.select((F.col("_n") + 1).alias("_n"), F.col("conv_id").alias("_pconv"),
                          F.col("role").alias("_prole"), F.col("text").alias("_ptext"))
        t = num.join(prev, "_n", "left").withColumn(
            "_prole", F.when(F.col("_pconv") == F.col("conv_id"), F.col("_prole"))).withColumn(
            "_ptext", F.when(F.col("_pconv") == F.col("conv_id"), F.col("_ptext")))
    else:
        w = Window.partitionBy("conv_id").orderBy("turn")
        t = t.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("_prole"),
                     F.lag("text").over(w).alias("_ptext"))
    pairs = t.where(F.col("role").isin(list(assistant_roles)) & F.col("_prole").isin(list(human_roles))
                    & present("_ptext"))
    return pairs.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.col("_ptext").alias("instruction"),
        F.lit("Conversational interaction").alias("context"),
        F.col("text").alias("output"),
        F.lit("conversation").alias("category"),
        F.array(F.lit("conversation")).alias("tags"),
        F.lit("intermediate").alias("difficulty"),
        F.lit("").alias("source_section"),
    )


def generate_items(queries: DataFrame, docs: DataFrame, existing: DataFrame, per_query: int = 5,
                   min_similarity: float = 0.7, min_quality: float = 0.7,
                   filters: dict[str, str] | None = None) -> DataFrame:
    """Items from the collection: each query's hits (at most ``per_query``, similarity at
    least ``min_similarity``) become instruction/output items, pass the quality gate (F12)
    and are de-duplicated against the existing items (G6)."""
    from weft.operators import vectors

    hits = vectors.training_query(queries, docs, k=per_query, min_score=min_similarity, filters=filters)
    items = hits.join(queries.select("query_id", F.col("text").alias("instruction")), "query_id").join(
        docs.select("doc_id", F.col("text").alias("output")), "doc_id").select(
        "query_id", "doc_id", "instruction", F.lit("").alias("context"), "output",
        F.lit("general").alias("category"), F.array().cast("array<string>").alias("tags"),
        F.lit("intermediate").alias("difficulty"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_section"))
    return dedup_against(quality.quality_filter(items, min_quality), existing)
