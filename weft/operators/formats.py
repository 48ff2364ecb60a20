"""Format conversion between the items table and exchange layouts.

Every conversion is a projection (struct / array building or picking) over
the items table; JSON text is produced with ``to_json`` and parsed with
``from_json`` against a declared schema, so nothing is inferred per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.text import present, present_arr, strip

# System messages of the OpenAI layout by category, and the default.
OPENAI_SYSTEM = {
    "philosophy": "You are a collaborative intelligence assistant who understands systematic methodologies.",
    "methodology": "You are a systematic methodology expert who provides structured guidance.",
    "process": "You are a process guidance specialist who helps with systematic procedures.",
    "crisis_management": "You are a crisis prevention assistant using collaborative approaches.",
    "conversation": "You are a collaborative intelligence assistant with systematic communication style.",
    "example": "You are a practical implementation guide providing concrete examples.",
    "implementation": "You are an implementation specialist for systematic methodologies.",
}
OPENAI_DEFAULT = "You are a helpful assistant trained in systematic methodologies."
SUPPORTED = ("alpaca", "sharegpt", "openai", "huggingface", "csv", "generic")

ITEM_FIELDS = ["instruction", "context", "output", "category", "tags", "difficulty", "source_section"]
MSG = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
ROLE_MSG = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
ALPACA_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()), T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("difficulty", T.StringType()),
    T.StructField("source_section", T.StringType()),
])
SHAREGPT_SCHEMA = T.StructType([
    T.StructField("conversations", T.ArrayType(MSG)),
    T.StructField("metadata", T.StructType([
        T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.StringType()), T.StructField("source_section", T.StringType())])),
])
OPENAI_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(ROLE_MSG)),
    T.StructField("metadata", T.StructType([
        T.StructField("category", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.StringType())])),
])
GENERIC_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()), T.StructField("context", T.StringType()),
    T.StructField("output", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("difficulty", T.StringType()),
    T.StructField("source_section", T.StringType()),
])


def _empty_tags() -> Column:
    return F.array().cast("array<string>")


def to_alpaca(items: DataFrame, keep=("item_id",)) -> DataFrame:
    """Instruction / input / output; category, tags, difficulty only when truthy (NULL otherwise)."""
    return items.select(
        *[c for c in keep if c in items.columns],
        F.struct(
            F.col("instruction").alias("instruction"),
            F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("")).alias("input"),
            F.col("output").alias("output"),
            F.when(present("category"), F.col("category")).alias("category"),
            F.when(present_arr("tags"), F.col("tags")).alias("tags"),
            F.when(present("difficulty"), F.col("difficulty")).alias("difficulty"),
        ).alias("alpaca"))


def from_alpaca(df: DataFrame, col: str = "alpaca", keep=("item_id",)) -> DataFrame:
    """Items from Alpaca records, defaults for absent keys."""
    a = F.col(col)
    return df.select(
        *[c for c in keep if c in df.columns],
        F.coalesce(a["instruction"], F.lit("")).alias("instruction"),
        F.coalesce(a["input"], F.lit("")).alias("context"),
        F.coalesce(a["output"], F.lit("")).alias("output"),
        F.coalesce(a["category"], F.lit("general")).alias("category"),
        F.coalesce(a["tags"], _empty_tags()).alias("tags"),
        F.coalesce(a["difficulty"], F.lit("intermediate")).alias("difficulty"),
        F.coalesce(a["source_section"], F.lit("")).alias("source_section"),
    )


def to_sharegpt(items: DataFrame, keep=("item_id",)) -> DataFrame:
    """Optional system turn (context), human, gpt; metadata struct."""
    def msg(frm: str, val: Column) -> Column:
        return F.struct(F.lit(frm).alias("from"), val.alias("value"))

    conv = F.filter(F.array(F.when(present("context"), msg("system", F.col("context"))),
                            msg("human", F.col("instruction")), msg("gpt", F.col("output"))),
                    lambda x: x.isNotNull())
    return items.select(*[c for c in keep if c in items.columns], F.struct(
        conv.alias("conversations"),
        F.struct("category", "tags", "difficulty", "source_section").alias("metadata")).alias("sharegpt"))


def _last_of(arr: Column, key: str, val: str, roles: list[str]) -> Column:
    picked = F.filter(arr, lambda m: m[key].isin(roles))
    return F.try_element_at(picked, F.lit(-1))[val]


def from_sharegpt(df: DataFrame, col: str = "sharegpt", keep=("item_id",), assistant_roles=("gpt", "assistant")) -> DataFrame:
    """I4: the last system / human / assistant turn wins; both instruction and output required."""
    conv = F.coalesce(F.col(col)["conversations"], F.array().cast(T.ArrayType(MSG)))
    meta = F.col(col)["metadata"]
    out = df.select(
        *[c for c in keep if c in df.columns],
        F.coalesce(_last_of(conv, "from", "value", ["human"]), F.lit("")).alias("instruction"),
        F.coalesce(_last_of(conv, "from", "value", ["system"]), F.lit("")).alias("context"),
        F.coalesce(_last_of(conv, "from", "value", list(assistant_roles)), F.lit("")).alias("output"),
        F.coalesce(meta["category"], F.lit("conversation")).alias("category"),
        F.coalesce(meta["tags"], _empty_tags()).alias("tags"),
        F.coalesce(meta["difficulty"], F.lit("intermediate")).alias("difficulty"),
        F.coalesce(meta["source_section"], F.lit("")).alias("source_section"),
    )
    return out.where(present("instruction") & present("output"))


def openai_system(category: Column) -> Column:
    m = F.create_map(*[x for k, v in OPENAI_SYSTEM.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.coalesce(category, F.lit(""))), F.lit(OPENAI_DEFAULT))


def to_openai(items: DataFrame, keep=("item_id",)) -> DataFrame:
    """System message by category, user, assistant; context is not exported (lossy, D-13)."""
    def msg(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return items.select(*[c for c in keep if c in items.columns], F.struct(
        F.array(msg("system", openai_system(F.col("category"))), msg("user", F.col("instruction")),
                msg("assistant", F.col("output"))).alias("messages"),
        F.struct("category", "tags", "difficulty").alias("metadata")).alias("openai"))


def from_openai(df: DataFrame, col: str = "openai", keep=("item_id",)) -> DataFrame:
    """Last message of each role; the system text becomes the context."""
    msgs = F.coalesce(F.col(col)["messages"], F.array().cast(T.ArrayType(ROLE_MSG)))
    meta = F.col(col)["metadata"]
    out = df.select(
        *[c for c in keep if c in df.columns],
        F.coalesce(_last_of(msgs, "role", "content", ["user"]), F.lit("")).alias("instruction"),
        F.coalesce(_last_of(msgs, "role", "content", ["system"]), F.lit("")).alias("context"),
        F.coalesce(_last_of(msgs, "role", "content", ["assistant"]), F.lit("")).alias("output"),
        F.coalesce(meta["category"], F.lit("general")).alias("category"),
        F.coalesce(meta["tags"], _empty_tags()).alias("tags"),
        F.coalesce(meta["difficulty"], F.lit("intermediate")).alias("difficulty"),
        F.lit("").alias("source_section"),
    )
    return out.where(present("instruction") & present("output"))


def to_columnar(items: DataFrame) -> DataFrame:
    """The column-per-field layout is the table itself (written as parquet);
    context and source_section default to ''."""
    return items.select(
        "instruction", F.coalesce("context", F.lit("")).alias("context"), "output", "category", "tags",
        "difficulty", F.coalesce("source_section", F.lit("")).alias("source_section"))


def from_columnar(df: DataFrame, carry=()) -> DataFrame:
    """I8: rows from records of per-field lists (missing lists take defaults).

    ``carry`` names further list columns (e.g. ids) picked at the same position.
    """
    n = F.size(F.col("instruction"))
    idx = F.sequence(F.lit(0), n - 1)

    def field(name, default):
        if name in df.columns:
            return F.coalesce(F.try_element_at(F.col(name), F.col("_i") + 1), default)
        return default

    x = df.select("*", F.explode(idx).alias("_i"))
    return x.select(
        F.col("_i").cast("long").alias("position"),
        *[F.try_element_at(F.col(c), F.col("_i") + 1).alias(c) for c in carry],
        field("instruction", F.lit("")).alias("instruction"),
        field("context", F.lit("")).alias("context"),
        field("output", F.lit("")).alias("output"),
        field("category", F.lit("general")).alias("category"),
        field("tags", _empty_tags()).alias("tags"),
        field("difficulty", F.lit("intermediate")).alias("difficulty"),
        field("source_section", F.lit("")).alias("source_section"),
    )


def to_flat(items: DataFrame, keep=("item_id",)) -> DataFrame:
    """Seven string columns, tags joined by ','."""
    return items.select(
        *[c for c in keep if c in items.columns],
        "instruction", F.coalesce("context", F.lit("")).alias("context"), "output", "category",
        F.when(present_arr("tags"), F.array_join("tags", ",")).otherwise(F.lit("")).alias("tags"),
        "difficulty", F.coalesce("source_section", F.lit("")).alias("source_section"))


def from_flat(df: DataFrame, keep=("item_id",)) -> DataFrame:
    """Tags split on ',', trimmed, blanks dropped; defaults for missing values."""
    tags = F.when(present("tags"), F.filter(F.transform(F.split(F.col("tags"), ","), lambda t: strip(t)),
                                            lambda t: t != "")).otherwise(_empty_tags())
    return df.select(
        *[c for c in keep if c in df.columns],
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("output", F.lit("")).alias("output"),
        F.coalesce("category", F.lit("general")).alias("category"),
        tags.alias("tags"),
        F.coalesce("difficulty", F.lit("intermediate")).alias("difficulty"),
        F.coalesce("source_section", F.lit("")).alias("source_section"),
    )


def from_generic(df: DataFrame, keep=("item_id",)) -> DataFrame:
    """Every field defaulted over the declared item schema."""
    def c(name, default):
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.select(*[k for k in keep if k in df.columns],
                     c("instruction", F.lit("")).alias("instruction"), c("context", F.lit("")).alias("context"),
                     c("output", F.lit("")).alias("output"), c("category", F.lit("general")).alias("category"),
                     c("tags", _empty_tags()).alias("tags"), c("difficulty", F.lit("intermediate")).alias("difficulty"),
                     c("source_section", F.lit("")).alias("source_section"))


def conforms(json_col: Column, layout: str) -> Column:
    """Does one JSON record fit the layout (unknown layouts always do)."""
    keys = F.json_object_keys(json_col)
    if layout == "alpaca":
        return F.coalesce(F.array_contains(keys, "instruction") & F.array_contains(keys, "output"), F.lit(False))
    if layout == "sharegpt":
        return F.coalesce(F.json_array_length(F.get_json_object(json_col, "$.conversations")).isNotNull()
                          & F.array_contains(keys, "conversations"), F.lit(False))
    if layout == "openai":
        return F.coalesce(F.json_array_length(F.get_json_object(json_col, "$.messages")).isNotNull()
                          & F.array_contains(keys, "messages"), F.lit(False))
    return F.lit(True)


def conforms_all(df: DataFrame, json_col: str, layout: str) -> DataFrame:
    """I12 dataset form: every record conforms (``bool_and``)."""
    return df.agg(F.coalesce(F.bool_and(conforms(F.col(json_col), layout)), F.lit(True)).alias("valid"))


def convert_items(items: DataFrame, to: str) -> DataFrame:
    """Family dispatch used by export (A10)."""
    if to == "alpaca":
        return to_alpaca(items).select("alpaca.*")
    if to == "sharegpt":
        return to_sharegpt(items).select("sharegpt.*")
    if to == "openai":
        return to_openai(items).select("openai.*")
    if to == "huggingface":
        return to_columnar(items)
    if to == "csv":
        return to_flat(items, keep=())
    if to == "generic":
        return items.select(*[c for c in ITEM_FIELDS if c in items.columns])
    raise ValueError(f"Unsupported format: {to}. Supported formats: {list(SUPPORTED)}")
