"""Prompt rendering of training items.

Rendering, truncation and statistics are native expressions over the items
table: a per-row projection plus a filter, so the job scales with the number
of partitions and never leaves the JVM.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.rows import select_where
from weft.functions.text import present, present_arr, rfind, strip, words

# Special tokens, system prompts per category, and the default prompt.
SYSTEM_TOKEN = "<|system|>"
USER_TOKEN = "<|user|>"
ASSISTANT_TOKEN = "<|assistant|>"
END_TOKEN = "<|end|>"
MIN_TRAINING_LENGTH = 50
DEFAULT_MAX_LENGTH = 2048
CATEGORY_PROMPTS = {
    "philosophy": "You are a collaborative intelligence assistant who understands the '42 = FOR TWO' philosophy. You provide guidance on systematic methodologies and collaborative approaches to complex problems.",
    "methodology": "You are a systematic methodology expert who helps implement collaborative intelligence protocols. You provide clear, structured guidance based on proven systematic approaches.",
    "process": "You are a process guidance specialist who helps users apply systematic procedures and crisis prevention protocols. You emphasize collaborative approaches and structured problem-solving.",
    "crisis_management": "You are a crisis prevention and management assistant. You help users apply the '42 = FOR TWO' collaborative approach when facing overwhelming problems or complex decisions.",
    "conversation": "You are a collaborative intelligence assistant who communicates using the systematic yet enthusiastic style of the '42 = FOR TWO' methodology. You provide guidance while maintaining the collaborative spirit.",
    "example": "You are a practical implementation guide who provides concrete examples of systematic methodologies and collaborative intelligence principles in action.",
    "core_principle": "You are a foundational philosophy guide who explains core principles of collaborative intelligence and the '42 = FOR TWO' methodology with clarity and practical application.",
    "implementation": "You are an implementation specialist who helps translate methodologies and principles into practical, actionable steps using systematic approaches.",
}
DEFAULT_PROMPT = "You are a helpful coding assistant trained in systematic methodologies and collaborative intelligence. You provide clear, structured guidance following the '42 = FOR TWO' principle."
ALPACA_HEAD = "Below is an instruction that describes a task"
ALPACA_INPUT_DESC = ", paired with an input that provides further context"
ALPACA_TAIL = ". Write a response that appropriately completes the request."
CUSTOM_TEMPLATE = """System: {system}

Category: {category}
Tags: {tags}
Difficulty: {difficulty}

Instruction: {instruction}
Context: {context}

Response: {output}"""
FORMATS = ("chatml", "alpaca", "vicuna", "codellama", "custom")


def _lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def system_prompt(include: bool = True) -> Column:
    """H1: category prompt (default otherwise) plus `` Context: ...`` when context is present."""
    if not include:
        return F.lit("")
    base = F.when(F.col("category").isNull(), F.lit(DEFAULT_PROMPT)).otherwise(
        _lookup(CATEGORY_PROMPTS, F.col("category"), DEFAULT_PROMPT))
    return F.when(present("context"), F.concat(base, F.lit(" Context: "), F.col("context"))).otherwise(base)


def _when_present(c: Column, value: Column) -> Column:
    return F.when(present(c), value)


def render_text(fmt: str = "chatml", include_system: bool = True, template: str | None = None) -> Column:
    """H2-H6: the training text of one item in the given layout."""
    sp = system_prompt(include_system)
    ins, out, ctx = F.col("instruction"), F.col("output"), F.col("context")
    if fmt == "chatml":
        return F.concat_ws("\n",
                           _when_present(sp, F.concat(F.lit(SYSTEM_TOKEN + "\n"), sp, F.lit(END_TOKEN))),
                           F.concat(F.lit(USER_TOKEN + "\n"), ins, F.lit(END_TOKEN)),
                           F.concat(F.lit(ASSISTANT_TOKEN + "\n"), out, F.lit(END_TOKEN)))
    if fmt == "alpaca":
        inp = (F.when(present(sp) & present(ctx), F.concat(F.lit("System: "), sp, F.lit("\n\nContext: "), ctx))
               .when(present(sp), F.concat(F.lit("System: "), sp))
               .otherwise(F.coalesce(ctx, F.lit(""))))
        return F.concat(F.lit(ALPACA_HEAD), F.when(present(inp), F.lit(ALPACA_INPUT_DESC)).otherwise(F.lit("")),
                        F.lit(ALPACA_TAIL + "\n\n### Instruction:\n"), ins, F.lit("\n"),
                        F.when(present(inp), F.concat(F.lit("\n### Input:\n"), inp, F.lit("\n"))).otherwise(F.lit("")),
                        F.lit("\n### Response:\n"), out)
    if fmt == "vicuna":
        return F.concat_ws("\n\n", _when_present(sp, F.concat(F.lit("SYSTEM: "), sp)),
                           F.concat(F.lit("USER: "), ins), F.concat(F.lit("ASSISTANT: "), out))
    if fmt == "codellama":
        return F.concat_ws(
            "\n",
            _when_present(sp, F.concat(F.lit("# System\n"), sp, F.lit("\n"))),
            _when_present(F.col("category"), F.concat(F.lit("# Category: "), F.col("category"))),
            F.when(present_arr("tags"), F.concat(F.lit("# Tags: "), F.array_join("tags", ", "))),
            _when_present(F.col("difficulty"), F.concat(F.lit("# Difficulty: "), F.col("difficulty"))),
            F.concat(F.lit("\n# Instruction\n"), ins, F.lit("\n")),
            _when_present(ctx, F.concat(F.lit("# Context\n"), ctx, F.lit("\n"))),
            F.concat(F.lit("# Response\n"), out),
        )
    if fmt == "custom":
        return format_template(template or CUSTOM_TEMPLATE, sp)
    raise ValueError(f"Unsupported format: {fmt}")


def format_template(template: str, sp: Column) -> Column:
    """H6: a ``str.format`` template with named slots as one ``concat`` of literals and columns."""
    slots = {
        "system": sp,
        "instruction": F.col("instruction"),
        "context": F.coalesce(F.col("context"), F.lit("")),
        "output": F.col("output"),
        "category": F.coalesce(F.col("category"), F.lit("")),
        "tags": F.when(present_arr("tags"), F.array_join("tags", ", ")).otherwise(F.lit("")),
        "difficulty": F.coalesce(F.col("difficulty"), F.lit("")),
    }
    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise KeyError(field)
            parts.append(slots[field])
    return F.concat(*parts) if parts else F.lit("")


def truncate_smart(text: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """H8: cut at the last sentence / paragraph / line break before ``max - 100`` when it lies
    past ``max / 2``; otherwise the words of the first ``max`` characters minus the last one."""
    limit = max_length - 100
    out = None
    for bp in [". ", "\n\n", "\n", ". "]:
        pos = rfind(text, bp, limit)
        cut = strip(F.substring(text, F.lit(1), pos + len(bp)))
        cond = pos > (max_length // 2)
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    ws = words(F.substring(text, 1, max_length))
    fallback = F.array_join(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), " ")
    return F.when(F.length(text) <= max_length, text).otherwise(out.otherwise(fallback))


def fit_length(text: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """H7: NULL when too short (stripped < 50), truncated when longer than ``max_length``."""
    t = F.when(F.length(text) > max_length, truncate_smart(text, max_length)).otherwise(text)
    return F.when(present(text) & (F.length(strip(text)) >= MIN_TRAINING_LENGTH)
                  & (F.length(strip(t)) >= MIN_TRAINING_LENGTH), t)


def render_corpus(items: DataFrame, fmt: str = "chatml", max_length: int = DEFAULT_MAX_LENGTH,
                  include_system: bool = True, template: str | None = None) -> DataFrame:
    """H9: rendered training texts with metadata; items lacking instruction or output dropped."""
    base = items.where(present("instruction") & present("output"))
    keep = [c for c in ("item_id",) if c in items.columns]
    raw = base.select(*keep, "category", "difficulty", "tags", "source_section",
                      (F.length("instruction") + F.length("output")).alias("original_length"),
                      render_text(fmt, include_system, template).alias("_raw"))
    cut = raw.withColumn("_cut", F.when(F.length("_raw") > max_length, truncate_smart(F.col("_raw"), max_length))
                         .otherwise(F.col("_raw")))
    ok = (present("_raw") & (F.length(strip(F.col("_raw"))) >= MIN_TRAINING_LENGTH)).alias("_ok")
    r = select_where(cut, [*[F.col(c) for c in keep], F.col("category"), F.col("difficulty"), F.col("tags"),
                           F.col("source_section"), F.col("original_length"), F.col("_cut").alias("text"), ok],
                     lambda x: x["_ok"] & (F.length(strip(x["text"])) >= MIN_TRAINING_LENGTH))
    return r.select(
        *keep,
        "text",
        F.struct(
            F.col("category"), F.col("difficulty"), F.col("tags"), F.col("source_section"),
            F.col("original_length"),
            F.length("text").alias("processed_length"),
            F.lit(fmt).alias("format"),
        ).alias("metadata"),
    )


def rendered_stats(rendered: DataFrame) -> DataFrame:
    """Length range, mean and upper median, distributions and the mean length ratio."""
    m = F.col("metadata")
    ratio = F.when(m["original_length"] > 0, m["processed_length"] / m["original_length"])
    # the texts are rendered once: all figures come from the counts per length, category and difficulty
    counts = rendered.groupBy(F.length("text").alias("len"), *[F.coalesce(m[c], F.lit("unknown")).alias(c) for c in ("category", "difficulty")]).agg(
        F.count(F.lit(1)).alias("count"), F.first(m["format"]).alias("format"), F.sum(ratio).alias("ratios"), F.count(ratio).alias("n_ratios")).checkpoint()
    hist = counts.groupBy("len").agg(F.sum("count").alias("count"))
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select("len", "count", F.sum("count").over(w).alias("cum"),
                      F.sum("count").over(Window.partitionBy()).alias("tot"))
    med = cum.where((F.col("cum") - F.col("count") <= F.floor(F.col("tot") / 2))
                    & (F.col("cum") > F.floor(F.col("tot") / 2))).agg(F.max("len").alias("text_length_median"))
    base = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_items"),
        F.first("format").alias("format"),
        F.min("len").alias("text_length_min"),
        F.max("len").alias("text_length_max"),
        (F.sum(F.col("len") * F.col("count")) / F.sum("count")).alias("text_length_avg"),
        F.coalesce(F.sum("ratios") / F.when(F.sum("n_ratios") > 0, F.sum("n_ratios")), F.lit(1.0)).alias("avg_compression_ratio"),
    )

    def dist(field):
        g = counts.groupBy(F.col(field).alias("k")).agg(F.sum("count").alias("count"))
        return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "count"))),
                                              lambda x: F.concat(x["k"], F.lit("="), x["count"].cast("string"))),
                                  ";").alias(f"{field}_distribution"))

    from weft.operators.quality import _one_row_join

    return _one_row_join(base, med, dist("category"), dist("difficulty"))


def write_rendered(rendered: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """jsonl/json as JSON lines of {text, metadata}; txt with numbered separators.

    The txt numbering follows the item order: a range-partitioned sort on
    ``item_id`` then a per-row number from partition offsets (no single-task
    window).
    """
    if fmt in ("jsonl", "json"):
        rendered.select("text", "metadata").write.mode("overwrite").json(path)
        return
    if fmt != "txt":
        raise ValueError(f"Unsupported format: {fmt}")
    from weft.operators.ordering import global_row_number

    numbered = global_row_number(rendered, "item_id", "n")
    block = F.concat(F.lit("=== Training Example "), F.col("n").cast("string"), F.lit(" ===\n"), F.col("text"),
                     F.lit("\n\n" + "=" * 50 + "\n\n"))
    numbered.sortWithinPartitions("n").select(block.alias("value")).write.mode("overwrite").text(path)
