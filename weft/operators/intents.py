"""Operators sketched in the reference's design notes (L1-L4).

Document classes and query intents are indicator-substring counts in native
expressions; routed retrieval is the filtered kNN kernel with the class as a
per-query filter; principle items expand each principle by a fixed set of
three templates with ``explode`` (no join).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import patterns
from weft.operators import vectors as VX

# Indicator substrings per document class (matched on lower-cased text).
CODE_INDICATORS = ["def ", "class ", "import ", "function", "method", "API", "endpoint", "database", "schema",
                   "migration", "test_", "spec", "config", "setup", "deploy"]
RUNTIME_INDICATORS = ["error", "exception", "debug", "log", "trace", "performance", "optimization", "memory", "cpu",
                      "deployment", "production", "staging"]
GENERAL_INDICATORS = ["concept", "theory", "algorithm", "pattern", "best practice", "tutorial", "guide",
                      "documentation"]
# Query-intent words, tested in this order.
INTENT_WORDS = [
    ("code_generation", ["write", "create", "implement", "code"]),
    ("debugging", ["debug", "fix", "error", "issue"]),
    ("architecture", ["design", "architecture", "structure"]),
]
INTENT_TO_CLASS = {"code_generation": "code", "debugging": "runtime", "architecture": "general"}
# The three principle templates (input, output, context).
PRINCIPLE_TEMPLATES = [
    ("How do I apply {p}?",
     "To apply {p}, follow these steps: 1) [methodology], 2) [constraints], 3) [best practices]. Here's why this matters: [reasoning].",
     "principle_application"),
    ("What violates {p}?",
     "These patterns violate {p}: [anti-patterns]. Instead, follow [correct patterns] because [reasoning].",
     "violation_detection"),
    ("Show me {p} in practice",
     "Here's how to implement {p}: [step-by-step methodology] with [code examples] that demonstrate [best practices].",
     "implementation_guidance"),
]


def _score(lower_text: Column, indicators: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(lower_text.contains(i), 1).otherwise(0) for i in indicators])


def document_class(text: Column) -> Column:
    """L1: code / runtime / general by indicator counts (ties as coded)."""
    lt = F.lower(F.coalesce(text, F.lit("")))
    code, runtime, general = _score(lt, CODE_INDICATORS), _score(lt, RUNTIME_INDICATORS), _score(lt, GENERAL_INDICATORS)
    return F.when(code > F.greatest(runtime, general), "code").when(runtime > general, "runtime").otherwise("general")


def classify_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("doc_class", document_class(F.col(text_col)))


def classify_by_automaton(docs: DataFrame, text_col: str = "text", classes: dict[str, list[str]] | None = None) -> DataFrame:
    """L1 for long rule lists: one automaton over the indicators of all classes. The class with most
    indicators in the text wins, the first of the listed ones where they tie."""
    classes = classes or {"general": GENERAL_INDICATORS, "runtime": RUNTIME_INDICATORS, "code": CODE_INDICATORS}
    listed = [(name, p) for name, ps in classes.items() for p in dict.fromkeys(ps)]
    groups = {name: [i for i, (n, _) in enumerate(listed) if n == name] for name in classes}
    low = docs.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    hits = patterns.with_found(low, "_low", [p for _, p in listed], "_found")
    scored = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
                       for i, (name, n) in enumerate(patterns.counts(F.col("_found"), groups).items())])
    return hits.withColumn("doc_class", F.array_max(scored)["name"]).drop("_low", "_found")


def query_intent(text: Column) -> Column:
    """L2: first intent whose words occur in the lower-cased query; else general."""
    lt = F.lower(F.coalesce(text, F.lit("")))
    expr = None
    for intent, ws in INTENT_WORDS:
        cond = reduce(lambda a, b: a | b, [lt.contains(w) for w in ws])
        expr = F.when(cond, intent) if expr is None else expr.when(cond, intent)
    return expr.otherwise("general")


def routed_knn(queries: DataFrame, docs: DataFrame, k: int = 4) -> DataFrame:
    """L3: kNN restricted to the document class the query intent asks for (general: any)."""
    m = F.create_map(*[x for a, b in INTENT_TO_CLASS.items() for x in (F.lit(a), F.lit(b))])
    q = queries.withColumn("intent", query_intent(F.col("text"))).withColumn("route_class", F.try_element_at(m, F.col("intent")))
    d = classify_documents(docs)
    routed = VX.knn(q.where(F.col("route_class").isNotNull()), d, k=k, filters={"route_class": "doc_class"})
    free = VX.knn(q.where(F.col("route_class").isNull()), d, k=k)
    return routed.unionByName(free)


def principle_items(principles: DataFrame, col: str = "principle") -> DataFrame:
    """L4: three training items per principle."""
    p = F.col(col)
    structs = []
    for i, (inp, out, ctx) in enumerate(PRINCIPLE_TEMPLATES):
        a, b = inp.split("{p}"), out.split("{p}")
        structs.append(F.struct(
            F.lit(i).alias("template"),
            F.concat(F.lit(a[0]), p, F.lit(a[1])).alias("input"),
            F.concat(*[x for part in b[:-1] for x in (F.lit(part), p)], F.lit(b[-1])).alias("output"),
            p.alias("principle"), F.lit(ctx).alias("context")))
    return principles.select(F.explode(F.array(*structs)).alias("it")).select("it.*")
