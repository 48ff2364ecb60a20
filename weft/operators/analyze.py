"""Markdown corpus analysis into training items.

One pass per document: sections are split with a regex, exploded with their
position, categorised by an ordered CASE, and each category builds its item
array with native expressions; one ``posexplode`` turns it into item rows.
No Python worker and no shuffle: the job is a projection of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.rows import select_where
from weft.functions.text import present, strip

# Section patterns (in order) and the keyword fall-backs of categorisation.
SECTION_PATTERNS = [
    ("philosophy", r"(?i)## (?:core )?philosophy|## (?:the )?fundamental|## universal|philosophy"),
    ("methodology", r"(?i)## (?:collaborative )?(?:intelligence )?(?:protocol|methodology|framework)"),
    ("process", r"(?i)## (?:implementation|steps?|workflow|procedure|protocol)"),
    ("examples", r"(?i)## (?:example|practical|implementation|case study)"),
    ("principles", r"(?i)## (?:principle|rule|guideline|standard)"),
    ("conversation", r"(?i)## (?:conversation|dialog|interaction|communication)"),
    ("crisis", r"(?i)## (?:crisis|prevention|emergency|problem)"),
]
KEYWORD_GROUPS = [
    ("philosophy", ["philosophy", "principle", "fundamental"]),
    ("process", ["process", "step", "protocol", "workflow"]),
    ("examples", ["example", "implementation", "practical"]),
    ("methodology", ["methodology", "framework", "approach"]),
]
DEFAULT_CATEGORY = "methodology"
CATEGORY_ORDER = [c for c, _ in SECTION_PATTERNS]

# Texts of generated items.
CORE_EXPLANATION_FALLBACK = ("42 = FOR TWO represents collaborative intelligence where complex problems require "
                             "two perspectives working together.")
PROTOCOL_PREFIX = "The collaborative intelligence protocol follows '42 = FOR TWO' philosophy:\n\n"
PROTOCOL_SUFFIX = ("**Combined Intelligence:** 1 + 1 = 11 - exponentially superior results through strategic "
                   "vision + systematic execution.")
CRISIS_PREFIX = "This is a perfect '42 = FOR TWO' moment! Let's apply the Crisis Prevention Protocol:\n\n"
CRISIS_SUFFIX = "\n\nThe key is never working 'all one' when collaboration would produce better results."
CRISIS_FALLBACK = "Apply the '42 = FOR TWO' principle: seek collaborative approach instead of working in isolation."

HEADER_RE = r"(?d)\n## (.+?)\n"
STEP_RE = r"(?msdU)(?:^|\n)\s*(?:\d+\.|\*|\-)\s*(.+?)(?=\n\s*(?:\d+\.|\*|\-)|$)"
CORE_RE = r"(?isd)42.*?FOR TWO.*?(?=\n\n|\n#|$)"
TRON_RE = r"(?isd)\*\*TRON Contribution.*?(?=\*\*AI Contribution|\n\n|$)"
AI_RE = r"(?isd)\*\*AI Contribution.*?(?=\*\*|$)"
HUMAN_RE = r"(?iU)\*\*Human:\*\*\s*\"([^\"]+)\""
ASSISTANT_RE = r"(?iU)\*\*(?:Assistant|TRON Response):\*\*\s*\"([^\"]+)\""


def split_sections(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per `## ` section with a non-blank body: doc_id, pos, header, content."""
    t = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    d = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t"))
    d = d.select("doc_id", F.split("_t", HEADER_RE).alias("_bodies"),
                 F.regexp_extract_all("_t", F.lit(HEADER_RE), 1).alias("_heads"))
    pairs = F.transform("_heads", lambda h, i: F.struct(strip(h).alias("header"),
                                                        F.try_element_at("_bodies", i + 2).alias("body")))
    s = d.select("doc_id", F.posexplode(pairs).alias("pos", "s"))
    return select_where(s, [F.col("doc_id"), F.col("pos"), F.col("s.header").alias("header"),
                            strip(F.col("s.body")).alias("content")],
                        lambda r: present(r["header"]) & present(r["content"]))


def categorize(header: Column, mode: str = "compat") -> Column:
    """Ordered section patterns, then keyword groups, default methodology.

    ``compat`` matches the patterns on the lower-cased header as the reference
    does (its `## ` prefixed patterns then only fire on headers containing
    `## `); ``intended`` prefixes the header with `## ` first.
    """
    hl = F.lower(header)
    target = hl if mode == "compat" else F.concat(F.lit("## "), hl)
    expr = None
    for cat, pat in SECTION_PATTERNS:
        cond = target.rlike(pat)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    for cat, kws in KEYWORD_GROUPS:
        cond = None
        for kw in kws:
            c = hl.contains(kw)
            cond = c if cond is None else cond | c
        expr = expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(DEFAULT_CATEGORY))


def key_concepts(content: Column) -> Column:
    """Quoted and bold terms, then two anchor phrases; de-duplicated in first-seen order."""
    anchors = F.filter(F.array(
        F.when(content.contains("42 = FOR TWO"), F.lit("42 = FOR TWO")),
        F.when(F.lower(content).contains("collaborative intelligence"), F.lit("collaborative intelligence")),
    ), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.regexp_extract_all(content, F.lit(r'"([^"]+)"'), 1),
                                     F.regexp_extract_all(content, F.lit(r"\*\*([^*]+)\*\*"), 1), anchors))


def concept_context(content: Column, concept: Column) -> Column:
    """Lines around every line mentioning the concept; else around the first line with a
    concept word; else the first paragraph (cut at 500 characters with ``...``)."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    cl = F.lower(concept)
    idx = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.lower(lines[i]).contains(cl))
    around = F.flatten(F.transform(idx, lambda i: F.slice(lines, F.greatest(F.lit(0), i - 2) + 1,
                                                         F.least(n, i + 5) - F.greatest(F.lit(0), i - 2))))
    first = strip(F.array_join(around, "\n"))
    cwords = F.filter(F.split(cl, r"(?U)\s+"), lambda w: w != "")
    hit = F.filter(F.sequence(F.lit(0), n - 1),
                   lambda i: F.exists(cwords, lambda w: F.lower(lines[i]).contains(w)))
    j = F.try_element_at(hit, F.lit(1))
    second = strip(F.array_join(F.slice(lines, F.greatest(F.lit(0), j - 1) + 1,
                                        F.least(n, j + 3) - F.greatest(F.lit(0), j - 1)), "\n"))
    p0 = F.substring_index(content, "\n\n", 1)
    third = F.when(F.length(p0) > 500, F.concat(F.substring(p0, 1, 500), F.lit("..."))).otherwise(p0)
    return F.when(F.size(idx) > 0, first).when(F.size(hit) > 0, second).otherwise(third)


def extract_steps(content: Column) -> Column:
    """Bullet / numbered steps (one line each), stripped, blanks dropped."""
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(STEP_RE), 1), lambda s: strip(s)),
                    lambda s: s != "")


def render_steps(steps: Column, name: Column) -> Column:
    body = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return strip(F.concat(F.lit("Here's the "), name, F.lit(" step by step:\n\n"), body))


def clean_content(c: Column) -> Column:
    """Collapse runs of three or more line breaks, strip, drop HTML comments, strip."""
    x = F.regexp_replace(c, r"(?U)\n\s*\n\s*\n", "\n\n")
    x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    return strip(x)


def squash(c: Column) -> Column:
    """Whitespace runs to one space, stripped (explanation formatting)."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def with_lead_in(c: Column, check: str, lead: str) -> Column:
    """Prefix ``lead + '\\n\\n'`` unless the text already starts with ``check``."""
    return F.when(c.startswith(check), c).otherwise(F.concat(F.lit(lead + "\n\n"), c))


def core_explanation(content: Column) -> Column:
    """The `42 ... FOR TWO ...` passage, whitespace-squashed; fixed sentence when absent."""
    m = F.regexp_extract(content, CORE_RE, 0)
    return F.when(m != "", squash(m)).otherwise(F.lit(CORE_EXPLANATION_FALLBACK))


def collaborative_protocol(content: Column) -> Column:
    tron = strip(F.regexp_extract(content, TRON_RE, 0))
    ai = strip(F.regexp_extract(content, AI_RE, 0))
    return F.concat(F.lit(PROTOCOL_PREFIX),
                    F.when(F.regexp_extract(content, TRON_RE, 0) != "", F.concat(tron, F.lit("\n\n"))).otherwise(""),
                    F.when(F.regexp_extract(content, AI_RE, 0) != "", F.concat(ai, F.lit("\n\n"))).otherwise(""),
                    F.lit(PROTOCOL_SUFFIX))


def crisis_protocol(content: Column) -> Column:
    """The passage from the first stop sign (or ``STOP``) to the next blank line, framed."""
    stop_pos = F.when(F.instr(content, "\U0001F6D1") > 0, F.instr(content, "\U0001F6D1")).otherwise(
        F.instr(content, "STOP"))
    tail = F.substring_index(content.substr(stop_pos, F.length(content) - stop_pos + 1), "\n\n", 1)
    return F.when(stop_pos > 0, F.concat(F.lit(CRISIS_PREFIX), tail, F.lit(CRISIS_SUFFIX))).otherwise(
        F.lit(CRISIS_FALLBACK))


def _item(instruction, context, output, category, tags: list, difficulty, header) -> Column:
    return F.struct(
        instruction.alias("instruction"),
        F.lit(context).alias("context") if isinstance(context, str) else context.alias("context"),
        output.alias("output"),
        F.lit(category).alias("category") if isinstance(category, str) else category.alias("category"),
        F.array(*[F.lit(t) if isinstance(t, str) else t for t in tags]).alias("tags"),
        F.lit(difficulty).alias("difficulty"),
        header.alias("source_section"),
    )


def _opt(cond: Column, item: Column) -> Column:
    return F.filter(F.array(F.when(cond, item)), lambda x: x.isNotNull())


def _no_prefix(header: Column) -> Column:
    return strip(F.replace(header, F.lit("## "), F.lit("")))


def section_items(sections: DataFrame, mode: str = "compat") -> DataFrame:
    """The item array of every section by its category, exploded (single scan)."""
    h, c = F.col("header"), F.col("content")
    s = sections.withColumn("section_category", categorize(h, mode))
    cat = F.col("section_category")
    # text the item builders read more than once is computed once per section, and only for
    # the categories that use it
    s = s.withColumn("_steps", F.when(cat == "process", extract_steps(c))).withColumn(
        "_clean", F.when(cat != "process", clean_content(c)))

    # philosophy (E5)
    concepts = key_concepts(c)
    phil = F.filter(F.transform(concepts, lambda k: _item(
        F.concat(F.lit("Explain the philosophy behind "), k), "User needs to understand the foundational philosophy",
        concept_context(c, k), "philosophy",
        ["philosophy", "42", "collaboration", F.replace(F.lower(k), F.lit(" "), F.lit("-"))], "foundational", h)),
        lambda it: present(it["output"]))
    core = _opt(c.contains("42") & c.contains("FOR TWO"), _item(
        F.lit("What does '42 = FOR TWO' mean in practice?"), "User learning collaborative intelligence methodology",
        core_explanation(c), "core_principle", ["42", "collaboration", "methodology", "core-principle"],
        "foundational", h))
    # methodology
    proto = _opt(c.contains("TRON Contribution") & c.contains("AI Contribution"), _item(
        F.lit("Explain the collaborative intelligence protocol"), "User needs systematic methodology guidance",
        collaborative_protocol(c), "methodology", ["collaboration", "protocol", "systematic-approach"],
        "intermediate", h))
    impl = _opt(F.lower(h).contains("framework") | F.lower(h).contains("protocol"), _item(
        F.concat(F.lit("How do I implement the "), F.lower(h), F.lit("?")), "User needs implementation guidance",
        with_lead_in(F.col("_clean"), "To implement", "To implement this methodology:"), "implementation",
        ["methodology", "framework", "implementation"], "intermediate", h))
    # process (E7, E8)
    steps = F.col("_steps")
    pname = _no_prefix(h)
    step_item = _opt(F.size(steps) > 0, _item(
        F.concat(F.lit("Walk me through the "), pname, F.lit(" step by step")), "User needs systematic process guidance",
        render_steps(steps, pname), "process", ["process", "systematic", "steps"], "intermediate", h))
    crisis = _opt(F.lower(h).contains("crisis") | F.lower(h).contains("prevention"), _item(
        F.lit("What should I do when I'm overwhelmed by a complex problem?"),
        "User facing complex problem and feeling panicked", crisis_protocol(c), "crisis_management",
        ["42", "crisis-prevention", "collaboration", "systematic-approach"], "intermediate", h))
    # examples (E9)
    example = F.array(_item(
        F.concat(F.lit("Provide an example of "), F.lower(pname)), "User needs concrete implementation example",
        with_lead_in(F.col("_clean"), "Here's a practical example", "Here's a practical example:"), "example",
        ["example", "practical", "implementation"], "intermediate", h))
    # conversation
    hum = F.regexp_extract_all(c, F.lit(HUMAN_RE), 1)
    asst = F.regexp_extract_all(c, F.lit(ASSISTANT_RE), 1)
    conv = F.transform(F.slice(F.arrays_zip(hum.alias("q"), asst.alias("a")), 1, F.least(F.size(hum), F.size(asst))),
                       lambda z: _item(z["q"], "User interaction following collaborative methodology", z["a"],
                                       "conversation", ["conversation", "interaction", "collaborative"],
                                       "intermediate", h))
    # any other category
    general = F.array(_item(
        F.concat(F.lit("Tell me about "), F.lower(pname)), F.concat(F.lit("User learning about "), cat),
        F.col("_clean"), cat, [cat, "methodology"], "intermediate", h))

    items = (F.when(cat == "philosophy", F.concat(phil, core))
             .when(cat == "methodology", F.concat(proto, impl))
             .when(cat == "process", F.concat(step_item, crisis))
             .when(cat == "examples", example)
             .when(cat == "conversation", conv)
             .otherwise(general))
    out = s.select("doc_id", "pos", "section_category", F.posexplode(items).alias("sub", "it"))
    order = F.array_position(F.array(*[F.lit(x) for x in CATEGORY_ORDER]), F.col("section_category"))
    return out.select("doc_id", order.cast("int").alias("category_order"), "pos", "sub", "it.*")


def analyze_corpus(docs: DataFrame, mode: str = "compat", text_col: str = "text") -> DataFrame:
    """Corpus -> training items (ITEM schema plus doc/section coordinates)."""
    return section_items(split_sections(docs, text_col), mode)


# The pattern kinds of the collection summary and the section categories they take.
PATTERN_KINDS = {
    "philosophy": ["philosophy", "principles"],
    "process": ["process", "crisis"],
    "communication": ["conversation"],
    "implementation": ["methodology", "examples"],
}


def pattern_summary(sections: DataFrame, top: int = 5, mode: str = "compat") -> DataFrame:
    """Per pattern kind the most frequent section headers (count, then header).

    Counting is a partial aggregate over (kind, header); the ranking window
    runs over that small result with a literal limit.
    """
    from pyspark.sql.window import Window

    kind_of = F.create_map(*[x for k, cats in PATTERN_KINDS.items() for c in cats for x in (F.lit(c), F.lit(k))])
    s = sections.select(F.try_element_at(kind_of, categorize(F.col("header"), mode)).alias("kind"), "header")
    counts = s.where(F.col("kind").isNotNull()).groupBy("kind", "header").agg(F.count(F.lit(1)).alias("sections"))
    w = Window.partitionBy("kind").orderBy(F.col("sections").desc(), F.col("header").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
