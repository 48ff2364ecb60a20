"""Web pages to documents (J1-J7), on stored pages (url, html).

Content comes from a page's tokens: a fold over its tags finds where the first
container ends, whatever is nested or left open inside; its text is what the
tokens between show. Titles, links and snippets are regular-expression projections whose
patterns are valid for Java and RE2, so the SQL oracle runs them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.rows import select_where
from weft.functions.text import present

MAX_CONTENT_CHARS = 10000
BLOCK_TAGS = "div|section|main|article|aside|span"
# The content containers in the order they are tried.
CONTAINER_SELECTORS = ["article", "main", ".content", "#content", ".main", "#main", ".article-content",
                       "#article-content", ".post-content"]
# Named entities decoded in page text (&amp; last).
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
CONSENT_REQUIRED = "Explicit consent is required for web scraping under EU regulations"

STRIP_BLOCKS = [r"(?is)<script\b[^>]*>.*?(?:</script>|\z)", r"(?is)<style\b[^>]*>.*?(?:</style>|\z)", r"(?s)<!--.*?(?:-->|\z)"]
BREAK_TAGS = (r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|section|article|header|footer|nav|main|aside"
              r"|blockquote|pre|hr|title)\b[^>]*>")
ANY_TAG = r"<[^>]*>"


def container_pattern(selector: str) -> str:
    """Regex (Java and RE2) for the first element matching a simple CSS selector."""
    if selector[0] not in ".#":
        return rf"(?is)<{selector}\b[^>]*>(.*?)</{selector}>"
    attr = "class" if selector[0] == "." else "id"
    name = selector[1:]
    if attr == "class":
        val = rf"\"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?\""
    else:
        val = rf"\"{name}\""
    return rf"(?is)<(?:{BLOCK_TAGS})\b[^>]*\b{attr}\s*=\s*{val}[^>]*>(.*?)</(?:{BLOCK_TAGS})>"


BODY_PATTERN = r"(?is)<body\b[^>]*>(.*)</body>"


def html_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment, whitespace squashed."""
    x = fragment
    for p in STRIP_BLOCKS:
        x = F.regexp_replace(x, p, " ")
    x = F.regexp_replace(x, BREAK_TAGS, " ")
    x = F.regexp_replace(x, ANY_TAG, "")
    for ent, ch in ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return normalize_content(x, None)


def normalize_content(c: Column, limit: int | None = MAX_CONTENT_CHARS) -> Column:
    """Squash whitespace runs to one space, strip, cut at ``limit`` characters."""
    x = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.substring(x, 1, limit) if limit else x


def _clean_html(html: Column) -> Column:
    x = html
    for p in STRIP_BLOCKS:
        x = F.regexp_replace(x, p, " ")
    return x


# One token after the other covers the page: comments, scripts and styles with their content, tags (a
# ``>`` in a quoted attribute does not end one), declarations, text, and a stray ``<``.
_INSIDE_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
TOKEN = (r"(?is)<!--.*?(?:-->|\z)"
         rf"|<script\b{_INSIDE_TAG}.*?(?:</script\s*>|\z)|<style\b{_INSIDE_TAG}.*?(?:</style\s*>|\z)"
         rf"|</?[a-z]{_INSIDE_TAG}|</?[a-z][^>]*+>|<[!?][^>]*+>|[^<]++|<")
# Elements without an end tag; scripts and styles are one token each.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
             "script", "style"]
_NO_RANK = len(CONTAINER_SELECTORS)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag (other attributes may hold the same text in quotes)."""
    others = r"^<[^\s/>]+(?:[\s/]+[^\s/=>]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*?"
    return F.regexp_extract(tag, rf"(?is){others}[\s/]+{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)


def _rank(tag: Column, name: Column) -> Column:
    """Place of the first selector that a start tag meets."""
    names, classes, ids = ([(i, x.lstrip(".#")) for i, x in enumerate(CONTAINER_SELECTORS) if (x[0] if x[0] in ".#" else "") == kind]
                           for kind in ("", ".", "#"))

    def place(pairs, value):
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, v in pairs for x in (v, i)]), value), F.lit(_NO_RANK))

    plain = lambda v: F.regexp_replace(v, "^[\"']|[\"']$", "")
    by_class = F.array_min(F.transform(F.split(plain(_attribute(tag, "class")), r"\s+"), lambda c: place(classes, c)))
    return F.when(name == "", _NO_RANK).otherwise(F.least(
        place(names, name), F.when(tag.rlike(r"(?i)\sclass\b"), by_class).otherwise(_NO_RANK),
        F.when(tag.rlike(r"(?i)\sid\b"), place(ids, plain(_attribute(tag, "id")))).otherwise(_NO_RANK)))


def _tags(tokens: Column) -> Column:
    """Tags that open or close an element: place, name, whether it closes, rank among the selectors."""
    marks = F.transform(tokens, lambda t, i: F.struct(
        i.alias("at"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"), t.startswith("</").alias("closes"), t.alias("tag")))
    kept = F.filter(marks, lambda m: (m["name"] != "") & ~m["name"].isin(VOID_TAGS) & ~m["tag"].endswith("/>"))
    return F.transform(kept, lambda m: F.struct(
        m["at"].alias("at"), m["name"].alias("name"), m["closes"].alias("closes"),
        F.when(m["closes"], _NO_RANK).otherwise(_rank(m["tag"], m["name"])).alias("rank")))


def _end_of(tags: Column, first: Column) -> Column:
    """Place of the tag that closes the element opened at token ``first``; null where nothing does.

    A fold over the tags with the open elements, innermost first. An end tag closes the innermost
    element of its name and all that were left open inside; without such an element it is void.
    """
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("floor"), F.lit(None).cast("int").alias("end"))

    def step(acc, m):
        opened = F.concat(F.array(m["name"]), acc["open"])
        match = F.array_position(acc["open"], m["name"]).cast("int")
        left = F.slice(acc["open"], match + 1, F.size(acc["open"]))
        after = F.struct(opened.alias("open"), F.when(m["at"] == first, F.size(opened)).otherwise(acc["floor"]).alias("floor"), acc["end"].alias("end"))
        closed = F.struct(left.alias("open"), acc["floor"].alias("floor"), F.when(F.size(left) < acc["floor"], m["at"]).alias("end"))
        return F.when(acc["end"].isNotNull(), acc).when(~m["closes"], after).when(match == 0, acc).otherwise(closed)

    return F.aggregate(tags, start, step, lambda acc: acc["end"])


def tokens_text(tokens: Column) -> Column:
    """Visible text of a stretch of tokens, whitespace squashed."""
    text = F.array_join(F.transform(tokens, lambda t: F.when(~t.startswith("<") | (t == "<"), t).when(
        t.rlike(f"^{BREAK_TAGS}") | t.rlike(r"(?i)^<(?:!--|(?:script|style)\b)"), " ").otherwise("")), "")
    for ent, ch in ENTITIES:
        text = F.replace(text, F.lit(ent), F.lit(ch))
    return normalize_content(text, None)


def container_tokens(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``_tok`` (the page's tokens) and ``_inner`` (those inside its first container, in the order of
    the selectors; null without one). Of several elements that a selector fits, the first of the page counts."""
    x = df.withColumn("_tok", F.regexp_extract_all(html_col, F.lit(TOKEN), F.lit(0))).withColumn("_tags", _tags(F.col("_tok")))
    best = F.array_min(F.transform("_tags", lambda m: m["rank"]))
    x = x.withColumn("_open", F.when(best < _NO_RANK, F.get(F.filter("_tags", lambda m: m["rank"] == best), F.lit(0))["at"]))
    x = x.withColumn("_shut", F.when(F.col("_open").isNotNull(), F.coalesce(_end_of(F.col("_tags"), F.col("_open")), F.size("_tok"))))
    inner = F.slice("_tok", F.col("_open") + 2, F.greatest(F.col("_shut") - F.col("_open") - 1, F.lit(0)))
    return x.withColumn("_inner", inner).drop("_tags", "_open", "_shut")


def with_content(df: DataFrame, html_col: str = "html", out: str = "content") -> DataFrame:
    """J1 + J2, natively: tokens, the container's place among them by a fold over the open elements, its
    text; the body's text where there is no container or none with text. ``_h`` is the cleaned page."""
    x = container_tokens(df.withColumn("_h", _clean_html(F.col(html_col))), html_col)
    x = x.withColumn("_first", F.coalesce(tokens_text(F.col("_inner")), F.lit("")))
    begin = F.array_position(F.transform("_tok", lambda t: t.rlike(r"(?i)^<body\b")), True).cast("int")
    stop = F.size("_tok") + 1 - F.array_position(F.reverse(F.transform("_tok", lambda t: t.rlike(r"(?i)^</body\b"))), True).cast("int")
    # without an end tag the body goes to the end of the page
    body = F.when(begin > 0, F.slice("_tok", begin + 1, F.greatest(F.when(stop <= F.size("_tok"), stop - begin - 1).otherwise(F.size("_tok")), F.lit(0))))
    x = x.withColumn(out, F.substring(F.when(F.col("_first") != "", F.col("_first")).otherwise(
        F.coalesce(tokens_text(body), F.lit(""))), 1, MAX_CONTENT_CHARS))
    return x.drop("_tok", "_inner", "_first")


def _first_text(h: Column, tag: str) -> Column:
    return html_text(F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def page_record(pages: DataFrame, content: bool = False) -> DataFrame:
    """Title / url / snippet by selector priority; rows without title or http url dropped."""
    x = with_content(pages) if content else pages.withColumn("_h", _clean_html(F.col("html")))
    h = F.col("_h")
    frags = F.array(*[F.regexp_extract(h, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1) for t in ("title", "h1", "h2", "p")])
    # one text chain applied to the four fragments (keeps generated code small)
    x = x.withColumn("_txt", F.transform(frags, lambda f: html_text(f)))
    heads = F.filter(F.slice("_txt", 1, 3), lambda t: t != "")
    title = F.try_element_at(heads, F.lit(1))
    url = F.when(F.col("url").startswith("http"), F.col("url"))
    snippet = F.coalesce(F.nullif(F.col("_txt")[3], F.lit("")),
                         F.nullif(F.regexp_extract(h, r"(?is)<meta\s+name=\"description\"\s+content=\"([^\"]*)\"", 1),
                                  F.lit("")), F.lit(""))
    return select_where(x, [F.col("page_id"), url.alias("url"), title.alias("title"), snippet.alias("snippet"),
                            *([F.col("content")] if content else [])],
                        lambda r: present(r["title"]) & present(r["url"]))


def _resolve(href: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    base_dir = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.rlike(r"^(?:#|mailto:|javascript:)"), F.lit(None))
            .otherwise(F.concat(F.when(base_dir != "", base_dir).otherwise(F.concat(origin, F.lit("/"))), href)))


ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"[^>]*>(.*?)</a>"


def harvest_links(pages: DataFrame, n: int = 5, engine_domain: str = "bing.com",
                  resolve_relative: bool = True) -> DataFrame:
    """Http links (relative hrefs resolved against the page url when asked), not on the
    engine's domain, not .css/.js, anchor text longer than 5 characters, first ``n`` per page."""
    x = pages.select("page_id", "url", _clean_html(F.col("html")).alias("_h"))
    x = x.select("page_id", "url", F.arrays_zip(F.regexp_extract_all("_h", F.lit(ANCHOR), 1).alias("href"),
                                                F.regexp_extract_all("_h", F.lit(ANCHOR), 2).alias("inner")).alias("_a"))
    links = F.transform("_a", lambda a, i: F.struct(
        i.alias("pos"), (_resolve(a["href"], F.col("url")) if resolve_relative else a["href"]).alias("link_url"),
        html_text(a["inner"]).alias("title")))
    x = x.select("page_id", "url", links.alias("_links"))

    def wanted(r):
        return F.coalesce(r["link_url"].startswith("http") & ~r["link_url"].contains(engine_domain) & ~r["link_url"].endswith(".css")
                          & ~r["link_url"].endswith(".js") & (F.length(r["title"]) > 5), F.lit(False))

    first = F.slice(F.filter("_links", wanted), 1, n)  # per page, so no shuffle
    out = x.select("page_id", F.posexplode(first).alias("_at", "_l"))
    return out.select("page_id", "_l.pos", "_l.link_url", "_l.title", (F.col("_at") + 1).alias("rank"), F.lit("").alias("snippet"))


def top_results(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """The first ``n`` results per query (a literal limit, planned as a group limit)."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pages_to_documents(records: DataFrame, use_content: bool = True, engine: str = "stored") -> DataFrame:
    """``"{title}\\n\\n{content or snippet}"`` documents; rows without text skipped."""
    body = F.col("content") if use_content else F.col("snippet")
    body = F.coalesce(body, F.lit(""))
    docs = select_where(records, [F.col("page_id"), F.col("title"), F.col("url"), body.alias("_body")],
                        lambda r: present(r["_body"]))
    return docs.select(
        "page_id",
        F.concat(F.col("title"), F.lit("\n\n"), F.col("_body")).alias("text"),
        F.create_map(F.lit("url"), F.coalesce("url", F.lit("")), F.lit("title"), F.coalesce("title", F.lit("")),
                     F.lit("source"), F.lit("web_scrape"), F.lit("search_engine"), F.lit(engine)).alias("metadata"),
    )


def consent_status(requests: DataFrame, consent_col: str = "explicit_consent",
                   policy_col: str = "privacy_policy_url") -> DataFrame:
    """J7 in one pass: every request with ``status`` accepted / rejected and the rejection reason."""
    ok = F.coalesce(F.col(consent_col), F.lit(False))
    return requests.withColumn("status", F.when(ok, "accepted").otherwise("rejected")).withColumn(
        "error", F.when(~ok, F.lit(CONSENT_REQUIRED))).withColumn(
        "policy", F.when(present(policy_col), F.col(policy_col)).otherwise(F.lit("Please provide a privacy policy URL")))


def consent_gate(requests: DataFrame, consent_col: str = "explicit_consent",
                 policy_col: str = "privacy_policy_url") -> tuple[DataFrame, DataFrame]:
    """Requests with explicit consent pass; the rest are rejected with the reason."""
    ok = F.coalesce(F.col(consent_col), F.lit(False))
    accepted = requests.where(ok)
    rejected = requests.where(~ok).withColumn("error", F.lit(CONSENT_REQUIRED)).withColumn(
        "consent_required", F.lit(True)).withColumn(
        "privacy_policy_url", F.when(present(policy_col), F.col(policy_col)).otherwise(
            F.lit("Please provide a privacy policy URL")))
    return accepted, rejected
