"""Registered jobs of the web-page family (J) on the stored ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import pages as P
from weft.plans.sqlfrag import WS
from weft.sources import tables


def _pages(spark, sf):
    return tables.pages(spark, sf)


def q_extract_content(spark, sf):
    return P.with_content(_pages(spark, sf)).select("page_id", "content")


# Pages derived from the table, one kind per id: nested containers by class and by id, and none.
_NESTED = [
    ("<html><body><p>before</p><div class='x content'><div>one ", "</div> two <div><div>three</div></div> four</div><p>after</p></body></html>", "one ", " two three four"),
    ('<html><body><section id="main"><section>a</section> b ', "<section>c</section> d</section> e</body></html>", "a b ", " c d"),
    ("<html><body><div><div>deep ", "</div> end</div> tail</body></html>", "deep ", " end tail"),
    ("<html><body><article>x <article>inner ", "</article> y</article> z</body></html>", "x inner ", " y"),
]


def q_nested_content(spark, sf):
    n = F.col("page_id") % len(_NESTED)
    html = F.lit(None).cast("string")
    for i, (a, b, _, _) in enumerate(_NESTED):
        html = F.when(n == i, F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b))).otherwise(html)
    return P.with_content(_pages(spark, sf).select("page_id", html.alias("html"))).select("page_id", "content")


def q_normalize_content(spark, sf):
    p = _pages(spark, sf)
    body = F.regexp_extract(F.regexp_replace(F.col("html"), r"(?is)<script\b[^>]*>.*?</script>", " "),
                            P.BODY_PATTERN, 1)
    return p.select("page_id", P.normalize_content(F.regexp_replace(body, P.ANY_TAG, " ")).alias("normalized"))


def q_harvest_links(spark, sf):
    return P.harvest_links(_pages(spark, sf), 5, "bing.com").select(
        "page_id", F.col("rank").cast("long").alias("rank"), "link_url", "title")


def q_page_record(spark, sf):
    return P.page_record(_pages(spark, sf)).select("page_id", "url", "title", "snippet")


def q_top_results(spark, sf):
    r = P.page_record(_pages(spark, sf)).withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return P.top_results(r, 5, "host", "page_id").select("host", "page_id", F.col("rank").cast("long").alias("rank"))


def q_pages_to_documents(spark, sf):
    d = P.pages_to_documents(P.page_record(_pages(spark, sf), content=True))
    return d.select("page_id", "text", F.col("metadata")["url"].alias("url"))


def q_consent_gate(spark, sf):
    req = _pages(spark, sf).select(
        "page_id", F.col("url").startswith("https").alias("explicit_consent"),
        F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/privacy")).alias("privacy_policy_url"))
    return P.consent_status(req).select("page_id", "status", "error")


# ---------------------------------------------------------------- DuckDB side


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_html(x: str) -> str:
    for p in P.STRIP_BLOCKS:
        x = f"regexp_replace({x}, {_q(p)}, ' ', 'g')"
    return x


def _norm(x: str, limit: int | None = P.MAX_CONTENT_CHARS) -> str:
    y = f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"
    return f"substr({y}, 1, {limit})" if limit else y


def _html_text(x: str) -> str:
    y = _clean_html(x)
    y = f"regexp_replace({y}, {_q(P.BREAK_TAGS)}, ' ', 'g')"
    y = f"regexp_replace({y}, {_q(P.ANY_TAG)}, '', 'g')"
    for ent, ch in P.ENTITIES:
        y = f"replace({y}, {_q(ent)}, {_q(ch)})"
    return _norm(y, None)


def _content(h: str) -> str:
    whens = []
    for sel in P.CONTAINER_SELECTORS:
        p = P.container_pattern(sel)
        whens.append(f"WHEN regexp_matches({h}, {_q(p)}) THEN {_html_text(f'regexp_extract({h}, {_q(p)}, 1)')}")
    first = "(CASE " + " ".join(whens) + " ELSE '' END)"
    # a page without the end tag of its body is its body to the end
    body = _html_text(f"CASE WHEN regexp_matches({h}, {_q(P.BODY_PATTERN)}) THEN regexp_extract({h}, {_q(P.BODY_PATTERN)}, 1) "
                      f"ELSE regexp_extract({h}, '(?is)<body\\b[^>]*>(.*)', 1) END")
    return f"substr(CASE WHEN {first} <> '' THEN {first} ELSE {body} END, 1, {P.MAX_CONTENT_CHARS})"


def _first_text(h: str, tag: str) -> str:
    return _html_text(f"regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)")


_REC = f"""
  rec AS (
    SELECT page_id, CASE WHEN starts_with(url, 'http') THEN url END AS url,
           coalesce(nullif({_first_text('h', 'title')}, ''), nullif({_first_text('h', 'h1')}, ''),
                    nullif({_first_text('h', 'h2')}, '')) AS title,
           coalesce(nullif({_first_text('h', 'p')}, ''),
                    nullif(regexp_extract(h, '(?is)<meta\\s+name="description"\\s+content="([^"]*)"', 1), ''), '') AS snippet,
           {_content('html')} AS content
    FROM (SELECT *, {_clean_html('html')} AS h FROM pages)),
  recs AS (SELECT * FROM rec WHERE title IS NOT NULL AND title <> '' AND url IS NOT NULL AND url <> '')"""


def _resolve(href: str, base: str) -> str:
    origin = f"regexp_extract({base}, '^(https?://[^/?#]+)', 1)"
    base_dir = f"regexp_extract({base}, '^(https?://[^?#]*/)', 1)"
    return (f"(CASE WHEN starts_with({href}, 'http') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^(https?:)', 1) || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
            f"WHEN regexp_matches({href}, '^(?:#|mailto:|javascript:)') THEN NULL "
            f"ELSE (CASE WHEN {base_dir} <> '' THEN {base_dir} ELSE {origin} || '/' END) || {href} END)")


SQL = {
    "j1_extract_content": f"SELECT page_id, {_content('html')} AS content FROM pages",
    "j1_nested_content": "SELECT page_id, CASE page_id % " + str(len(_NESTED)) + "".join(
        f" WHEN {i} THEN {_q(a)} || page_id || {_q(b)}" for i, (_, _, a, b) in enumerate(_NESTED)) + " END AS content FROM pages",
    "j2_normalize_content": f"""
        SELECT page_id, {_norm("regexp_replace(regexp_extract(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), " + _q(P.BODY_PATTERN) + ", 1), " + _q(P.ANY_TAG) + ", ' ', 'g')")} AS normalized
        FROM pages""",
    "j3_harvest_links": f"""
        WITH a AS (SELECT page_id, url, regexp_extract_all({_clean_html('html')}, {_q(P.ANCHOR)}, 1) AS hrefs,
                          regexp_extract_all({_clean_html('html')}, {_q(P.ANCHOR)}, 2) AS texts FROM pages),
        z AS (SELECT page_id, url, unnest(generate_series(0, len(hrefs) - 1)) AS pos, unnest(hrefs) AS href,
                     unnest(texts) AS inner_html FROM a WHERE len(hrefs) > 0),
        t AS (SELECT page_id, pos, {_resolve('href', 'url')} AS link_url, {_html_text('inner_html')} AS title FROM z),
        f AS (SELECT * FROM t WHERE starts_with(link_url, 'http') AND NOT contains(link_url, 'bing.com')
                AND NOT ends_with(link_url, '.css') AND NOT ends_with(link_url, '.js') AND length(title) > 5),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f)
        SELECT page_id, CAST(rank AS BIGINT) AS rank, link_url, title FROM r WHERE rank <= 5""",
    "j4_page_record": f"WITH {_REC} SELECT page_id, url, title, snippet FROM recs",
    "j5_top_results": f"""WITH {_REC},
        h AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM recs),
        r AS (SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM h)
        SELECT host, page_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""",
    "j6_pages_to_documents": f"""WITH {_REC}
        SELECT page_id, title || chr(10) || chr(10) || content AS text, url FROM recs
        WHERE content IS NOT NULL AND content <> ''""",
    "j7_consent_gate": f"""
        SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'accepted' ELSE 'rejected' END AS status,
               CASE WHEN starts_with(url, 'https') THEN NULL ELSE {_q(P.CONSENT_REQUIRED)} END AS error
        FROM pages""",
}

QUERIES = {
    "j1_extract_content": q_extract_content,
    "j1_nested_content": q_nested_content,
    "j2_normalize_content": q_normalize_content,
    "j3_harvest_links": q_harvest_links,
    "j4_page_record": q_page_record,
    "j5_top_results": q_top_results,
    "j6_pages_to_documents": q_pages_to_documents,
    "j7_consent_gate": q_consent_gate,
}
