"""DuckDB forms of the derived views (same definitions as ``sources.tables``).

Each constant is one CTE body; ``with_views`` prefixes a query with the CTEs
it names. DuckDB registers the driver tables as views of the same name.
"""

from __future__ import annotations

ITEMS = """items AS (
  SELECT doc_id AS item_id,
         split_part(text, chr(10), 1) AS instruction,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('about ', lang) END AS context,
         CASE WHEN doc_id % 13 = 0 THEN 'ok.'
              ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS output,
         CASE doc_id % 7 WHEN 0 THEN 'philosophy' WHEN 1 THEN 'methodology'
              WHEN 2 THEN 'process' WHEN 3 THEN 'example' WHEN 4 THEN 'conversation'
              WHEN 5 THEN 'misc' ELSE '' END AS category,
         CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE [lang, source] END AS tags,
         CASE doc_id % 4 WHEN 0 THEN 'foundational' WHEN 1 THEN 'intermediate'
              WHEN 2 THEN 'advanced' ELSE 'expert' END AS difficulty,
         CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS source_section
  FROM documents)"""

MARKDOWN = """markdown_docs AS (
  SELECT doc_id,
         concat('intro', array_to_string(list_transform(string_split(text, chr(10)), lambda l, j:
           concat(chr(10) || '## ',
                  ['Core Philosophy', 'Workflow Steps', 'Practical Example', 'Team Framework',
                   'Crisis Prevention Protocol', 'Notes'][((doc_id + j - 1) % 6) + 1],
                  chr(10),
                  CASE (j - 1) % 3
                    WHEN 0 THEN concat('The "', split_part(l, ' ', 1), '" idea', chr(10), l)
                    WHEN 1 THEN concat('1. ', split_part(l, ' ', 1), chr(10), '- ', l)
                    ELSE concat('**', split_part(l, ' ', 1), '** ', l) END)), '')) AS text
  FROM documents)"""

_SAID = "concat(chr(34), replace(text, chr(34), chr(39)), chr(34))"

DIALOGUE = f"""markdown_docs AS (
  SELECT conv_id AS doc_id, concat('intro', chr(10), '## Conversation Patterns', chr(10), string_agg(piece, chr(10) ORDER BY turn, piece)) AS text
  FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('**Human:** ', {_SAID}) WHEN turn % 4 = 3 THEN concat('**TRON Response:** ', {_SAID})
                              WHEN role = 'assistant' THEN concat('**Assistant:** ', {_SAID}) ELSE text END AS piece FROM conversations)
  GROUP BY conv_id)"""

ANCHORS = """markdown_docs AS (
  SELECT doc_id, concat('intro', n, '## Core Philosophy', n, 'Here 42 means ', a, n, ' = FOR TWO  and ', b, n, n, a,
           n, '## Team Framework', n, 'first', n, '**TRON Contribution:** ', a, n, '**AI Contribution:** ', b, n, n, 'end ', a,
           n, '## Crisis Prevention Protocol', n, a, CASE WHEN doc_id % 2 = 0 THEN ' STOP ' ELSE ' \U0001F6D1 ' END, b, n, n, a) AS text
  FROM (SELECT doc_id, chr(10) AS n, split_part(text, chr(10), 1) AS a, split_part(text, chr(10), 2) AS b FROM documents))"""

HISTORY = """history AS (
  SELECT CAST(k.event_id AS VARCHAR) AS id,
         k.event_id AS seq,
         CAST(k.user_id AS VARCHAR) AS user_id,
         concat(k.event_type, ' ', k.props) AS query,
         concat('value ', CAST(CAST(k.value AS DECIMAL(18,2)) AS VARCHAR)) AS response,
         CASE WHEN k.event_id % 97 = 0 THEN NULL ELSE k.ts END AS ts,
         concat('m', CAST(k.event_id % 3 AS VARCHAR)) AS model,
         e.embedding AS embedding
  FROM (SELECT *, event_id % (SELECT count(*) FROM embeddings) AS vec_key FROM events) k
  LEFT JOIN embeddings e ON e.vec_id = k.vec_key)"""

COLLECTION = """collection AS (
  SELECT e.vec_id AS doc_id, coalesce(d.text, '') AS text, d.source, d.lang, e.label, e.embedding
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""

QUERIES = """queries AS (
  SELECT vec_id AS query_id,
         CASE vec_id % 4
           WHEN 0 THEN concat('"', split_part(split_part(text, chr(10), 1), ' ', 1), '" ', split_part(text, chr(10), 1))
           WHEN 1 THEN concat(split_part(text, chr(10), 1), ' ', lower(split_part(split_part(text, chr(10), 1), ' ', 1)), '_', coalesce(lang, 'xx'))
           ELSE split_part(text, chr(10), 1) END AS text,
         CAST(1 + vec_id % 6 AS INTEGER) AS k,
         CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS filter_label,
         CAST(vec_id % 200 AS VARCHAR) AS user_id,
         embedding
  FROM (SELECT e.vec_id, e.embedding, e.label, coalesce(d.text, '') AS text, d.lang
        FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id))"""

VIEWS = {
    "items": ITEMS,
    "markdown_docs": MARKDOWN,
    "dialogue_docs": DIALOGUE,
    "anchor_docs": ANCHORS,
    "history": HISTORY,
    "collection": COLLECTION,
    "queries": QUERIES,
}


def with_views(names: list[str], body: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + "\n" + body
