"""Parts that the queries' SQL has in common."""

from __future__ import annotations

from vellum.functions.text import STOPWORDS


def stop_list() -> str:
    return ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(text: str, kind: str) -> str:
    """Lower-cased tokens; words with a letter beyond ASCII are blanked first."""
    plain = text
    for sort in ("L", "N"):
        plain = rf"regexp_replace({plain}, '[\p{{L}}\p{{N}}_]*[^\x00-\x7F\P{{{sort}}}][\p{{L}}\p{{N}}_]*', ' ', 'g')"
    pattern = r"\b[a-zA-Z][a-zA-Z0-9_\-]{2,}\b" if kind == "keyword" else r"\b[a-zA-Z0-9][a-zA-Z0-9_\-]*\b"
    return f"list_transform(regexp_extract_all({plain}, '{pattern}'), lambda t: lower(t))"


KEYWORDS = f"""
toks AS (SELECT doc_id, {tokens_sql('text', 'keyword')} AS t FROM documents),
placed AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
counted AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM placed WHERE token NOT IN ({stop_list()}) GROUP BY doc_id, token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM counted)
"""

def summary_sql(name: str, relation: str, key: str) -> str:
    """Extractive summaries (key, summary) of the texts of a relation, as tables of a WITH."""
    n = name
    return rf"""
{n}_p AS (SELECT {key}, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS s FROM {relation}),
{n}_w AS (SELECT {key}, token, count(*) AS w FROM (SELECT {key}, unnest({tokens_sql('text', 'keyword')}) AS token FROM {relation}) WHERE token NOT IN ({stop_list()}) GROUP BY ALL),
{n}_e AS (SELECT {key}, unnest(range(len(s))) AS position, unnest(s) AS sentence FROM {n}_p WHERE len(s) > 6),
{n}_t AS (SELECT {key}, position, unnest({tokens_sql('sentence', 'keyword')}) AS token FROM {n}_e),
{n}_s AS (SELECT t.{key}, t.position, sum(coalesce(w, 0))::DOUBLE / sqrt(count(*)) AS score FROM {n}_t t LEFT JOIN {n}_w USING ({key}, token) GROUP BY ALL),
{n}_b AS (SELECT {key}, position FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, position) AS r FROM {n}_s WHERE {key} IN (SELECT {key} FROM {n}_w)) WHERE r <= 6
  UNION ALL SELECT {key}, position FROM {n}_e WHERE position < 6 AND {key} NOT IN (SELECT {key} FROM {n}_w)),
{n}_o AS (SELECT {key}, string_agg(sentence, ' ' ORDER BY position) AS t FROM {n}_e JOIN {n}_b USING ({key}, position) GROUP BY {key}),
{n} AS (SELECT p.{key}, CASE WHEN length(b) <= 1200 AND length(b) - length(replace(b, chr(10), '')) < 4 THEN b
  ELSE substr(coalesce(t, array_to_string(s, ' ')), 1, 1200) END AS summary
  FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM {n}_p) p LEFT JOIN {n}_o USING ({key}))
"""


NAMED = "named AS (SELECT *, doc_id || '.txt' AS title FROM documents)"


def postings_sql(name: str, table: str, key: str) -> str:
    """Postings of a table: tokens and pairs, hashed to 512 signed buckets."""
    return f"""
{name}_t AS (SELECT {key}, {tokens_sql('text', 'search')} AS t FROM {table}),
{name}_f AS (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS f FROM {name}_t),
{name}_c AS (SELECT {key}, f, md5(f) AS h, count(*) AS n FROM {name}_f GROUP BY {key}, f),
{name} AS (SELECT {key}, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 512)::INT AS bucket,
  sum(CASE WHEN ('0x' || h[10:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(n::DOUBLE))) AS weight FROM {name}_c GROUP BY ALL)
"""


def unit_sql(name: str, postings: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, bucket, (weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})))::FLOAT AS v FROM {postings})"


POSTINGS = postings_sql("postings", "documents", "doc_id")
UNIT = unit_sql("unit", "postings", "doc_id")

RECORDS = "records AS (SELECT doc_id AS id, source AS source_id, text, lower(doc_id || '.txt' || chr(10) || 'text://' || doc_id || chr(10) || text || chr(10) || lang) AS hay FROM documents)"

SEARCH_TERMS = f"""
asked AS (SELECT item_id AS query_id, text AS query, list_distinct({tokens_sql('text', 'search')}) AS terms FROM benchmark),
term AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM asked),
post AS (SELECT id, unnest(list_distinct({tokens_sql('hay', 'search')})) AS term FROM records),
met AS (SELECT query_id, id, count(*) / max(n) AS share FROM term JOIN post USING (term) GROUP BY ALL),
lexical AS (SELECT query_id, id, round(least(share + CASE WHEN contains(hay, lower(query)) THEN 0.25 ELSE 0 END, 1), 9) AS score FROM met JOIN records USING (id) JOIN asked USING (query_id))
"""


def hybrid_sql(condition: str = "true", k: int = 8, final: bool = True) -> str:
    """The blended ranking of every benchmark item over the documents."""
    records = RECORDS.replace("FROM documents)", f"FROM documents WHERE {condition.replace('source_id', 'source')})")
    return f"""
WITH {records}, {SEARCH_TERMS},
{postings_sql('dp', 'documents', 'doc_id')}, {unit_sql('du', 'dp', 'doc_id')},
{postings_sql('qp', 'benchmark', 'item_id')}, {unit_sql('qu', 'qp', 'item_id')},
du_n AS (SELECT doc_id, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS s FROM du GROUP BY doc_id), qu_n AS (SELECT item_id, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS s FROM qu GROUP BY item_id),
dot AS (SELECT item_id AS query_id, doc_id AS id, sum(q.v::DOUBLE * d.v::DOUBLE) AS p FROM qu q JOIN du d USING (bucket) GROUP BY ALL),
sem AS (SELECT query_id, r.id, round(coalesce(p / (qn.s * dn.s), 0), 9) AS score FROM records r CROSS JOIN (SELECT item_id AS query_id, s FROM qu_n) qn LEFT JOIN du_n dn ON dn.doc_id = r.id LEFT JOIN dot USING (query_id, id)),
sem_top AS (SELECT query_id, id, score AS sem FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sem) WHERE r <= {3 * k}),
lex_top AS (SELECT query_id, id, score AS lex FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM lexical) WHERE r <= {3 * k}),
blend AS (SELECT query_id, id, round(0.7::DOUBLE * coalesce(sem, 0) + 0.3::DOUBLE * coalesce(lex, 0), 9) AS score FROM sem_top FULL JOIN lex_top USING (query_id, id)),
ranked_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM blend)
SELECT query_id, id, {'round(score, 4) AS score' if final else 'score'}, rank FROM ranked_hits WHERE rank <= {k}
"""
