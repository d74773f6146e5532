"""DuckDB SQL for each registered query (same column names and values)."""

from __future__ import annotations

from .. import fixed
from ..functions._regex import NOT_WS, WS, sql_str, sql_strip_ws
from ..functions.html import sql_html_to_markdown, sql_normalize_html

SQL: dict[str, str] = {}

SEP = chr(0xE000)


def words(t):
    return f"CAST(len(regexp_extract_all({t}, {sql_str(NOT_WS + '+')})) AS BIGINT)"


def marks(t):
    return f"CAST(length({t}) - length(translate({t}, '.!?', '')) AS BIGINT)"


def nonspace(t):
    return f"CAST(length(regexp_replace({t}, {sql_str(WS)}, '', 'g')) AS BIGINT)"


def readability_raw(t):
    return (f"({fixed.READABILITY_BASE} - {fixed.READABILITY_WORDS_PER_SENTENCE} * "
            f"({words(t)} / greatest(1, {marks(t)})) - {fixed.READABILITY_CHARS_PER_WORD} * "
            f"({nonspace(t)} / greatest(1, {words(t)})))")


def readability(t):
    return f"(floor({readability_raw(t)} * 100 + 0.5) / 100)"


def readability_cents(t):
    return f"CAST(floor({readability_raw(t)} * 100 + 0.5) AS BIGINT)"


def sentences(t):
    marked = f"regexp_replace({sql_strip_ws(t)}, {sql_str('([.!?])' + WS + '+')}, {sql_str(chr(92) + '1' + SEP)}, 'g')"
    return f"list_filter(string_split({marked}, {sql_str(SEP)}), lambda s: s <> '')"


def truncate_markdown(t, n, m):
    joined = f"array_to_string(list_slice({sentences(t)}, 1, {n}), ' ')"
    cut = sql_strip_ws(f"regexp_replace(substring(j, 1, {m}), {sql_str(chr(10) + '[^' + chr(10) + ']*$')}, '')")
    return (f"(SELECT CASE WHEN {t} IS NULL OR {t} = '' THEN '' "
            f"WHEN length(j) > {m} THEN {cut} ELSE j END FROM (SELECT {joined} AS j))")


def first_line(t):
    return f"regexp_extract({t}, {sql_str('^([^' + chr(10) + ']*)')}, 1)"


def partition_key(t):
    # '_' before every upper-case letter except a leading one, lower, keep [a-z0-9_-]
    snake = f"regexp_replace({t}, '([A-Z])', '_\\1', 'g')"
    snake = f"CASE WHEN regexp_matches({t}, '^[A-Z]') THEN substring({snake}, 2) ELSE {snake} END"
    return f"regexp_replace(lower({snake}), '[^a-z0-9_-]', '', 'g')"


SQL["readability_by_source"] = f"""
SELECT source, count(*) AS n_entries,
       sum({readability_cents('text')}) / count(*) / 100 AS mean_readability,
       sum(n_chars) / count(*) AS mean_chars
FROM documents GROUP BY source
"""

SQL["readability"] = f"""
SELECT doc_id, {words('text')} AS n_words, {marks('text')} AS n_marks,
       {nonspace('text')} AS n_nonspace, {readability('text')} AS readability
FROM documents
"""

SQL["partition_key"] = f"""
WITH t AS (
  SELECT 'page' AS kind, page_id AS id,
         nullif(regexp_extract(html, {sql_str('(?is)<title\\b[^>]*>(.*?)</title\\s*>')}, 1), '') AS title
  FROM pages
  UNION ALL
  SELECT 'doc', doc_id, {first_line('text')} FROM documents)
SELECT kind, id, title, {partition_key('title')} AS partition_key FROM t
"""

SQL["format_summary"] = f"""
SELECT doc_id, upper(substring(s, 1, 1)) || lower(substring(s, 2)) AS summary
FROM (SELECT doc_id, {sql_strip_ws('text')} AS s FROM documents)
"""

SQL["truncate_markdown"] = f"""
SELECT doc_id, CAST(len({sentences('text')}) AS BIGINT) AS n_sentences,
       {truncate_markdown('text', fixed.MAX_SUMMARY_SENTENCES, fixed.MAX_SUMMARY_CHARACTERS)} AS truncated
FROM documents
"""

SQL["truncate_by_sentences"] = f"""
WITH s AS (
  SELECT doc_id, list_slice({sentences('text')}, 1, {fixed.MAX_SUMMARY_SENTENCES}) AS ss FROM documents),
u AS (
  SELECT doc_id, unnest(ss) AS sent, generate_subscripts(ss, 1) AS i FROM s),
c AS (
  SELECT doc_id, sent, i,
         coalesce(sum(length(sent) + 1) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM u),
f AS (
  SELECT doc_id, min(i) FILTER (WHERE before + length(sent) > {fixed.MAX_SUMMARY_CHARACTERS}) AS stop_at
  FROM c GROUP BY doc_id),
k AS (
  SELECT c.doc_id, string_agg(sent, ' ' ORDER BY i) AS kept
  FROM c JOIN f USING (doc_id) WHERE f.stop_at IS NULL OR c.i < f.stop_at GROUP BY c.doc_id)
SELECT s.doc_id, {sql_strip_ws("coalesce(k.kept, '')")} AS truncated
FROM s LEFT JOIN k USING (doc_id)
"""

SQL["html_to_markdown"] = f"""
SELECT page_id, {sql_html_to_markdown(sql_normalize_html('html'))} AS markdown FROM pages
"""


# ------------------------------------------------------------ helpers --

def md_of(expr):
    return sql_html_to_markdown(expr)


def cut(j, m):
    return sql_strip_ws(f"regexp_replace(substring({j}, 1, {m}), {sql_str(chr(10) + '[^' + chr(10) + ']*$')}, '')")


def clean_summary_ctes(src_table, id_col, text_col):
    """CTEs a, b, cs: ``cs(id, summary)`` is F10c of ``text_col``."""
    n, m = fixed.MAX_SUMMARY_SENTENCES, fixed.MAX_SUMMARY_CHARACTERS
    return f"""
cs_n AS (SELECT {id_col} AS cid, {text_col} AS t, {sql_normalize_html(text_col)} AS nh FROM {src_table}),
cs_m AS (SELECT cid, t, {md_of('nh')} AS md FROM cs_n),
cs_j AS (SELECT cid, t, md, array_to_string(list_slice({sentences('md')}, 1, {n}), ' ') AS j FROM cs_m),
cs AS (SELECT cid, CASE WHEN t IS NULL OR t = '' THEN NULL WHEN md = '' THEN ''
                        WHEN length(j) > {m} THEN {cut('j', m)} ELSE j END AS summary FROM cs_j)"""


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]*)(.*)$"
_AUTH = r"^(?:([^@]*)@)?([^:@]*)(?::([0-9]*))?$"


def normalize_url(raw):
    u = sql_strip_ws(raw)
    scheme = f"lower(regexp_extract({u}, {sql_str(_URL)}, 1))"
    auth = f"regexp_extract({u}, {sql_str(_URL)}, 2)"
    rest = f"regexp_extract({u}, {sql_str(_URL)}, 3)"
    userinfo = f"regexp_extract({auth}, {sql_str(_AUTH)}, 1)"
    host = f"lower(regexp_extract({auth}, {sql_str(_AUTH)}, 2))"
    port = f"regexp_extract({auth}, {sql_str(_AUTH)}, 3)"
    ok = (f"regexp_matches({u}, {sql_str(_URL)}) AND {scheme} IN ('http', 'https') "
          f"AND regexp_matches({auth}, {sql_str(_AUTH)}) AND {host} <> '' "
          f"AND regexp_matches({host}, '^[a-z0-9.-]+$')")
    port_txt = (f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') "
                f"OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END")
    user_txt = f"CASE WHEN {userinfo} = '' THEN '' ELSE {userinfo} || '@' END"
    path = (f"replace(CASE WHEN {rest} = '' OR starts_with({rest}, '?') OR starts_with({rest}, '#') "
            f"THEN '/' || {rest} ELSE {rest} END, ' ', '%20')")
    return f"(CASE WHEN {ok} THEN {scheme} || '://' || {user_txt} || {host} || {port_txt} || {path} END)"


def iso_utc(ts):
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 "
            f"THEN '.' || strftime({ts}, '%f') ELSE '' END || '+00:00')")


def str_to_bool(raw):
    v = f"lower({sql_strip_ws(raw)})"
    t = ", ".join(sql_str(x) for x in fixed.TRUE_WORDS)
    f_ = ", ".join(sql_str(x) for x in fixed.FALSE_WORDS)
    return f"(CASE WHEN {raw} IS NULL THEN false WHEN {v} IN ({t}) THEN true WHEN {v} IN ({f_}) THEN false END)"


PAGE_TITLE = "nullif(regexp_extract(html, " + sql_str(r"(?is)<title\b[^>]*>(.*?)</title\s*>") + ", 1), '')"
ENTRY_LINK = "'https://' || source || '.example.com/entries/' || CAST(doc_id AS VARCHAR)"


def entries_cte():
    """Typed entries of all documents with their violations."""
    return f"""WITH {clean_summary_ctes('documents', 'doc_id', 'text')},
e AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, {partition_key('d.source')} AS partition_key,
             {first_line('d.text')} AS title, {normalize_url(ENTRY_LINK.replace('source', 'd.source').replace('doc_id', 'd.doc_id'))} AS link,
             TIMESTAMP '1970-01-01 00:00:00' AS published, cs.summary
      FROM documents d JOIN cs ON cs.cid = d.doc_id),
v AS (SELECT *, list_filter([
        CASE WHEN partition_key IS NULL OR NOT regexp_matches(partition_key, {sql_str(fixed.KEY_PATTERN)}) THEN 'partition_key_pattern' END,
        CASE WHEN id IS NULL OR length(id) < 1 OR length(id) > 200 THEN 'id_length' END,
        CASE WHEN length(title) < 1 OR length(title) > 200 THEN 'title_length' END,
        CASE WHEN link IS NULL THEN 'link_not_http_url' END,
        CASE WHEN length(summary) > {fixed.MAX_SUMMARY_CHARACTERS} THEN 'summary_length' END,
        CASE WHEN published IS NULL THEN 'published_unparsable' END], lambda x: x IS NOT NULL) AS vl
      FROM e)"""


SQL["summary_clean"] = f"""
WITH {clean_summary_ctes('documents', 'doc_id', 'text')}
SELECT cid AS doc_id, summary FROM cs
"""

SQL["str_to_bool"] = f"""
WITH t AS (
  SELECT 'quality' AS kind, doc_id AS id, CAST(quality AS VARCHAR) AS raw FROM labels
  UNION ALL SELECT 'toxic', doc_id, CAST(toxic AS VARCHAR) FROM labels
  UNION ALL SELECT 'event', event_id, event_type FROM events)
SELECT kind, id, raw, {str_to_bool('raw')} AS value FROM t
"""

SQL["parse_date"] = """
SELECT event_id, date_trunc('second', ts) AS from_rfc, ts AS from_iso,
       date_trunc('second', ts) AS from_slash, CAST(NULL AS TIMESTAMP) AS bad
FROM events
"""

SQL["month_key"] = "SELECT event_id, strftime(ts, '%Y-%m') AS month_key FROM events"

SQL["timestamp_formats"] = f"""
SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc1123, {iso_utc('ts')} AS iso
FROM events
"""

SQL["url_normalise"] = f"""
WITH t AS (SELECT page_id AS id, url AS raw FROM pages
           UNION ALL SELECT doc_id, 'HTTPS://' || upper(source) || '.Example.COM:443' FROM documents)
SELECT id, raw, {normalize_url('raw')} AS url FROM t
"""

SQL["conform_13"] = f"""
SELECT {first_line('text')} AS Title, {ENTRY_LINK} AS URL, text AS Summary,
       CAST(NULL AS VARCHAR) AS Published_Date, coalesce(text, {sql_str(fixed.DEFAULT_CONTENT)}) AS Full_Content,
       concat_ws('|', lang, source) AS Categories, CAST(NULL AS VARCHAR) AS Author,
       CAST(0 AS BIGINT) AS n_embeddings, {sql_str(fixed.DEFAULT_SENTIMENT)} AS Sentiment,
       CAST(0.0 AS DOUBLE) AS Sentiment_Score, CAST(0.0 AS DOUBLE) AS Readability_FK,
       CAST(0.0 AS DOUBLE) AS Readability_DC, CAST(16 AS BIGINT) AS entry_id_len
FROM documents
"""

SQL["conform_15"] = f"""
SELECT {first_line('text')} AS Title, {ENTRY_LINK} AS URL, text AS Summary,
       CAST(doc_id AS VARCHAR) AS Entry_ID, CAST(NULL AS VARCHAR) AS Published_Date,
       coalesce(text, {sql_str(fixed.DEFAULT_CONTENT)}) AS Full_Content,
       concat_ws('|', lang, source) AS Categories, CAST(NULL AS VARCHAR) AS Author, '' AS Keywords,
       {sql_str(fixed.DEFAULT_SENTIMENT)} AS Sentiment, CAST(0.0 AS DOUBLE) AS Readability_Score,
       CAST(0 AS BIGINT) AS Engagement_Score, false AS Processed, '' AS Engagement_Type,
       false AS Response_Received
FROM documents
"""

SQL["validate_entries"] = entries_cte() + """
SELECT id, partition_key, title, link, published, array_to_string(vl, '|') AS violations,
       len(vl) = 0 AS valid
FROM v
"""

SQL["log_once"] = entries_cte() + """
SELECT message, count(*) AS n, min(doc_id) AS first_id
FROM (SELECT doc_id, unnest(vl) AS message FROM v) GROUP BY message
"""

_EVENT_OK = "event_type NOT IN ('signup', 'purchase')"
_EVENT_URL = "CASE WHEN event_type = 'error' THEN NULL ELSE 'https://feed' || CAST(user_id AS VARCHAR) || '.example.com/rss' END"

SQL["reject_reasons"] = f"""
WITH r AS (
  SELECT 'invalid_status' AS reason FROM events WHERE NOT ({_EVENT_OK})
  UNION ALL SELECT 'invalid_payload' FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'missing_feed_url' FROM events WHERE event_type IN ('error', 'purchase'))
SELECT reason, count(*) AS n_messages FROM r GROUP BY reason
"""

SQL["queue_roundtrip"] = f"""
SELECT event_id,
       CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'signup' THEN 'retrieved' ELSE 'enqueued' END AS status,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE {iso_utc('ts')} END AS enqueued_at,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE 'feed' || CAST(user_id AS VARCHAR) END AS feed_name,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE {_EVENT_URL} END AS feed_url
FROM events
"""

SQL["redelivery_dedupe"] = f"""
SELECT DISTINCT {_EVENT_URL} AS feed_url, {iso_utc('ts')} AS enqueued_at
FROM events WHERE {_EVENT_OK} AND event_type <> 'error'
"""

SQL["json_path"] = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"

SQL["tags_to_terms"] = "SELECT CAST(doc_id AS VARCHAR) AS id, concat_ws('|', lang, source) AS terms FROM documents"

SQL["full_content"] = f"SELECT page_id, coalesce(html, {sql_str(fixed.DEFAULT_CONTENT)}) AS full_content FROM pages"

SQL["image_json"] = f"SELECT page_id, url AS image_url, {PAGE_TITLE} AS image_title FROM pages"

SQL["embedding_json"] = """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n_dims, embedding IS NOT NULL AS roundtrip_equal
FROM embeddings
"""

SQL["engagement_score"] = """
SELECT entry_id, likes, shares, comments,
       likes * CAST(0.4 AS DOUBLE) + shares * CAST(0.4 AS DOUBLE) + comments * CAST(0.2 AS DOUBLE) AS engagement_score
FROM (SELECT user_id AS entry_id,
             count(*) FILTER (WHERE event_type = 'click') AS likes,
             count(*) FILTER (WHERE event_type = 'purchase') AS shares,
             count(*) FILTER (WHERE event_type = 'view') AS comments
      FROM events GROUP BY user_id)
"""

SQL["prompt_render"] = f"""
SELECT conv_id, turn, {sql_str(fixed.ENGAGEMENT_SYSTEM_PROMPT)} AS system,
       replace({sql_str(fixed.ENGAGEMENT_USER_TEMPLATE)}, '{{content_text}}', text) AS prompt,
       substring(text, 1, {fixed.TEXT_PREVIEW_CHARS}) AS preview
FROM conversations
"""


# -------------------------------------------------- joins / aggregates --

SQL["new_entries_anti"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS Entry_ID, {first_line('text')} AS Title
FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
"""

SQL["processed_status"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS Entry_ID, {first_line('text')} AS Title
FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (
  SELECT CAST(doc_id AS VARCHAR) FROM labels GROUP BY doc_id HAVING bool_or(quality = 1))
"""

FEED_LINK = "'https://' || source || '.example.com/feed'"

SQL["entry_feed_join"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {partition_key('source')} AS partition_key, source AS feed_title,
       {normalize_url(FEED_LINK)} AS feed_link, CAST(NULL AS VARCHAR) AS feed_language,
       'feed' AS feed_partition_key
FROM documents
"""

SQL["feed_rows"] = f"""
SELECT 'feed' AS partition_key, source AS title, {normalize_url(FEED_LINK)} AS link,
       CAST(NULL AS VARCHAR) AS language, TIMESTAMP '1970-01-01 00:00:00' AS updated,
       {partition_key('source')} AS entry_partition, CAST(16 AS BIGINT) AS row_key_len,
       concat_ws('|', CASE WHEN length(source) < 1 OR length(source) > 200 THEN 'title_length' END,
                      CASE WHEN {normalize_url(FEED_LINK)} IS NULL THEN 'link_not_http_url' END) AS violations
FROM (SELECT DISTINCT source FROM documents)
"""

SQL["entry_enrichment"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(len(e.embedding) AS BIGINT) AS n_dims,
       CAST(e.label AS DOUBLE) AS engagement_score
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""

_PAGE_MD = sql_html_to_markdown(sql_normalize_html("p2.html"))
SQL["content_fallback"] = f"""
WITH stored AS (
  SELECT doc_id, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) AND text IS NOT NULL AND text <> '' AND text <> {sql_str(SEP)}),
e AS (SELECT p.page_id, p.url, s.text FROM pages p LEFT JOIN stored s ON s.doc_id = p.page_id),
f AS (SELECT e.page_id, e.text, p2.html, {_PAGE_MD} AS md FROM e LEFT JOIN pages p2 ON p2.url = e.url
      WHERE e.text IS NULL)
SELECT page_id AS id, 'store' AS content_source, text AS content FROM e WHERE text IS NOT NULL
UNION ALL
SELECT page_id, CASE WHEN html IS NOT NULL AND md <> '' THEN 'page' ELSE 'missing' END,
       CASE WHEN html IS NOT NULL AND md <> '' THEN md END FROM f
"""

_STATE = """state AS (SELECT user_id AS feed_id, max(ts) AS last_ingestion FROM events
                      WHERE event_type = 'signup' GROUP BY user_id)"""
_CHANGED = f"""WITH l AS (
  SELECT user_id AS feed_id, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 304 ELSE 200 END AS status,
         ts AS last_modified,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events),
{_STATE},
ch AS (
  SELECT l.feed_id, l.status, l.last_modified,
         coalesce(s.last_ingestion, TIMESTAMP '1970-01-01 00:00:00') AS since,
         coalesce(l.status = 200 AND l.last_modified > coalesce(s.last_ingestion, TIMESTAMP '1970-01-01 00:00:00'),
                  false) AS changed
  FROM l LEFT JOIN state s ON s.feed_id = l.feed_id WHERE l.rn = 1)"""

SQL["changed_feeds"] = _CHANGED + "\nSELECT feed_id, status, last_modified, since, changed FROM ch\n"

SQL["next_watermark"] = _CHANGED + """
SELECT coalesce(n.feed_id, s.feed_id) AS feed_id,
       coalesce(n.last_ingestion, s.last_ingestion) AS last_ingestion
FROM state s FULL OUTER JOIN
     (SELECT feed_id, TIMESTAMP '2024-02-01 06:00:00' AS last_ingestion FROM ch WHERE changed) n
  ON n.feed_id = s.feed_id
"""

SQL["entry_key_lists"] = """
SELECT source, chunk, count(*) AS n_entries, min(doc_id) AS first_entry, max(doc_id) AS last_entry,
       count(*) AS n_keys
FROM (SELECT source, doc_id,
             CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 400) AS BIGINT) AS chunk
      FROM documents)
GROUP BY source, chunk
"""

_LAST = """SELECT user_id, event_id, event_type, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events {where}) WHERE rn = 1"""

SQL["last_write_wins"] = _LAST.format(where="")

SQL["upsert_merge"] = f"""
WITH o AS ({_LAST.format(where="WHERE ts < TIMESTAMP '2024-01-16 00:00:00'")}),
n AS (SELECT user_id, event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value, ts
      FROM ({_LAST.format(where="WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'")}))
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id,
       coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value,
       coalesce(n.ts, o.ts) AS ts
FROM o FULL OUTER JOIN n ON n.user_id = o.user_id
"""

SQL["keyed_delete"] = """
SELECT doc_id AS id, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
"""

# ------------------------------------------------------ parse / score --

SQL["feed_xml_parse"] = f"""
SELECT doc_id, source AS feed_title, lang AS feed_language, {first_line('text')} AS title,
       {ENTRY_LINK} AS link, text, concat_ws('|', lang, source) AS categories
FROM documents
"""

POSITIVE = "', '".join(__import__("rivulet.operators.enrich", fromlist=["x"]).POSITIVE_WORDS)
NEGATIVE = "', '".join(__import__("rivulet.operators.enrich", fromlist=["x"]).NEGATIVE_WORDS)


def lexicon(t):
    toks = f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}]+'), lambda x: x <> '')"
    return f"""(SELECT {{'pos': p, 'neg': n, 'score': CAST(p - n AS DOUBLE) / greatest(1, p + n)}} FROM (
      SELECT CAST(len(list_filter(tk, lambda x: x IN ('{POSITIVE}'))) AS BIGINT) AS p,
             CAST(len(list_filter(tk, lambda x: x IN ('{NEGATIVE}'))) AS BIGINT) AS n
      FROM (SELECT {toks} AS tk)))"""


def lexicon_label(s):
    return (f"CASE WHEN {s}.pos + {s}.neg = 0 THEN 'Neutral' WHEN {s}.score > 0.2 THEN 'Positive' "
            f"WHEN {s}.score < -0.2 THEN 'Negative' ELSE 'Mixed' END")


SQL["sentiment_lexicon"] = f"""
SELECT doc_id, {lexicon_label('s')} AS sentiment, s.score AS score, s.pos AS positive, s.neg AS negative
FROM (SELECT doc_id, {lexicon('text')} AS s FROM documents)
"""

SQL["model_reply_parse"] = f"""
SELECT conv_id, turn,
       CASE WHEN role = 'user' THEN {lexicon_label('s')} ELSE 'Error' END AS sentiment,
       CASE WHEN role = 'user' THEN s.score ELSE CAST(0.0 AS DOUBLE) END AS score
FROM (SELECT conv_id, turn, role, {lexicon('text')} AS s FROM conversations)
"""

from ..functions.html import MARKDOWN_TO_HTML_RULES  # noqa: E402
from ..functions._regex import sql_apply_rules  # noqa: E402

SQL["markdown_to_html"] = f"""
WITH m AS (SELECT page_id, {sql_html_to_markdown(sql_normalize_html('html'))} AS md FROM pages)
SELECT page_id, CASE WHEN md IS NULL OR md = '' THEN NULL
                     ELSE {sql_strip_ws(sql_apply_rules('md', MARKDOWN_TO_HTML_RULES))} END AS html_out
FROM m
"""


def _list_rules_sql():
    rl = "floor(" + readability_raw("text") + " * 100 + 0.5) / 100"
    return f"""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS Entry_ID, {rl} AS Readability_Score,
                  {lexicon_label('s')} AS Sentiment, {first_line('text')} AS Title,
                  {ENTRY_LINK} AS URL, CAST(NULL AS VARCHAR) AS Published_Date
           FROM (SELECT *, {lexicon('text')} AS s FROM documents))
SELECT Entry_ID, Readability_Score, Sentiment,
       concat_ws('|', CASE WHEN Title IS NULL THEN 'Title_null' END,
                      CASE WHEN URL IS NULL THEN 'URL_null' END,
                      CASE WHEN Entry_ID IS NULL THEN 'Entry_ID_null' END,
                      CASE WHEN Published_Date IS NULL THEN 'Published_Date_null' END,
                      CASE WHEN Sentiment IS NULL THEN 'Sentiment_null' END,
                      CASE WHEN Sentiment NOT IN ('Positive', 'Neutral', 'Negative', 'Mixed') THEN 'Sentiment_allowed' END,
                      CASE WHEN Readability_Score IS NULL THEN 'Readability_Score_null' END,
                      CASE WHEN NOT (Readability_Score BETWEEN 0.0 AND 100.0) THEN 'Readability_Score_range' END) AS violations
FROM r
"""


SQL["list_schema_rules"] = _list_rules_sql()

SQL["frame_rows"] = f"""
SELECT '1970-01' AS PartitionKey, {first_line('text')} AS Title, {ENTRY_LINK} AS URL,
       {sql_str(fixed.DEFAULT_SENTIMENT)} AS Sentiment, CAST(0.0 AS DOUBLE) AS Readability,
       '[]' AS Embedding, CAST(16 AS BIGINT) AS row_key_len
FROM documents
"""

SQL["enrichment_rows"] = f"""
SELECT e.vec_id, {partition_key('d.source')} AS partition_key, CAST(e.label AS DOUBLE) AS engagement_score,
       CAST(len(e.embedding) AS BIGINT) AS n_dims,
       concat_ws('|', CASE WHEN NOT regexp_matches({partition_key('d.source')}, {sql_str(fixed.KEY_PATTERN)})
                           THEN 'partition_key_pattern' END,
                      CASE WHEN NOT (CAST(e.label AS DOUBLE) BETWEEN 0.0 AND 10.0)
                           THEN 'engagement_score_range' END) AS violations
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
"""

SQL["model_batch_score"] = """
WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)
SELECT doc_id, CAST(NULL AS VARCHAR) AS reply_error,
       CASE WHEN regexp_matches(s, '(?s)[.!?]\\s') THEN regexp_extract(s, '(?s)^(.*?[.!?])\\s', 1) ELSE s END AS summary,
       CAST(least(10, 1 + length(text) // 2000) AS DOUBLE) AS score
FROM t
"""

SQL["enrich_pipeline"] = f"""
WITH {clean_summary_ctes('documents', 'doc_id', 'text')},
f AS (SELECT cid, summary, {sentences('summary')}[1] AS first, {lexicon('summary')} AS s,
             len(list_filter(string_split_regex(lower(summary), '[^\\p{{L}}]+'), lambda x: x <> '')) AS n_tokens FROM cs),
g AS (SELECT *, CASE WHEN first IS NULL OR length(first) > {fixed.MAX_SUMMARY_CHARACTERS} THEN '' ELSE {sql_strip_ws('first')} END AS one FROM f)
SELECT cid AS doc_id, upper(substring(one, 1, 1)) || lower(substring(one, 2)) AS ai_summary,
       {lexicon_label('s')} AS sentiment, s.score AS sentiment_score, {readability('summary')} AS readability,
       CAST(64 AS BIGINT) AS n_dims, CASE WHEN n_tokens > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
FROM g
"""

_SPACED = "CASE WHEN lang = 'fr' THEN source || ' ' || lang ELSE source END"
_KEY_BAD = f"CASE WHEN lang = 'fr' OR NOT regexp_matches(source, {sql_str(fixed.KEY_PATTERN)}) THEN 'partition_key_pattern' END"

SQL["feed_rules_broken"] = f"""
SELECT doc_id, concat_ws('|', {_KEY_BAD},
  CASE WHEN length(text) < 1 OR length(text) > 200 THEN 'title_length' END,
  CASE WHEN lang = 'de' THEN 'link_not_http_url' END,
  CASE WHEN lang = 'es' THEN 'language_pattern' END,
  CASE WHEN length(text) < 1 OR length(text) > 200 THEN 'publisher_length' END,
  CASE WHEN length(text) > 500 THEN 'rights_length' END,
  CASE WHEN length(text) > 500 THEN 'subtitle_length' END,
  CASE WHEN lang = 'es' THEN 'updated_unparsable' END) AS violations
FROM documents
"""

SQL["entry_rules_broken"] = f"""
SELECT doc_id, concat_ws('|', {_KEY_BAD},
  CASE WHEN lang = 'de' OR length(f) < 1 OR length(f) > 200 THEN 'id_length' END,
  CASE WHEN lang = 'es' THEN 'feed_key_pattern' END,
  CASE WHEN length(f) < 1 OR length(f) > 200 THEN 'title_length' END,
  CASE WHEN lang = 'de' THEN 'link_not_http_url' END,
  CASE WHEN length(f) > 50 THEN 'author_length' END,
  CASE WHEN length(text) > 2000 THEN 'summary_length' END,
  CASE WHEN lang = 'fr' THEN 'published_unparsable' END) AS violations
FROM (SELECT *, {first_line('text')} AS f FROM documents)
"""

SQL["enrichment_rules_broken"] = f"""
SELECT doc_id, concat_ws('|', {_KEY_BAD},
  CASE WHEN NOT regexp_matches(text, '^[a-zA-Z0-9_-]+$') THEN 'row_key_pattern' END,
  CASE WHEN length(text) > 2000 THEN 'summary_length' END,
  CASE WHEN NOT n_chars / 200 BETWEEN {fixed.GRADE_LEVEL_RANGE[0]} AND {fixed.GRADE_LEVEL_RANGE[1]} THEN 'grade_level_range' END,
  CASE WHEN NOT n_chars / 400 BETWEEN {fixed.DIFFICULTY_RANGE[0]} AND {fixed.DIFFICULTY_RANGE[1]} THEN 'difficulty_range' END,
  CASE WHEN NOT n_chars / 500 BETWEEN {fixed.ENGAGEMENT_SCORE_RANGE[0]} AND {fixed.ENGAGEMENT_SCORE_RANGE[1]} THEN 'engagement_score_range' END,
  CASE WHEN lang IN ('fr', 'de') THEN 'engagement_categories' END) AS violations
FROM documents
"""

SQL["post_rules_broken"] = """
SELECT partition_key, violations, count(*) AS n,
       count(*) FILTER (WHERE role = 'user' AND text <> '') AS n_keyed
FROM (
  SELECT role, text, CASE WHEN role = 'user' THEN '2025-02' END AS partition_key, concat_ws('|',
    CASE WHEN length(concat_ws(' ', conv_id, turn, text)) > 100 THEN 'title_length' END,
    CASE WHEN len(string_split(text, ' ')) > 10 THEN 'keywords_size' END,
    CASE WHEN length(text) < 1 OR length(text) > 10000 THEN 'content_length' END,
    CASE WHEN role <> 'user' THEN 'draft_status' END,
    CASE WHEN role <> 'user' THEN 'draft_date_unparsable' END,
    CASE WHEN role <> 'user' OR text = '' THEN 'row_key_missing' END) AS violations
  FROM conversations)
GROUP BY partition_key, violations
"""

SQL["content_rules_broken"] = """
SELECT doc_id, CASE WHEN lang = 'en' AND text <> '' THEN '' ELSE 'content_missing' END AS violations FROM documents
"""

SQL["upsert_duplicate_keys"] = """
WITH a AS (SELECT source, lang, max(doc_id) AS v FROM documents GROUP BY source, lang),
b AS (SELECT source, lang, max(n_chars) AS v FROM documents WHERE lang <> 'de' GROUP BY source, lang)
SELECT a.source AS partition_key, a.lang AS row_key, coalesce(b.v, a.v) AS last_doc, 'first' AS note
FROM a LEFT JOIN b ON a.source = b.source AND a.lang = b.lang
"""

SQL["feed_accounting"] = """
SELECT 'document' AS origin, 'item' AS outcome, count(*) AS n FROM documents HAVING count(*) > 0
UNION ALL SELECT 'page', 'document_unparsable', count(*) FROM pages HAVING count(*) > 0
"""


# ---------------------------------------------- sentences by statistics --
# Written out from the definitions: Dunning's ratios over plain counts.

_TOK = "[^" + WS[1:] + "+"
_EDGES = "^[\"''(\\[{«“‘¿¡*_]+|[\"'')\\]}»”’*_]+$"


def _ll(k, n, p):
    return (f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + "
            f"CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)")


_BOUNDARIES = f"""
texts AS MATERIALIZED (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
listed AS (SELECT text, regexp_extract_all(text, {sql_str(_TOK)}) AS a FROM texts),
raw AS (SELECT text, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS tok, unnest(list_concat(a[2:], [NULL])) AS nxt FROM listed WHERE len(a) > 0),
bare AS (SELECT text, pos, regexp_replace(tok, '{_EDGES}', '', 'g') AS core, regexp_replace(nxt, '{_EDGES}', '', 'g') AS after FROM raw),
toks AS MATERIALIZED (SELECT *, lower(regexp_replace(core, '[.,;:!?…]+$', '')) AS word,
                             lower(regexp_replace(after, '[.,;:!?…]+$', '')) AS next_word FROM bare),
counts AS MATERIALIZED (SELECT word, count(*) FILTER (core LIKE '%.') AS a, count(*) FILTER (core NOT LIKE '%.') AS b FROM toks GROUP BY word),
totals AS MATERIALIZED (SELECT sum(a + b) AS n, greatest(1e-9, least(1 - 1e-9, sum(a) / sum(a + b))) AS p FROM counts),
abbr AS MATERIALIZED (
  SELECT word FROM (SELECT *, length(replace(word, '.', '')) AS letters, length(word) - length(replace(word, '.', '')) + 1 AS periods FROM counts), totals
  WHERE a > 0 AND regexp_matches(word, '\\p{{L}}')
    AND -2.0 * ((a * ln(p) + b * ln(1 - p)) - (a * ln(0.99::DOUBLE) + b * ln(1 - 0.99::DOUBLE))) * exp(-letters) * periods * pow(letters, -b) >= 0.3),
sure AS MATERIALIZED (
  SELECT next_word AS word, count(*) AS k FROM toks
  WHERE regexp_matches(core, '[.!?]$') AND regexp_matches(next_word, '\\p{{L}}') AND word NOT IN (SELECT word FROM abbr) GROUP BY next_word),
rates AS (SELECT word, k, a + b AS c, n, h, (a + b) / n AS p, k / h AS p1, (a + b - k) / greatest(n - h, 1) AS p2
          FROM sure JOIN counts USING (word), totals, (SELECT sum(k) AS h FROM sure)),
starters AS MATERIALIZED (
  SELECT word FROM rates WHERE p1 > p2
    AND -2.0 * ({_ll('k', 'h', 'p')} + {_ll('(c - k)', '(n - h)', 'p')} - {_ll('k', 'h', 'p1')} - {_ll('(c - k)', '(n - h)', 'p2')}) >= 30),
ends AS MATERIALIZED (
  SELECT text, list(pos ORDER BY pos) AS ends FROM toks
  WHERE regexp_matches(core, '[.!?…]$') AND after IS NOT NULL AND CASE
    WHEN regexp_matches(core, '[!?]$') THEN true
    WHEN regexp_matches(core, '(\\.\\.|…)$') OR regexp_matches(word, '^[0-9]+$') THEN regexp_matches(after, '^\\p{{Lu}}')
    WHEN word IN (SELECT word FROM abbr) OR regexp_matches(word, '^\\p{{L}}$')
      THEN regexp_matches(after, '^\\p{{Lu}}') AND next_word IN (SELECT word FROM starters)
    ELSE true END
  GROUP BY text),
pieces AS (SELECT text, regexp_extract_all(text, {sql_str(_TOK + WS + '*')}) AS p, list_concat(coalesce(ends, []), [len(regexp_extract_all(text, {sql_str(_TOK)}))]) AS e
           FROM texts LEFT JOIN ends USING (text)),
split AS MATERIALIZED (
  SELECT text, list_filter(list_transform(range(1, len(e) + 1), lambda i:
           {sql_strip_ws("array_to_string(p[(CASE WHEN i > 1 THEN e[i - 1] ELSE 0 END) + 1:e[i]], '')")}), lambda s: s <> '') AS sentences
  FROM pieces)
""".replace("\\\\", "\\")

SQL["sentence_boundaries"] = f"""
WITH {_BOUNDARIES}
SELECT doc_id, CAST(coalesce(len(sentences), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ends, '|'), '') AS ends
FROM documents LEFT JOIN split USING (text) LEFT JOIN ends USING (text)
"""

SQL["truncate_by_boundaries"] = f"""
WITH {_BOUNDARIES},
joined AS (SELECT text, sentences, array_to_string(sentences[1:{fixed.MAX_SUMMARY_SENTENCES}], ' ') AS j FROM split),
fitting AS (SELECT text, sentences, j, [list_sum(list_transform(sentences[1:i], lambda s: length(s) + 1)) FOR i IN range(1, least(len(sentences), {fixed.MAX_SUMMARY_SENTENCES}) + 1)] AS upto
            FROM joined),
kept AS (SELECT *, len(list_filter(range(1, len(upto) + 1), lambda i: len(list_filter(upto[1:i], lambda u: u - 1 > {fixed.MAX_SUMMARY_CHARACTERS})) = 0)) AS k FROM fitting)
SELECT doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN '' WHEN length(j) > {fixed.MAX_SUMMARY_CHARACTERS}
         THEN {sql_strip_ws(f"regexp_replace(substring(j, 1, {fixed.MAX_SUMMARY_CHARACTERS}), {sql_str(chr(10) + '[^' + chr(10) + ']*$')}, '')")} ELSE j END AS truncated,
       {sql_strip_ws("array_to_string(sentences[1:k], ' ')")} AS by_sentences
FROM documents d LEFT JOIN kept USING (text)
"""

SQL["extractive_summary"] = rf"""
WITH {_BOUNDARIES},
sent AS MATERIALIZED (SELECT text, unnest(range(0, len(sentences))) AS s, unnest(sentences) AS sentence FROM split WHERE len(sentences) > 0),
tf AS MATERIALIZED (
  SELECT text, s, word, count(*) AS tf
  FROM (SELECT text, s, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+')) AS word FROM sent) GROUP BY text, s, word),
idf AS (SELECT word, CAST(floor(ln(1 + (SELECT count(*) FROM texts) / count(DISTINCT text)) * 1024) AS BIGINT) AS idf FROM tf GROUP BY word),
w AS MATERIALIZED (SELECT text, s, word, tf * idf AS w FROM tf JOIN idf USING (word)),
u AS MATERIALIZED (
  SELECT text, s, word, CAST(floor(w * 65536 / sqrt(sq)) AS BIGINT) AS u
  FROM w JOIN (SELECT text, s, CAST(sum(w * w) AS DOUBLE) AS sq FROM w GROUP BY text, s) USING (text, s)),
c AS (SELECT text, word, sum(u) AS c FROM u GROUP BY text, word),
score AS (SELECT text, s, sum(u * c) AS centrality FROM u JOIN c USING (text, word) GROUP BY text, s),
ranked AS (SELECT text, s, sentence, coalesce(centrality, 0) AS centrality, sum(coalesce(centrality, 0)) OVER (PARTITION BY text) AS mass,
                  row_number() OVER (PARTITION BY text ORDER BY coalesce(centrality, 0) DESC, s) AS rank
           FROM sent LEFT JOIN score USING (text, s)),
fit AS (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY text ORDER BY rank) - 1 AS n FROM ranked WHERE rank <= 3),
full_at AS (SELECT text, min(rank) AS full_at FROM fit WHERE n > {fixed.MAX_SUMMARY_CHARACTERS} AND rank > 1 GROUP BY text),
picked AS (SELECT text, string_agg(substring(sentence, 1, {fixed.MAX_SUMMARY_CHARACTERS}), ' ' ORDER BY s) AS summary,
                  CAST(1 + floor(CASE WHEN any_value(mass) > 0 THEN CAST(sum(centrality) AS DOUBLE) / CAST(any_value(mass) AS DOUBLE) ELSE 1 END * 9) AS INTEGER) AS score
           FROM fit LEFT JOIN full_at USING (text) WHERE rank < coalesce(full_at, 99) GROUP BY text)
SELECT doc_id, summary, score FROM documents LEFT JOIN picked USING (text)
"""

SQL["entry_enrichment_bucketed"] = SQL["entry_enrichment"]

# A step per check: errors in a row are the rows since the last good one.
SQL["feed_transitions"] = """
WITH l AS (
  SELECT 'https://feed' || CAST(user_id AS VARCHAR) || '.example.com/rss' AS feed_url, event_type, event_id, epoch_us(ts) AS us,
         event_type <> 'error' AS good FROM events),
n AS (SELECT *, row_number() OVER w AS i, max(CASE WHEN good THEN us END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good_us,
             lead(us) OVER w AS later, max(us) OVER () AS last_us
      FROM l WINDOW w AS (PARTITION BY feed_url ORDER BY us, event_id)),
f AS (SELECT *, CAST(i - coalesce(max(CASE WHEN good THEN i END) OVER (PARTITION BY feed_url ORDER BY i), 0) AS INTEGER) AS failures FROM n),
s AS (SELECT *, CASE WHEN NOT good AND failures <= 2 THEN us + CAST(86400000000 * pow(3.0, failures - 1) AS BIGINT) END AS next_us FROM f)
SELECT feed_url, us AS at_us, CASE WHEN good THEN CASE WHEN event_type <> 'view' AND us > coalesce(good_us, 0) THEN 'due' ELSE 'unchanged' END
                                   WHEN failures <= 2 THEN 'failed' ELSE 'gave_up' END AS event, failures, next_us FROM s
UNION ALL
SELECT feed_url, next_us, 'retry', failures, NULL FROM s WHERE next_us < coalesce(later, last_us)
"""

# The given pages hold no nested elements of a kind, so the ordered rules over a page
# with its white space folded are another way to what the fold makes of them.
SQL["page_markdown"] = f"""
SELECT page_id, {sql_html_to_markdown("regexp_replace(html, '[ ' || chr(9) || chr(10) || chr(12) || chr(13) || ']+', ' ', 'g')")} AS markdown FROM pages
"""

# The report's HTML written from the documents themselves, without Markdown.
SQL["post_html"] = r"""
WITH t AS (SELECT doc_id, coalesce(source, 'nowhere') AS source, coalesce(lang, 'none') AS lang,
                  regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'), ' ')), lambda s: s <> '') AS items FROM t),
u AS (SELECT *, '</li>' || chr(10) || '</ul>' || chr(10) AS up, '<ul>' || chr(10) || '<li>' AS down FROM l)
SELECT doc_id, '<h1>Document ' || doc_id || '</h1>' || chr(10) || '<blockquote>' || chr(10) || '<p>from <strong>' || source || '</strong>' || chr(10)
    || 'in <code>' || lang || '</code></p>' || chr(10) || '</blockquote>' || chr(10)
    || array_to_string(list_transform(items, lambda s, i: CASE WHEN i = 1 THEN down WHEN i % 3 = 1 THEN up || up || '</li>' || chr(10) || '<li>'
                                                               ELSE chr(10) || down END || s), '')
    || repeat(up, CASE WHEN len(items) = 0 THEN 0 ELSE (len(items) - 1) % 3 + 1 END)
    || '<ol>' || chr(10) || '<li><a href="http://h.example/' || doc_id || '">source</a></li>' || chr(10) || '<li>text' || chr(10) || '<pre><code>'
    || replace(replace(replace(replace(text, chr(9), '    '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    || chr(10) || '</code></pre>' || chr(10) || '</li>' || chr(10) || '</ol>' AS html_out
FROM u
"""


# ------------------------------------------------ polarity of words --

from .catalog import POLARITY_SEEDS  # noqa: E402

_SEEDS = {"p": ", ".join(map(sql_str, POLARITY_SEEDS[0])), "q": ", ".join(map(sql_str, POLARITY_SEEDS[1]))}


def _side(k, kk):
    seed = f"word IN ({_SEEDS[k]})"
    low = f"(CASE WHEN {seed} THEN {k} ELSE {k} - 2 * sqrt({k}) END)"
    ratio = (f"2 * ({_ll(k, kk, f'({k} / {kk})')} + {_ll(f'(n - {k})', f'(nn - {kk})', f'((n - {k}) / greatest(nn - {kk}, 1))')}"
             f" - {_ll(k, kk, '(n / nn)')} - {_ll(f'(n - {k})', f'(nn - {kk})', '(n / nn)')})")
    return f"""CASE WHEN {k} = 0 OR {low} <= 0 THEN 0 WHEN {low} * nn <= n * {kk} THEN 0
      WHEN {seed} OR (floor(log2({low} * nn / (n * {kk})) * 1024) >= 2048 AND {ratio} >= 10.83)
      THEN CAST(floor(log2({low} * nn / (n * {kk})) * 1024) AS BIGINT) ELSE 0 END"""


_POLAR = rf"""
stretches AS (SELECT lang, unnest(regexp_split_to_array(text, '[\r\n]+')) AS stretch FROM (SELECT DISTINCT lang, text FROM documents WHERE text IS NOT NULL)),
lists AS (SELECT lang, list_distinct(regexp_extract_all(lower(stretch), '\p{{L}}+')) AS words FROM stretches),
contexts AS MATERIALIZED (SELECT lang, words, list_has_any(words, [{_SEEDS['p']}]) AS p, list_has_any(words, [{_SEEDS['q']}]) AS q FROM lists WHERE len(words) > 0),
totals AS (SELECT lang, count(*) AS nn, count(*) FILTER (p) AS pp, count(*) FILTER (q) AS qq FROM contexts GROUP BY lang),
counts AS (SELECT lang, word, count(*) AS n, count(*) FILTER (p) AS p, count(*) FILTER (q) AS q
           FROM (SELECT lang, unnest(words) AS word, p, q FROM contexts) GROUP BY lang, word),
polar AS MATERIALIZED (
  SELECT * FROM (SELECT lang, word, {_side('p', 'pp')} - {_side('q', 'qq')} AS polarity FROM counts JOIN totals USING (lang) WHERE p > 0 OR q > 0) WHERE polarity <> 0)
"""

SQL["polarity_words"] = f"WITH {_POLAR} SELECT lang, word, polarity FROM polar"

SQL["polarity_sentiment"] = rf"""
WITH {_POLAR},
w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents),
m AS (SELECT doc_id, CAST(sum(greatest(polarity, 0)) AS BIGINT) AS p, CAST(sum(greatest(-polarity, 0)) AS BIGINT) AS n FROM w JOIN polar USING (lang, word) GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(p, 0) AS positive, coalesce(n, 0) AS negative, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END::DOUBLE AS score
      FROM documents LEFT JOIN m USING (doc_id))
SELECT doc_id, positive, negative, score,
       CASE WHEN positive + negative = 0 THEN 'Neutral' WHEN score > 0.2 THEN 'Positive' WHEN score < -0.2 THEN 'Negative' ELSE 'Mixed' END AS sentiment FROM s
"""

# Each form's result is written from the parts of the page's address; no segments are folded.
SQL["url_resolve"] = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+:') AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
                  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract_all(html, 'href="(/[^"/?#.]+)"', 1) AS links FROM pages),
l AS (SELECT *, unnest(links) AS h, unnest(range(0, len(links))) AS pos,
             CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS dir FROM p),
f AS (SELECT page_id, pos, unnest(range(0, 6)) AS form, unnest([
    origin || h, origin || dir || substring(h, 2), origin || regexp_replace(dir, '[^/]+/$', '') || substring(h, 2), origin || dir || substring(h, 2),
    scheme || '//cdn.example.org' || h, origin || path || '?q=1']) AS resolved FROM l)
SELECT page_id, pos, form, resolved FROM f
"""

SQL["npy_roundtrip"] = """
SELECT vec_id, 128 + 4 * len(embedding) AS n_bytes, unnest(range(0, len(embedding))) AS pos, unnest(embedding::FLOAT[])::DOUBLE AS x FROM embeddings
"""

SQL["feed_bytes"] = f"""
SELECT doc_id, true AS parsed, doc_id AS item_id, {first_line('text')} AS title, {ENTRY_LINK} AS link, text, concat_ws('|', lang, source) AS categories FROM documents
"""
