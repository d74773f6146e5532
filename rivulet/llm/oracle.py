"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .queries import LISTED_NAMES

SQL: dict[str, str] = {}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op1_url_filter"] = rf"""
WITH u AS (
  SELECT page_id, url, coalesce(position('://' IN url), 0) > 0 AS ok,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    nullif(regexp_extract(host, '(^|\.)(({"|".join(LISTED_NAMES)})(\..*)?)$', 2), '') AS listed_key
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed_key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       listed_key
FROM r
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
spots AS (SELECT doc_id, i, n, w[i:i + n - 1] AS x
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM spots s JOIN win ON s.x = win.x),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _lloyd_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out; vectors of parts x width components."""
    far = " + ".join(f"(v.x[{i}] - b.c[{i}]) * (v.x[{i}] - b.c[{i}])" for i in range(1, width + 1))
    floors = ", ".join(f"CAST((s{i} - ((s{i} % n) + n) % n) // n AS BIGINT)" for i in range(1, width + 1))
    sums = ", ".join(f"sum(x[{i}]) AS s{i}" for i in range(1, width + 1))
    out = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, label, p, x[p * {width} + 1:p * {width} + {width}] AS x FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM v WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, any_value(v.x) AS x, min((d, e)) AS best
  FROM (SELECT v.r, v.p, v.x, b.e, {far} AS d FROM v JOIN b{k} b ON v.p = b.p) v GROUP BY r, p)""")
        if k < rounds:
            out.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, e, [{floors}] AS c FROM (SELECT p, best[2] AS e, count(*) AS n, {sums} FROM a{k} GROUP BY p, best[2])) m ON b.p = m.p AND b.e = m.e)""")
    out.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return ",\n".join(out) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


SQL["op11_vector_codes"] = _lloyd_sql()

SQL["op12_substring_dedup"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT x, min(doc_id) AS first FROM spots GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spots JOIN low USING (x) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
stays AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
          FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN stays USING (doc_id)
"""
