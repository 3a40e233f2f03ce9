"""The same results in DuckDB SQL, for the text queries that SQL can express."""

_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_AZ}', '{_LOW}') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM parts)),
shared AS (SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE least < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE least IS NULL OR least >= doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY doc_id
"""

DECONTAMINATION = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[pos:pos + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS pos FROM iw WHERE len(ws) > 0)),
grams AS (
  SELECT doc_id, pos, n, array_to_string(ws[pos:pos + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
found AS (SELECT doc_id, pos, n, item_id FROM grams JOIN windows USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _escapes(x: str) -> str:
    return (
        f"length({x}) - length(replace({x}, '\\', '')) + (length({x}) - length(replace({x}, '</turn>', ''))) // 7 "
        f"+ coalesce(list_sum([length(h) - 2 for h in regexp_extract_all({x}, '###+')]), 0)"
    )


CHAT_FORMAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(cast(sum(length(text)) FILTER (WHERE role = 'assistant') AS bigint), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(14 + length(role) + length(text) + {_escapes('text')}
                + {_escapes('role')} + length(role) - length(replace(role, ':', ''))) AS bigint) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _mixing(powers: dict[str, float], bins: int, rounds: int, near: float, step: float) -> str:
    """Raking as a recursion over the table of cells, one round a step, and the nearest probability of each cell."""
    axes = list(powers)
    cell = ", ".join(axes)
    aims = ", ".join(f"aim_{a} AS (SELECT {a}, sum(tokens) AS held, power(sum(tokens), {p}) / sum(power(sum(tokens), {p})) OVER () AS aim FROM cells GROUP BY {a})" for a, p in powers.items())
    largest = ", ".join(f"(SELECT min(held / aim) FROM aim_{a} WHERE aim > 0)" for a in axes)
    sql = f"SELECT {cell}, tokens, keep, goal, round, w, 0.0 AS off FROM raked WHERE NOT done"
    for a in axes:
        sql = f"""SELECT {cell}, tokens, keep, goal, round, least(tokens, CASE WHEN now > 0 THEN w * (aim * goal / now) ELSE 0 END) AS w, greatest(off, max(abs(now - aim * goal)) OVER () / goal) AS off
          FROM (SELECT c.*, sum(w) OVER (PARTITION BY {a}) AS now, aim FROM ({sql}) c JOIN aim_{a} USING ({a}))"""
    return rf"""
WITH RECURSIVE marked AS (
  SELECT doc_id, text, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
         CASE WHEN regexp_matches(text, '[Ll]icense|LICENSE|[Cc]opyright|COPYRIGHT') THEN 'legal' WHEN regexp_matches(text, '@|https?://|www\.') THEN 'web'
              WHEN regexp_matches(text, '[0-9]{{3}}') THEN 'figures' ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
         cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), text, '')), 1, 8) AS bigint) / 4294967296.0 AS u
  FROM documents),
cells AS (SELECT {cell}, cast(sum(n_tokens) AS bigint) AS tokens FROM marked GROUP BY {cell}),
{aims},
first AS (SELECT least({largest}) / sum(tokens) AS keep, sum(tokens) AS total FROM cells),
raked AS (
  SELECT {cell}, tokens, keep, keep * total AS goal, 0 AS round, tokens * keep AS w, false AS done FROM cells, first
  UNION ALL
  SELECT {cell}, tokens, CASE WHEN again THEN keep * {step} ELSE keep END, CASE WHEN again THEN goal * {step} ELSE goal END, CASE WHEN again THEN 0 ELSE round + 1 END,
         CASE WHEN again THEN tokens * keep * {step} ELSE w END, off <= {near} OR (round + 1 >= {rounds} AND NOT again)
  FROM (SELECT *, off > {near} AND round + 1 >= {rounds} AND bool_or(tokens > 0 AND w >= tokens) OVER () AS again FROM ({sql}))),
weights AS (SELECT {cell}, tokens, w FROM raked WHERE done),
steps AS (SELECT {cell}, cast(floor(u * {bins}) AS bigint) AS step, sum(n_tokens) AS t FROM marked GROUP BY ALL),
chances AS (
  SELECT {cell}, (step + 1) / {bins}.0 AS p, sum(t) OVER (PARTITION BY {cell} ORDER BY step) AS drawn FROM steps
  UNION ALL SELECT {cell}, 0.0, 0 FROM cells UNION ALL SELECT {cell}, 1.0, tokens FROM cells),
chance AS (
  SELECT {cell}, CASE WHEN tokens > 0 THEN p ELSE 1.0 END AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY abs(drawn - w), p DESC) AS k FROM chances JOIN weights USING ({cell})) WHERE k = 1)
SELECT doc_id, {cell}, n_tokens, cast(p AS double) AS p, u < p AS sampled
FROM marked JOIN chance USING ({cell})
"""


MIXING = _mixing({"source": 0.5, "lang": 0.7, "topic": 0.5}, 1024, 60, 1e-4, 0.98)
