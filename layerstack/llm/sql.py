"""DuckDB SQL of queries whose rules SQL can express, for comparison on the same tables."""

from __future__ import annotations

BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
POLYNOMIAL = 0xEDB88320


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


def crc32(text: str) -> str:
    """Checksum of a string expression's UTF-8 bytes, a table look-up for each byte."""
    table = "[" + ", ".join(map(str, _crc_table())) + "]::BIGINT[]"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 8, ({table})[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


def conversation_repair() -> str:
    """Damage, faults, the least costs from each row to the end, and the walk that takes the first cheapest edit."""
    def choice(q: str, keep: str, then: str) -> str:
        """Costs from a row on in state q without inserting: delete, keep or rerole."""
        return (
            f"least(3 + v{q}, CASE WHEN gone THEN 1000000000 ELSE least("
            f"{keep}, 2 + cut + v{then}) END)"
        )

    stays = lambda initial, then: f"CASE WHEN a = '{initial}' THEN cut + v{then} ELSE 1000000000 END"
    b0 = choice("0", f"CASE WHEN a = 's' THEN cut + v1 WHEN a = 'u' THEN cut + v2 ELSE 1000000000 END", "2")
    b1, b2, b3 = choice("1", stays("u", 2), "2"), choice("2", stays("a", 3), "3"), choice("3", stays("u", 2), "2")
    # By state: what can come next, and its role.
    then, role = "CASE q WHEN 2 THEN 3 ELSE 2 END", "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
    at = lambda state, name: f"list_extract({name}, {state} + 1)"
    kept = f"CASE WHEN q = 0 AND a = 's' THEN 1 ELSE {then} END"
    fits = f"(q = 0 AND a = 's' OR a = left({role}, 1))"
    return f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM r)),
o AS (
  SELECT *, left(role, 1) AS a, rtrim(text, {BLANKS}) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (
  SELECT conv_id, turn, role, text, a, i, body = '' AS blank, body <> '' AND again AS duplicate,
    body = '' OR again AS gone,
    (body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?'))::INT AS cut,
    lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM g),
s AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
costs AS (
  SELECT conv_id, n + 1 AS i, 0 AS v0, 4 AS v1, 2 AS v2, 0 AS v3 FROM s
  UNION ALL
  SELECT conv_id, i, least(b0, 2 + least(b2, 2 + b3)), least(b1, 2 + least(b2, 2 + b3)),
    least(b2, 2 + b3), least(b3, 2 + b2)
  FROM (SELECT c.conv_id, f.i, {b0} AS b0, {b1} AS b1, {b2} AS b2, {b3} AS b3
    FROM costs c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i - 1)),
rows_ AS (
  SELECT c.conv_id, c.i, [c.v0, c.v1, c.v2, c.v3] AS here, [e.v0, e.v1, e.v2, e.v3] AS after,
    f.role, f.text, f.a, f.gone, f.cut
  FROM costs c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i
    LEFT JOIN costs e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i + 1),
walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS out, false AS done FROM s
  UNION ALL
  SELECT conv_id, CASE WHEN edit IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
    CASE edit WHEN 'I' THEN {then} WHEN 'R' THEN {then} WHEN 'K' THEN {kept} ELSE q END,
    audit || coalesce(edit, ''),
    CASE edit WHEN 'I' THEN list_append(out, {role} || ':') WHEN 'R' THEN list_append(out, {role} || ':' || text)
      WHEN 'K' THEN list_append(out, role || ':' || text) ELSE out END,
    edit IS NULL
  FROM (SELECT w.*, x.role, x.text, x.a,
      CASE WHEN gone IS NOT NULL AND {at('q', 'here')} = 3 + {at('q', 'after')} THEN 'D'
        WHEN {at('q', 'here')} = 2 + {at(then, 'here')} THEN 'I'
        WHEN NOT gone AND {fits} AND {at('q', 'here')} = cut + {at(kept, 'after')} THEN 'K'
        WHEN gone IS NOT NULL THEN 'R' END AS edit
    FROM walk w JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i WHERE NOT w.done)),
e AS (SELECT conv_id, length(audit) AS n, audit, sha256(array_to_string(out, chr(10))) AS sha FROM walk WHERE done),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank,
  coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(c.v0, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit,
  coalesce(e.sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id AND c.i = 1
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def spelling_variants() -> str:
    """Counts of words, and near words by what is left when one character is taken out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE t AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
    translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run
  FROM documents),
g AS (SELECT doc, run, count(*) AS m FROM t GROUP BY doc, run),
h AS (SELECT run, m, {crc32("doc || ':' || run")} AS h FROM g),
w AS (
  SELECT word, sum(m)::BIGINT AS n
  FROM (SELECT m, CASE WHEN h % 97 = 0
      THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  GROUP BY word HAVING length(word) >= 5 AND sum(m) >= 3),
x AS (
  SELECT word, n, place, left(word, place) || substr(word, place + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word)))::INT AS place FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b USING (place, rest) WHERE a.word <> b.word
  UNION
  SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.rest
  UNION
  SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.rest),
b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS form_n, arg_min(near, (-near_n, near)) AS form
  FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
c AS (
  SELECT word, word AS root, form AS further FROM f
  UNION ALL
  SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.further IS NULL"""
