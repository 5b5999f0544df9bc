"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY digest) AS keep_id,
       count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY digest) AS kept,
       digest AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents)
"""

# Runs are compared as whole strings; the shortest runs come from sums over every start and end.
LINE_DEDUP = """
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents),
lines AS (
  SELECT doc_id, line, content, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p,
         len(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, i - 1 AS line, trim(cut[i], e' \\t\\n\\r\\f\\v') AS content
        FROM (SELECT doc_id, cut, unnest(range(1, len(cut) + 1)) AS i FROM texts))
  WHERE content <> ''),
sequences AS (
  SELECT doc_id, list(content ORDER BY p) AS content, list(words ORDER BY p) AS words, max(p) AS n FROM lines GROUP BY doc_id),
ends AS (
  SELECT l.doc_id, l.p AS s, list_position(list_transform(range(1, least(n - p + 1, 10) + 1),
         lambda k: list_sum(s.words[l.p : l.p + k - 1]) >= 10), true) AS size FROM lines l JOIN sequences s USING (doc_id)),
starts AS (
  SELECT l.doc_id, l.p AS e, list_position(list_transform(range(1, least(p, 10) + 1),
         lambda k: list_sum(s.words[l.p - k + 1 : l.p]) >= 10), true) AS size FROM lines l JOIN sequences s USING (doc_id)),
runs AS (
  SELECT doc_id, s, size FROM ends WHERE size IS NOT NULL
  UNION SELECT doc_id, e - size + 1, size FROM starts WHERE size IS NOT NULL),
placed AS (
  SELECT doc_id, r.s, size, array_to_string(content[r.s : r.s + size - 1], chr(10)) AS run FROM runs r JOIN sequences USING (doc_id)),
copies AS (
  SELECT doc_id, unnest(range(s, s + size)) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM placed) WHERE copy > 1),
gone AS (SELECT DISTINCT doc_id, line FROM copies JOIN lines USING (doc_id, p)),
removed AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(len(gone), 0)::INTEGER AS n_removed,
       array_to_string(list_transform(list_filter(range(1, len(cut) + 1),
         lambda i: NOT list_contains(coalesce(gone, []), i - 1)), lambda i: cut[i]), chr(10)) AS text
FROM texts LEFT JOIN removed USING (doc_id)
"""

# Levels of the tree from the top, with the fixed weights of op5.
_LEVELS = ("domain", "lang", "source")


def mixing(weights: dict[str, dict[str, int]], max_epochs: int, seed: int, fraction: float) -> str:
    """Budgets level by level with window functions, then prefixes in hash order."""
    parts = ["""
base AS (
  SELECT doc_id, n_tokens, lang, source, CASE WHEN number IS NULL THEN 'other'
         WHEN number % 3 = 0 THEN 'web' WHEN number % 3 = 1 THEN 'books' ELSE 'forum' END AS domain
  FROM (SELECT doc_id, coalesce(lang, '(missing)') AS lang, coalesce(source, '(missing)') AS source,
               try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS number,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
        FROM documents))""", """
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM base GROUP BY ALL)""", f"""
b0 AS (SELECT floor(sum(supply) * {fraction})::BIGINT AS budget FROM leaves)"""]
    for depth in range(1, len(_LEVELS) + 1):
        path, name = ", ".join(_LEVELS[:depth]), _LEVELS[depth - 1]
        above = ", ".join(_LEVELS[: depth - 1])
        family = f"PARTITION BY {above}" if above else ""
        named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(name, {}).items())
        weight = f"CASE {name} {named} ELSE 1 END" if named else "1"
        joined = f"JOIN b{depth - 1} USING ({above})" if above else "CROSS JOIN b0"
        parts.append(f"""
c{depth} AS (
  SELECT *, cap::DOUBLE * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= weight::DOUBLE * (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM (SELECT {path}, (sum(supply) * {max_epochs})::BIGINT AS cap, {weight} AS weight FROM leaves GROUP BY {path}) {joined}
  WINDOW w AS ({family} ORDER BY cap / weight, {name})),
b{depth} AS (
  SELECT {path}, CASE WHEN filled THEN cap
         ELSE weight * (budget - coalesce(sum(cap) FILTER (filled) OVER ({family}), 0))
              // sum(weight) FILTER (NOT filled) OVER ({family}) END::BIGINT AS budget
  FROM c{depth})""")
    return "WITH " + ",".join(parts) + f""",
shares AS (SELECT domain, lang, source, budget // supply AS whole, budget % supply AS rest
           FROM b{len(_LEVELS)} JOIN leaves USING (domain, lang, source) WHERE supply > 0 AND budget > 0),
placed AS (
  SELECT *, ('0x' || substr(md5('{seed}:' || whole || ':' || doc_id), 1, 13))::BIGINT AS place
  FROM base JOIN shares USING (domain, lang, source)),
ordered AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before
  FROM placed WHERE rest > 0)
SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens
FROM (SELECT *, unnest(range(whole)) AS epoch FROM placed WHERE whole > 0)
UNION ALL
SELECT doc_id, domain, lang, source, whole, n_tokens FROM ordered WHERE before < rest
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Windows are compared as whole strings with every run of as many document words.
DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS content
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS content
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, n, item_id FROM runs JOIN windows USING (n, content)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def vector_codes(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """All distances of all parts to all entries, in every round."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)),
book0 AS (
  SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST) - 1 AS e FROM parts) WHERE e < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best
  FROM (SELECT r, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
        FROM parts JOIN book{k} USING (p)) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS m FROM (
      SELECT p, best.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m
      FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e) USING (p, e))""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, byte by byte; the table follows from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    step = f"lambda c, x: xor(c >> 8, list_extract({table}::BIGINT[], (xor(c, x) & 255) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295)"


def _edits() -> str:
    """Ways over one row as ``(role, deleted, truncated, before, after, cost, edits)``: up to two inserted turns, then one edit."""
    expected = ["u", "u", "a", "u"]  # after nothing, a system, a user and an assistant turn
    reached = {"u": 2, "a": 3}
    found = []
    for role in "suax":
        for deleted, truncated in ((0, 0), (0, 1), (1, 0)):
            for before in range(4):
                at = before
                for inserted in range(3):
                    stay, edits, cost = 3 * truncated, "I" * inserted, 3 * inserted
                    found.append((role, deleted, truncated, before, at, cost + 4, edits + "D"))
                    if not deleted:
                        found.append((role, deleted, truncated, before, reached[expected[at]], cost + 3 + stay, edits + "R"))
                        if role == expected[at] or (role == "s" and at == 0):
                            found.append((role, deleted, truncated, before, reached.get(role, 1), cost + stay, edits + "K"))
                    at = reached[expected[at]]
    return ", ".join(map(str, found))


CONVERSATION_REPAIR = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
changed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract_all(text, '[^\\x20\\x09-\\x0D]')[-1] AS last FROM changed),
first_faults AS (
  SELECT *, last IS NULL AS blank, last IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM placed),
rows_ AS (
  SELECT *, NOT blank AND NOT duplicate AND last NOT IN ('.', '!', '?') AS truncated,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM first_faults),
ways(role, deleted, cut, before, after, cost, edits) AS (VALUES {_edits()}),
paths AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM rows_
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit FROM (
    SELECT p.conv_id, p.i + 1 AS i, w.after AS state, min(struct_pack(cost := p.cost + w.cost, audit := p.audit || w.edits)) AS best
    FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN ways w ON w.role = r.initial AND w.deleted = (r.blank OR r.duplicate)::INT AND w.cut = r.truncated::INT AND w.before = p.state
    GROUP BY ALL)),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (former IS NOT NULL AND former || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
solved AS (
  SELECT p.conv_id, min(struct_pack(cost := cost + e.extra, audit := audit || e.edits)) AS best
  FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
  JOIN (VALUES (0, 0, ''), (1, 6, 'II'), (2, 3, 'I'), (3, 0, '')) AS e(state, extra, edits) ON e.state = p.state GROUP BY p.conv_id),
edits AS (
  SELECT conv_id, k, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS made
  FROM (SELECT conv_id, k, best.audit[k] AS edit FROM (SELECT conv_id, best, unnest(range(1, len(best.audit) + 1)) AS k FROM solved))
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (
  SELECT e.conv_id, e.k, e.edit, e.made, r.role, r.text,
         max(CASE WHEN e.made = 1 AND e.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
  FROM edits e JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = greatest(e.i, 1) WHERE e.edit <> 'D'),
turns AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (made - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op5_source_mixing": mixing({"domain": {"web": 2, "books": 1, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}, 4, 20, 1.0),
    "op8_exact_dedup": EXACT_DEDUP,
    "op11_conversation_repair": CONVERSATION_REPAIR,
    "op12_benchmark_decontamination": DECONTAMINATION,
    "op13_vector_codes": vector_codes(),
}
