"""SQL for the check engine, where it can express an operator."""

from __future__ import annotations

from kerbline.llm import secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(pattern: str, group: int, condition: str, kind: str, nth: int) -> str:
    """Rows ``doc, s, e, kind, nth`` of a pattern's matches: places from the lengths of matches and of what lies between."""
    p = _text(pattern)
    return f"""
    SELECT doc, s, s + length(w) AS e, '{kind}' AS kind, {nth} AS nth FROM (
      SELECT doc, whole[i] AS w, value[i] AS v,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc, whole, value, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT doc, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS value
        FROM d WHERE regexp_matches(t, {p}))))
    WHERE {condition}"""


def _bound(expression: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({expression}, '{pattern}') THEN {secrets._bound(bits)}" for _, pattern, bits in secrets.CLASSES[:-1])
    return f"CASE {cases} ELSE {secrets._bound(secrets.CLASSES[-1][2])} END"


def secret_spans() -> str:
    w = secrets.WINDOW
    terms = "[" + ", ".join(map(str, secrets._TERMS)) + "]"
    least = f"""list_min(list_transform(range(1, length(w) - {w - 2}), lambda o: list_sum(list_transform(list_distinct(string_split(substr(w, o, {w}), '')),
        lambda c: {terms}[{w} - length(replace(substr(w, o, {w}), c, '')) + 1]))))"""
    # RE2 has no back references: eight equal characters in a row are spelled out by code.
    runs = "(" + "|".join(f"{'[+]' if c == '+' else c}{{8}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-") + ")"
    allowed = [a.replace("(.)\\1{7}", runs) for a in secrets.ALLOWED]
    worth = " AND ".join(["regexp_matches(w, '[0-9]')", "regexp_matches(w, '[A-Za-z]')", *(f"NOT regexp_matches(w, {_text(a)})" for a in allowed)])
    base = "\n    UNION ALL".join(_spans(p, g, f"length(v) >= {n}", k, i) for i, (k, p, g, n) in enumerate(secrets.BASE, 1))
    more = _spans(secrets.CANDIDATE, 0, f"{worth} AND {least} <= {_bound('w')}", "entropy", 4)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({base}),
    more AS ({more}),
    every AS (SELECT * FROM base UNION ALL
              SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = m.doc AND b.s < m.e AND m.s < b.e)),
    listed AS (SELECT doc, count(*) FILTER (nth = 1) AS n_assign, count(*) FILTER (nth = 2) AS n_access, count(*) FILTER (nth = 3) AS n_hex,
                      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 4) AS base,
                      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans
               FROM every GROUP BY doc)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN listed USING (doc)"""


def prefix_trie() -> str:
    """Nodes by their lists of turns; CRC-32 bit by bit, as the check engine has no function for it."""
    crc = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: 0::UBIGINT)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"""
    return f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, CAST({crc} % 9 AS BIGINT) AS h, conv_id - conv_id % 5 AS lender FROM (SELECT DISTINCT conv_id FROM t)),
    rebuilt AS (SELECT c.conv_id, 0 AS part, t.place, role, text FROM c JOIN t ON t.conv_id = c.lender AND place <= h
                UNION ALL SELECT c.conv_id, 1, t.place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
    numbered AS (SELECT conv_id, row_number() OVER w AS depth, text, list(struct_pack(r := role, t := text)) OVER (w ROWS UNBOUNDED PRECEDING) AS p
                 FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
    member AS (SELECT conv_id, depth, p, strlen(text) AS bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM numbered
               UNION ALL SELECT conv_id, 0, [], 0, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.conv_id = c.conv_id) FROM c),
    node AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
             FROM member GROUP BY depth, p),
    of AS (SELECT m.conv_id AS member, m.depth, n.conv_id AS node FROM member m JOIN node n ON n.depth = m.depth AND n.p = m.p),
    parent AS (SELECT n.conv_id, n.depth, o.node AS parent FROM node n JOIN of o ON o.member = n.conv_id AND o.depth = n.depth - 1),
    child AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM parent GROUP BY 1, 2),
    below AS (SELECT o.node AS conv_id, o.depth, count(*) FILTER (ch.n IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
              FROM node n JOIN of o ON o.member = n.conv_id AND o.depth <= n.depth LEFT JOIN child ch ON ch.conv_id = n.conv_id AND ch.depth = n.depth GROUP BY 1, 2)
    SELECT conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(child.n, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
    FROM node JOIN below USING (conv_id, depth) LEFT JOIN parent USING (conv_id, depth) LEFT JOIN child USING (conv_id, depth)"""


def collocations(least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100) -> str:
    counted = " UNION ALL ".join(f"SELECT lang, {n} AS m, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM pieces, unnest(range(1, len(w) - {n - 2})) AS u(i)" for n in range(1, longest + 1))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
           SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    counts AS (SELECT lang, m, phrase, count(*) AS f FROM ({counted}) GROUP BY ALL HAVING count(*) >= {least}),
    sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    many AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
    cuts AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
             FROM (SELECT *, unnest(range(1, m)) AS k FROM many) c
             JOIN counts x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(w[1:k], ' ')
             JOIN counts y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(w[k + 1:], ' ') JOIN sizes s ON s.lang = c.lang),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
    held AS (SELECT lang, n AS m, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most
             FROM many, unnest(range(2, {longest})) AS u(n), unnest(range(1, {longest} + 1)) AS v(i) WHERE n < many.m AND i + n - 1 <= many.m GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest LEFT JOIN held USING (lang, m, phrase) WHERE most IS NULL OR 100 * most < {inside} * a
    QUALIFY rank <= {top}"""
