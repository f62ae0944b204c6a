"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessella.llm.pii import CONTEXT

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Kind, rank, pattern and the check on a match ``m`` (``d``: its digits; ``c``: without spaces; ``around``: the text nearby).
_LUHN = "list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[-i] AS INTEGER) ELSE (CAST(d[-i] AS INTEGER) * 2) // 10 + (CAST(d[-i] AS INTEGER) * 2) % 10 END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1 AS BIGINT))), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1"
_KINDS = (
    ("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    ("ip", 1, "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INTEGER) > 255)) = 0"),
    ("card", 2, "[0-9](?:[\\x20-]?[0-9])+", f"CASE WHEN length(d) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"),
    ("phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15"),
    ("iban", 4, "\\b[A-Z][A-Z][0-9][0-9](?:\\x20?[A-Z0-9]){11,30}\\b", f"length(c) BETWEEN 15 AND 34 AND {_MOD97}"),
    ("ssn", 5, "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", "NOT regexp_matches(m, '^(?:000|666|9[0-9][0-9])|^[0-9]{3}-00|0000$') AND regexp_matches(lower(around), '(?:^|[^\\pL])(?:ssn|social|security)(?:[^\\pL]|$)')"),
)


def _spans(kind: str, rank: int, pattern: str, check: str) -> str:
    """All matches of a kind with their places; starts add up the pieces between matches and the matches before."""
    return f"""SELECT r, '{kind}' AS kind, {rank} AS rank, s AS start, s + length(m) AS stop, regexp_matches(lower(around), '(?:^|[^\\pL])(?:{CONTEXT[kind]})(?:[^\\pL]|$)') AS near FROM (
        SELECT r, m, s, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c, substr(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(t, s + length(m) + 1, 40) AS around FROM (
            SELECT r, t, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
                SELECT r, t, ms, gs, unnest(generate_series(1, len(ms))) AS i FROM (
                    SELECT r, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)))) WHERE {check}"""


_N_KINDS = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k, *_ in _KINDS)
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in _KINDS)

ORACLES: dict[str, str] = {
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
               FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
               FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT r, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op6_line_dedup": """
        WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        e AS (SELECT r, doc_id, source, text, p, l[p] AS line, trim(l[p], ' ' || chr(9) || chr(13)) AS bare FROM (SELECT *, unnest(generate_series(1, len(l))) AS p FROM d)),
        lines AS (SELECT bare, min(doc_id) AS first, min_by(text, doc_id) AS first_text, count(DISTINCT source) >= 3 AS wide,
                         len(string_split_regex(bare, '[ \\t\\x0B\\f\\r]+')) > 50 AND min(text) < max(text) AS repeated FROM e WHERE bare <> '' GROUP BY bare),
        m AS (SELECT e.*, coalesce(e.doc_id > l.first AND (l.wide OR (l.repeated AND e.text <> l.first_text)), false) AS gone FROM e LEFT JOIN lines l USING (bare)),
        t AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS clean FROM m GROUP BY r)
        SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE n END AS INTEGER) AS n_lines, CAST(g AS INTEGER) AS n_removed,
               CASE WHEN text IS NULL THEN NULL ELSE sha256(clean) END AS text_sha256
        FROM d JOIN t USING (r)""",
    "op9_url_filter": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS p FROM pages),
        r AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM r),
        rules(v, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fit AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
                FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN starts_with(md5(host), '0') THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN fit USING (page_id)""",
    "op4_chat": """
        WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, t, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
        e AS (SELECT *, length(role) + length(regexp_replace(role, '[^' || chr(92) || chr(92) || '<:#]', '', 'g')) AS nr,
                     length(text) + length(regexp_replace(text, '[^' || chr(92) || chr(92) || '<:#]', '', 'g')) AS nt FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(nr + nt + 20) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op1_pii": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
        spans AS ({" UNION ALL ".join(_spans(*k) for k in _KINDS)}),
        g AS (SELECT r, {_COUNTS}, count(*) FILTER (WHERE near) AS n_context, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
                     string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base FROM spans GROUP BY r)
        SELECT doc_id, {_N_KINDS}, CAST(coalesce(n_context, 0) AS BIGINT) AS n_context, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        walk AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT id, b FROM walk JOIN links ON reached = a),
        c AS (SELECT id, min(reached) AS component_id FROM walk GROUP BY id),
        n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id""",
    "op12_filter_audit": """
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
        m AS (SELECT r, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                     || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails,
                     EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS bad
              FROM d JOIN firsts USING (text)),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM m GROUP BY part, fails),
        o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE NOT contains(filter_order, f)),
        s AS (SELECT filter_order, step, filter_order[step] AS f, substr(filter_order, 1, step - 1) AS before FROM o, generate_series(1, 5) AS g(step) WHERE length(filter_order) = 5),
        e AS (SELECT part, filter_order, step, n, good, bad, fails, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '0]') AS gone, fails = f AS alone FROM c, s)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (WHERE hit), 0) AS BIGINT) AS shapley
        FROM e GROUP BY part, filter_order, step""",
}
