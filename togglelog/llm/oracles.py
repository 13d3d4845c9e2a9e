"""DuckDB SQL with the results of the registered queries, where SQL can express them."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

LINE_FREQUENCY = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT r, doc_id, source, text, {WORDS.format("text")} AS words FROM d
), grams AS (
    SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), often AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM grams) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY r
), lines AS (
    SELECT r, source, line, i, array_to_string({WORDS.format("regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g')")}, ' ') AS norm
    FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
), full_lines AS (
    SELECT * FROM lines WHERE norm <> ''
), dups AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r
), hosts AS (
    SELECT source, count(*) AS host_docs FROM d GROUP BY source
), common AS (
    SELECT c.source, c.norm
    FROM (SELECT source, norm, count(DISTINCT r) AS n FROM full_lines GROUP BY source, norm) c
    JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE c.n > 50 OR (c.n >= 10 AND 1000 * c.n > 50 * h.host_docs)
), removed AS (
    SELECT r, count(*) AS n, sum(len(string_split(l.norm, ' '))) AS words
    FROM full_lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm GROUP BY r
), counted AS (
    SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
        length(array_to_string(w.words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(u.n, 0)::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(f.n, 0)::BIGINT AS n_lines,
        coalesce(m.n, 0)::BIGINT AS n_removed_lines,
        (len(w.words) - coalesce(m.words, 0))::BIGINT AS n_left_words
    FROM w LEFT JOIN covered c USING (r) LEFT JOIN dups u USING (r) LEFT JOIN removed m USING (r)
    LEFT JOIN (SELECT r, count(*) AS n FROM full_lines GROUP BY r) f USING (r)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_left_words >= 50 AND 100 * n_left_words >= 50 * n_words AS kept FROM judged
"""

MIXTURE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sized AS (
    SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        greatest(coalesce(power(length(translate(text, '#*$%&|<>{}[]=_~^@\0123456789', ''))::DOUBLE
            / nullif(length(text), 0), 2), 0), 0.01) AS weight,
        (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
    FROM d
), keyed AS (
    SELECT doc_id, source, size, -ln(u) / weight AS k FROM sized
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source
), turns AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM sums
), levels AS (
    SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
        / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
    FROM turns
    WINDOW b AS (ORDER BY cap::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cuts AS (
    SELECT level AS cut FROM levels WHERE level <= cap::DOUBLE / w ORDER BY cap::DOUBLE / w, source IS NULL, source LIMIT 1
), targets AS (
    SELECT source, source_size,
        CASE WHEN c.cut IS NULL OR cap::DOUBLE / w < c.cut THEN cap::DOUBLE ELSE w * c.cut END AS target
    FROM levels LEFT JOIN cuts c ON true
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), units AS (
    SELECT doc_id, k.source, size, k, count(*) * size AS unit, any_value(target - epochs * b.source_size) AS budget
    FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source GROUP BY doc_id, k.source, size, k
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size) AS place FROM units WHERE budget > 0
), starts AS (
    -- what is left of a source's budget, and the last place that has been looked at
    SELECT source, max(budget) AS gap, 0::BIGINT AS place, 0 AS step FROM placed GROUP BY source
    UNION ALL
    SELECT source, gap - coalesce(max(CASE WHEN upto <= gap THEN upto END), 0), min(CASE WHEN upto > gap THEN place END), step + 1
    FROM (
        SELECT s.source, s.gap, s.step, u.place, sum(u.unit) OVER (PARTITION BY s.source ORDER BY u.place ROWS UNBOUNDED PRECEDING) AS upto
        FROM starts s JOIN placed u ON s.source IS NOT DISTINCT FROM u.source AND u.place > s.place AND (s.step = 0 OR u.unit <= s.gap)
    )
    GROUP BY source, gap, step HAVING max(upto) > gap
), chosen AS (
    SELECT doc_id, source, size, k FROM (
        SELECT u.*, s.gap, sum(u.unit) OVER (PARTITION BY s.source, s.step ORDER BY u.place ROWS UNBOUNDED PRECEDING) AS upto
        FROM starts s JOIN placed u ON s.source IS NOT DISTINCT FROM u.source AND u.place > s.place AND (s.step = 0 OR u.unit <= s.gap)
    ) WHERE upto <= gap
)
SELECT k.doc_id, k.size, b.source_size, b.target,
    ((b.epochs + CASE WHEN c.k IS NULL THEN 0 ELSE 1 END) * k.size)::BIGINT AS taken
FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
LEFT JOIN chosen c ON k.doc_id IS NOT DISTINCT FROM c.doc_id AND k.source IS NOT DISTINCT FROM c.source AND k.size = c.size AND k.k = c.k
"""

LINKED_CALLS = r"""
WITH calls AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, text,
        ['count', 'echo', 'search'][length(text) % 3 + 1] AS name
    FROM conversations WHERE role = 'assistant'
), results AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'user'
), first_calls AS (
    SELECT conv_id, call_id, min(turn) AS turn, arg_min(name, turn) AS name, arg_min(text, turn) AS text FROM calls GROUP BY ALL
), first_results AS (
    SELECT conv_id, call_id, min(turn) AS turn, min(text) AS text FROM results GROUP BY conv_id, call_id
), chains AS (
    SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, turn // 2 - k ORDER BY turn) - 1 AS depth
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS k FROM first_calls)
), linked AS (
    SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, d.depth,
        coalesce(c.turn, r.turn) AS turn, c.name, c.text AS arg, r.text AS content,
        CASE WHEN c.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status
    FROM first_calls c FULL JOIN first_results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
    LEFT JOIN chains d ON c.conv_id = d.conv_id AND c.call_id = d.call_id
), made AS (
    SELECT *, CASE WHEN status = 'no_call' THEN NULL ELSE '{"arguments":{'
        || CASE WHEN name = 'echo' THEN '' ELSE '"chars":' || length(arg) || ',' END || '"text":' || to_json(arg)::VARCHAR
        || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' END AS json
    FROM linked
)
SELECT conv_id, call_id, status, depth, false AS cyclic,
    row_number() OVER (PARTITION BY conv_id ORDER BY depth IS NULL, depth, turn, call_id)::INTEGER AS position,
    status <> 'no_call' AND name <> 'search' AS valid,
    CASE WHEN name = 'search' THEN 'missing exact; unexpected chars' ELSE '' END AS errors, md5(json) AS json_md5
FROM made
"""

HARD_NEGATIVES = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""

# crc32 of `conv_id:turn` byte by byte, with its table made from the polynomial; the repair state by state, one row at a time.
TURN_REPAIR = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
        FROM range(256) r(i))
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS codes
    FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM keyed, crc_table
), damaged AS (
    SELECT conv_id, turn, role AS role0, text AS text0, copy,
        CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hashed, (VALUES (1), (2)) copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, md5(text0), copy) AS i FROM damaged
), faulty AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM placed
), figures AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank)::BIGINT AS blank,
        count_if(NOT blank AND again)::BIGINT AS duplicate, count_if(NOT blank AND NOT again AND cut)::BIGINT AS truncated,
        count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
    FROM faulty GROUP BY conv_id
), inserts(s, t, cost, edits, lines) AS (
    VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
        (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), moves(s, initial, t) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), edits AS (
    SELECT conv_id, i, s, s AS t, 2 AS cost, 'D' AS edit, []::VARCHAR[] AS lines FROM faulty, range(4) r(s)
    UNION ALL
    SELECT conv_id, i, s, t, CASE WHEN cut THEN 5 ELSE 0 END, 'K', [role || ':' || text]
    FROM faulty JOIN moves ON initial = left(role, 1) WHERE NOT blank AND NOT again
    UNION ALL
    SELECT conv_id, i, s, t, CASE WHEN cut THEN 6 ELSE 1 END, 'R', [CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM faulty JOIN moves ON initial IN ('u', 'a') WHERE NOT blank AND NOT again
), states AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]} AS best FROM figures
    UNION ALL
    SELECT p.conv_id, e.i, e.t, min({'c': p.best.c + x.cost + e.cost, 'a': p.best.a || x.edits || e.edit, 'l': p.best.l || x.lines || e.lines})
    FROM states p JOIN inserts x ON p.s = x.s JOIN edits e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = p.i + 1 AND e.s = x.t
    GROUP BY p.conv_id, e.i, e.t
), repaired AS (
    SELECT p.conv_id, min({'c': p.best.c + x.cost, 'a': p.best.a || x.edits, 'l': p.best.l || x.lines}) AS best
    FROM states p JOIN figures f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.n JOIN inserts x ON p.s = x.s AND x.t IN (0, 3)
    GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(r.best.c, 0) AS cost, coalesce(r.best.a, '') AS audit,
    sha256(coalesce(array_to_string(r.best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_line_frequency": LINE_FREQUENCY,
    "op5_linked_calls": LINKED_CALLS,
    "op7_mixture": MIXTURE,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_turn_repair": TURN_REPAIR,
}
