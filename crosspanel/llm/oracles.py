"""DuckDB SQL equivalent to the queries that SQL can express."""

from __future__ import annotations

# Texts: null and empty have no words.  A-Z are lower-cased, other letters kept.
_FOLDED = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED} AS ws FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS m, ws[i : i + least(len(ws), 10) - 1] AS seq
    FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0),
occurrence AS (
    SELECT r, i, p.m, p.item_id
    FROM (SELECT r, i, m, ws[i : i + m - 1] AS seq
          FROM d, (SELECT DISTINCT m FROM pattern) AS lengths, unnest(range(1, len(ws) - m + 2)) AS t(i)
          WHERE len(ws) >= m) AS w JOIN pattern AS p ON p.m = w.m AND p.seq = w.seq),
hit AS (
    SELECT r, count(DISTINCT j) AS n_hit
    FROM occurrence, unnest(range(i, i + m)) AS t(j) GROUP BY r),
found AS (
    SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occurrence GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

OP9 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d),
win AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, seq) AS times
    FROM (SELECT r, i, ws[i : i + 4] AS seq FROM s, unnest(range(1, len(ws) - 3)) AS t(i)
          WHERE len(ws) >= 5)),
rep AS (
    SELECT r, count(DISTINCT j) AS n FROM win, unnest(range(i, i + 5)) AS t(j) WHERE times > 1 GROUP BY r),
f AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
        CAST(n_symbols AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_lettered
    FROM s LEFT JOIN rep USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars BETWEEN 2 * n_words AND 40 * n_words
    AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * n_lines
    AND 10 * n_lettered >= 6 * n_words AS kept
FROM g
"""


def _digest(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def _rounds(seed: int, rounds: int) -> str:
    """Nested selects that send x through the Feistel network; keeps the other columns."""
    sql = "SELECT r, n, x % a AS l, x // a AS h, a, b FROM walk WHERE x >= n OR step = 0"
    for i in range(rounds):
        half, size, other = ("l", "a", "h") if i % 2 == 0 else ("h", "b", "l")
        mixed = f"({half} + {_digest(f"'{seed}:{i}:' || {other}")}) % {size} AS {half}"
        sql = f"SELECT r, n, {mixed}, {other}, a, b FROM ({sql})"
    return sql


OP3 = f"""
WITH RECURSIVE table_of AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1
        THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS tab
    FROM range(256) AS t(n)),
d AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS hx
    FROM documents),
c AS (
    SELECT doc_id, size, xor(4294967295, list_reduce(range(1, len(hx), 2), lambda c, i:
        xor(c // 256, tab[xor(c % 256, CAST('0x' || substr(hx, i, 2) AS BIGINT)) + 1]),
        CAST(4294967295 AS BIGINT))) AS text_crc32 FROM d, table_of),
o AS (
    SELECT *, row_number() OVER (ORDER BY {_digest("coalesce(CAST(doc_id AS VARCHAR), 'null') || ',' || text_crc32 || ',' || size")},
        doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM c),
walk AS (
    SELECT r, n, r AS x, 0 AS step, CAST(ceil(sqrt(n)) AS BIGINT) AS a,
        CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM o
    UNION ALL
    SELECT r, n, h * a + l, 1, a, b FROM ({_rounds(1, 6)}))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
    CAST(x % 40 AS INTEGER) AS shard, CAST(x // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN walk USING (r) WHERE step = 1 AND x < walk.n
"""

OP7 = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
    SELECT source, sum(size) AS source_size,
        ([5, 2, 1])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
    FROM d GROUP BY source),
share AS (
    SELECT 0 AS step, source, source_size, weight, CAST(0 AS DOUBLE) AS target,
        CAST((SELECT sum(size) FROM d) AS DOUBLE) AS rest FROM s
    UNION ALL
    SELECT step + 1, source, source_size, weight, new_target, rest_of - sum(new_target) OVER () FROM (
        SELECT *, least(3.0 * source_size, target + CASE WHEN target < 3.0 * source_size
            THEN rest * weight / sum(CASE WHEN target < 3.0 * source_size THEN weight ELSE 0 END) OVER ()
            ELSE 0 END) AS new_target, rest + sum(target) OVER () AS rest_of FROM share)
    WHERE step < 60),
goal AS (SELECT source, source_size, round(target, 6) AS target FROM share WHERE step = 60),
o AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY {_digest("coalesce(CAST(doc_id AS VARCHAR), 'null') || ',' || size")}
        ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST(CASE WHEN size = 0 THEN 0 ELSE size * (
        (start + size / 2 < target)::INT + (start + size / 2 + source_size < target)::INT
        + (start + size / 2 + 2 * source_size < target)::INT) END AS BIGINT) AS taken
FROM o JOIN goal ON o.source IS NOT DISTINCT FROM goal.source
"""

OP10 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
            FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(6 + 6 + 5 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
            + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))) AS chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM c
"""


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789:/._?=&#%-~$"


def _levels(order: int) -> str:
    """The smoothed models of each context length, from counts g (ctx, c, a, r) and ctxs."""
    ctes = []
    for k in range(order + 1):
        below = (f"JOIN level{k - 1} AS q ON q.ctx = substr(x.ctx, 2) AND q.c = x.c" if k else
                 f"CROSS JOIN (SELECT 1.0::DOUBLE / {len(_ALPHABET)} AS p_a, 1.0::DOUBLE / {len(_ALPHABET)} AS p_r) AS q")
        ctes.append(f"""
level{k} AS (
    SELECT x.ctx, x.c, (coalesce(g.a, 0) + 4.0::DOUBLE * q.p_a) / (x.ctx_a + 4.0::DOUBLE) AS p_a,
        (coalesce(g.r, 0) + 4.0::DOUBLE * q.p_r) / (x.ctx_r + 4.0::DOUBLE) AS p_r, q.p_a AS b_a, q.p_r AS b_r
    FROM (SELECT ctxs.*, l.c FROM ctxs, letters AS l WHERE length(ctx) = {k}) AS x
    LEFT JOIN g ON g.ctx = x.ctx AND g.c = x.c {below})""")
    return ",".join(ctes)


OP5 = rf"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url,
        translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM pages),
hp AS (
    SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path,
        '^' || regexp_replace(low, '[^a-z0-9:/._?=&#%-]', '~', 'g') || '$' AS s
    FROM p),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM hp),
tabs AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1
        THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) ORDER BY n) AS tab
    FROM range(256) AS t(n)),
u AS (
    SELECT s, count(*) FILTER (WHERE rule IN ('org/', 'com/fr/')) AS accepted,
        count(*) FILTER (WHERE rule IN ('example.org/en/1', 'example.org/es/', 'com/de/')) AS rejected
    FROM ruled GROUP BY s),
e AS (
    SELECT u.*, xor(4294967295, list_reduce(range(1, length(s) + 1), lambda c, i:
        xor(c // 256, tab[xor(c % 256, ascii(substr(s, i, 1))) + 1]), CAST(4294967295 AS BIGINT))) % 5 <> 0 AS train
    FROM u, tabs),
grams AS (
    SELECT s, accepted, rejected, train, substr(s, i, k) AS gram
    FROM e, unnest(range(1, length(s) + 1)) AS t(i), unnest(range(1, 6)) AS v(k)
    WHERE i + k - 1 <= length(s) AND substr(s, i, k) <> '^'),
g AS (
    SELECT left(gram, length(gram) - 1) AS ctx, right(gram, 1) AS c, sum(accepted) AS a, sum(rejected) AS r
    FROM grams WHERE train AND accepted + rejected > 0 GROUP BY gram),
ctxs AS (
    SELECT ctx, sum(a) AS ctx_a, sum(r) AS ctx_r FROM g GROUP BY ctx
    HAVING ctx = '' OR sum(a) + sum(r) >= 16),
letters AS (SELECT unnest(string_split('{_ALPHABET}', '')) AS c),{_levels(4)},
model AS ({" UNION ALL ".join(f"SELECT ctx || c AS gram, ln(p_a / p_r) - ln(b_a / b_r) AS change FROM level{k}" for k in range(5))}),
scored AS (
    SELECT s, round(sum(change) / (length(s) - 1), 6) AS score FROM grams JOIN model USING (gram) GROUP BY s),
bins AS (
    SELECT floor(score * 100) AS bin, sum(accepted) AS a, sum(rejected) AS r
    FROM e JOIN scored USING (s) WHERE NOT train AND accepted + rejected > 0 GROUP BY 1),
gaps AS (
    SELECT bin, round(sum(a) OVER w / sum(a) OVER () - sum(r) OVER w / sum(r) OVER (), 9) AS gap,
        sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
    FROM bins WINDOW w AS (ORDER BY bin DESC)),
best AS (SELECT bin / 100.0 AS threshold FROM gaps WHERE all_a > 0 AND all_r > 0 ORDER BY gap DESC, abs(bin), bin LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(score, 0) >= coalesce((SELECT threshold FROM best), 0) THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN scored USING (s)
"""

OP6 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY ws[i : i + 19] ORDER BY doc_id, i) AS nth
        FROM d, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, j FROM later, unnest(range(i, i + 20)) AS t(j)),
word AS (SELECT doc_id, j, ws[j] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(j)),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS text
    FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT * FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive AS p JOIN pair AS n USING (anchor_id)
WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

OP12 = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece),
f AS (
    SELECT lang, k, ws[i : i + k - 1] AS seq, count(*) AS f
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
          FROM p, unnest(range(1, 5)) AS v(k) WHERE len(ws) >= k) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, seq, f AS a FROM f WHERE k >= 2 AND f >= 30),
side AS (SELECT lang, seq, a, j, seq[1 : j] AS head, seq[j + 1 : k] AS tail
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cut AS (
    SELECT side.lang, side.seq, a, j, l.f AS l, r.f AS r,
        CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
    FROM side JOIN f AS l ON l.lang = side.lang AND l.seq = side.head
    JOIN f AS r ON r.lang = side.lang AND r.seq = side.tail),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, seq ORDER BY score, j) = 1),
part AS (
    SELECT lang, seq[i : i + m - 1] AS seq, max(a) AS longer
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, unnest(range(2, 4)) AS u(m) WHERE k > m)
    GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.seq, ' ')) AS rank,
    array_to_string(b.seq, ' ') AS phrase, a, l, r, n, score
FROM best AS b JOIN total USING (lang) LEFT JOIN part ON part.lang = b.lang AND part.seq = b.seq
WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2, "op3_shard": OP3, "op5_url_filter": OP5, "op6_substrings": OP6,
    "op7_mix": OP7, "op9_quality": OP9, "op10_chat": OP10,
    "op11_hard_negatives": OP11, "op12_collocations": OP12,
}
