"""DuckDB SQL that states the queries of this subpackage which SQL can express: op1, op3, op7, op11 and op12, over whole tables."""

from __future__ import annotations

LETTERS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x <> '')"


SPACE, OTHER = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = LETTERS.format("coalesce(text, '')")

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(LOWERED, SPACE)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id < y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM sets
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words("coalesce(text, '')", SPACE)} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN often USING (h)),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN hit USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words(LOWERED, OTHER)} AS w FROM documents),
items AS (SELECT DISTINCT item_id::VARCHAR AS item, w FROM (SELECT item_id, {_words(LOWERED, OTHER)} AS w FROM benchmark) WHERE len(w) > 0),
numbered AS (SELECT row_number() OVER () AS k, item, w, least(len(w), 13) AS n FROM items),
starts AS (SELECT k, item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM numbered),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM starts),
here AS (SELECT r, z.n, i, array_to_string(w[i:i + z.n - 1], ' ') AS phrase FROM (SELECT r, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM phrases) z WHERE len(w) >= z.n) z),
met AS (SELECT r, i, here.n, item FROM here JOIN phrases ON here.n = phrases.n AND here.phrase = phrases.phrase),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
listed AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r),
placed AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
counts AS (SELECT word, count(*) AS df FROM placed GROUP BY word),
parts AS (SELECT k, item, s, q, w[q] AS word FROM (SELECT k, item, w, s, unnest(range(s, s + n)) AS q FROM starts)),
ranked AS (SELECT k, item, s, word, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY k, s ORDER BY coalesce(df, 0), word, q) AS place FROM parts LEFT JOIN counts USING (word)),
rare AS (SELECT DISTINCT x.item, x.word AS w1, y.word AS w2 FROM ranked x JOIN ranked y ON x.k = y.k AND x.s = y.s AND x.place = 1 AND y.place = 2 WHERE x.df > 0),
spots AS (SELECT r, word, p FROM placed WHERE word IN (SELECT w1 FROM rare UNION SELECT w2 FROM rare)),
close AS (SELECT DISTINCT x.r, x.word AS w1, y.word AS w2 FROM spots x JOIN spots y ON x.r = y.r AND x.p <> y.p AND y.p BETWEEN x.p - 13 AND x.p + 13),
beside AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM close JOIN rare USING (w1, w2) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(listed.n, 0)::BIGINT AS n_items, sha256(coalesce(listed.t, '')) AS items_sha256,
    coalesce(beside.n, 0)::BIGINT AS n_near, sha256(coalesce(beside.t, '')) AS near_items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r) LEFT JOIN beside USING (r)
"""


def _framed(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_framed, ['doc_id', 'source', 'lang', n_chars, 'text']))})"


#: A tree's levels: each node with its digest, then the next level's, from pairs of neighbours.
def _levels(name: str, base: str) -> str:
    return f"""{name}(g, l, i, d) AS (SELECT g, 0, i, d FROM ({base})
    UNION ALL SELECT g, l + 1, i // 2, sha256(d || coalesce(e, '')) FROM (SELECT g, l, i, d, lead(d) OVER (PARTITION BY g ORDER BY i) AS e, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 AND i % 2 = 0)"""


#: The siblings of place i, from level 0 up, and the fold of a digest along them.
def _climb(name: str, start: str, nodes: str) -> str:
    return f"""{name}(r, g, i, l, d, proof) AS (SELECT r, g, i, 0, d, '' FROM ({start})
    UNION ALL SELECT r, c.g, c.i // 2, c.l + 1, sha256(CASE WHEN c.i % 2 = 1 THEN s.d || c.d ELSE c.d || coalesce(s.d, '') END), proof || coalesce(s.d, '')
    FROM {name} c JOIN {nodes} p ON p.g = c.g AND p.l = c.l + 1 AND p.i = c.i // 2 LEFT JOIN {nodes} s ON s.g = c.g AND s.l = c.l AND s.i = c.i + 1 - 2 * (c.i % 2))"""


#: The crc32 of an id's digits: a byte is xored in and eight bits are shifted out.
CRC = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({0}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) WHEN h % 2 = 1 THEN xor(h // 2, 3988292384) ELSE h // 2 END), 4294967295)"

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g, {_leaf('n_chars')} AS leaf,
    CASE WHEN {CRC.format('doc_id')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS bent FROM documents),
leaves AS (SELECT r, doc_id, g, leaf, coalesce(bent, leaf) AS claim, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_levels("low", "SELECT g, i, leaf AS d FROM leaves")},
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS place FROM low WHERE (g, l) IN (SELECT g, max(l) FROM low GROUP BY g)),
{_levels("high", "SELECT '' AS g, place AS i, d FROM subroots")},
top AS (SELECT d AS root FROM high WHERE l = (SELECT max(l) FROM high)),
{_climb("up", "SELECT r, g, i, claim AS d FROM leaves", "low")},
risen AS (SELECT r, up.g, up.d, up.proof FROM up WHERE (up.g, up.l) IN (SELECT g, max(l) FROM low GROUP BY g)),
{_climb("on_", "SELECT r, '' AS g, s.place AS i, u.d FROM risen u JOIN subroots s ON s.g = u.g", "high")},
done AS (SELECT r, d, proof FROM on_ WHERE l = (SELECT max(l) FROM high))
SELECT a.doc_id, a.leaf, s.d AS subroot, t.root, sha256(u.proof || o.proof) AS proof_sha256, o.d AS folded_root, o.d = t.root AS verified
FROM leaves a JOIN subroots s ON s.g = a.g JOIN risen u ON u.r = a.r JOIN done o ON o.r = a.r CROSS JOIN top t
"""

AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, {_words("coalesce(text, '')", SPACE)} AS w FROM documents),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS m FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id),
k AS (SELECT part, m, count(*) AS n, sum(good::INT) AS g, sum(toxic::INT) AS t FROM f GROUP BY part, m),
one(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM one a, one b, one c, one d, one e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)),
every AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit <> 0 AND m & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN m & bit <> 0 AND m & before = 0 THEN t ELSE 0 END) AS toxic_lost FROM k CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM every
"""

SQL = {"op1_ngram_jaccard": JACCARD, "op3_decontamination": DECONTAMINATION, "op7_substring_dedup": SUBSTRINGS, "op11_merkle_manifest": MANIFEST, "op12_filter_audit": AUDIT}
