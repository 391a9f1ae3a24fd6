"""SQL of the queries of this subpackage, where SQL can express their rows, for DuckDB.

It compares all pairs and repeats no method of the operators, so it suits small tables.
"""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: The least id that each id of nodes(id) reaches over links(a, b), which hold both directions.
_REACHED = "reached AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.id), component AS (SELECT id, min(root) AS root FROM reached GROUP BY id)"

TOPK = f"""WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scored) WHERE k <= 5"""

NEARDUP = f"""WITH RECURSIVE good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN component ON id = vec_id"""

NGRAMS = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2, 3),
near AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n - k)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id FROM sets JOIN component ON id = doc_id"""

#: Host, path, rule and the rule's verdict.
URLS = f"""SELECT page_id, host, path, CASE rule WHEN 1 THEN 'www.example.com/en/' WHEN 2 THEN 'example.com/en/' WHEN 3 THEN 'net/es/' WHEN 4 THEN 'net/fr/' WHEN 5 THEN 'com/' END AS rule,
CASE rule WHEN 1 THEN 'allow' WHEN 2 THEN 'block' WHEN 3 THEN 'block' WHEN 4 THEN 'block' WHEN 5 THEN 'allow' END AS decided FROM (
SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 1 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 2 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 3
WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 4 WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 5 END AS rule FROM (
SELECT page_id, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages))"""

_PLACES = "list_filter(range(1, len(w) + 1), lambda i: w[i:i + {1}] = {0})"
#: Words and the phrases' places.
LICENSES = f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(a) + len(b) + len(c) AS BIGINT) AS n_base, list_min(a || b || c) - 1 AS first_word, list_max(a || b || c) - 1 AS last_word,
array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM (
SELECT *, {_PLACES.format("['cc', 'by']", 1)} AS a, {_PLACES.format("['general', 'public', 'license']", 2)} AS b, {_PLACES.format("['all', 'rights', 'reserved']", 2)} AS c FROM (
SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents))"""

_SIZES = "SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents"
#: Sizes and targets.
MIXING = f"""WITH by_source AS (SELECT source, sum(size) AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM ({_SIZES}) GROUP BY source),
levels AS (SELECT x.source, x.s, x.w, 2.0 * x.s / x.w AS full_at, ((SELECT 1.5 * sum(s) FROM by_source) - coalesce(sum(2.0 * y.s) FILTER (WHERE 2.0 * y.s / y.w < 2.0 * x.s / x.w), 0)) / sum(y.w) FILTER (WHERE 2.0 * y.s / y.w >= 2.0 * x.s / x.w) AS level FROM by_source x, by_source y GROUP BY 1, 2, 3),
unit AS (SELECT arg_min(level, full_at) AS u FROM levels WHERE full_at >= level)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(l.s AS BIGINT) AS source_size, round(least(2.0 * l.s, coalesce(u * l.w, 2.0 * l.s)), 3) AS target FROM ({_SIZES}) d JOIN levels l ON d.source IS NOT DISTINCT FROM l.source CROSS JOIN unit"""

_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(0, len({0})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({0}[len({0}) - i] AS INTEGER) ELSE 2 * CAST({0}[len({0}) - i] AS INTEGER) - CASE WHEN CAST({0}[len({0}) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_LUHN = _LUHN.format(_DIGITS.format("s"))
#: How many base spans of each kind.
PII = f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda s: len(list_filter(string_split(s, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) > 255, true))) = 0)) AS BIGINT) AS n_ip,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda s: len({_DIGITS.format('s')}) BETWEEN 14 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda s: len({_DIGITS.format('s')}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

#: CRC-32 bit by bit: the value of each byte as a list t, then a text's bytes one after another.
_CRC_TABLE = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
_HEX = "(instr('0123456789ABCDEF', upper(substr({0}, CAST({1} AS BIGINT), 1))) - 1)"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex({0})) // 2), lambda i: 16 * " + _HEX.format("hex({0})", "2 * i + 1") + " + " + _HEX.format("hex({0})", "2 * i + 2")
    + ")), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])))"
)

TRIE = f"""WITH tab AS {_CRC_TABLE},
own AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taking AS (SELECT c, s, {_CRC.format('CAST(c AS VARCHAR)')} % 6 AS h FROM own, tab),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM taking a LEFT JOIN own b ON b.c = a.c - a.c % 100),
members AS (SELECT c, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS digest, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(k[d].x) END AS saved FROM members GROUP BY d, k),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)),
sums AS (SELECT k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.digest AS ends_sha256
FROM full_nodes n JOIN sums s USING (k) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_HEAD = "list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: CAST(" + _HEX.format("sha256('2024:' || CAST(doc_id AS VARCHAR))", "i") + " AS BIGINT))), lambda a, b: 16 * a + b)"
RESAMPLING = f"""WITH tab AS {_CRC_TABLE},
d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), g AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
named AS (SELECT w, {_CRC.format('w')} % 10000 AS b FROM (SELECT w FROM d UNION SELECT w FROM g), tab),
here AS (SELECT b, count(*) AS s FROM d JOIN named USING (w) GROUP BY b), there AS (SELECT b, count(*) AS t FROM g JOIN named USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM d) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + 10000)))) AS BIGINT) AS gain FROM here LEFT JOIN there USING (b)),
summed AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN named USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_HEAD} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN summed USING (doc_id)),
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ordered) // 100 THEN place END AS rank FROM scored LEFT JOIN ordered USING (doc_id)"""

#: Which documents are held out.
TOXICITY = f"SELECT doc_id, {_CRC.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 AS held_out FROM documents, {_CRC_TABLE}"

_KINDS = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda p: coalesce(try_cast(p AS HUGEINT) > 255, true))) = 0"),
    "card": ("[0-9](?:[\\x20-]?[0-9])+", f"len({_DIGITS.format('s')}) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"len({_DIGITS.format('s')}) BETWEEN 10 AND 15"),
}
#: A kind's matches and the texts between them give the places.
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + length(s) AS stop FROM (SELECT doc_id, s, b[i] AS before, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM "
    f"(SELECT doc_id, m, b, unnest(m) AS s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS b FROM d))) WHERE {valid}"
    for k, (kind, (pattern, valid)) in enumerate(_KINDS.items())
)
#: The digest of all base spans.
PII_SPANS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_FOUND})
SELECT doc_id, sha256(coalesce(all_spans, '')) AS base_sha256 FROM documents LEFT JOIN (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS all_spans FROM spans GROUP BY doc_id) USING (doc_id)"""
