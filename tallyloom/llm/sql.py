"""SQL that checks the queries of this subpackage that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UP}', '{_LOW}')"


OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low('text')}, {_ALNUM}) AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
met AS (SELECT doc_id, g.k, p, item_id FROM grams g JOIN items i ON g.k = i.k AND g.gram = i.gram),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM often) GROUP BY 1),
lines AS (SELECT * FROM (SELECT doc_id, source, text, line, regexp_extract_all({_low('line')}, {_SPACED}) AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1),
shared AS (SELECT source, array_to_string(lw, ' ') AS norm, count(DISTINCT text) AS n FROM lines GROUP BY 1, 2),
bad AS (SELECT s.source, norm FROM shared s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source WHERE s.n > 20 AND s.n > h.n * 0.02),
gone AS (SELECT doc_id, CAST(sum(len(lw)) AS BIGINT) AS n FROM lines l JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND array_to_string(lw, ' ') = norm GROUP BY 1),
f AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 50 AND 2 * (n_words - removed_words) <= n_words) AS kept
FROM f
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[p] || ' ' || w[p + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(reached) AS low FROM r GROUP BY 1) c ON c.id = d.doc_id
"""

_SEEDS = 8


def _draw(seed: int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), '{seed}')), 1, 13) AS BIGINT) / 4503599627370496.0"


OP9 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 3.0 * source_size AS cap, CAST(1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM p),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, level * weight > cap AS capped FROM o),
t AS (SELECT source, source_size, CAST(CASE WHEN capped THEN cap ELSE least(cap, weight * coalesce((SELECT level FROM g x WHERE NOT capped ORDER BY cap / weight, level LIMIT 1), 0)) END AS DOUBLE) AS target FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM t),
j AS (SELECT d.*, source_size, target, rate, rate - floor(rate) AS fraction, [{', '.join(_draw(s) for s in range(_SEEDS))}] AS draws FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
k AS (SELECT source, i, abs(sum(CASE WHEN draws[i] < fraction THEN size ELSE 0 END) - first(fraction) * first(source_size)) AS off FROM j, range(1, {_SEEDS + 1}) x(i) GROUP BY 1, 2),
c AS (SELECT source, min_by(i, (off, i)) AS seed FROM k GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draws[seed] < fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM j JOIN c ON j.source IS NOT DISTINCT FROM c.source
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_BIT = "lambda x, _: xor(x >> 1, (x & 1) * 3988292384)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {_BIT})), 4294967295)"


def _tree(name: str, leaves: str, key: str) -> str:
    """Nodes of a forest by level, and of each leaf the siblings and ancestors by level."""
    return f"""{name} AS (SELECT {key} AS tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max(n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8),
{name}_steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY 1, 2, 3)"""


OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS digest,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UP}', '{_LOW}')")} ELSE {_leaf('text')} END AS given FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM d),
{_tree('t', 'leaves', 'tree')},
subroots AS (SELECT tree AS lang_tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM t WHERE n = 1),
{_tree('u', 'subroots', "'^'")},
steps AS (SELECT tree, level, pos, before, after FROM t_steps UNION ALL
  SELECT lang_tree, 100 + level, s.pos, before, after FROM subroots s JOIN u_steps x ON x.pos = s.pos >> (3 * level)),
way AS (SELECT doc_id, l.pos AS own, l.tree, list(s.before ORDER BY s.level) AS before, list(s.after ORDER BY s.level) AS after
  FROM leaves l LEFT JOIN steps s ON s.tree = l.tree AND s.pos = CASE WHEN s.level >= 100 THEN s.pos ELSE l.pos >> (3 * s.level) END GROUP BY 1, 2, 3),
folds AS (SELECT tree, pos, 1 AS step, given AS node FROM leaves
  UNION ALL SELECT f.tree, f.pos, step + 1, sha256(before[step] || node || after[step]) FROM folds f JOIN way w ON w.tree = f.tree AND w.own = f.pos WHERE before[step] IS NOT NULL),
ends AS (SELECT tree, pos, arg_max(node, step) AS folded_root FROM folds GROUP BY 1, 2),
top AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, root, sha256(coalesce(array_to_string(list_transform(range(1, len(before) + 1), lambda i: coalesce(before[i] || after[i], '')), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM leaves l JOIN way w ON w.tree = l.tree AND w.own = l.pos JOIN ends e ON e.tree = l.tree AND e.pos = l.pos JOIN subroots s ON s.lang_tree = l.tree, top
"""

OP13 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

SQL = {
    "op1_benchmark_decontamination": OP1,
    "op4_quality_rules": OP4,
    "op5_odd_sketch_near_duplicates": OP5,
    "op9_source_mixing": OP9,
    "op12_merkle_manifest": OP12,
    "op13_digest_index": OP13,
}
