"""DuckDB SQL with the rows of the registered queries that SQL can express."""

from __future__ import annotations

from .merkle import COLUMNS, TAMPERED
from .mixing import REPEATS, SHARE, WEIGHTS
from .quality import FENCE, LEAST_SPREAD, MAX_REPEAT_PERCENT, MIN_GROUP, MIN_WORDS

WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"
ALNUM = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _chars(text: str, pattern: str) -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"


MEASURES = {"symbol_pm": ("n_symbols", "word_chars"), "shout_pm": ("n_shouts", "word_chars"), "upper_pm": ("n_upper", "word_chars"), "dup_line_pm": ("n_dup_lines", "n_lines"), "repeat_pm": ("n_repeat_words", "n_words"), "long_word_pm": ("word_chars", "n_words")}


def _quality() -> str:
    measures = ", ".join(f"CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END AS {k}" for k, (a, b) in MEASURES.items())
    names = ", ".join(f"'{k}'" for k in LEAST_SPREAD)
    spread = " ".join(f"WHEN '{k}' THEN {x}" for k, x in LEAST_SPREAD.items())

    def fences(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        at = "list_sort(list(value))[ceil(count(*) * {}::DOUBLE)::BIGINT]"
        return f"""{name} AS (SELECT {keys}name, count(*) AS n, {at.format(0.5)} + {FENCE} * greatest({at.format(0.5)} - {at.format(0.1)}, CASE name {spread} END) AS
  fence FROM long GROUP BY {keys}name)"""

    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[ \t\n\x0B\f\r]', '', 'g')) > 0)
  AS l FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id,
  list_slice(w, i, i + 4)) AS c FROM g),
 r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (SELECT unnest(range(5)) AS j) WHERE c > 1 GROUP BY doc_id),
 c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g')) AS word_chars,
  {_chars("t", "[#*$%&|<>]")} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
  {_chars("t", "[!?]")} AS n_shouts, {_chars("t", "\\p{Lu}")} AS n_upper FROM w LEFT JOIN r USING (doc_id)),
 m AS (SELECT *, {measures} FROM c),
 raw AS (SELECT doc_id, lang, source, unnest([{names}]) AS name, unnest([{", ".join(LEAST_SPREAD)}]) AS v FROM m),
 long AS (SELECT doc_id, lang, source, name, v, (2 ** greatest(length(bin(v)) - 7, 0))::BIGINT * (v // (2 ** greatest(length(bin(v)) - 7,
  0))::BIGINT) AS value FROM raw),
 {fences("own", "lang, source")}, {fences("by_lang", "lang")}, {fences("every", "")},
 f AS (SELECT doc_id, long.name AS name, v > CASE WHEN own.n >= {MIN_GROUP} THEN own.fence WHEN by_lang.n >= {MIN_GROUP} THEN by_lang.fence ELSE
  every.fence END AS beyond FROM long JOIN own ON own.name = long.name AND own.lang IS NOT DISTINCT FROM long.lang AND own.source IS NOT DISTINCT
  FROM long.source JOIN by_lang ON by_lang.name = long.name AND by_lang.lang IS NOT DISTINCT FROM long.lang JOIN every ON every.name = long.name),
 b AS (SELECT doc_id, arg_min(name, list_position([{names}], name)) FILTER (beyond) AS why FROM f GROUP BY doc_id),
 v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c JOIN b USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND why IS NULL AS kept, CASE WHEN
  base_failed THEN 'base' ELSE why END AS reason FROM v"""


def _mixing() -> str:
    weight = "[" + ", ".join(map(str, WEIGHTS)) + f"][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}) + 1]"
    return f"""WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':mix') AS key,
  md5(coalesce(text, '')) AS tie FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, {weight} AS w FROM d GROUP BY source), t AS (SELECT sum(source_size)::BIGINT *
  {SHARE}::DOUBLE AS budget FROM s),
 o AS (SELECT *, row_number() OVER r AS i, coalesce(sum({REPEATS} * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  0)::BIGINT AS full_, (sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_ FROM s
  WINDOW r AS (ORDER BY ({REPEATS} * source_size)::DOUBLE / w, source NULLS LAST)),
 l AS (SELECT min_by((budget - full_) / left_, i) AS level FROM o, t WHERE ({REPEATS} * source_size)::DOUBLE / w >= (budget - full_) / left_),
 g AS (SELECT source, source_size, least({REPEATS} * source_size, w * coalesce(level, 'inf'::DOUBLE))::DOUBLE AS target FROM s, l),
 q AS (SELECT d.*, source_size, target, sum(size) OVER r AS sent, row_number() OVER r AS place FROM d JOIN g ON g.source IS NOT DISTINCT FROM
  d.source WINDOW r AS (PARTITION BY d.source ORDER BY key, tie ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT q.*, epoch, (source_size * epoch + sent)::DOUBLE / target AS finish FROM q, (SELECT unnest(range({REPEATS})) AS epoch) WHERE size > 0
  AND target > 0),
 k AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, place, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM e),
 n AS (SELECT source, place, sum(size)::BIGINT AS taken FROM k, t WHERE upto <= floor(budget) GROUP BY source, place)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN n ON n.source IS NOT DISTINCT FROM q.source AND n.place =
  q.place"""


DECONTAMINATION = f"""WITH i AS (SELECT item_id::VARCHAR AS item, {ALNUM.format("coalesce(text, '')")} AS w FROM benchmark), iw AS (SELECT item, least(len(w), 10) AS n,
  list_slice(w, p, p + least(len(w), 10) - 1) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
 d AS (SELECT doc_id, {ALNUM.format("coalesce(text, '')")} AS w FROM documents), l AS (SELECT DISTINCT n FROM iw),
 dw AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, l WHERE len(w)
  >= n)),
 h AS (SELECT DISTINCT doc_id, dw.n, p, item FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g), hit AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit
  FROM h, (SELECT unnest(range(10)) AS j) WHERE j < n GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY
  doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT
  NULL AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN m USING (doc_id)"""

REPEATED = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents), g AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS g FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
 r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least_ FROM g) WHERE least_ < doc_id), c AS (SELECT DISTINCT
  doc_id, p + j AS p FROM r, (SELECT unnest(range(13)) AS j)),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
  FROM d) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

#: CRC-32 by its table, which eight shifts of each number below 256 make.
SHARDS = """WITH t AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS tab
  FROM (SELECT unnest(range(256)) AS k)),
 d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
  lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
 c AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32 FROM d,
  t),
 s AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before_, sum(size) OVER () AS total FROM c),
 p AS (SELECT doc_id, size, text_crc32, (SELECT count(*) FROM (SELECT unnest(range(1, 16)) AS k) WHERE 2 * k * total // 16 <= 2 * before_ +
  size)::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
  FROM p"""

#: Exact similarity join; MinHash finds each of these links with the chosen recall.
JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents), s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >=
  5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
  ELSE [] END) AS s FROM d),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id !=
  b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4),
 l AS (SELECT * FROM p UNION SELECT a.doc_id, b.doc_id FROM s a JOIN s b ON len(a.s) = 0 AND len(b.s) = 0 AND a.doc_id != b.doc_id), r AS (SELECT
  DISTINCT a AS root, a AS node FROM l UNION SELECT root, b FROM r JOIN l ON a = node)
SELECT doc_id, coalesce((SELECT min(root) FROM r WHERE node = doc_id), doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links,
  len(s) AS n_shingles FROM s"""

NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x:
  floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x:
  isfinite(x))) = len(embedding)),
 p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON
  a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM p WHERE same),
 n AS (SELECT k.anchor_id, k.id AS positive_id, p.id AS negative_id, k.score AS positive_score, p.score AS negative_score, row_number() OVER
  (PARTITION BY k.anchor_id, k.id ORDER BY p.score DESC, p.id) AS rank FROM k JOIN p ON p.anchor_id = k.anchor_id AND NOT p.same WHERE k.k <= 5 AND
  50 * k.score <= 100 * p.score AND 100 * p.score <= 95 * k.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR END"


def _merkle() -> str:
    leaf = lambda n: f"sha256({' || '.join(_field(c if c != 'n_chars' else n) for c in COLUMNS)})"
    up = "SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY tree, level, i // 2, n"
    return f"""WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)
  ORDER BY k) AS tab FROM (SELECT unnest(range(256)) AS k)),
 d AS (SELECT *, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS changed, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'),
  lambda h: ('0x' || h)::BIGINT) AS b, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree FROM documents),
 t AS (SELECT tree, doc_id, leaf, CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(b, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8),
  4294967295), 4294967295) % {TAMPERED} = 0 THEN changed ELSE leaf END AS now, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS r FROM d, tab),
 up AS (SELECT tree, 0 AS level, r AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM t UNION ALL {up.format("up")}),
 s AS (SELECT tree, h AS subroot, level AS depth, row_number() OVER (ORDER BY encode(tree)) - 1 AS r FROM up WHERE n = 1),
 top AS (SELECT '' AS tree, 0 AS level, r AS i, subroot AS h, count(*) OVER () AS n FROM s UNION ALL {up.format("top")}),
 w AS (SELECT doc_id, l AS step, r >> l AS i, t.tree, l AS level FROM (SELECT *, unnest(range(depth)) AS l FROM t JOIN (SELECT tree, depth FROM s) USING
  (tree)) t UNION ALL SELECT doc_id, s.depth + l, s.r >> l, '', l FROM t JOIN s USING (tree), (SELECT unnest(range((SELECT max(level) FROM top))) AS l)),
 n AS (SELECT * FROM up UNION ALL SELECT * FROM top),
 g AS (SELECT doc_id, step, w.i & 1 AS is_right, n.h AS sibling FROM w LEFT JOIN n ON n.tree = w.tree AND n.level = w.level AND n.i = xor(w.i, 1)),
 f AS (SELECT doc_id, 0 AS step, now AS h FROM t UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE WHEN sibling IS NULL THEN h WHEN is_right = 1 THEN
  sibling || h ELSE h || sibling END) FROM f JOIN g ON g.doc_id = f.doc_id AND g.step = f.step),
 o AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM f GROUP BY doc_id), q AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY
  step), '')) AS proof_sha256 FROM t LEFT JOIN g USING (doc_id) GROUP BY doc_id), z AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM t JOIN s USING (tree) JOIN o USING (doc_id) JOIN q
  USING (doc_id), z"""


SQL: dict[str, str] = {
    "op2_jaccard_join": JACCARD,
    "op4_quality_rules": _quality(),
    "op5_sharding": SHARDS,
    "op7_decontamination": DECONTAMINATION,
    "op9_substring_dedup": REPEATED,
    "op10_mixing": _mixing(),
    "op11_hard_negatives": NEGATIVES,
    "op13_merkle_manifest": _merkle(),
}
