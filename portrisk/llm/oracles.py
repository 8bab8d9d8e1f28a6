"""DuckDB SQL of the training-data queries that SQL can express."""

#: Levels of eight children a node that the SQL of the manifest unrolls: 16.7 million rows a language.
_LEVELS = 8


def _tree(name: str, leaves: str, key: str) -> str:
    """CTEs of a table of leaves (key, p, h, and of each row its node q, digest g, sibs and folded f) up to its subroots."""
    out = [f"{name}0n AS (SELECT {key}, p, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for k in range(_LEVELS):
        out.append(
            f"{name}{k + 1} AS (SELECT {key}, CASE WHEN n > 1 THEN p // 8 ELSE p END AS p,"
            f" CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h,"
            f" list(h ORDER BY p) AS run, any_value(n) > 1 AS up FROM {name}{k}n GROUP BY {key}, n, CASE WHEN n > 1 THEN p // 8 ELSE p END)")
        out.append(f"{name}{k + 1}n AS (SELECT {key}, p, h, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{k + 1})")
    return ",\n".join(out)


def _climb(name: str, rows: str, tree: str, key: str) -> str:
    """CTEs that take rows (rid, key, q, f, sibs) up the levels of a tree."""
    out, now = [], rows
    for k in range(_LEVELS):
        out.append(
            f"{name}{k + 1} AS (SELECT c.* EXCLUDE (q, f, sibs), CASE WHEN up THEN q // 8 ELSE q END AS q,"
            f" CASE WHEN up THEN sibs || array_to_string(run[:q % 8], '') || array_to_string(run[q % 8 + 2:], '') ELSE sibs END AS sibs,"
            f" CASE WHEN up THEN sha256(array_to_string(run[:q % 8], '') || f || array_to_string(run[q % 8 + 2:], '')) ELSE f END AS f"
            f" FROM {now} c JOIN {tree}{k + 1} t ON c.{key} = t.{key} AND t.p = CASE WHEN up THEN q // 8 ELSE q END)")
        now = f"{name}{k + 1}"
    return ",\n".join(out)


def _field(name: str, value: str | None = None) -> str:
    value = value or name
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str = "text") -> str:
    return f"sha256({' || '.join([*map(_field, ('doc_id', 'source', 'lang', 'n_chars')), _field('text', text)])})"


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of the decimal id, its table made from the polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: xor(crc >> 8, tab[xor(crc, b) % 256 + 1])))"""

MANIFEST = f"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, doc_id, {_leaf()} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_FOLDED.format('text'))} ELSE {_leaf()} END AS shown FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS p, leaf AS h FROM d),
{_tree('t', 'leaves', 'tree')},
tops AS (SELECT 0 AS top, tree AS p, h FROM t{_LEVELS}),
{_tree('r', 'tops', 'top')},
start AS (SELECT rid, tree, doc_id, leaf, p AS q, shown AS f, '' AS sibs FROM leaves),
{_climb('c', 'start', 't', 'tree')},
middle AS (SELECT rid, doc_id, leaf, tree, 0 AS top, tree AS q, f, sibs FROM c{_LEVELS}),
{_climb('u', 'middle', 'r', 'top')}
SELECT doc_id, leaf, tops.h AS subroot, (SELECT h FROM r{_LEVELS}) AS root, sha256(sibs) AS proof_sha256, f AS folded_root,
  f = (SELECT h FROM r{_LEVELS}) AS verified
FROM u{_LEVELS} u JOIN tops ON tops.p = u.tree
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ALL: dict[str, str] = {
    "op11_merkle_manifest": MANIFEST,
    "op12_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, g),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct({_TERMS}) AS ws FROM benchmark),
qt AS (SELECT qid, item_id, unnest(ws) AS term FROM q),
s AS (
  SELECT qid, item_id, d.doc_id, d.rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.ws) * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN d USING (rid), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""",
    "op10_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS r1, (n_words > 0 AND 10 * n_symbols > n_words) AS r2,
    (n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines) AS r3, (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)) AS r4 FROM m),
u AS (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([r1, r2, r3, r4])::INT AS bad FROM f),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM u GROUP BY source, rule),
mo AS (SELECT rule, sum(bad) / sum(n) AS mean, coalesce(var_samp(bad / n), 0) AS v FROM h GROUP BY rule),
pr AS (SELECT rule, mean, least(greatest(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1000.0 END, 2.0), 1000.0) AS weight FROM mo),
verdict AS (SELECT source, max((bad + mean * weight) / (n + weight)) <= 0.5 AS host_kept FROM h JOIN pr USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 AS base_failed, (NOT r1 AND host_kept) AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
""",
}
