"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import string

from scriptoria.llm import lexical, licences, merkle, mixing

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: string_split at runs of spaces, without the empty ends.
WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{SPACE_RUN}'), lambda x: x <> '')"

MEASURED = rf"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
occurrences AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM docs WHERE len(w) >= 5),
windows AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM occurrences),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY rid),
lines AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)
)"""

OP4 = f"""
WITH {MEASURED},
base AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR n_dup_lines * 10 > n_words) AS kept
FROM base
"""


def _dealt(values: tuple) -> str:
    return "[" + ", ".join(f"{float(v)}::DOUBLE" for v in values) + f"][(i % {len(values)} + 1)::INT]"


OP3 = f"""
WITH docs AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
sources AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (ORDER BY no_source, source) - 1 AS i FROM sources),
weighed AS (SELECT *, {_dealt(mixing.WEIGHTS)} AS weight, {_dealt(mixing.TILTS)} AS tilt, source_size * {mixing.PASSES}::DOUBLE AS cap FROM numbered),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chosen AS (SELECT (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, i LIMIT 1) AS level),
targets AS (SELECT no_source, source, source_size, tilt, least(cap, coalesce(chosen.level, 'infinity'::DOUBLE) * weight) AS target FROM levels, chosen),
queued AS (
  SELECT docs.*, coalesce(sum(size) OVER (PARTITION BY no_source, source ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs
),
placed AS (
  SELECT doc_id, size, source_size, target, tilt,
    list_filter([start + size / 2, source_size + start + size / 2], lambda m: m <= target AND target > 0) AS spots
  FROM queued JOIN targets USING (no_source, source)
)
SELECT doc_id, size, source_size, target, (len(spots) * size)::BIGINT AS taken,
  CASE WHEN len(spots) = 0 THEN NULL WHEN tilt = 0 THEN spots[1] / target
    ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (spots[1] / target)) - (1 - tilt)) / (2 * tilt) END AS first_position
FROM placed
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    t = f"lower(regexp_replace(coalesce({text}, ''), {_quoted(licences.COPYRIGHT_LINE)}, ' ', 'g'))"
    t = f"' ' || regexp_replace({t}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for other, usual in licences.SPELLINGS.items():
        t = f"replace({t}, ' {other} ', ' {usual} ')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


KNOWN = " UNION ALL ".join(f"SELECT {_quoted(name)} AS licence, {_quoted(t)} AS t, {whole} AS whole" for name, t, whole in licences.known_texts())

OP7 = f"""
WITH digests AS (SELECT sha256({canonical_sql("t")}) AS digest, licence, whole FROM ({KNOWN})),
known AS (SELECT digest, min(licence) AS licence, bool_or(whole) AS whole FROM digests GROUP BY digest HAVING count(DISTINCT licence) = 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {canonical_sql("text")} AS canonical FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS part FROM docs),
blocks AS (SELECT rid, unnest(string_split_regex(text, '{licences.BLANK_LINE}')) AS part FROM docs),
parts AS (
  SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(trim(part, chr(10)), chr(10))
),
found AS (SELECT rid, licence FROM parts JOIN known ON known.digest = sha256({canonical_sql("part")}) WHERE regexp_matches(lower(part), '{licences.HINT}')),
notices AS (SELECT rid, count(*)::BIGINT AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM found GROUP BY rid)
SELECT doc_id, length(canonical)::BIGINT AS n_canonical, sha256(canonical) AS digest, known.licence, coalesce(notices.n, 0)::BIGINT AS n_notices, coalesce(notices.names, '') AS notices
FROM docs LEFT JOIN known ON known.digest = sha256(docs.canonical) AND known.whole LEFT JOIN notices USING (rid)
"""

LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(LOWER.format("coalesce(text, '')"))

OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS t FROM documents),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs),
asked AS (SELECT DISTINCT iid, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS iid, item_id, {TERMS} AS t FROM benchmark)),
posts AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posts, totals GROUP BY term, n_docs),
impacts AS (
  SELECT rid, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(t)::BIGINT * n_docs) // n_terms))) AS impact
  FROM posts JOIN weights USING (term) JOIN docs USING (rid), totals
),
scores AS (SELECT iid, item_id, rid, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN docs USING (rid))
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}
"""


#: Unsigned CRC-32 of a value's decimal text, bit by bit.
CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (level, g, i, digest, n) of the trees over ``leaves`` (g, i, digest, n)."""
    return f"""{name} AS (
  SELECT 0 AS level, g, i, digest, n FROM {leaves}
  UNION ALL
  SELECT level + 1, g, i // {merkle.RUN}, sha256(string_agg(digest, '' ORDER BY i)), (n + {merkle.RUN - 1}) // {merkle.RUN} FROM {name} WHERE n > 1 GROUP BY level, g, i // {merkle.RUN}, n
)"""


def _way(name: str, start: str, tree: str) -> str:
    """(rid, level, g, i, digest, proof) of ``start`` (rid, g, i, digest, proof) up ``tree``: the last level holds the top."""
    return f"""{name} AS (
  SELECT rid, 0 AS level, g, i, digest, proof FROM {start}
  UNION ALL
  SELECT w.rid, w.level + 1, w.g, w.i // {merkle.RUN}, sha256(string_agg(CASE WHEN t.i = w.i THEN w.digest ELSE t.digest END, '' ORDER BY t.i)),
    w.proof || coalesce(string_agg(t.digest, '' ORDER BY t.i) FILTER (t.i <> w.i), '')
  FROM {name} w JOIN {tree} t ON t.level = w.level AND t.g = w.g AND t.i // {merkle.RUN} = w.i // {merkle.RUN} WHERE t.n > 1 GROUP BY w.rid, w.level, w.g, w.i, w.digest, w.proof
)"""


OP12 = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_field("source")} AS g, {_leaf("text")} AS leaf, CASE WHEN tampered THEN {_leaf(LOWER.format("text"))} ELSE {_leaf("text")} END AS given
  FROM (SELECT *, {CRC.format("doc_id")} % 5 = 0 AS tampered FROM documents)
),
leaves AS MATERIALIZED (
  SELECT rid, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS digest, count(*) OVER (PARTITION BY g) AS n, given FROM docs
),
{_tree("trees", "leaves")},
nodes AS MATERIALIZED (SELECT * FROM trees),
tops AS (SELECT DISTINCT g, source, digest AS subroot FROM nodes JOIN docs USING (g) WHERE n = 1),
groups AS MATERIALIZED (SELECT '' AS g, g AS own, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, subroot AS digest, count(*) OVER () AS n FROM tops),
{_tree("over", "groups")},
upper AS MATERIALIZED (SELECT * FROM over),
begin AS (SELECT rid, g, i, given AS digest, '' AS proof FROM leaves),
{_way("ways", "begin", "nodes")},
half AS (SELECT rid, g AS own, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM ways GROUP BY ALL),
again AS (SELECT rid, groups.g, groups.i, half.digest, half.proof FROM half JOIN groups USING (own)),
{_way("ends", "again", "upper")},
done AS (SELECT rid, arg_max(digest, level) AS folded_root, arg_max(proof, level) AS proof FROM ends GROUP BY ALL)
SELECT doc_id, leaf, groups.digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM docs JOIN done USING (rid) JOIN groups ON groups.own = docs.g, (SELECT digest AS root FROM upper WHERE n = 1)
"""

ORACLES = {"op3_mixing": OP3, "op4_quality": OP4, "op7_licences": OP7, "op11_lexical_search": OP11, "op12_merkle": OP12}
