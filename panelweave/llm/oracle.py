"""DuckDB SQL for the queries that SQL can express, from their definitions over the same tables.

Not here: novelty by compression, URL templates (a tree of unknown depth), the boosted model, byte-level BPE,
packed sequences, periodic runs (chosen by CRC-32) and the pipeline that ends in BPE.
"""

from __future__ import annotations

from panelweave.llm.license_scan import CONTAINED_PERCENT, PHRASES, TEMPLATES
from panelweave.llm.queries import CLUSTERS, MIX, MIX_WEIGHTS

SPACE = r"'[\x20\x09-\x0D]+'"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {SPACE}), lambda w: w <> '')"


LINES = f"""
docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, source, text, i, s[i] AS line, lower(array_to_string({words("s[i]")}, ' ')) AS norm
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS s,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs))"""

# Equal texts of one source count once.
TEXTS = """
hosts AS (SELECT source, count(DISTINCT text) AS n_docs FROM docs GROUP BY source),
counts AS (SELECT source, norm, count(DISTINCT text) AS n FROM lines WHERE norm <> '' GROUP BY source, norm)"""


def often(share: float, at_least: int) -> str:
    return f"""often AS (SELECT c.source, c.norm FROM counts c JOIN hosts h
  ON c.source IS NOT DISTINCT FROM h.source WHERE n >= {at_least} AND n > {share}::DOUBLE * n_docs)"""


LINE_DEDUP = f"""
WITH {LINES}, {TEXTS}, {often(0.1, 5)},
marked AS (SELECT l.*, o.norm IS NOT NULL AS gone FROM lines l LEFT JOIN often o
  ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

# Texts of one source whose sets of five-word windows have a similarity of 0.8, and all they reach, count as one.
COPY_CLASSES = f"""
numbered AS (SELECT source, text, row_number() OVER () AS t FROM (SELECT DISTINCT source, text FROM docs)),
split AS (SELECT t, source, {words("text")} AS w FROM numbered),
fives AS (SELECT DISTINCT t, source, array_to_string(w[p:p + 4], ' ') AS five FROM (
  SELECT t, source, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM split WHERE len(w) > 0)),
widths AS (SELECT t, count(*) AS n FROM fives GROUP BY t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM fives a JOIN fives b
  ON a.five = b.five AND a.source IS NOT DISTINCT FROM b.source AND a.t < b.t GROUP BY ALL),
alike AS (SELECT a, b FROM common c JOIN widths x ON c.a = x.t JOIN widths y ON c.b = y.t
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach AS (SELECT t AS a, t AS b FROM numbered
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
classes AS (SELECT source, text, min(b) AS class FROM numbered n JOIN reach r ON n.t = r.a GROUP BY source, text),
classed AS (SELECT l.source, l.norm, class FROM lines l JOIN classes c
  ON l.source IS NOT DISTINCT FROM c.source AND l.text = c.text WHERE norm <> ''),
hosts AS (SELECT source, count(DISTINCT class) AS n_docs FROM classes GROUP BY source),
counts AS (SELECT source, norm, count(DISTINCT class) AS n FROM classed GROUP BY source, norm)"""

QUALITY_RULES = f"""
WITH RECURSIVE {LINES}, {COPY_CLASSES}, {often(0.1, 10)},
texts AS (SELECT doc_id, text, {words("text")} AS w FROM docs),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM texts WHERE len(w) > 4),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS five FROM starts),
repeated AS (SELECT doc_id, p FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n
  FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE norm <> '' GROUP BY doc_id),
frequent AS (SELECT l.doc_id, sum(len({words("l.line")}))::BIGINT AS n FROM lines l
  JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY l.doc_id),
rows AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(f.n, 0) AS n_frequent_words
  FROM texts t LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN frequent f USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM rows)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_frequent_words >= 10
    AND n_words - n_frequent_words >= 0.2::DOUBLE * n_words AS kept,
  n_frequent_words
FROM judged
"""


def weight_case(names: list[str]) -> str:
    cases = [
        "WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(names, path, strict=True)) + f" THEN {w}"
        for path, w in MIX_WEIGHTS.items()
        if len(path) == len(names)
    ]
    return "CASE " + " ".join(cases) + " ELSE 1 END" if cases else "1"


def level(depth: int) -> str:
    """Budgets of the nodes at one depth from those above."""
    names = ["domain", "lang", "source"][:depth]
    parent = ", ".join(["root", *names[:-1]])
    match = " AND ".join(f"c.{n} IS NOT DISTINCT FROM b.{n}" for n in ["root", *names[:-1]])
    order = f"PARTITION BY {parent} ORDER BY capacity / weight, {names[-1]} NULLS LAST"
    return f"""
children{depth} AS (SELECT root, {", ".join(names)}, sum(supply * {MIX["max_epochs"]})::BIGINT AS capacity,
  {weight_case(names)} AS weight FROM leaves GROUP BY ALL),
rates{depth} AS (SELECT c.*, (b.budget - coalesce(sum(capacity) OVER (
    PARTITION BY {", ".join("c." + n for n in ["root", *names[:-1]])} ORDER BY capacity / weight, c.{names[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (PARTITION BY {", ".join("c." + n for n in ["root", *names[:-1]])} ORDER BY capacity / weight, c.{names[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM children{depth} c JOIN budgets{depth - 1} b ON {match}),
budgets{depth} AS (SELECT root, {", ".join(names)}, least(capacity,
  floor(weight * max(rate) OVER (PARTITION BY {parent}))::BIGINT) AS budget FROM rates{depth})"""


MIXING = f"""
WITH docs AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
  lang, source, len({words("coalesce(text, '')")})::BIGINT AS tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, lang, source, sum(tokens)::BIGINT AS supply FROM docs GROUP BY ALL),
budgets0 AS (SELECT 0 AS root, floor(sum(supply)::DOUBLE * {MIX["budget_share"]}::DOUBLE)::BIGINT AS budget FROM leaves),
{",".join(level(d) for d in (1, 2, 3))},
plan AS (SELECT l.domain, l.lang, l.source, budget // supply AS whole, budget % supply AS rest
  FROM leaves l JOIN budgets3 b ON l.domain = b.domain AND l.lang IS NOT DISTINCT FROM b.lang
  AND l.source IS NOT DISTINCT FROM b.source WHERE supply > 0),
placed AS (SELECT d.*, whole, rest, md5('{MIX["seed"]}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang
  AND d.source IS NOT DISTINCT FROM p.source),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS up_to FROM placed),
epochs AS (SELECT *, whole + CASE WHEN up_to <= rest THEN 1 ELSE 0 END AS n FROM running)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, n)) AS epoch FROM epochs WHERE n > 0
"""

EMBEDDINGS = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.a LEFT JOIN counts c ON e.vec_id = c.a
"""

MINHASH = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS five FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM texts WHERE len(w) > 0)),
bags AS (SELECT doc_id, five, count(*) AS n FROM windows GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS n FROM bags GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n FROM bags a JOIN bags b
  ON a.five = b.five AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id
  WHERE s.n >= 0.8::DOUBLE * (x.n + y.n - s.n)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS doc_id, min(b) AS class_id, min(b) = a AS kept FROM reach GROUP BY a
"""



def squared(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def assignment(number: int) -> str:
    """Every vector with its nearest centroid of one round."""
    return f"""
near{number} AS MATERIALIZED (SELECT r, vec_id, v, min((d, c)) AS best FROM (
  SELECT r, vec_id, k.v AS v, c, {squared("k.v", "m.v")} AS d FROM kept k, means{number} m) GROUP BY ALL)"""


def means(number: int) -> str:
    """Centroids after a round: means rounded down, old ones where a centroid has no vector."""
    return f"""
sums{number} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
  SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{number - 1}) GROUP BY ALL),
moved{number} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{number} GROUP BY c),
means{number} AS MATERIALIZED (SELECT m.c, coalesce(x.v, m.v) AS v FROM means{number - 1} m LEFT JOIN moved{number} x ON m.c = x.c)"""


CLUSTERED = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
means0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{CLUSTERS["seed"]}:' || vec_id), v) - 1 AS c, v
  FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS["k"]}),
{",".join(assignment(n) + "," + means(n + 1) for n in range(CLUSTERS["rounds"]))},
{assignment(CLUSTERS["rounds"])}
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance,
  (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{CLUSTERS["rounds"]} n JOIN means{CLUSTERS["rounds"]} m ON n.best[2] = m.c
"""

ASCII_BETWEEN = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def licence_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {ASCII_BETWEEN}), lambda w: w <> '')"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LICENCE_ROWS = ", ".join(f"({i}, '{t.label}', {len(t.within) > 1}, {quoted([t.text])})" for i, t in enumerate(TEMPLATES))
PHRASE_ROWS = ", ".join(f"({quoted([phrase, label])})" for phrase, label in PHRASES.items())

LICENCES = rf"""
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
texts AS (SELECT doc_id, text, {licence_words("text")} AS w FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
phrases(phrase, label) AS (VALUES {PHRASE_ROWS}),
followed AS (SELECT doc_id, i, word, lead(word) OVER d AS second, lead(word, 2) OVER d AS third
  FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
places AS (SELECT doc_id, i, label FROM followed JOIN phrases
  ON phrase = CASE WHEN phrase LIKE '% % %' THEN word || ' ' || second || ' ' || third ELSE word || ' ' || second END),
templates(t, label, paragraph, text) AS (VALUES {LICENCE_ROWS}),
template_words AS (SELECT DISTINCT t, label, paragraph, unnest({licence_words("lower(text)")}) AS word FROM templates),
sizes AS (SELECT t, count(*) AS size FROM template_words GROUP BY t),
blocks AS (SELECT doc_id, FALSE AS paragraph, unnest(s) AS block, generate_subscripts(s, 1) AS b
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM docs)
  UNION ALL SELECT doc_id, TRUE, unnest(s), generate_subscripts(s, 1)
  FROM (SELECT doc_id, string_split_regex(text, '
[ 	-
]*
') AS s FROM docs)),
block_words AS (SELECT DISTINCT doc_id, paragraph, b, unnest({licence_words("block")}) AS word FROM blocks),
contained AS (SELECT doc_id, label, count(*) / any_value(size) AS part
  FROM block_words x JOIN template_words y ON x.word = y.word AND x.paragraph = y.paragraph JOIN sizes s ON s.t = y.t
  GROUP BY doc_id, x.paragraph, b, y.t, label HAVING 100 * count(*) >= {CONTAINED_PERCENT} * any_value(size)),
base AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
  SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM contained) GROUP BY doc_id),
best AS (SELECT doc_id, max(part) AS part FROM contained GROUP BY doc_id)
SELECT x.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low AS first_word, high AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM texts x LEFT JOIN base ON x.doc_id = base.doc_id LEFT JOIN every ON x.doc_id = every.doc_id
LEFT JOIN best ON x.doc_id = best.doc_id
"""

ORACLE = {
    "op2_line_dedup": LINE_DEDUP,
    "op7_mixing_weights": MIXING,
    "op8_quality_rules": QUALITY_RULES,
    "op9_embedding_tiles": EMBEDDINGS,
    "op10_bag_minhash": MINHASH,
    "op11_centroid_search": CLUSTERED,
    "op12_license_scan": LICENCES,
}
