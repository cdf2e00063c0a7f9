"""DuckDB SQL of the corpus queries that SQL can express.

Each function returns common table expressions that read the table
expression ``docs`` (columns of ``documents``) and end in the named one, so
the pipeline's SQL is its stages' in a row.  ``p`` prefixes the names.
"""

from __future__ import annotations

from tessera.llm import line_dedup, mixing, quality_rules

_SPACE = r"[\x20\x09-\x0D]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separator: str = _SPACE) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{separator}'), lambda x: x <> '')"


def substring_dedup(docs: str = "documents", k: int = 50) -> str:
    return f"""
WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM {docs}),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {k - 1}), ' ')) AS h
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM
         (SELECT win.doc_id, win.i, unnest(range({k})) AS j FROM win JOIN low USING (h) WHERE low.m < win.doc_id)),
each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
         GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def decontaminate(docs: str, p: str, n: int = 10) -> str:
    """``{p}found``: doc_id, n_words, n_hit, n_items, ids."""
    words = _words(_LOWER.format("text"), _BREAK)
    return f"""
{p}item AS (SELECT item_id, {words} AS ws FROM benchmark),
{p}gram AS (SELECT DISTINCT item_id, len, array_to_string(list_slice(ws, i, i + len - 1), ' ') AS g FROM
            (SELECT item_id, ws, least({n}, len(ws)) AS len, unnest(range(1, len(ws) - least({n}, len(ws)) + 2)) AS i
             FROM {p}item WHERE len(ws) > 0)),
{p}w AS (SELECT doc_id, {words} AS ws FROM {docs}),
{p}at AS (SELECT doc_id, i, len, array_to_string(list_slice(ws, i, i + len - 1), ' ') AS g FROM
          (SELECT doc_id, ws, l.len, unnest(range(1, len(ws) - l.len + 2)) AS i
           FROM {p}w, (SELECT DISTINCT len FROM {p}gram) l WHERE len(ws) >= l.len)),
{p}hit AS (SELECT DISTINCT a.doc_id, a.i, a.len, b.item_id FROM {p}at a JOIN {p}gram b ON a.len = b.len AND a.g = b.g),
{p}cover AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(len)) AS j FROM {p}hit) GROUP BY doc_id),
{p}ids AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
           FROM (SELECT DISTINCT doc_id, item_id FROM {p}hit) GROUP BY doc_id),
{p}found AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
             CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(ids, '') AS ids
             FROM {p}w w LEFT JOIN {p}cover USING (doc_id) LEFT JOIN {p}ids USING (doc_id))"""


def near_dedup(docs: str, p: str, k: int = 4, threshold: int = 80) -> str:
    """``{p}group``: doc_id, n_shingles, component_id."""
    return f"""
{p}w AS (SELECT doc_id, {_words(_LOWER.format('text'))} AS ws FROM {docs}),
{p}sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + {k - 1}), ' ')) AS s FROM
          (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS i FROM {p}w WHERE len(ws) > 0)),
{p}n AS (SELECT doc_id, count(*) AS n FROM {p}sh GROUP BY doc_id),
{p}both AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM {p}sh a JOIN {p}sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
{p}link AS (SELECT u, v FROM {p}both JOIN {p}n x ON x.doc_id = u JOIN {p}n y ON y.doc_id = v
            WHERE 100 * c >= {threshold} * (x.n + y.n - c)),
{p}sym AS (SELECT u, v FROM {p}link UNION SELECT v, u FROM {p}link),
{p}reach AS (SELECT u, v FROM {p}sym UNION SELECT r.u, s.v FROM {p}reach r JOIN {p}sym s ON r.v = s.u),
{p}group AS (SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
             FROM {p}w w LEFT JOIN {p}n USING (doc_id) LEFT JOIN (SELECT u, min(v) AS m FROM {p}reach GROUP BY u) ON u = w.doc_id)"""


def _listed(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def quality_rules_of(docs: str, p: str) -> str:
    """``{p}judged``: doc_id, the base counts, base_failed, kept."""
    stop = " ".join(f"WHEN lang = '{c}' THEN len(list_filter(ws, lambda x: list_contains("
                    f"{_listed(f for w in ws for f in dict.fromkeys((w, w.capitalize(), w.upper())))}, x)))"
                    for c, ws in quality_rules.STOP_WORDS.items())
    measure = {
        "mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / word_chars", "exclaim_ratio": "n_excl / word_chars",
        "capital_ratio": "n_caps / word_chars", "stop_word_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines",
        "bullet_line_ratio": "n_bullets / n_lines", "ellipsis_line_ratio": "n_ellipsis / n_lines"}
    fails = []
    for r in quality_rules.RULES:
        bounds = ([f"{measure[r.measure]} < {r.low}"] if r.low is not None else []) + (
            [f"{measure[r.measure]} > {r.high}"] if r.high is not None else [])
        fails.append(f"coalesce(({' OR '.join(bounds)}) AND n_words >= {r.min_words}, false)")
    return f"""
{p}w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_words('text')} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM {docs}),
{p}win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS h FROM
           (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM {p}w WHERE len(ws) >= 5)),
{p}rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS j FROM {p}win
           JOIN (SELECT doc_id, h FROM {p}win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, h)) GROUP BY doc_id),
{p}c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(replace(t, '!', '')) AS n_excl, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_caps,
         CASE {stop} END AS n_stop, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ellipsis
         FROM {p}w w LEFT JOIN {p}rep rep USING (doc_id)),
{p}judged AS (SELECT *, base_failed IS FALSE AND NOT ({' OR '.join(fails)}) AS kept FROM
              (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM {p}c))"""


def line_dedup_of(docs: str, p: str) -> str:
    """``{p}clean``: the columns of documents, text without boilerplate, and n_lines, n_dropped."""
    bare = "regexp_replace({}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
    return f"""
{p}page AS (SELECT DISTINCT source, text FROM {docs}),
{p}total AS (SELECT source, count(*) AS total FROM {p}page GROUP BY source),
{p}line AS (SELECT source, l, count(*) AS pages FROM
            (SELECT DISTINCT source, text, {bare.format('l')} AS l FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS l FROM {p}page))
            WHERE l <> '' GROUP BY ALL),
{p}drop AS (SELECT source, list(l) AS ls FROM {p}line JOIN {p}total USING (source)
            WHERE pages >= {line_dedup.MIN_PAGES} AND pages / total > {line_dedup.RATIO} GROUP BY source),
{p}clean AS (SELECT doc_id, CASE WHEN ls IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)),
             lambda x: NOT list_contains(ls, {bare.format('x')})), chr(10)) END AS text, lang, d.source, d.n_chars,
             CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
             CAST(CASE WHEN ls IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(ls, {bare.format('x')}))) END AS BIGINT)
             AS n_dropped FROM {docs} d LEFT JOIN {p}drop b ON d.source IS NOT DISTINCT FROM b.source)"""


def mixing_of(docs: str, p: str) -> str:
    """``{p}mix``: doc_id, size, source_size, target, copies."""
    weights = ", ".join(str(float(w)) for w in mixing.WEIGHTS)
    key = f"md5('{mixing.SEED}' || coalesce('|' || CAST(doc_id AS VARCHAR), ''))"
    return f"""
{p}size AS (SELECT doc_id, source, CAST(len({_words('text')}) AS BIGINT) AS size FROM {docs}),
{p}src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM {p}size GROUP BY source),
{p}wt AS (SELECT *, source_size * {mixing.MAX_REPEAT} AS lim,
          [{weights}][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mixing.WEIGHTS)}] AS w FROM {p}src),
{p}lev AS (SELECT *, (sum(source_size) OVER () * {mixing.BUDGET} - coalesce(sum(lim) OVER before, 0)) /
           (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level, lim / w AS full_at FROM {p}wt
           WINDOW before AS (ORDER BY lim / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}top AS (SELECT coalesce(arg_min(level, full_at) FILTER (level <= full_at), max(full_at)) AS level FROM {p}lev),
{p}goal AS (SELECT source, source_size, CAST(least(lim, w * level) AS DOUBLE) AS target FROM {p}wt, {p}top),
{p}rate AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
            FROM {p}size s JOIN {p}goal g ON s.source IS NOT DISTINCT FROM g.source),
{p}mix AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr({key}, 1, 13) AS BIGINT) / {1 << 52} < rate - floor(rate)
           THEN 1 ELSE 0 END AS copies FROM {p}rate)"""


def spelling(docs: str = "documents", damage: int = 97, least: int = 5, often: int = 3, ratio: int = 2) -> str:
    run = r"[A-Za-z\u00C0-\u00FF]+".encode().decode("unicode_escape")
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
             THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
run AS (SELECT doc_id, {_LOWER.format('raw')} AS run, count(*) AS times
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{run}')) AS raw FROM {docs}) GROUP BY ALL),
keyed AS (SELECT *, CAST(doc_id AS VARCHAR) || ':' || run AS k, hex(k) AS x FROM run),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
             lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
             lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM keyed, crc_table),
spelt AS (SELECT CASE WHEN h % {damage} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) ||
             substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
vocab AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= {least} GROUP BY word HAVING sum(times) >= {often}),
cut AS (SELECT DISTINCT word, n, length(word) AS len, gap, substr(word, 1, gap) || substr(word, gap + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS gap FROM vocab)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.gap = b.gap AND a.len = b.len AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM pair),
linked AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= {ratio} * n THEN near END AS form,
           CASE WHEN near_n >= {ratio} * n THEN near_n END AS form_n FROM vocab v LEFT JOIN (FROM ranked WHERE place = 1) r USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM linked
          UNION ALL SELECT c.word, l.word, l.form FROM chain c JOIN linked l ON c.next = l.word)
SELECT word, form, root, n, n_near, form_n FROM linked JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)"""


def hard_negatives(positives: int = 5, negatives: int = 3) -> str:
    return f"""
WITH item AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
              list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
score AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s
          FROM item a JOIN item b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= {positives}),
neg AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.s AS positive_score, n.s AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.s DESC, n.id) AS INTEGER) AS rank
        FROM pos p JOIN score n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT * FROM neg WHERE rank <= {negatives}"""


def pipeline() -> str:
    """Rows of the whole pipeline over ``documents``."""
    cols = "doc_id, text, lang, source, n_chars"
    return f"""
WITH RECURSIVE {quality_rules_of('documents', 'q_')},
s1 AS (SELECT d.* FROM documents d JOIN q_judged j USING (doc_id) WHERE j.kept),
{line_dedup_of('s1', 'l_')},
s2 AS (SELECT doc_id, text, lang, source, CASE WHEN n_dropped > 0 THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars FROM l_clean),
{near_dedup('s2', 'n_')},
s3 AS (SELECT s2.* FROM s2 JOIN n_group USING (doc_id) WHERE component_id = doc_id),
{decontaminate('s3', 'd_')},
s4 AS (SELECT s3.* FROM s3 JOIN d_found USING (doc_id) WHERE n_hit = 0),
{mixing_of('s4', 'm_')}
SELECT {cols} FROM (SELECT s4.*, unnest(range(copies)) AS copy FROM s4 JOIN m_mix USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    base = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    return {
        "op1_substring_dedup": substring_dedup(),
        "op2_decontaminate": f"WITH {decontaminate('documents', 'd_')} SELECT doc_id, n_words, n_hit, n_items, "
                             "sha256(ids) AS items_sha256, n_hit > 0 AS contaminated FROM d_found",
        "op3_near_dedup": f"WITH RECURSIVE {near_dedup('documents', 'n_')} SELECT *, doc_id = component_id AS kept FROM n_group",
        "op5_quality_rules": f"WITH {quality_rules_of('documents', 'q_')} SELECT doc_id, {base}, base_failed, kept FROM q_judged",
        "op8_mix_sources": f"WITH {mixing_of('documents', 'm_')} SELECT doc_id, size, source_size, target, "
                           "CAST(size * copies AS BIGINT) AS taken FROM m_mix",
        "op11_spelling_variants": spelling(),
        "op12_hard_negatives": hard_negatives(),
        "op9_line_dedup": f"WITH {line_dedup_of('documents', 'l_')} SELECT doc_id, source, n_lines, n_dropped, text FROM l_clean",
    }
