r"""DuckDB SQL for the queries of this package that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_decontamination"] = r"""
WITH item AS (
    SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS words, least(10, len(w)) AS width
    FROM item, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS u(i) WHERE len(w) > 0),
doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
run AS (
    SELECT doc_id, i, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS words
    FROM doc, (SELECT DISTINCT width FROM win), unnest(generate_series(1, len(w) - width + 1)) AS u(i)),
hit AS (SELECT doc_id, i, run.width AS width, item_id FROM run JOIN win ON run.words = win.words AND run.width = win.width),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, i, width FROM hit), unnest(generate_series(i, i + width - 1)) AS u(p)
    GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op7_chat_formatting"] = """
WITH turn AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM turn),
conv AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY n) AS said, count(*) AS turns FROM numbered GROUP BY conv_id),
beginning AS (SELECT DISTINCT list_slice(said, 1, i) AS said FROM conv, unnest(generate_series(1, turns - 1)) AS u(i)),
kept AS (SELECT min(conv_id) AS conv_id, min(turns) AS turns FROM conv WHERE said NOT IN (SELECT said FROM beginning) GROUP BY said)
SELECT conv_id, turns, n, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10)
    AS rendered, coalesce(role, '') = 'assistant' AS trained
FROM numbered JOIN kept USING (conv_id)
"""

ORACLES["op10_repeated_passages"] = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
run AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS words
    FROM doc, unnest(generate_series(1, len(w) - 12)) AS u(i)),
early AS (SELECT words, min(doc_id) AS first FROM run GROUP BY words),
gone AS (
    SELECT DISTINCT doc_id, p FROM run JOIN early USING (words), unnest(generate_series(i, i + 12)) AS u(p) WHERE first < doc_id),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op11_lexical_search"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM doc WHERE len(w) > 0),
item AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (
    SELECT doc_id, term, n, count(*) AS tf
    FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY doc_id, term, n),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words))))) AS BIGINT) AS score
    FROM item JOIN weight USING (term) JOIN held USING (term), total GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op12_exact_duplicates"] = r"""
WITH doc AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM doc
"""

ORACLES["op13_filter_audit"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM doc GROUP BY t),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
         'C': 100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
         'E': coalesce(first < doc_id, false)} AS f
    FROM doc JOIN first USING (t) LEFT JOIN said USING (doc_id)),
mask AS (
    SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END)
        || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
        count(*) AS n FROM failed GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (
    SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, filter_order[1:i - 1] AS earlier
    FROM orders, unnest(generate_series(1, 5)) AS u(i)),
each AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS fail,
        len(fails) > len(translate(fails, earlier, '')) AS gone FROM mask, step),
counted AS (
    SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (fail AND gone), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(n) FILTER (fail AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(n) FILTER (fail AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
    FROM each GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
