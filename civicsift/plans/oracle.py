"""SQL twins of the registered queries, for a second engine to check results against."""

from __future__ import annotations

from civicsift.constants import LABELS
from civicsift.operators.metrics import GRID
from civicsift.plans.lexicon import ENTRIES, QUERY_NEGATORS
from civicsift.plans.registry import (
    EVAL_THRESHOLDS,
    MASK_THRESHOLDS,
    MODEL_INTERCEPTS,
    MODEL_LABELS,
    MODEL_THRESHOLDS,
)

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
RULE_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
MODEL_TOKEN = r"[\p{L}\p{N}_]{2,}"
BLANK = r"\t\n\x0b\f\r\x{FEFF}\p{Z}"
SENTENCE = rf"[^.!?\n\r]+[.!?\x{{2026}}]*[{BLANK}]*"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _clean(column: str) -> str:
    return f"trim(regexp_replace({column}, '[{SPACE}]+', ' ', 'g'))"


def _key(column: str) -> str:
    low = f"lower({_clean(column)})"
    return f"CASE WHEN starts_with({low}, 'http://') OR starts_with({low}, 'https://') THEN '' ELSE {low} END"


def _hit(sequences: list[list[str]]) -> str:
    """True at a token at which one of the token sequences starts."""
    return " OR ".join(
        "(" + " AND ".join(f"{('tok', 'next1')[k]} = {_text(word)}" for k, word in enumerate(words)) + ")"
        for words in sequences)


def _pairs(tokens: str) -> str:
    return f"list_transform(list_zip({tokens}[:-2], {tokens}[2:]), lambda x: x[1] || ' ' || x[2])"


def _labeled() -> str:
    """CTEs ending in ``l``: comments with scores, flags and labels."""
    negators = "(" + ", ".join(_text(word) for word in QUERY_NEGATORS) + ")"
    counts = ", ".join(f"count(*) FILTER (free AND ({_hit(sequences)})) AS h{i}"
                       for i, (_, _, _, sequences) in enumerate(ENTRIES))
    zeros = ", ".join(f"coalesce(h{i}, 0) AS h{i}" for i in range(len(ENTRIES)))
    raw = []
    for name in LABELS:
        own = [(i, weight) for i, (label, _, weight, _) in enumerate(ENTRIES) if label == name]
        count = " + ".join(f"h{i}" for i, _ in own)
        weight = " + ".join(f"h{i} * {weight}" for i, weight in own)
        raw.append(f"CASE WHEN live THEN least(1.0::DOUBLE, 0.5::DOUBLE * ({count}) + 0.15::DOUBLE * ({weight})) "
                   f"ELSE 0.0 END AS r_{name}")
    others = ", ".join(f"r_{name}" for name in LABELS)
    exact = ", ".join([f"greatest({others}) AS e_toxic"] + [f"r_{n} AS e_{n}" for n in LABELS if n != "toxic"])
    scores = ", ".join(f"round_even(e_{n}, 4)::DOUBLE AS {n}_score, (e_{n} >= 0.5)::INTEGER AS {n}_bin"
                       for n in LABELS)
    joined = ", ".join(f"CASE WHEN e_{n} >= 0.5 THEN '{n}' END" for n in LABELS)
    return f"""
WITH s AS (
  SELECT doc_id, source, text,
    regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS t FROM documents),
k AS (
  SELECT *, t <> '' AND NOT starts_with(lower(t), 'http') AS live,
    regexp_extract_all(lower(t), '{RULE_TOKEN}') AS tk FROM s),
u AS (SELECT doc_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS i FROM k),
w AS (SELECT doc_id, tok, lead(tok) OVER d AS next1,
    coalesce(lag(tok, 1) OVER d, '') NOT IN {negators} AND coalesce(lag(tok, 2) OVER d, '') NOT IN {negators}
    AND coalesce(lag(tok, 3) OVER d, '') NOT IN {negators} AS free
  FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, {counts} FROM w GROUP BY doc_id),
h AS (SELECT doc_id, source, text, live, {zeros} FROM k LEFT JOIN c USING (doc_id)),
r AS (SELECT doc_id, source, text, {', '.join(raw)} FROM h),
e AS (SELECT doc_id, source, text, {exact} FROM r),
l AS (SELECT doc_id, source AS source_subreddit, doc_id::VARCHAR AS comment_id, text,
  {scores}, concat_ws('|', {joined}) AS labels FROM e)"""


_GRAMS = f"""
toks AS (SELECT doc_id, regexp_extract_all(lower({_clean('text')}), '{MODEL_TOKEN}') AS tk FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(tk, {_pairs('tk')})) AS term FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
kept AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 5 AND count(*) <= 0.9 * (SELECT n FROM n)),
vocab AS (
  SELECT term, df, row_number() OVER (ORDER BY encode(term)) - 1 AS idx,
    ln((1.0::DOUBLE + (SELECT n FROM n)) / (1 + df)) + 1 AS idf FROM kept)"""

_VECTORS = """
raw AS (SELECT doc_id, term, idx, (1 + ln(tf::DOUBLE)) * idf AS v FROM tf JOIN vocab USING (term)),
lens AS (SELECT doc_id, sqrt(sum(v * v)) AS len FROM raw GROUP BY doc_id)"""


def _labels_table(thresholds: dict[str, float], name: str = "lab") -> str:
    rows = ", ".join(
        f"({i}, '{label}', {MODEL_INTERCEPTS[i]}::DOUBLE, {thresholds.get(label, 0.5)}::DOUBLE)"
        for i, label in enumerate(MODEL_LABELS))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(no, label, intercept, cut))"


def _scored(thresholds: dict[str, float]) -> str:
    """CTEs ending in ``p``: ``(doc_id, no, label, prob, pred)``."""
    return f"""
WITH {_GRAMS}, {_VECTORS}, {_labels_table(thresholds)},
dots AS (SELECT doc_id, no, sum(v / len * (((idx * (7 + no)) % 13) - 6) * 0.5) AS dot
  FROM raw JOIN lens USING (doc_id), lab GROUP BY doc_id, no),
p AS (SELECT doc_id, no, label, 1 / (1 + exp(-(intercept + coalesce(dot, 0)))) AS prob,
  (1 / (1 + exp(-(intercept + coalesce(dot, 0)))) >= cut)::INTEGER AS pred
  FROM documents CROSS JOIN lab LEFT JOIN dots USING (doc_id, no))"""


def _sentence_scores(segments: str) -> str:
    """CTEs that score ``segments(key, node, pos, part)`` and end in ``act(key, node, pos, labels)``."""
    return f"""
{_GRAMS}, {_labels_table(MASK_THRESHOLDS)},
{segments},
seg AS (SELECT key, node, pos, part,
  regexp_replace(part, '^[{BLANK}]+|[{BLANK}]+$', '', 'g') AS body FROM parts),
stoks AS (SELECT key, node, pos,
  regexp_extract_all(lower({_clean('body')}), '{MODEL_TOKEN}') AS tk FROM seg WHERE body <> ''),
sgrams AS (SELECT key, node, pos, unnest(list_concat(tk, {_pairs('tk')})) AS term FROM stoks),
stf AS (SELECT key, node, pos, term, count(*) AS tf FROM sgrams GROUP BY ALL),
sraw AS (SELECT key, node, pos, idx, (1 + ln(tf::DOUBLE)) * idf AS v FROM stf JOIN vocab USING (term)),
slen AS (SELECT key, node, pos, sqrt(sum(v * v)) AS len FROM sraw GROUP BY ALL),
sdots AS (SELECT key, node, pos, no, sum(v / len * (((idx * (7 + no)) % 13) - 6) * 0.5) AS dot
  FROM sraw JOIN slen USING (key, node, pos), lab GROUP BY ALL),
act AS (SELECT key, node, pos, string_agg(label, ', ' ORDER BY no) AS labels
  FROM stoks CROSS JOIN lab LEFT JOIN sdots USING (key, node, pos, no)
  WHERE 1 / (1 + exp(-(intercept + coalesce(dot, 0)))) >= cut GROUP BY ALL)"""


_BEST = f"""
SELECT comment_id, source_subreddit, toxic_score, created_utc, body FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY try_cast(toxic_score AS DOUBLE) DESC NULLS LAST,
    created_utc DESC, comment_id DESC, doc_id) AS rn
  FROM (SELECT d.doc_id, d.doc_id::VARCHAR AS comment_id, source AS source_subreddit,
      coalesce(toxic::VARCHAR, '') AS toxic_score, n_chars::VARCHAR AS created_utc, text AS body,
      {_key('text')} AS key
    FROM documents d LEFT JOIN labels USING (doc_id))
  WHERE key <> '') WHERE rn = 1"""

_PREPARED = f"""
WITH prep AS (
  SELECT d.doc_id::VARCHAR AS comment_id, (d.doc_id % 50)::VARCHAR AS post_id, '' AS created_utc, source AS subreddit,
    coalesce(toxic, 0) AS toxic, coalesce(quality, 0) AS insult, 0 AS threat, {_clean('text')} AS body_clean
  FROM documents d LEFT JOIN labels USING (doc_id)
  WHERE text NOT IN ('', '[deleted]', '[removed]')
    AND {_clean('text')} <> '' AND NOT starts_with({_clean('text')}, 'http'))"""

_CLEAN_COUNTS = f"""
SELECT count(*) AS input_rows, count(*) FILTER (k = '') AS removed_empty,
  count(*) FILTER (k <> '') - count(DISTINCT k) FILTER (k <> '') AS removed_duplicates,
  count(DISTINCT k) FILTER (k <> '') AS output_rows FROM (SELECT {_key('text')} AS k FROM documents)"""

_DIRTY = """
WITH x AS (
  SELECT CASE j WHEN 3 THEN 'hot' WHEN 2 THEN 'v' || doc_id WHEN 4 THEN 'v' || doc_id ELSE doc_id::VARCHAR END AS comment_id,
    CASE j WHEN 1 THEN 'again ' || text WHEN 4 THEN 'late ' || text WHEN 2 THEN
      ['', '[deleted]', '[removed]', 'http://x.org/ a', E' \\n\\t ', 'HTTP://X.ORG a', '  https://y.org', '[deleted] '][doc_id % 8 + 1]
      ELSE text END AS body, doc_id * 5 + j AS "at"
  FROM documents, (SELECT unnest(range(5)) AS j))"""

_PATTERN_FILES = f"""
WITH d AS (
  SELECT doc_id, coalesce(nullif(regexp_extract(text, '[A-Za-z]{{3,}}'), ''), 'none') AS word, doc_id % {len(LABELS)} AS place,
    doc_id // {len(LABELS)} % 10 AS kind FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY doc_id) AS line FROM d),
o AS (SELECT *, 0 AS origin FROM n UNION ALL SELECT *, 1 FROM n WHERE place < 3)
SELECT origin, [{", ".join(_text(name) for name in LABELS)}][place + 1] AS label, line,
  CASE kind WHEN 7 THEN '(' || word WHEN 8 THEN '\\b' || word || '\\b' WHEN 9 THEN word || '|x' || word ELSE word END AS pattern,
  CASE kind WHEN 2 THEN 0.5 WHEN 3 THEN 1.25 WHEN 6 THEN NULL WHEN 8 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
  CASE kind WHEN 6 THEN 'no number' WHEN 7 THEN 'invalid regex' ELSE '' END AS problem,
  row_number() OVER (ORDER BY place, origin, line) AS number
FROM o WHERE kind > 1"""

_PAIRS_OF = """SELECT {id} p || ' ' || r AS pair FROM (
  SELECT {id} unnest(w) AS p, unnest(w[2:]) AS q, unnest(w[3:]) AS r FROM (
    SELECT {id} regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS w FROM {table}))
  WHERE regexp_full_match(p, '[a-z]{{4,}}') AND q = ' ' AND regexp_full_match(r, '[a-z]{{4,}}') AND p <> r"""

_PATTERN_HITS = f"""
WITH known AS (SELECT DISTINCT pair FROM ({_PAIRS_OF.format(id='', table='conversations')}))
SELECT doc_id, pair, count(*) AS matches FROM ({_PAIRS_OF.format(id='doc_id,', table='documents')})
JOIN known USING (pair) GROUP BY ALL"""

_TRUTH = """truth AS (SELECT doc_id, doc_id % 50 AS post_id, n_chars, toxic, quality
  FROM documents JOIN labels USING (doc_id))"""

_ALL_THREADS = """truth AS (SELECT doc_id, doc_id % 50 AS post_id, n_chars, coalesce(toxic, 0) AS toxic,
  coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id))"""

_EVAL = f"""
WITH {_TRUTH},
ev AS (
  SELECT doc_id AS row_id, 'toxic' AS label, toxic AS y, least((n_chars * 37 % 101) / 100.0::DOUBLE, 1.0) AS prob
  FROM truth
  UNION ALL
  SELECT doc_id, 'quality', quality, (n_chars * 7919 % 10007 + quality * 2000) / 12007.0::DOUBLE FROM truth),
cut AS (SELECT * FROM (VALUES ('toxic', {EVAL_THRESHOLDS['toxic']}::DOUBLE), ('quality', 0.5::DOUBLE)) v(label, thr)),
pr AS (SELECT row_id, label, y, prob, prob >= thr AS hit, thr FROM ev JOIN cut USING (label)),
cm AS (SELECT label, count(*) FILTER (y = 0 AND NOT hit) AS tn, count(*) FILTER (y = 0 AND hit) AS fp,
  count(*) FILTER (y = 1 AND NOT hit) AS fn, count(*) FILTER (y = 1 AND hit) AS tp, max(thr) AS threshold
  FROM pr GROUP BY label),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cm),
g AS (SELECT label, prob, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ev GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY label) AS positives, sum(neg) OVER (PARTITION BY label) AS negatives
  FROM g WINDOW w AS (PARTITION BY label ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT label, sum(pos / positives * tp / (tp + fp)) AS average_precision,
  sum(neg * (tp - pos + pos / 2)) / (max(positives) * max(negatives)) AS roc_auc FROM c GROUP BY label)"""

_PAGE_PIECE = (
    "(?is)"
    + "|".join(rf"<{name}\b[^>]*>.*?</{name}\s*>" for name in ("title", "script", "style", "noscript", "textarea", "template"))
    + r"""|<!--.*?-->|<[!?/][^>]*>|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<"""
).replace("'", "''")

_DECODED = (
    "replace(replace(replace(replace(piece, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
)

_NODES = f"""
pieces AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS node
  FROM (SELECT page_id, regexp_extract_all(html, '{_PAGE_PIECE}') AS ps FROM pages)),
nodes AS (SELECT page_id, node, {_DECODED} AS text FROM pieces
  WHERE NOT regexp_matches(piece, '(?i)^<([a-z/!?]|$)') AND regexp_matches({_DECODED}, '[A-Za-z0-9_]'))"""

_TURNS = f"""
turns AS (SELECT concat_ws('-', conv_id::VARCHAR, turn::VARCHAR) AS turn_id, text,
  regexp_extract_all(text, '{SENTENCE}') AS found FROM conversations),
tparts AS (SELECT turn_id, text, CASE WHEN len(found) = 0 THEN [text] ELSE found END AS parts FROM turns)"""

_PLACEHOLDER = (
    "'<this sentence was removed for ' || labels || '>' || "
    f"regexp_extract(part, '([{BLANK}]+)$', 1)"
)


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_MASKED_TEXTS = f"""
WITH {_TURNS}, {_sentence_scores('''parts AS (SELECT turn_id AS key, 0 AS node, unnest(parts) AS part,
  generate_subscripts(parts, 1) - 1 AS pos FROM tparts)''')},
joined AS (SELECT key, string_agg(CASE WHEN labels IS NULL THEN part ELSE {_PLACEHOLDER} END, '' ORDER BY pos) AS out,
  count(labels) AS hits FROM seg LEFT JOIN act USING (key, node, pos) GROUP BY key)
SELECT turn_id, CASE WHEN coalesce(hits, 0) = 0 THEN text ELSE out END AS masked
FROM tparts LEFT JOIN joined ON key = turn_id"""

_MASKED_PAGES = f"""
WITH {_NODES},
nparts AS (SELECT page_id, node, CASE WHEN len(found) = 0 THEN [text] ELSE found END AS ps
  FROM (SELECT *, regexp_extract_all(text, '{SENTENCE}') AS found FROM nodes)),
{_sentence_scores('''parts AS (SELECT page_id AS key, node, unnest(ps) AS part,
  generate_subscripts(ps, 1) - 1 AS pos FROM nparts)''')},
rebuilt AS (SELECT key AS page_id, node, string_agg(CASE WHEN labels IS NULL THEN {_escaped('part')}
  ELSE '<span data-masked="placeholder">' || {_escaped(f'({_PLACEHOLDER})')} || '</span>' END, '' ORDER BY pos) AS out
  FROM seg LEFT JOIN act USING (key, node, pos) GROUP BY ALL HAVING count(labels) > 0)
SELECT page_id, string_agg(coalesce(out, piece), '' ORDER BY node) AS masked
FROM pieces LEFT JOIN rebuilt USING (page_id, node) GROUP BY page_id"""

_DETAIL = " UNION ALL ".join(
    f"SELECT source_subreddit, '{n}' AS label, sum({n}_bin)::BIGINT AS positives FROM l GROUP BY source_subreddit"
    for n in LABELS if n != "toxic")
_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS label, sum({n}_bin)::BIGINT AS positives FROM l" for n in LABELS)
_SCORE_COLUMNS = ", ".join(f"{n}_score, {n}_bin" for n in LABELS)
_TRIGRAMS = (
    f"list_concat(list_concat(tk, {_pairs('tk')}), "
    "list_transform(list_zip(tk[:-3], tk[2:-2], tk[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))"
)
_GRID_VALUES = ", ".join(f"({value!r}::DOUBLE)" for value in GRID)

ORACLE: dict[str, str] = {
    "merge_union": """
SELECT 'documents' AS source_subreddit, doc_id::VARCHAR AS comment_id, lang, text AS body, '' AS post_id, '' AS role
FROM documents
UNION ALL SELECT 'conversations', '', '', text, conv_id::VARCHAR, role FROM conversations
UNION ALL SELECT 'benchmark', item_id::VARCHAR, '', text, '', '' FROM benchmark""",
    "merge_files": """
        SELECT tag AS source_subreddit, doc_id::VARCHAR AS comment_id, text AS body,
          CASE WHEN tag = 'beta' THEN n_chars::VARCHAR ELSE '' END AS score,
          CASE WHEN tag = 'gamma' THEN lang ELSE '' END AS lang, row_number() OVER (ORDER BY tag, doc_id) AS position
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS tag FROM documents)""",
    "merge_counts": "SELECT count(*) AS rows, true AS all_files FROM documents",
    "pattern_files": _PATTERN_FILES,
    "pattern_hits": _PATTERN_HITS,
    "clean_sorted": f"""
        SELECT comment_id, toxic_score, created_utc, row_number() OVER (ORDER BY try_cast(toxic_score AS DOUBLE)
          DESC NULLS LAST, created_utc DESC, comment_id DESC) AS position FROM ({_BEST})""",
    "label_order": f"""{_PREPARED}, x AS (
        SELECT unnest([{", ".join(_text(name) for name in LABELS)}]) AS label,
          unnest([{", ".join(f"(SELECT sum({name})::BIGINT FROM prep)" if name in ("toxic", "insult") else "0::BIGINT"
                             for name in LABELS)}]) AS positives)
        SELECT label, positives, row_number() OVER (ORDER BY positives DESC, label) AS position FROM x""",
    "preview_rows": f"""{_PREPARED}
        SELECT comment_id, subreddit, toxic, row_number() OVER (ORDER BY comment_id::BIGINT) AS position
        FROM prep ORDER BY position LIMIT 3""",
    "prepare_dirty": f"""{_DIRTY}, c AS (
        SELECT *, {_clean('body')} AS k FROM x WHERE body NOT IN ('', '[deleted]', '[removed]'))
        SELECT comment_id, "at", md5(k) AS body_md5 FROM c WHERE k <> '' AND NOT starts_with(k, 'http')
        QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY "at") = 1""",
    "clean_dirty": f"""{_DIRTY}, c AS (SELECT *, {_key('body')} AS k FROM x)
        SELECT comment_id, "at" FROM c WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY "at") = 1""",
    "label_dirty": f"""{_labeled()}
        SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 0.0 ELSE toxic_score END AS toxic_score,
          CASE WHEN doc_id % 4 < 2 THEN 0.0 ELSE insult_score END AS insult_score,
          CASE WHEN doc_id % 4 < 2 THEN '' ELSE labels END AS labels FROM l""",
    "write_inplace": f"""
        SELECT doc_id::VARCHAR AS comment_id, text AS body FROM documents WHERE {_key('text')} <> ''
        QUALIFY row_number() OVER (PARTITION BY {_key('text')} ORDER BY doc_id) = 1""",
    "model_saved": f"{_scored(MODEL_THRESHOLDS)} SELECT doc_id, label, round(prob, 6) AS prob, pred FROM p",
    "tolerant_read": """
        SELECT 'good' AS source_subreddit, doc_id::VARCHAR AS comment_id, md5(text) AS body_md5, '' AS problem
        FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT 'records', doc_id::VARCHAR, CASE WHEN doc_id % 2 = 0 THEN '' ELSE md5(md5(text)) END,
          CASE WHEN doc_id % 2 = 0 THEN '3 cells for 2 columns' ELSE '' END FROM documents WHERE doc_id % 3 = 1
        UNION ALL SELECT 'bodiless', '', '', 'no column body' UNION ALL SELECT 'broken', '', '', 'file cannot be read'""",
    "stream_burst": """
        WITH s AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER w > INTERVAL 30 MINUTES AS fresh FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM s)
        SELECT user_id, max_by(event_id, ts) AS last_event, count(*) AS versions FROM b GROUP BY user_id, burst
        HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_once_bounded": "SELECT event_id, true AS state_bounded FROM events",
    "csv_roundtrip": "SELECT doc_id::VARCHAR AS doc_id, source, text FROM documents",
    "normalised": f"SELECT doc_id, md5({_key('text')}) AS dedupe_md5, md5({_clean('text')}) AS clean_md5 FROM documents",
    "clean_best": _BEST,
    "clean_first": f"""
SELECT doc_id, body, source FROM (
  SELECT doc_id, text AS body, source, row_number() OVER (PARTITION BY {_key('text')} ORDER BY doc_id) AS rn
  FROM documents WHERE {_key('text')} <> '') WHERE rn = 1""",
    "clean_counts": _CLEAN_COUNTS,
    "observed_counts": _CLEAN_COUNTS,
    "label_rules": f"{_labeled()} SELECT source_subreddit, comment_id, {_SCORE_COLUMNS}, labels FROM l",
    "label_counts": f"{_labeled()} {_COUNTS}",
    "label_overall": f"""{_labeled()}
SELECT count(*) AS total_rows, sum(toxic_bin)::BIGINT AS toxic_rows, (count(*) - sum(toxic_bin))::BIGINT AS clean_rows,
  round(sum(toxic_bin) / count(*) * 100, 6)::DOUBLE AS toxic_percent,
  round(100 - sum(toxic_bin) / count(*) * 100, 6)::DOUBLE AS clean_percent FROM l""",
    "label_by_source": f"""{_labeled()}
SELECT source_subreddit, count(*) AS size, sum(toxic_bin)::BIGINT AS toxic_rows,
  (count(*) - sum(toxic_bin))::BIGINT AS clean_rows,
  round(sum(toxic_bin) / count(*) * 100, 6)::DOUBLE AS toxic_percent FROM l GROUP BY source_subreddit""",
    "label_source_detail": f"{_labeled()} SELECT * FROM ({_DETAIL}) WHERE positives > 0",
    "label_report": f"{_labeled()} SELECT rpad(label, 14, ' ') || ': ' || positives AS line FROM ({_COUNTS})",
    "source_label_report": f"""{_labeled()}
SELECT source_subreddit, rpad(label, 14, ' ') || ': ' || positives AS line FROM ({_DETAIL}) WHERE positives > 0""",
    "clean_report": f"""
WITH k AS (SELECT {_key('text')} AS k FROM documents),
c AS (SELECT count(*) AS n, count(*) FILTER (k = '') AS e, count(DISTINCT k) FILTER (k <> '') AS d FROM k)
SELECT unnest(['Input rows: ' || n, 'Removed empty/url-only bodies: ' || e,
  'Removed duplicate bodies: ' || (n - e - d), 'Output rows: ' || d]) AS line FROM c""",
    "label_then_clean": f"""{_labeled()}
SELECT comment_id, source_subreddit, toxic_score, labels FROM (
  SELECT *, row_number() OVER (PARTITION BY {_key('text')}
    ORDER BY toxic_score DESC, comment_id DESC, doc_id) AS rn FROM l WHERE {_key('text')} <> '') WHERE rn = 1""",
    "label_scores": f"{_labeled()} " + " UNION ALL ".join(
        f"SELECT comment_id, '{n}' AS label, {n}_score AS score FROM l" for n in LABELS),
    "source_report": f"""{_labeled()}
SELECT source_subreddit, format('r/{{}}: {{}}/{{}} toxic ({{:.2f}}%), {{}} clean', source_subreddit,
  sum(toxic_bin)::BIGINT, count(*), sum(toxic_bin) / count(*) * 100, (count(*) - sum(toxic_bin))::BIGINT) AS line
FROM l GROUP BY source_subreddit""",
    "overall_report": f"""{_labeled()},
o AS (SELECT count(*) AS n, sum(toxic_bin)::BIGINT AS t FROM l)
SELECT format('Overall toxic rows: {{}}/{{}} ({{:.2f}}%)', t, n, t / n * 100) AS line FROM o
UNION ALL SELECT format('Overall non-toxic rows: {{}}/{{}} ({{:.2f}}%)', n - t, n, 100 - t / n * 100) FROM o""",
    "summary_report": f"""{_PREPARED}, x AS (
  SELECT subreddit, length(body_clean) AS c, len(string_split(body_clean, ' ')) AS t FROM prep)
SELECT 'Total komentar' AS "Metrik", format('{{:,}}', count(*)) AS "Nilai" FROM x
UNION ALL SELECT 'Jumlah subreddit', count(DISTINCT subreddit)::VARCHAR FROM x
UNION ALL SELECT 'Rata-rata panjang (karakter)', round_even(avg(c), 2)::DOUBLE::VARCHAR FROM x
UNION ALL SELECT 'Median panjang (karakter)', round_even(median(c), 2)::DOUBLE::VARCHAR FROM x
UNION ALL SELECT 'Rata-rata panjang (token)', round_even(avg(t), 2)::DOUBLE::VARCHAR FROM x
UNION ALL SELECT 'Median panjang (token)', round_even(median(t), 2)::DOUBLE::VARCHAR FROM x""",
    "dataset_summary": f"""{_PREPARED}, x AS (
  SELECT subreddit, length(body_clean) AS c, len(string_split(body_clean, ' ')) AS t FROM prep)
SELECT count(*) AS comments, count(DISTINCT subreddit) AS communities,
  round_even(avg(c), 2)::DOUBLE AS mean_chars, round_even(median(c), 2)::DOUBLE AS median_chars,
  round_even(avg(t), 2)::DOUBLE AS mean_tokens, round_even(median(t), 2)::DOUBLE AS median_tokens FROM x""",
    "label_distribution": _PREPARED + " UNION ALL ".join(
        f" SELECT '{n}' AS label, sum({n})::BIGINT AS positives, round_even(avg({n}) * 100, 2)::DOUBLE AS percent "
        "FROM prep" for n in ("toxic", "insult", "threat")),
    "length_histogram": f"""{_PREPARED},
x AS (SELECT len(string_split(body_clean, ' ')) AS t FROM prep),
m AS (SELECT min(t)::DOUBLE AS lo, max(t)::DOUBLE AS hi FROM x),
b AS (SELECT i::INTEGER AS bin, i * ((hi - lo) / 60) + lo AS l,
  CASE WHEN i = 59 THEN hi ELSE (i + 1) * ((hi - lo) / 60) + lo END AS r FROM m, range(0, 60) q(i))
SELECT bin, round(l, 6)::DOUBLE AS left, round(r, 6)::DOUBLE AS right,
  (SELECT count(*) FROM x WHERE t >= l AND (t < r OR (bin = 59 AND t <= r))) AS comments FROM b""",
    "prepare_frame": f"""{_PREPARED}
SELECT comment_id, post_id, created_utc, toxic::INTEGER AS toxic, insult::INTEGER AS insult, threat,
  md5(body_clean) AS body_md5 FROM prep""",
    "blank_counts": f"""
SELECT lang AS split, count(*) AS rows,
  count(*) FILTER ({_clean("regexp_replace(text, '[A-Za-z]', '', 'g')")} = '') AS blank_rows
FROM documents GROUP BY lang""",
    "fit_optimum": f"""WITH {_TRUTH}
SELECT label, count(*) AS rows, sum(y)::BIGINT AS positives, true AS optimal FROM (
  SELECT 'toxic' AS label, toxic AS y FROM truth UNION ALL SELECT 'quality', quality FROM truth) GROUP BY label""",
    "thread_labels": f"""WITH {_ALL_THREADS}
SELECT post_id, max(toxic) AS toxic, max(quality) AS quality, count(*) AS n_comments FROM truth GROUP BY post_id""",
    "thread_split": f"""WITH {_ALL_THREADS},
th AS (SELECT post_id, max(toxic)::VARCHAR || max(quality)::VARCHAR AS stratum FROM truth GROUP BY post_id),
o AS (SELECT post_id, (row_number() OVER (ORDER BY stratum, (post_id * 2654435761) % 4294967296, post_id) - 1) % 6 AS m
  FROM th)
SELECT doc_id, post_id, toxic, quality, CASE WHEN m < 4 THEN 'train' WHEN m = 4 THEN 'val' ELSE 'test' END AS split
FROM truth JOIN o USING (post_id)""",
    "tokens": f"""
SELECT doc_id, len(r) AS rule_tokens, md5(array_to_string(r, ' ')) AS rule_md5,
  len(w) AS model_tokens, md5(array_to_string(w, ' ')) AS model_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{RULE_TOKEN}') AS r,
  regexp_extract_all(lower(text), '{MODEL_TOKEN}') AS w FROM documents)""",
    "ngrams": f"""
SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS ngram_md5
FROM (SELECT doc_id, {_TRIGRAMS} AS g FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{MODEL_TOKEN}'),
    lambda x: x NOT IN ('the', 'of')) AS tk FROM documents))""",
    "doc_freq": f"WITH {_GRAMS} SELECT term, df, round(idf, 9) AS idf FROM vocab",
    "vocabulary_index": f"WITH {_GRAMS} SELECT term, idx, df FROM vocab",
    "tfidf": f"""WITH {_GRAMS}, {_VECTORS}
SELECT doc_id, term, idx, round(v / len, 6) AS value FROM raw JOIN lens USING (doc_id)""",
    "score_model": f"{_scored(MODEL_THRESHOLDS)} SELECT doc_id, label, round(prob, 6) AS prob, pred FROM p",
    "prediction_text": f"""{_scored(MODEL_THRESHOLDS)}
SELECT doc_id, md5('TEXT: ' || text || chr(10) || 'Active labels: ' || coalesce(act, 'none') || chr(10)
  || 'Probabilities: ' || probs || chr(10)) AS report_md5
FROM documents JOIN (
  SELECT doc_id, string_agg(CASE WHEN pred = 1 THEN label END, ', ' ORDER BY no) AS act,
    string_agg(label || ':' || format('{{:.3f}}', prob), ', ' ORDER BY no) AS probs
  FROM p GROUP BY doc_id) USING (doc_id)""",
    "triggered": f"""{_scored(MODEL_THRESHOLDS)},
act AS (SELECT doc_id, coalesce(string_agg(CASE WHEN pred = 1 THEN label END, '|' ORDER BY no), '') AS active
  FROM p GROUP BY doc_id)
SELECT doc_id, active, label, round(prob, 6) AS prob
FROM act LEFT JOIN (SELECT * FROM p WHERE pred = 1) USING (doc_id)""",
    "artifact_roundtrip": f"{_scored(MODEL_THRESHOLDS)} SELECT doc_id, label, round(prob, 6) AS prob FROM p",
    "confusion": f"{_EVAL} SELECT label, tn, fp, fn, tp FROM cm",
    "prf": f"""{_EVAL} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1 FROM f""",
    "micro_macro": f"""{_EVAL}
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9)::DOUBLE AS micro_f1,
  round(avg(f1), 9) AS macro_f1 FROM f""",
    "subset_accuracy": f"""{_EVAL},
ok AS (SELECT row_id, bool_and((y = 1) = hit) AS good FROM pr GROUP BY row_id)
SELECT round(avg(good::INTEGER), 9) AS subset_accuracy, round(1 - avg(good::INTEGER), 9) AS subset_error FROM ok""",
    "average_precision": f"{_EVAL} SELECT label, round(average_precision, 9) AS average_precision FROM a",
    "roc_auc": f"{_EVAL} SELECT label, round(roc_auc, 9) AS roc_auc FROM a",
    "pr_curve": f"""{_EVAL}
SELECT label, round(prob, 9) AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / positives, 9) AS recall
FROM c UNION ALL SELECT DISTINCT label, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM c""",
    "calibrate": f"""{_EVAL},
grid AS (SELECT * FROM (VALUES {_GRID_VALUES}) v(t)),
ps AS (SELECT label, sum(y) AS positives FROM ev GROUP BY label),
gp AS (SELECT label, t, coalesce(sum(y) FILTER (prob >= t), 0) AS tp, count(*) FILTER (prob >= t) AS hits
  FROM ev, grid GROUP BY label, t),
s AS (SELECT label, t, 2 * tp / (hits + positives) AS f1 FROM gp JOIN ps USING (label))
SELECT label, round(t, 9)::DOUBLE AS threshold, round(f1, 9)::DOUBLE AS f1 FROM s
QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) = 1""",
    "evaluate": f"""{_EVAL}
SELECT label, round(average_precision, 9) AS average_precision, round(roc_auc, 9) AS roc_auc,
  round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(threshold, 9) AS threshold
FROM a JOIN f USING (label)""",
    "sentence_split": f"""WITH {_TURNS}
SELECT turn_id, unnest(parts) AS segment_text, generate_subscripts(parts, 1) - 1 AS pos FROM tparts""",
    "mask_sentences": _MASKED_TEXTS,
    "page_nodes": f"WITH {_NODES} SELECT page_id, node, text FROM nodes",
    "mask_pages": _MASKED_PAGES,
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_label": f"{_labeled()} SELECT doc_id, toxic_score, labels FROM l",
    "stream_score": f"{_scored(MODEL_THRESHOLDS)} SELECT doc_id, label, round(prob, 6) AS prob FROM p",
    "stream_mask": _MASKED_PAGES,
}
