"""SQL for the queries that it can express, written apart from the operators: counts by
unnesting, quotients for every block, pairs from shared n-grams."""

from __future__ import annotations

from . import importance, mixing, ngram_join, quality_rules, spelling, substring_dedup

EXACT = r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
           row_number() OVER w = 1 AS kept, sha AS text_sha256
    FROM d WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id)"""


def _quality() -> str:
    scores = {"symbols": "n_symbols / greatest(word_chars, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "capitals": "n_capitals / greatest(word_chars, 1)"}
    grid = ", ".join(f"('{rule}', {g}, {c}::DOUBLE)" for rule, cuts in quality_rules.GRID.items() for g, c in enumerate(cuts))
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{rule}' AS rule, {s} AS score FROM m" for rule, s in scores.items())
    share, n_rules, miss = quality_rules.MAX_FALSE_REJECTION / len(scores), len(scores), quality_rules.CONFIDENCE_MISS
    return rf"""
    WITH base AS (
        SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5),
    twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, i, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM starts)),
    spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE c > 1),
    rep AS (SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id),
    m AS (
        SELECT doc_id, stratum, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS wc, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals, coalesce(wc, 0) AS word_chars
        FROM base LEFT JOIN rep USING (doc_id)),
    s AS ({long}),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    held AS (SELECT s.* FROM s JOIN good USING (doc_id)),
    grid(rule, g, cut) AS (VALUES {grid}),
    k AS (SELECT stratum, rule, g, cut, count(*) AS n, count(*) FILTER (score > cut) AS k FROM held JOIN grid USING (rule) GROUP BY ALL),
    terms AS (SELECT stratum, rule, g, cut, n, k, unnest(range(0, k + 1)) AS j FROM k WHERE k <= {share} * n),
    tail AS (SELECT stratum, rule, g, cut, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share}) + (n - j) * ln(1 - {share}))) AS p FROM terms GROUP BY ALL),
    tests AS (SELECT k.stratum, k.rule, k.g, k.cut, coalesce(p <= {miss} / ({n_rules} * (SELECT count(DISTINCT stratum) FROM held)), false) AS ok FROM k LEFT JOIN tail USING (stratum, rule, g, cut)),
    passed AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY g) AS so_far FROM tests),
    cuts AS (SELECT stratum, rule, min(cut) AS cut FROM passed WHERE so_far GROUP BY ALL),
    bad AS (SELECT DISTINCT s.doc_id FROM s JOIN cuts USING (stratum, rule) WHERE s.score > cuts.cut)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.doc_id IS NULL AS kept
    FROM m LEFT JOIN bad USING (doc_id)"""


def _mixing() -> str:
    b, r, rows = mixing.BLOCK_WORDS, mixing.MAX_REPEATS, mixing.ROWS_A_SHARD
    return rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
    lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({r} * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv FROM s
        WINDOW o AS (ORDER BY {r} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, n, least({r} * source_size::DOUBLE, w * coalesce((SELECT arg_min(lv, {r} * source_size / w) FROM lv WHERE {r} * source_size > w * lv), (SELECT max(lv) FROM lv))) AS target FROM lv),
    m AS (SELECT CAST(round(sum(source_size) / {b}) AS BIGINT) AS blocks FROM s),
    qs AS (SELECT source, target / (2 * k + 1) AS q FROM (SELECT source, target, unnest(range(0, CAST(target / {b} AS BIGINT) + 50)) AS k FROM t)),
    won AS (SELECT source, count(*) FILTER (rk <= (SELECT blocks FROM m)) AS quota FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST) AS rk FROM qs) GROUP BY source),
    p AS (SELECT d.*, t.source_size, t.target, won.quota, CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(ceil(t.n / {rows}) AS BIGINT) AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN won ON won.source IS NOT DISTINCT FROM t.source),
    sh AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(quota) AS quota FROM p GROUP BY ALL),
    qh AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k + 1) DESC, shard) AS rk FROM (SELECT *, unnest(range(0, quota)) AS k FROM sh)),
    wh AS (SELECT source, shard, count(*) FILTER (rk <= quota) AS q FROM qh GROUP BY ALL),
    take AS (SELECT sh.source, sh.shard, sh.shard_size, least(coalesce(wh.q, 0) * {b}, {r} * sh.shard_size) AS words FROM sh LEFT JOIN wh ON sh.source IS NOT DISTINCT FROM wh.source AND sh.shard = wh.shard),
    o AS (SELECT p.*, take.words, take.shard_size, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY key, size, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM p JOIN take ON p.source IS NOT DISTINCT FROM take.source AND p.shard = take.shard)
    SELECT doc_id, size, source_size, target, CAST(CASE WHEN shard_size > 0 THEN (words // shard_size) * size + greatest(0, least(size, words % shard_size - start)) ELSE 0 END AS BIGINT) AS taken FROM o"""


CHAT = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS et, regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') AS er FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(8 + length(er) + 8 + length(et) + 7) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id"""


def _near() -> str:
    n = ngram_join.SHINGLE
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {n - 2}))) AS i FROM w WHERE len(w) > 0)),
    z AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS digest FROM g GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y, zx.digest = zy.digest AS copies, zy.digest AS other FROM pairs JOIN z zx ON x = zx.doc_id JOIN z zy ON y = zy.doc_id WHERE 10 * shared >= {round(10 * ngram_join.THRESHOLD)} * (zx.n + zy.n - shared)),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x),
    c AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
    n AS (SELECT x AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT copies THEN other END) AS n_text_links FROM links GROUP BY x)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, doc_id = class_id AS kept
    FROM c LEFT JOIN n USING (doc_id)"""


def _substring() -> str:
    n, m = substring_dedup.RUN, substring_dedup.MIN_WORDS
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    p AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?][\x20\x09-\x0D]+)', '\1' || chr(1), 'g'), '([\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS raw FROM d),
    q AS (SELECT doc_id, text, CASE WHEN len(raw) > 0 AND NOT regexp_matches(raw[1], '[^\x20\x09-\x0D]') THEN CASE WHEN len(raw) > 1 THEN list_prepend(raw[1] || raw[2], raw[3:]) ELSE [] END ELSE raw END AS ps FROM p),
    s AS (SELECT doc_id, ps, list_transform(ps, lambda x: regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS ws FROM q),
    x AS (SELECT doc_id, unnest(ps) AS piece, unnest(list_transform(ws, lambda w: len(w))) AS n, generate_subscripts(ps, 1) AS i FROM s),
    c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, max(i) OVER (PARTITION BY doc_id) AS last FROM x),
    e AS (SELECT a.doc_id, a.i, greatest(a.i + {n - 1}, min(b.i)) AS j, any_value(a.last) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {m} GROUP BY a.doc_id, a.i),
    bodies AS (SELECT doc_id, list_transform(ws, lambda w: array_to_string(w, ' ')) AS b FROM s),
    runs AS (SELECT e.doc_id, i, j, md5(array_to_string(b[i:j], chr(2))) AS h FROM e JOIN bodies USING (doc_id) WHERE j <= last),
    later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later),
    marked AS (SELECT c.*, gone.i IS NOT NULL AS dropped FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.i = gone.i),
    kept AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT dropped), '') AS text, count(*) AS n_sentences, count(*) FILTER (dropped) AS n_removed FROM marked GROUP BY doc_id),
    isles AS (SELECT doc_id, min(stop - length(piece)) AS a, max(stop) AS z FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked WHERE dropped) GROUP BY doc_id, g),
    spans AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ';' ORDER BY a) AS removed FROM isles GROUP BY doc_id)
    SELECT d.doc_id, coalesce(kept.text, d.text) AS text, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)"""


#: CRC-32's table, and the CRC of a text given as hexadecimal digits of its bytes.
CRC_TABLE = """crcs AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) t(i)))"""


def _digit(at: str) -> str:
    return f"(instr('0123456789ABCDEF', hx[{at}]) - 1)"


CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx) // 2 + 1), lambda i: (16 * {_digit("2 * i - 1")} + {_digit("2 * i")})::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER}, '{spelling.LETTERS}')) AS run FROM documents),
    once AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS hx FROM runs WHERE length(run) >= {spelling.MIN_LENGTH} GROUP BY id, run),
    hashed AS (SELECT run, n, {CRC} AS h FROM once, crcs),
    w AS (SELECT CASE WHEN h % {spelling.MISPRINTS} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
        FROM hashed GROUP BY 1 HAVING length(word) >= {spelling.MIN_LENGTH} AND sum(n) >= {spelling.MIN_COUNT}),
    cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM w, unnest(range(1, length(word) + 1)) t(i)),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
        UNION SELECT w.word, w.n, c.word, c.n FROM w JOIN cuts c ON w.word = c.cut UNION SELECT c.word, c.n, w.word, w.n FROM w JOIN cuts c ON w.word = c.cut),
    best AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
    forms AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE k = 1 AND other_n >= {spelling.FORM_RATIO} * n),
    steps AS (SELECT word, form AS upto FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.upto = f.word)
    SELECT w.word, f.form, coalesce(s.upto, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
    FROM w LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN (SELECT * FROM steps WHERE upto NOT IN (SELECT word FROM forms)) s USING (word)"""


def _importance() -> str:
    n, word = importance.BUCKETS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
    WITH {CRC_TABLE},
    d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{word}') AS ws FROM documents),
    said AS (SELECT doc_id, unnest(ws) AS word FROM d),
    aim AS (SELECT unnest(regexp_extract_all({LOWER}, '{word}')) AS word FROM benchmark),
    vocabulary AS (SELECT word, {CRC} % {n} AS bucket FROM (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM said UNION SELECT word FROM aim)), crcs),
    s AS (SELECT bucket, count(*) AS n FROM said JOIN vocabulary USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM aim JOIN vocabulary USING (word) GROUP BY bucket),
    sums AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t_all),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {n}) / ((s.n + 1)::DOUBLE * (t_all + {n})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
    weighed AS (SELECT doc_id, count(*) AS k, CAST(sum(gain) AS BIGINT) AS g FROM said JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
    noisy AS (SELECT doc_id, len(ws) AS n_features, coalesce((g - ((g % k) + k) % k) // k, 0) AS weight,
        list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i]) - 1)::BIGINT)), lambda a, b: 16 * a + b) AS h
        FROM d LEFT JOIN weighed USING (doc_id)),
    scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM noisy),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {importance.MIN_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= {importance.DRAW_PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


SQL = {"op1_exact_dedup": EXACT, "op4_quality_rules": _quality(), "op6_chat_format": CHAT, "op8_substring_dedup": _substring(), "op9_mixing": _mixing(), "op10_ngram_join": _near(), "op12_spelling": SPELLING, "op13_importance": _importance()}
