"""DuckDB SQL for the registered queries."""

from __future__ import annotations

SENTS = r"""WITH lines AS (
  SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS sent_id, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
), sents AS (
  SELECT doc_id, sent_id, line, list_filter(regexp_split_to_array(lower(line), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS tokens FROM lines
), sent AS (SELECT * FROM sents WHERE len(tokens) > 0)"""
TOK = SENTS + r""", tok AS (
  SELECT doc_id, sent_id, CAST(generate_subscripts(tokens, 1) - 1 AS BIGINT) AS pos, unnest(tokens) AS word FROM sent
)"""
LEX = TOK + r""", lex AS (SELECT word, count(*) AS freq FROM tok GROUP BY word HAVING count(*) >= 4)"""
SIG = r"""'UNK' || CASE WHEN contains(word, '-') THEN '-DASH' ELSE '' END || CASE WHEN regexp_matches(word, '[0-9]') THEN '-NUM' ELSE '' END ||
  CASE WHEN length(word) >= 3 AND ends_with(word, 's') THEN '-s' WHEN length(word) < 5 THEN ''
       WHEN ends_with(word, 'ed') THEN '-ed' WHEN ends_with(word, 'ing') THEN '-ing' WHEN ends_with(word, 'ion') THEN '-ion'
       WHEN ends_with(word, 'er') THEN '-er' WHEN ends_with(word, 'est') THEN '-est' WHEN ends_with(word, 'ly') THEN '-ly'
       WHEN ends_with(word, 'ity') THEN '-ity' WHEN ends_with(word, 'y') THEN '-y' WHEN ends_with(word, 'al') THEN '-al' ELSE '' END"""
CLEAN = LEX + rf""", cleaned AS (
  SELECT t.doc_id, t.sent_id, t.pos, CASE WHEN l.word IS NOT NULL THEN t.word ELSE {SIG.replace("word", "t.word")} END AS word, l.word IS NOT NULL AS known
  FROM tok t LEFT JOIN lex l ON t.word = l.word
)"""
CSENT = CLEAN + r""", csent AS (SELECT doc_id, sent_id, list(word ORDER BY pos) AS tokens FROM cleaned GROUP BY doc_id, sent_id)"""


def windows(source: str, n: int, base: str = CSENT, where: str = "") -> str:
    """Windows of n tokens of a CTE of sentences, as `win`."""
    pads = "[" + ", ".join(["'<s>'"] * (n - 1)) + "]"
    return base + f""", padded AS (
  SELECT doc_id, sent_id, list_concat(list_concat(CAST({pads} AS VARCHAR[]), tokens), ['</s>']) AS t FROM {source}
), win AS (
  SELECT doc_id, sent_id, i - 1 AS pos, list_slice(t, i, i + {n - 1}) AS ngram
  FROM (SELECT doc_id, sent_id, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM padded) {where}
)"""


def kn(base: str, n: int = 3) -> str:
    """num and ctx tables from `win`."""
    out = base + f", n{n} AS (SELECT ngram, count(*) AS c FROM win GROUP BY ngram)"
    for d in range(n - 1, 0, -1):
        out += f", n{d} AS (SELECT list_slice(ngram, 2, {d + 1}) AS ngram, count(*) AS c FROM n{d + 1} GROUP BY 1)"
    for d in range(2, n + 1):
        out += f", x{d} AS (SELECT list_slice(ngram, 1, {d - 1}) AS ctx, CAST(sum(c) AS BIGINT) AS den, count(*) AS nz FROM n{d} GROUP BY 1)"
    return out + ", meta AS (SELECT CAST(sum(c) AS BIGINT) AS unigram_denominator FROM n1)"


NUM = " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS \"order\", array_to_string(ngram, ' ') AS ngram, c FROM n{d}" for d in (1, 2, 3))
CTX = " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS \"order\", array_to_string(ctx, ' ') AS ctx, den, nz FROM x{d}" for d in (2, 3))
PROBS = r""", joined AS (
  SELECT w.ngram, coalesce(n1.c, 0) AS c1, coalesce(n2.c, 0) AS c2, coalesce(n3.c, 0) AS c3, coalesce(x2.den, 0) AS d2, coalesce(x2.nz, 0) AS z2,
         coalesce(x3.den, 0) AS d3, coalesce(x3.nz, 0) AS z3, unigram_denominator AS u
  FROM (SELECT DISTINCT ngram FROM win) w
  LEFT JOIN n1 ON n1.ngram = w.ngram[3:3] LEFT JOIN n2 ON n2.ngram = w.ngram[2:3] LEFT JOIN n3 ON n3.ngram = w.ngram
  LEFT JOIN x2 ON x2.ctx = w.ngram[2:2] LEFT JOIN x3 ON x3.ctx = w.ngram[1:2], meta
), low AS (
  SELECT *, CAST(c1 AS DOUBLE) / u AS p1 FROM joined
), mid AS (
  SELECT *, CASE WHEN d2 = 0 THEN p1 ELSE CASE WHEN c2 > 0 THEN (c2 - 0.7::DOUBLE) / d2 ELSE 0 END + z2 * 0.7::DOUBLE / d2 * p1 END AS p2 FROM low
), prob AS (
  SELECT ngram, p1, CASE WHEN d2 = 0 OR d3 = 0 THEN p2 ELSE CASE WHEN c3 > 0 THEN (c3 - 0.7::DOUBLE) / d3 ELSE 0 END + z3 * 0.7::DOUBLE / d3 * p2 END AS p FROM mid
)"""
KN3 = kn(windows("csent", 3))
WORDS = KN3 + PROBS + r""", words AS (
  SELECT doc_id, sent_id, pos, log10(p) AS lp, log10(p1) AS up FROM win JOIN prob ON win.ngram = prob.ngram
)"""
PCT = "CASE WHEN floor({q} * n) = 0 THEN r[1] WHEN floor({q} * n) >= n - 1 THEN r[n] ELSE r[CAST(floor({q} * n) AS INT)] + ({q} * n - floor({q} * n)) * (r[CAST(floor({q} * n) AS INT) + 1] - r[CAST(floor({q} * n) AS INT)]) END"
SCORES = (
    WORDS
    + r""", persent AS (
  SELECT doc_id, sent_id, count(*) AS n, sum(lp) AS lp, sum(up) AS up, list_sort(list(-lp / up)) AS r FROM words GROUP BY doc_id, sent_id
), pct AS (
  SELECT *, """ + PCT.format(q="0.25::DOUBLE") + " AS q1, " + PCT.format(q="0.5::DOUBLE") + r""" AS q2 FROM persent
), scored AS (
  SELECT doc_id, sent_id, pow(10::DOUBLE, -lp / n) AS ppl, n - 1 AS sent_length, lp AS logprob, up AS unigram_logprob, lp / n AS mean_logprob, lp / -up AS norm_logprob_div, lp - up AS norm_logprob_sub,
    (lp - up) / (n + 2) AS slor, coalesce(r[1], 0) AS wlogprob_bot_1, coalesce(r[2], 0) AS wlogprob_bot_2, coalesce(r[3], 0) AS wlogprob_bot_3, coalesce(r[4], 0) AS wlogprob_bot_4, coalesce(r[5], 0) AS wlogprob_bot_5,
    list_sum(r) / n AS wlogprob_mean, list_avg(list_filter(r, lambda x: x <= q1)) AS wlogprob_m1q, list_avg(list_filter(r, lambda x: x <= q2)) AS wlogprob_m2q
  FROM pct
)"""
)
METRICS = ["logprob", "unigram_logprob", "mean_logprob", "norm_logprob_div", "norm_logprob_sub", "slor", *[f"wlogprob_bot_{i}" for i in range(1, 6)], "wlogprob_mean", "wlogprob_m1q", "wlogprob_m2q"]
STATE = TOK + r""", st AS (SELECT *, CAST(length(word) % 5 AS INT) AS state, CAST(length(word) % 3 AS INT) AS chunk, CAST(doc_id % 4 AS INT) AS topic, pos % 3 = 2 AS boundary FROM tok),
  ctx AS (SELECT *, coalesce(lag(state, 1) OVER w, 5) AS lag1, coalesce(lag(state, 2) OVER w, 5) AS lag2, lead(state) OVER w AS ns, lead(chunk) OVER w AS nc FROM st WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY pos))"""
SEGS = STATE + r""", seg AS (
  SELECT doc_id, sent_id, chunk_id, string_agg(CAST(state AS VARCHAR), '+' ORDER BY pos) AS chunk
  FROM (SELECT *, coalesce(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_id FROM st)
  GROUP BY doc_id, sent_id, chunk_id
), cc AS (SELECT chunk, count(*) AS n FROM seg GROUP BY chunk),
bi AS (SELECT prev, chunk, count(*) AS n FROM (SELECT chunk, coalesce(lag(chunk) OVER (PARTITION BY doc_id, sent_id ORDER BY chunk_id), '.') AS prev FROM seg) GROUP BY ALL),
sh AS (SELECT CAST(state AS VARCHAR) AS s, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM st GROUP BY state),
cp AS (
  SELECT chunk, (n + 2.0::DOUBLE * p0) / ((SELECT sum(n) FROM cc) + 2.0::DOUBLE) AS p
  FROM (SELECT chunk, n, exp(sum(ln(share))) * 0.5::DOUBLE * pow(0.5::DOUBLE, count(*) - 1) AS p0 FROM (SELECT chunk, n, unnest(string_split(chunk, '+')) AS part FROM cc) JOIN sh ON part = s GROUP BY chunk, n)
)"""
CONF = "WITH conf AS (SELECT l_linenumber AS model, l_returnflag AS gold, count(*) AS n FROM lineitem GROUP BY ALL), tot AS (SELECT *, sum(n) OVER (PARTITION BY model) AS ni, sum(n) OVER (PARTITION BY gold) AS nj, sum(n) OVER () AS nn FROM conf)"
BAGS = r"""WITH b AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS word FROM benchmark),
bag AS (SELECT item_id, word, count(*) AS n FROM b GROUP BY ALL)"""
VOC = TOK + r""", voc AS (
  SELECT 0::BIGINT AS word_id, '</s>' AS word, (SELECT count(*) FROM sent) AS cn
  UNION ALL SELECT row_number() OVER (ORDER BY cn DESC, word), word, cn FROM (SELECT word, count(*) AS cn FROM tok GROUP BY word)
)"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


UNI_TAIL = r""", uni AS (
  SELECT word, log10(count(*) / CAST((SELECT count(*) FROM cleaned) AS DOUBLE)) AS up FROM cleaned GROUP BY word
  UNION ALL SELECT '</s>', log10((SELECT count(*) FROM csent) / CAST((SELECT count(*) FROM cleaned) AS DOUBLE))
)"""
UNI = CSENT + UNI_TAIL

ORACLES = {
    "sentences": SENTS + " SELECT doc_id, sent_id, line, len(tokens) AS n_tokens FROM sent",
    "tokens": TOK + " SELECT doc_id, sent_id, pos, word FROM tok",
    "conll_sentences": r"""WITH t AS (SELECT conv_id, turn, role, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (
        SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM conversations))
        SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS sent, CAST(pos - 1 AS BIGINT) AS pos, word, role AS tag FROM t""",
    "document_numbers": SENTS + r""", marked AS (
        SELECT d.source AS file, l.doc_id, l.sent_id, l.line FROM sent l JOIN documents d ON l.doc_id = d.doc_id
        UNION ALL SELECT source, doc_id, -1, '<PAGEBOUNDARY>' FROM documents)
        SELECT file, doc, count(*) AS lines FROM (SELECT file, line, CAST(sum(CASE WHEN trim(line) = '<PAGEBOUNDARY>' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY doc_id, sent_id) AS BIGINT) AS doc FROM marked)
        WHERE trim(line) <> '<PAGEBOUNDARY>' GROUP BY file, doc""",
    "char_tokens": r"""SELECT c AS token, count(*) AS n FROM (
        SELECT unnest(list_append(list_transform(string_split(text || chr(10), ''), lambda c: CASE WHEN regexp_matches(c, '[ \t\n\r]') THEN '<sp>' ELSE c END), '</s>')) AS c FROM documents) GROUP BY c""",
    "lexicon": LEX + " SELECT word, freq FROM lex",
    "lexicon_top": LEX + " SELECT word, freq FROM lex ORDER BY freq DESC, word LIMIT 100",
    "unknown_signatures": LEX + f" SELECT DISTINCT word, {SIG} AS signature FROM tok WHERE word NOT IN (SELECT word FROM lex)",
    "cleaned_corpus": CSENT + " SELECT doc_id, sent_id, array_to_string(tokens, ' ') AS line FROM csent",
    "unknown_rate": CLEAN + " SELECT doc_id, count(*) AS tokens, count(*) FILTER (NOT known) AS unknown FROM cleaned GROUP BY doc_id",
    "reversed_sentences": SENTS + " SELECT doc_id, sent_id, array_to_string(list_reverse(tokens), ' ') AS line FROM sent",
    "known_sentences": CLEAN + " SELECT doc_id, sent_id FROM cleaned GROUP BY doc_id, sent_id HAVING bool_and(known)",
    "short_sentences": SENTS + " SELECT doc_id, sent_id, len(tokens) AS n_tokens FROM sent WHERE len(tokens) <= 10",
    "normalized_words": TOK + r""" SELECT word, lower(CASE WHEN regexp_extract(word, '^[^A-Za-z0-9_]*([A-Za-z0-9_].*[A-Za-z0-9_])[^A-Za-z0-9_]*$', 1) <> '' THEN regexp_extract(word, '^[^A-Za-z0-9_]*([A-Za-z0-9_].*[A-Za-z0-9_])[^A-Za-z0-9_]*$', 1)
        WHEN regexp_matches(word, '^[A-Za-z0-9_]+$') THEN word ELSE '' END) AS trimmed, CASE WHEN regexp_matches(word, '[0-9]') THEN '#' ELSE word END AS numbered, count(*) AS n FROM tok GROUP BY ALL""",
    "tag_split": r"""SELECT split_part(t, '_@', 1) AS tag, CASE WHEN contains(t, '_@') THEN split_part(t, '_@', 2) ELSE t END AS word, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN lang || '_@' || source ELSE source END AS t FROM documents) GROUP BY ALL""",
    "ngram_counts": windows("sent", 1, SENTS) + r""", p3 AS (SELECT list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>']) AS t FROM sent),
        g AS (SELECT d, list_slice(t, i, i + d - 1) AS ngram FROM (SELECT t, d, unnest(range(1, len(t) - d + 2)) AS i FROM p3, (SELECT unnest([1, 2, 3]) AS d)))
        SELECT d::BIGINT AS "order", array_to_string(ngram, ' ') AS ngram, count(*) AS c FROM g GROUP BY ALL""",
    "ngram_totals": windows("sent", 1, SENTS) + r""", p3 AS (SELECT unnest(list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>'])) AS w FROM sent)
        SELECT count(*) AS tokens, count(DISTINCT w) AS vocab FROM p3""",
    "kn_num": KN3 + " " + NUM,
    "kn_ctx": KN3 + " " + CTX,
    "kn_meta": KN3 + " SELECT unigram_denominator FROM meta",
    "kn_stingy_ctx": kn(windows("csent", 3, CSENT + r""", voc AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS w FROM benchmark UNION SELECT '<s>' UNION SELECT '</s>')""", "WHERE list_extract(t, i + 2) IN (SELECT w FROM voc)")) + " " + CTX,
    "kn_tag_ctx": kn(windows("tagged", 3, TOK + r""", tagged AS (SELECT doc_id, sent_id, list(CAST(length(word) % 7 AS VARCHAR) ORDER BY pos) AS tokens FROM tok GROUP BY doc_id, sent_id)""")) + " " + CTX,
    "kn_twosided_ctx": CSENT + r""", p AS (SELECT list_concat(list_concat(['<s>'], tokens), ['</s>']) AS t FROM csent), w AS (SELECT t[i] || ' ' || t[i + 2] AS ctx, t[i + 1] AS middle FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p)),
        c AS (SELECT ctx, middle, count(*) AS n FROM w GROUP BY ALL) SELECT ctx, CAST(sum(n) AS BIGINT) AS den, count(*) AS nz FROM c GROUP BY ctx""",
    "laplace_prob": CSENT + r""", p3 AS (SELECT list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>']) AS t FROM csent),
        g3 AS (SELECT list_slice(t, i, i + 2) AS g, count(*) AS c FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p3) GROUP BY 1),
        g2 AS (SELECT list_slice(t, i, i + 1) AS g, count(*) AS c FROM (SELECT t, unnest(range(1, len(t))) AS i FROM p3) GROUP BY 1), v AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM p3))
        SELECT array_to_string(g3.g, ' ') AS ngram, round((g3.c + 1) / CAST(coalesce(g2.c, 0) + v AS DOUBLE), 9) AS p FROM g3 LEFT JOIN g2 ON g2.g = g3.g[1:2], v""",
    "kn_prob": KN3 + PROBS + " SELECT array_to_string(ngram, ' ') AS ngram, round(p, 9) AS p, round(p1, 9) AS p1 FROM prob",
    "score_sentences": SCORES + " SELECT doc_id, sent_id, round(ppl, 4) AS ppl, sent_length, " + r6(*METRICS) + " FROM scored",
    "perplexity_by_document": WORDS + " SELECT doc_id, round(-sum(lp) / count(*), 6) AS entropy, round(pow(10::DOUBLE, -sum(lp) / count(*)), 4) AS perplexity FROM words GROUP BY doc_id",
    "score_correlation": SCORES + ", d AS (SELECT doc_id, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM scored GROUP BY doc_id), j AS (SELECT d.*, CAST(quality AS DOUBLE) AS rating FROM d JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(corr({m}, rating), 6) AS correlation FROM j" for m in METRICS),
    "lm_interpolation": WORDS + " SELECT w.doc_id, round(sum(CASE WHEN c.known THEN log10(0.75::DOUBLE * pow(10::DOUBLE, lp) + 0.25::DOUBLE * pow(10::DOUBLE, up)) WHEN c.known IS NULL THEN log10(0.75::DOUBLE * pow(10::DOUBLE, lp) + 0.25::DOUBLE * pow(10::DOUBLE, up)) ELSE -8 END), 5) AS logprob FROM words w LEFT JOIN cleaned c ON w.doc_id = c.doc_id AND w.sent_id = c.sent_id AND w.pos = c.pos GROUP BY w.doc_id",
    "selected_ngrams": KN3 + r""", bs AS (SELECT list_concat(list_concat(['<s>', '<s>'], list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')), ['</s>']) AS t FROM benchmark),
        bg AS (SELECT DISTINCT list_slice(t, i, i + 2) AS ngram FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM bs)) SELECT array_to_string(n3.ngram, ' ') AS ngram, c FROM n3 WHERE ngram IN (SELECT ngram FROM bg)""",
    "vocabulary": VOC + " SELECT word_id, word, cn FROM voc",
    "noise_distribution": VOC + " SELECT word, round(pow(cn::DOUBLE, 0.75::DOUBLE) / sum(pow(cn::DOUBLE, 0.75::DOUBLE)) OVER (), 9) AS p FROM voc",
    "document_filter": r"""WITH f AS (SELECT page_id, regexp_matches(html, '(?i)<article[\s/>]') AS article, regexp_matches(html, '(?i)<b[\s/>]') AS bold, regexp_matches(html, '(?i)<table[\s/>]') AS tab, coalesce(list_contains(regexp_split_to_array(regexp_extract(html, '(?is)<html\b[^>]*?\slang\s*=\s*"([^"]*)"', 1), '\s+'), 'fr'), false) AS fr FROM pages)
        SELECT page_id, article AND bold AS both_of, fr OR tab AS either_of, (article AND NOT fr) OR (tab AND bold) AS mixed FROM f""",
    "bag_counts": BAGS + " SELECT item_id, word, n FROM bag",
    "bag_centroid": TOK + ", b AS (SELECT t.doc_id, word, count(*) AS n FROM tok t GROUP BY ALL), k AS (SELECT lang, count(DISTINCT b.doc_id) AS bags FROM b JOIN documents d ON b.doc_id = d.doc_id GROUP BY lang) SELECT k.lang, word, CAST(floor(sum(n) / CAST(bags AS DOUBLE) + 0.5) AS BIGINT) AS n FROM b JOIN documents d ON b.doc_id = d.doc_id JOIN k ON k.lang = d.lang GROUP BY k.lang, word, bags HAVING floor(sum(n) / CAST(bags AS DOUBLE) + 0.5) > 0",
    "bag_distances": BAGS + r""", s AS (SELECT item_id, sum(n) AS s, sum(n * n) AS q FROM bag GROUP BY item_id), sh AS (SELECT x.item_id AS a, y.item_id AS b, sum(least(x.n, y.n)) AS l, sum(x.n * y.n) AS dot FROM bag x JOIN bag y ON x.word = y.word AND x.item_id < y.item_id GROUP BY ALL)
        SELECT a, b, round(1 - 2 * l / CAST(sa.s + sb.s AS DOUBLE), 6) AS bray_curtis, CAST(sa.s + sb.s - 2 * l AS DOUBLE) AS manhattan, round(sqrt(sa.q + sb.q - 2 * dot), 6) AS euclidean FROM sh JOIN s sa ON a = sa.item_id JOIN s sb ON b = sb.item_id""",
    "tag_confusion": CONF + " SELECT model, gold, n FROM conf",
    "jaccard_cost": CONF + " SELECT model, gold, round(1 - n / CAST(ni + nj - n AS DOUBLE), 9) AS cost FROM tot",
    "many_to_one_accuracy": CONF + ", m AS (SELECT model, gold, n, row_number() OVER (PARTITION BY model ORDER BY 1 - n / CAST(ni + nj - n AS DOUBLE), gold) AS r FROM tot) SELECT round(sum(CASE WHEN r = 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 9) AS accuracy FROM m",
    "pairwise_prf": CONF + r""", s AS (SELECT (SELECT sum(n::DOUBLE * n) FROM conf) AS b, (SELECT sum(x * x) FROM (SELECT sum(n)::DOUBLE AS x FROM conf GROUP BY model)) AS m, (SELECT sum(x * x) FROM (SELECT sum(n)::DOUBLE AS x FROM conf GROUP BY gold)) AS g, (SELECT sum(n)::DOUBLE FROM conf) AS a),
        q AS (SELECT (b - a) / (m - a) AS p, (b - a) / (g - a) AS r FROM s) SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f FROM q""",
    "variation_of_information": CONF + r""", h AS (SELECT (SELECT -sum(x / nn * ln(x / nn)) FROM (SELECT sum(n)::DOUBLE AS x, max(nn)::DOUBLE AS nn FROM tot GROUP BY model)) AS hm, (SELECT -sum(x / nn * ln(x / nn)) FROM (SELECT sum(n)::DOUBLE AS x, max(nn)::DOUBLE AS nn FROM tot GROUP BY gold)) AS hg,
        (SELECT sum(n / nn::DOUBLE * ln((n / nn::DOUBLE) / ((ni / nn::DOUBLE) * (nj / nn::DOUBLE)))) FROM tot) AS mi) SELECT round(hm + hg - 2 * mi, 9) AS vi FROM h""",
    "run_statistics": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stdev, count(o_totalprice) AS runs FROM orders GROUP BY o_orderpriority",
    "mapping_ratio": "SELECT CASE WHEN k <= 3 THEN CAST(k AS VARCHAR) ELSE 'M' END AS ratio, count(*) AS tags FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY o_custkey) GROUP BY 1",
    "harmonic_mean": "SELECT l_returnflag, round(count(*) / sum(1 / l_quantity), 9) AS harmonic_mean FROM lineitem GROUP BY l_returnflag",
    "shannon_entropy": CONF + " SELECT model, round(-sum(n / ni::DOUBLE * log2(n / ni::DOUBLE)), 9) AS entropy FROM tot GROUP BY model",
    "hmm_state_words": STATE + " SELECT state, word, count(*) AS n FROM st GROUP BY ALL",
    "hmm_transitions": STATE + " SELECT lag2, lag1, state, count(*) AS n FROM ctx GROUP BY ALL",
    "hmm_transition_prob": STATE + r""", g AS (SELECT a.range AS prev, b.range AS state FROM range(6) a, range(6) b), t AS (SELECT lag1, state, count(*) AS n FROM ctx GROUP BY ALL)
        SELECT CAST(prev AS INT) AS prev, CAST(g.state AS INT) AS state, round((coalesce(n, 0) + 0.1::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY prev) + 0.6::DOUBLE), 9) AS p FROM g LEFT JOIN t ON prev = lag1 AND g.state = t.state""",
    "hmm_emission_prob": STATE + ", c AS (SELECT state, word, count(*) AS n FROM st GROUP BY ALL) SELECT state, word, round((n + 0.01::DOUBLE) / (sum(n) OVER (PARTITION BY state) + (SELECT count(DISTINCT word) FROM c) * 0.01::DOUBLE), 9) AS p FROM c",
    "topic_counts": STATE + " SELECT 'topic_word' AS kind, topic::BIGINT AS id, word AS key, count(*) AS n FROM st WHERE state = 0 GROUP BY ALL UNION ALL SELECT 'topic', topic::BIGINT, '', count(*) FROM st WHERE state = 0 GROUP BY ALL UNION ALL SELECT 'doc_topic', doc_id, topic::VARCHAR, count(*) FROM st GROUP BY ALL",
    "top_words": STATE + " SELECT state, r AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, word) AS r FROM (SELECT state, word, count(*) AS n FROM st GROUP BY ALL)) WHERE r <= 10",
    "two_tier_counts": STATE + " SELECT 'chunk' AS kind, chunk, state, coalesce(nc, -1) AS next, count(*) AS n FROM ctx GROUP BY ALL UNION ALL SELECT 'state', chunk, state, coalesce(ns, 5), count(*) FROM ctx GROUP BY ALL",
    "chunk_counts": SEGS + " SELECT chunk, n FROM cc",
    "chunk_bigrams": SEGS + " SELECT prev, chunk, n FROM bi",
    "chunk_prob": SEGS + " SELECT chunk, round(p, 9) AS p FROM cp",
    "chunk_transition_prob": SEGS + " SELECT prev, bi.chunk, round((n + 3.0::DOUBLE * p) / (sum(n) OVER (PARTITION BY prev) + 3.0::DOUBLE * (SELECT count(*) FROM cp)), 9) AS p FROM bi JOIN cp ON bi.chunk = cp.chunk",
    "stem_affix_prob": LEX + r""", sp AS (SELECT word[1:i] AS stem, word[i + 1:] AS affix, freq AS n FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS i FROM lex)), c AS (SELECT affix, stem, sum(n) AS n FROM sp GROUP BY ALL)
        SELECT affix, stem, round((n + exp(ln(0.3::DOUBLE) + length(stem) * (ln(0.7::DOUBLE) + ln(1 / 26::DOUBLE)))) / (sum(n) OVER (PARTITION BY affix) + 1.0::DOUBLE), 9) AS p FROM c""",
    "unigram_reestimate": UNI + " SELECT word, round(up, 9) AS up FROM uni",
    "net_style_scores": KN3 + PROBS + UNI_TAIL + r""", words AS (SELECT doc_id, sent_id, pos, log10(p) AS lp, up FROM win JOIN prob ON win.ngram = prob.ngram JOIN uni ON win.ngram[3] = uni.word), persent AS (
        SELECT doc_id, sent_id, count(*) AS n, sum(lp) AS lp, sum(up) AS up, list_sort(list(-lp / up)) AS r FROM words GROUP BY doc_id, sent_id), pct AS (SELECT *, """ + PCT.format(q="0.25::DOUBLE") + " AS q1, " + PCT.format(q="0.5::DOUBLE") + r""" AS q2 FROM persent), scored AS (
        SELECT doc_id, sent_id, lp AS logprob, up AS unigram_logprob, lp / n AS mean_logprob, lp / -up AS norm_logprob_div, lp - up AS norm_logprob_sub, (lp - up) / n AS slor,
        """ + ", ".join(f"CASE WHEN n >= 5 THEN r[{i}] END AS wlogprob_bot_{i}" for i in range(1, 6)) + r""", CASE WHEN n >= 5 THEN list_sum(r) / n END AS wlogprob_mean, CASE WHEN n >= 5 THEN list_avg(list_filter(r, lambda x: x <= q1)) END AS wlogprob_m1q, CASE WHEN n >= 5 THEN list_avg(list_filter(r, lambda x: x <= q2)) END AS wlogprob_m2q FROM pct)
        SELECT doc_id, sent_id, """ + r6(*METRICS) + " FROM scored",
    "kn_tag_prob": kn(windows("tagged", 3, TOK + r""", tagged AS (SELECT doc_id, sent_id, list(CAST(length(word) % 7 AS VARCHAR) ORDER BY pos) AS tokens FROM tok GROUP BY doc_id, sent_id)""")) + PROBS + r""",
        wf AS (SELECT word, count(*) AS f FROM tok GROUP BY word), tf AS (SELECT CAST(length(word) % 7 AS VARCHAR) AS tag, count(*) AS f FROM tok GROUP BY 1),
        pairs AS (SELECT DISTINCT tok.word, win.ngram FROM win JOIN tok ON win.doc_id = tok.doc_id AND win.sent_id = tok.sent_id AND win.pos = tok.pos)
        SELECT pairs.word, array_to_string(pairs.ngram, ' ') AS ngram, round((wf.f + 1) / CAST(tf.f AS DOUBLE) * prob.p, 9) AS p FROM pairs JOIN prob ON pairs.ngram = prob.ngram JOIN wf ON wf.word = pairs.word JOIN tf ON tf.tag = CAST(length(pairs.word) % 7 AS VARCHAR)""",
    "back_off_prob": windows("csent", 3) + r""", p3 AS (SELECT list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>']) AS t FROM csent), g1 AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM p3) GROUP BY w),
        g2 AS (SELECT list_slice(t, i, i + 1) AS g, count(*) AS c FROM (SELECT t, unnest(range(1, len(t))) AS i FROM p3) GROUP BY 1), g3 AS (SELECT list_slice(t, i, i + 2) AS g, count(*) AS c FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p3) GROUP BY 1)
        SELECT array_to_string(w.ngram, ' ') AS ngram, round(coalesce(g3.c / CAST(b2.c AS DOUBLE), g2.c / CAST(b1.c AS DOUBLE), g1.c / CAST((SELECT sum(c) FROM g1) AS DOUBLE), 0), 9) AS p
        FROM (SELECT DISTINCT ngram FROM win) w LEFT JOIN g3 ON g3.g = w.ngram LEFT JOIN g2 b2 ON b2.g = w.ngram[1:2] LEFT JOIN g2 ON g2.g = w.ngram[2:3] LEFT JOIN g1 b1 ON b1.w = w.ngram[2] LEFT JOIN g1 ON g1.w = w.ngram[3]""",
}
