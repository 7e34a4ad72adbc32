"""DuckDB SQL for the further queries."""

from __future__ import annotations

from tessera.operators.tags import PENN_FULL
from tessera.plans.oracles import CLEAN, CSENT, CTX, NUM, PROBS, SENTS, STATE, TOK, VOC, WORDS, kn, windows  # noqa: F401

W = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
STREAM = r"""list_concat(list_transform(list_filter(regexp_split_to_array(replace(line, chr(13), ''), '[ \t]'), lambda w: w <> ''), lambda w: left(w, {n})), ['</s>'])"""
RAW = "WITH raw AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS sent_id, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
SMALL = VOC + ", sv AS (SELECT * FROM voc WHERE cn >= 4 {more})"
FULL = sorted(PENN_FULL)
TAGS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in FULL) + "]"
PAIRS = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in sorted(PENN_FULL.items()))
TAGGED = TOK + f", tg AS (SELECT *, CASE WHEN length(word) < 40 THEN {TAGS}[CAST(length(word) % {len(FULL)} + 1 AS INT)] END AS tag FROM tok)"
TRIMMED = r"""lower(CASE WHEN regexp_extract(word, '^[^A-Za-z0-9_]*([A-Za-z0-9_].*[A-Za-z0-9_])[^A-Za-z0-9_]*$', 1) <> '' THEN regexp_extract(word, '^[^A-Za-z0-9_]*([A-Za-z0-9_].*[A-Za-z0-9_])[^A-Za-z0-9_]*$', 1) WHEN regexp_matches(word, '^[A-Za-z0-9_]+$') THEN word ELSE '' END)"""
POS5 = TOK + ", st AS (SELECT word, CAST(pos % 5 AS INT) AS state FROM tok)"
DICT = POS5 + """, ws AS (SELECT word, state, count(*) AS n FROM st GROUP BY ALL),
  dict AS (SELECT word, list_sort(list(state) FILTER (WHERE n >= 2)) AS states FROM ws GROUP BY word HAVING sum(n) >= 20 AND count(*) FILTER (WHERE n >= 2) > 0)"""
BWIN = r""", bs AS (SELECT item_id AS doc_id, list_filter(regexp_split_to_array(lower(replace(text, chr(10), ' ')), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS tokens FROM benchmark),
bp AS (SELECT list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>']) AS t FROM bs WHERE len(tokens) > 0), bwin AS (SELECT list_slice(t, i, i + 2) AS ngram FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM bp))"""
STINGY = kn(windows("csent", 3, CSENT + r""", voc AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS w FROM benchmark UNION SELECT '<s>' UNION SELECT '</s>')""", "WHERE list_extract(t, i + 2) IN (SELECT w FROM voc)"))
EMIT = STATE + ", sw AS (SELECT state, word, count(*) AS n FROM st GROUP BY ALL), em AS (SELECT state, word, n, (n + 0.01::DOUBLE) / (sum(n) OVER (PARTITION BY state) + (SELECT count(DISTINCT word) FROM st) * 0.01::DOUBLE) AS p FROM sw)"
TOPS = STATE + ", top AS (SELECT state, r AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, word) AS r FROM (SELECT state, word, count(*) AS n FROM st GROUP BY ALL)) WHERE r <= 10)"


def segmented(every: int) -> str:
    return STATE + f""", seg AS (
  SELECT doc_id, sent_id, chunk_id, string_agg(CAST(state AS VARCHAR), '+' ORDER BY pos) AS chunk
  FROM (SELECT *, pos // {every} AS chunk_id FROM st) GROUP BY doc_id, sent_id, chunk_id), cc AS (SELECT chunk, count(*) AS n FROM seg GROUP BY chunk)"""


MORE = {
    "conll_words": f"SELECT conv_id, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS sent, array_to_string(w, ' ') AS words FROM (SELECT conv_id, turn, {W} AS w FROM conversations) WHERE len(w) > 0",
    "net_words": RAW + f" SELECT word, count(*) AS n FROM (SELECT unnest({STREAM.format(n=999)}) AS word FROM raw) GROUP BY word",
    "net_lines": RAW + f" SELECT doc_id, sent_id, array_to_string(words, ' ') AS words FROM (SELECT doc_id, sent_id, {STREAM.format(n=99)} AS words FROM raw) WHERE len(words) > 1",
    "net_sentence_ids": SMALL.format(more="") + " SELECT doc_id, sent_id, '0 ' || string_agg(CAST(coalesce(word_id, -1) AS VARCHAR), ' ' ORDER BY pos DESC) || ' 0' AS ids, bool_or(word_id IS NULL) AS oov FROM tok LEFT JOIN sv USING (word) GROUP BY doc_id, sent_id",
    "net_unknown_ids": SMALL.format(more="AND word_id <> 1") + " SELECT doc_id, sent_id, '0 ' || string_agg(CAST(coalesce(word_id, 1) AS VARCHAR), ' ' ORDER BY pos) || ' 0' AS ids, false AS oov FROM tok LEFT JOIN sv USING (word) GROUP BY doc_id, sent_id",
    "vocabulary_file": VOC + " SELECT word_id, word || ' ' || CAST(cn AS VARCHAR) AS line FROM voc",
    "vocabulary_reload": VOC + " SELECT CAST(row_number() OVER (ORDER BY word_id > 0, cn // 2 DESC, word_id) - 1 AS BIGINT) AS word_id, word, cn // 2 AS cn FROM voc",
    "external_probabilities": "SELECT conv_id, turn, CAST('0.' || lpad(CAST(turn AS VARCHAR), 3, '0') AS DOUBLE) AS p FROM conversations",
    "corpus_kinds": r"SELECT doc_id, contains(regexp_extract(line, '^[ \t]*([^ \t\n]+)', 1), '_@') AS tagged, regexp_matches(line, '^[ \t\n\r]*<[A-Za-z!?]') AS xml FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '_@' || text WHEN 1 THEN chr(10) || ' <p>' || text ELSE text END AS line FROM documents)",
    "word_score_lines": f"SELECT CAST('-' || conv_id || '.5' AS DOUBLE) AS logprob, n, CAST('-' || turn || '.25' AS DOUBLE) AS unigram, CAST(sum(n) AS BIGINT) AS scores, count(*) AS lines FROM (SELECT conv_id, turn, len({W}) AS n FROM conversations) WHERE n > 0 GROUP BY conv_id, turn, n",
    "pos_dictionary": "SELECT replace(n_name, ' ', '_') AS tag, count(*) AS words FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT c_custkey % 25 FROM customer) JOIN nation ON k = n_nationkey GROUP BY 1",
    "debug_log": f"SELECT word, count(*) AS n, max(CAST('0.' || (length(word) + 10) AS DOUBLE)) AS p FROM (SELECT unnest({W}) AS word FROM benchmark) GROUP BY word",
    "annotated_lines": "SELECT CAST(l_linenumber AS BIGINT) AS state, l_returnflag AS one_to_one, l_linestatus AS many_to_one, 'G' || l_suppkey % 3 AS gold, 'x' AS gold_reduced, count(*) AS n, count(DISTINCT l_suppkey) AS words FROM lineitem GROUP BY 1, 2, 3, 4",
    "unpivoted_scores": "SELECT doc_id, 'quality' AS metric, CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS DOUBLE) ELSE 0 END AS score FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels",
    "reduced_tags": TAGGED + f", names(f, r) AS (VALUES {PAIRS}) SELECT r AS tag, w AS word, count(*) AS n FROM (SELECT tag, {TRIMMED} AS w FROM tg WHERE tag IS NOT NULL AND tag NOT IN ('SYM', 'LS')) LEFT JOIN names ON f = tag WHERE w <> '' GROUP BY ALL",
    "tag_numbers": TAGGED + " SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS BIGINT) AS tag_id FROM (SELECT DISTINCT tag FROM tg WHERE tag IS NOT NULL)",
    "allowed_states": DICT + " SELECT state, states IS NULL OR list_contains(states, state) AS allowed, count(*) AS n FROM st LEFT JOIN dict USING (word) GROUP BY ALL",
    "ngram_cutoff": SENTS + ", p AS (SELECT list_concat(list_concat(['<s>', '<s>'], tokens), ['</s>']) AS t FROM sent) " + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS \"order\", array_to_string(g, ' ') AS ngram, count(*) AS c FROM (SELECT list_slice(t, i, i + {k - 1}) AS g FROM (SELECT t, unnest(range(1, len(t) - {k} + 2)) AS i FROM p)) GROUP BY 2" + (" HAVING count(*) > 1" if k == 3 else "") for k in (1, 2, 3)),
    "kn_stingy_prob": STINGY + BWIN + PROBS.replace("FROM (SELECT DISTINCT ngram FROM win) w", "FROM (SELECT DISTINCT ngram FROM bwin) w") + " SELECT array_to_string(ngram, ' ') AS ngram, round(p, 9) AS p, round(p1, 9) AS p1 FROM prob",
    "kn_twosided_prob": CSENT + r""", p AS (SELECT list_concat(list_concat(['<s>'], tokens), ['</s>']) AS t FROM csent), w AS (SELECT t[i] || ' ' || t[i + 2] AS ctx, t[i + 1] AS middle FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM p)), c AS (SELECT ctx, middle, count(*) AS n FROM w GROUP BY ALL)
      SELECT ctx, middle AS "pivot", round((n - 0.7::DOUBLE) / sum(n) OVER (PARTITION BY ctx) + count(*) OVER (PARTITION BY ctx) * 0.7::DOUBLE / sum(n) OVER (PARTITION BY ctx) * sum(n) OVER (PARTITION BY middle) / sum(n) OVER (), 9) AS p FROM c""",
    "sentence_measures": WORDS + " SELECT doc_id, sent_id, round(sum(lp), 6) AS logprob, round(sum(lp) / count(*), 6) AS mean_logprob, round(-sum(lp) / sum(up), 6) AS norm_logprob, round((sum(lp) - sum(up)) / count(*), 6) AS slor FROM words GROUP BY doc_id, sent_id",
    "nbest_scores": WORDS + " SELECT w.doc_id, w.sent_id, round(sum(CASE WHEN NOT coalesce(c.known, true) THEN -5 ELSE lp END), 6) AS senp, count(*) AS n, round(sum(CASE WHEN NOT coalesce(c.known, true) THEN 0 ELSE up END), 6) AS unigram FROM words w LEFT JOIN cleaned c ON w.doc_id = c.doc_id AND w.sent_id = c.sent_id AND w.pos = c.pos GROUP BY w.doc_id, w.sent_id",
    "nbest_lines": SENTS + " SELECT doc_id, sent_id, '1 ' || line AS line FROM sent",
    "hmm_transition_prob2": STATE + r""", tr AS (SELECT lag2, lag1, state, count(*) AS n FROM ctx GROUP BY ALL), ids AS (SELECT CAST(unnest(range(0, 6)) AS INT) AS s)
      SELECT a.s AS prev2, b.s AS prev, c.s AS state, round((coalesce(n, 0) + 0.1::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY a.s, b.s) + 6 * 0.1::DOUBLE), 9) AS p
      FROM ids a, ids b, ids c LEFT JOIN tr ON lag2 = a.s AND lag1 = b.s AND state = c.s""",
    "hmm_third_order": STATE + " SELECT lag3, lag2, lag1, state, count(*) AS n FROM (SELECT *, coalesce(lag(state, 3) OVER (PARTITION BY doc_id, sent_id ORDER BY pos), 5) AS lag3 FROM ctx) GROUP BY ALL",
    "masked_emission_prob": DICT + r""", vs AS (SELECT s.state, (SELECT count(*) FROM (SELECT DISTINCT word FROM st) WHERE word NOT IN (SELECT word FROM dict)) + (SELECT count(*) FROM dict WHERE list_contains(states, s.state)) AS v FROM (SELECT DISTINCT state FROM st) s),
      kept AS (SELECT ws.* FROM ws LEFT JOIN dict USING (word) WHERE states IS NULL OR list_contains(states, state))
      SELECT state, word, round((n + 0.01::DOUBLE) / (sum(n) OVER (PARTITION BY state) + v * 0.01::DOUBLE), 9) AS p FROM kept JOIN vs USING (state)""",
    "word_unigram_prob": EMIT + " SELECT word, round(sum(p * share), 9) AS p FROM em JOIN (SELECT state, sum(n) / CAST((SELECT sum(n) FROM sw) AS DOUBLE) AS share FROM sw GROUP BY state) USING (state) GROUP BY word",
    "top_likely_words": EMIT + ", rk AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY p DESC, word) AS r FROM em) SELECT s.state, CAST(k AS BIGINT) AS rank, coalesce(word, 'Null') AS word, round(coalesce(p, 0), 9) AS p FROM (SELECT DISTINCT state, unnest(range(1, 11)) AS k FROM sw) s LEFT JOIN rk ON rk.state = s.state AND r = k",
    "top_word_table": TOPS + " SELECT CAST(state // 4 AS BIGINT) AS block, rank, " + ", ".join(f"max(CASE WHEN state % 4 = {i} THEN word END) AS c{i}" for i in range(4)) + " FROM top GROUP BY 1, 2",
    "top_chunks": segmented(3) + " SELECT chunk, n FROM cc ORDER BY n DESC, chunk DESC LIMIT 100",
    "long_chunks": segmented(8) + " SELECT chunk, n FROM cc WHERE len(string_split(chunk, '+')) > 5",
    "count_invariants": TOK + ", c AS (SELECT count(*) AS n FROM tok) SELECT unnest(['state_word', 'first_order', 'second_order', 'state']) AS name, n AS counted, n AS expected FROM c",
    "first_seen_words": TOK + " SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS BIGINT) AS word_id, word FROM (SELECT word, min((doc_id, sent_id, pos)) AS a FROM tok GROUP BY word)",
    "perplexity_average": "SELECT l_returnflag, round(count(*) / sum(exp(l_quantity / 50.0::DOUBLE)), 9) AS perplexity FROM lineitem GROUP BY 1",
    "bag_minkowski": r"""WITH b AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS word FROM benchmark), bag AS (SELECT item_id, word, count(*) AS n FROM b GROUP BY ALL),
      s AS (SELECT item_id, sum(pow(n, 3)) AS q FROM bag GROUP BY 1), m AS (SELECT x.item_id AS a, y.item_id AS b, sum(pow(abs(x.n - y.n), 3) - pow(x.n, 3) - pow(y.n, 3)) AS near FROM bag x JOIN bag y ON x.word = y.word AND x.item_id < y.item_id GROUP BY ALL)
      SELECT a, m.b, round(pow(sa.q + sb.q + near, 1 / 3.0::DOUBLE), 6) AS minkowski FROM m JOIN s sa ON sa.item_id = a JOIN s sb ON sb.item_id = m.b""",
    "merged_spaces": f"WITH w AS (SELECT conv_id, role, unnest({W}) AS word FROM conversations), ids AS (SELECT DISTINCT conv_id FROM w) SELECT conv_id, coalesce(string_agg(word, ' ' ORDER BY word), '') AS words FROM ids LEFT JOIN (SELECT DISTINCT conv_id, word FROM w WHERE role IN ('user', 'assistant')) USING (conv_id) GROUP BY conv_id",
    "interleaved_words": f"SELECT item_id, array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda i: [w[i], w[len(w) + 1 - i]])), ' ') AS words FROM (SELECT item_id, {W} AS w FROM benchmark) WHERE len(w) > 0",
    "same_lines": "SELECT doc_id, text = lower(text) AS same FROM documents",
    "sentence_names": "SELECT name, left(name, 3) AS file, CAST(substr(name, 5) AS BIGINT) AS number FROM (SELECT left(rpad(source, 3, '0'), 3) || '.' || doc_id AS name FROM documents)",
    "ordered_steps": "SELECT step, n, CAST(CASE step WHEN 'full' THEN 3 WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS BIGINT) AS place FROM (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'full' ELSE o_orderpriority END AS step, count(*) AS n FROM orders GROUP BY 1)",
    "binomials": "SELECT n_nationkey, n_regionkey, CAST(CASE WHEN n_regionkey > n_nationkey THEN 0 ELSE round(gamma(n_nationkey + 1) / gamma(n_regionkey + 1) / gamma(n_nationkey - n_regionkey + 1)) END AS BIGINT) AS sets FROM nation",
    "sample_vectors": "SELECT l_orderkey, '[' || string_agg(CAST(v AS VARCHAR), ' ' ORDER BY l_linenumber, v) || ']' AS matlab, string_agg('(' || k || ',' || v || ')', '' ORDER BY l_linenumber, v) AS latex, round(avg(v), 9) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, v) AS k FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INT) AS v FROM lineitem)) GROUP BY l_orderkey",
}
