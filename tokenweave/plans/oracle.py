"""DuckDB statements with the same results as the registered queries, written independently of them."""

from __future__ import annotations

B, E = "'___BEGIN__'", "'___END__'"
WS = r"[\t\n\x0B\f\r\x{85}\pZ]"
TRIM = f"regexp_replace(@, '^{WS}+|{WS}+$', '', 'g')"
CUT = f"""string_split(regexp_replace(@, '([.!?]){WS}+(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"""
LINES = "string_split(@, chr(10))"
WALKS, SEED = 200, 7


def units(source: str, key: str, cut: str = CUT) -> str:
    """(doc_id, pos, s)"""
    parts = f"list_filter(list_transform({cut.replace('@', 'text')}, lambda x: {TRIM.replace('@', 'x')}), lambda x: x <> '')"
    return f"SELECT doc_id, i - 1 AS pos, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key} AS doc_id, {parts} AS l FROM {source} WHERE text IS NOT NULL))"


def runs(source: str = "documents", key: str = "doc_id", cut: str = CUT, normalize: bool = False) -> str:
    """(doc_id, pos, w)"""
    w = f"string_split_regex(s, '{WS}+')"
    if normalize:
        w = f"list_filter(list_transform({w}, lambda x: regexp_replace(lower(x), '[^A-Za-z0-9]', '', 'g')), lambda x: x <> '')"
    return f"SELECT doc_id, pos, w FROM (SELECT doc_id, pos, {w} AS w FROM ({units(source, key, cut)})) WHERE len(w) > 0"


def transitions(run: str, k: int) -> str:
    begin = ", ".join([B] * k)
    return f"SELECT doc_id, pos, i, it[i + 1 : i + {k}] AS state, it[i + {k} + 1] AS follow FROM (SELECT doc_id, pos, list_concat(list_concat([{begin}], w), [{E}]) AS it, unnest(range(0, len(w) + 1)) AS i FROM ({run}))"


def model(run: str, k: int) -> str:
    return f"SELECT state, follow, count(*)::BIGINT AS n FROM ({transitions(run, k)}) GROUP BY state, follow"


def flat(m: str) -> str:
    return f"SELECT array_to_string(state, ' ') AS state, follow, n FROM ({m})"


def cdf(m: str, t: float = 1.0) -> str:
    w = "n::DOUBLE" if t == 1.0 else f"pow(n, {1 / t!r})"
    return (
        f"SELECT state, follow, hi, coalesce(lag(hi) OVER (PARTITION BY state ORDER BY follow), 0.0) AS lo, last(hi) OVER (PARTITION BY state ORDER BY follow ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total "
        f"FROM (SELECT state, follow, sum({w}) OVER (PARTITION BY state ORDER BY follow ROWS UNBOUNDED PRECEDING) AS hi FROM ({m}))"
    )


def roll(*parts) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def walks(requests: str, m: str, t: float, more: str = "") -> str:
    """WITH clauses up to done(walk_id, attempt, words, status); requests gives walk_id, attempt, init."""
    return f"""
WITH RECURSIVE m AS MATERIALIZED ({m}), cdf AS MATERIALIZED ({cdf("SELECT * FROM m", t)}), req AS MATERIALIZED ({requests}),
walk(walk_id, attempt, step, state, words, status) AS (
  SELECT walk_id, attempt, 0, init, []::VARCHAR[], NULL::VARCHAR FROM req
  UNION ALL
  SELECT w.walk_id, w.attempt, w.step + 1, CASE WHEN c.follow IS NULL THEN w.state ELSE list_append(w.state[2:], c.follow) END,
         CASE WHEN c.follow IS NULL OR c.follow = {E} OR w.step = 1000 THEN w.words ELSE list_append(w.words, c.follow) END,
         CASE WHEN c.follow IS NULL THEN 'dead' WHEN c.follow = {E} THEN 'end' WHEN w.step = 1000 THEN 'cut' END
  FROM walk w LEFT JOIN cdf c ON w.state = c.state AND {roll(SEED, "w.walk_id", "w.attempt", "w.step")} * c.total >= c.lo AND {roll(SEED, "w.walk_id", "w.attempt", "w.step")} * c.total < c.hi
  WHERE w.status IS NULL
),
done AS MATERIALIZED (SELECT walk_id, attempt, words, status FROM walk WHERE status IS NOT NULL){more}
"""


BENCH = runs("benchmark", "item_id")
DOCS = runs()


def begin_requests(n: int, tries: int, k: int) -> str:
    return f"SELECT w AS walk_id, a::INTEGER AS attempt, [{', '.join([B] * k)}] AS init FROM range({n}) x(w), range({tries}) y(a)"


GRAMS = """, over AS (SELECT *, least(15, round(0.7 * len(words))::INTEGER) AS o FROM done),
grams AS MATERIALIZED (SELECT walk_id, attempt, i, array_to_string(words[i + 1 : i + o + 1], ' ') AS gram FROM (SELECT *, unnest(range(0, greatest(len(words) - o, 1))) AS i FROM over))"""
SOURCE = f"SELECT doc_id, string_agg(array_to_string(w, ' ') || ' ', '' ORDER BY pos) AS source FROM ({{}}) GROUP BY doc_id"
REJECT = f""", src AS MATERIALIZED ({SOURCE.format(BENCH)}),
hits AS MATERIALIZED (SELECT gram FROM (SELECT DISTINCT gram FROM grams) g WHERE EXISTS (SELECT 1 FROM src WHERE contains(src.source, g.gram))),
bad AS (SELECT DISTINCT walk_id, attempt FROM grams JOIN hits USING (gram))"""


def sentences(n: int, tries: int, where: str, test: bool = True, dead: bool = True) -> str:
    stop = "(ok OR status = 'dead')" if dead else "ok"
    return f"""
{walks(begin_requests(n, tries, 1), model(BENCH, 1), 1.0, GRAMS + REJECT)},
judged AS (
  SELECT walk_id, attempt, status, array_to_string(words, ' ') AS sentence, status = 'end' AND ({where}) {"AND bad.walk_id IS NULL" if test else ""} AS ok
  FROM done LEFT JOIN bad USING (walk_id, attempt)
),
first AS (SELECT walk_id, arg_min({{'ok': ok, 's': sentence}}, attempt) AS f FROM judged WHERE {stop} GROUP BY walk_id)
SELECT w AS walk_id, CASE WHEN f.ok THEN f.s END AS sentence FROM range({n}) r(w) LEFT JOIN first ON first.walk_id = w
"""


CHARS = "length(array_to_string(words, ' ')) BETWEEN {} AND {}"
ROUND_TRIP = flat(model(BENCH, 2))
LABELLED = "(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = {}))"


def combined(a: float, b: float) -> str:
    parts = [f"SELECT state, follow, round_even(n * {w!r}, 0)::BIGINT AS n FROM ({model(runs(LABELLED.format(q)), 2)})" for q, w in ((1, a), (0, b))]
    return flat(f"SELECT state, follow, sum(n)::BIGINT AS n FROM ({parts[0]} UNION ALL {parts[1]}) WHERE n > 0 GROUP BY state, follow")


def keyed(source: str, key: str, order: str, token: str, k: int) -> str:
    lags = ", ".join(f"lag(tok, {j}, {B}) OVER w" for j in range(k, 0, -1))
    tail = ", ".join([f"lag(tok, {j}, {B}) OVER w" for j in range(k - 1, 0, -1)] + ["tok"])
    return f"""
WITH r AS (SELECT {key} AS k, {order}, {token} AS tok FROM {source}),
p AS (SELECT [{lags}] AS state, tok AS follow FROM r WINDOW w AS (PARTITION BY k ORDER BY {order})),
t AS (SELECT k, [{tail}] AS state, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS c FROM r WINDOW w AS (PARTITION BY k ORDER BY {order}))
{flat(f"SELECT state, follow, count(*)::BIGINT AS n FROM (SELECT state, follow FROM p UNION ALL SELECT state, {E} FROM t WHERE i = c) GROUP BY state, follow")}
"""


IDS = f"""
WITH m AS MATERIALIZED ({model(DOCS, 2)}),
v AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT unnest(list_append(state, follow)) AS word FROM m)),
enc AS (SELECT a.word_id AS id0, b.word_id AS id1, c.word_id AS follow_id, n FROM m JOIN v a ON m.state[1] = a.word JOIN v b ON m.state[2] = b.word JOIN v c ON m.follow = c.word)
"""
LOOSE = f"""SELECT row_number() OVER (ORDER BY md5('{SEED}:' || array_to_string(state, ' ')), array_to_string(state, ' ')) - 1 AS rank, state
FROM (SELECT DISTINCT state FROM ({model(BENCH, 2)}) WHERE list_filter(state, lambda x: x <> {B})[1] = 'the')"""


def started(requests: str, where: str) -> str:
    return f"""
{walks(requests, model(BENCH, 2), 1.0)},
whole AS (SELECT walk_id, attempt, status, list_concat(list_filter(init, lambda x: x <> {B}), words) AS words FROM done JOIN req USING (walk_id, attempt)),
first AS (SELECT walk_id, arg_min({{'ok': status = 'end' AND {where}, 's': array_to_string(words, ' ')}}, attempt) AS f FROM whole WHERE status = 'dead' OR (status = 'end' AND {where}) GROUP BY walk_id)
SELECT arg_min(f.s, walk_id) AS sentence FROM first WHERE f.ok
"""


SQL = {
    "split_sentences": f"SELECT doc_id, pos, s AS sentence FROM ({units('documents', 'doc_id')})",
    "split_lines": f"SELECT doc_id, pos, s AS line FROM ({units('documents', 'doc_id', LINES)})",
    "split_words": f"SELECT doc_id, pos, len(w) AS n_words, array_to_string(w, '|') AS words FROM ({DOCS})",
    "split_words_normalized": f"SELECT doc_id, pos, len(w) AS n_words, array_to_string(w, '|') AS words FROM ({runs(normalize=True)})",
    "rejoin_sentences": f"SELECT doc_id, pos, array_to_string(w, ' ') AS sentence FROM ({DOCS})",
    "model_normalized_k2": flat(model(runs(normalize=True), 2)),
    "train_text_k2": flat(model(BENCH, 2)),
    "train_newline_k1": flat(model(runs("conversations", "conv_id || ':' || turn", LINES), 1)),
    "train_from_sentences": flat(model(f"SELECT 0 AS doc_id, 0 AS pos, string_split_regex(s, '{WS}+') AS w FROM (SELECT {TRIM.replace('@', 'text')} AS s FROM conversations WHERE role = 'user') WHERE s <> ''", 2)),
    "chain_events_k1": keyed("events", "user_id", "ts, event_id", "event_type", 1),
    "chain_orders_k2": keyed("orders", "o_custkey", "o_orderdate, o_orderkey", "o_orderstatus || '/' || replace(o_orderpriority, ' ', '_')", 2),
    "followers_nested": f"SELECT array_to_string(state, ' ') AS state, count(*)::BIGINT AS degree, sum(n)::BIGINT AS total, string_agg(follow || '=' || n, ',' ORDER BY follow) AS followers FROM ({model(DOCS, 2)}) GROUP BY state",
    "follower_lookup": flat(f"SELECT * FROM ({model(DOCS, 1)}) WHERE state = ['the']"),
    "state_stats": f"SELECT array_to_string(state, ' ') AS state, count(*)::BIGINT AS degree, sum(n)::BIGINT AS total, max(n) AS top, arg_max(follow, {{'n': n, 'f': follow}}) AS top_follow FROM ({model(DOCS, 2)}) GROUP BY state",
    "begin_followers": f"SELECT follow, n FROM ({model(DOCS, 2)}) WHERE state = [{B}, {B}]",
    "successor_states": f"SELECT array_to_string(state, ' ') AS state, state[2] || ' ' || follow AS successor, n FROM ({model(DOCS, 2)}) WHERE follow <> {E}",
    "state_repr": f"SELECT DISTINCT '(' || array_to_string(state, ', ') || ')' AS repr, len(state) AS length, state[1] AS first FROM ({model(DOCS, 2)})",
    "model_totals": " UNION ALL ".join(f"SELECT {k} AS k, count(DISTINCT state)::BIGINT AS n_states, count(*)::BIGINT AS n_pairs, sum(n)::BIGINT AS n_transitions FROM ({model(DOCS, k)})" for k in (1, 2, 3)),
    "vocab_encode": f"{IDS} SELECT word, word_id FROM v",
    "model_int_ids": f"{IDS} SELECT * FROM enc",
    "csr_rows": f"{IDS}, rows AS (SELECT id0, id1, count(*)::BIGINT AS degree, sum(n)::BIGINT AS total FROM enc GROUP BY id0, id1) SELECT id0 || ' ' || id1 AS key, row_number() OVER w - 1 AS state_id, (coalesce(sum(degree) OVER (ORDER BY id0, id1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS row_start, degree, total FROM rows WINDOW w AS (ORDER BY id0, id1)",
    "combine_sources": f"SELECT source FROM ({SOURCE.format(BENCH)}) UNION ALL SELECT source FROM ({SOURCE.format(DOCS)})",
    "prune_2": flat(f"SELECT * FROM ({model(DOCS, 2)}) WHERE n >= 2"),
    "prune_removed": f"SELECT count(*) FILTER (WHERE n < 2) AS n_removed FROM ({model(DOCS, 2)})",
    "dangling_after_prune": f"WITH m AS MATERIALIZED (SELECT * FROM ({model(DOCS, 2)}) WHERE n >= 2) SELECT DISTINCT state[2] || ' ' || follow AS state FROM m WHERE follow <> {E} AND [state[2], follow] NOT IN (SELECT state FROM m)",
    "weights_t1_5": f"SELECT array_to_string(state, ' ') AS state, follow, round(pow(n, {1 / 1.5!r}), 6) AS w FROM ({model(DOCS, 2)})",
    "move_grid": f"WITH c AS MATERIALIZED ({cdf(model(DOCS, 2))}) SELECT array_to_string(c.state, ' ') AS state, u, follow FROM c JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.999)) r(u) ON u * total >= lo AND u * total < hi",
    "move_missing": f"WITH c AS MATERIALIZED ({cdf(model(DOCS, 2))}), s AS (SELECT DISTINCT state FROM ({model(BENCH, 2)})) SELECT array_to_string(s.state, ' ') AS state, follow FROM s LEFT JOIN c ON s.state = c.state AND 0.5 * total >= lo AND 0.5 * total < hi",
    "walk_begin": f"{walks(begin_requests(WALKS, 1, 2), model(DOCS, 2), 1.5)} SELECT walk_id, array_to_string(words, ' ') AS sentence, len(words)::BIGINT AS n_words, status FROM done",
    "walk_from_state": f"{walks(f'SELECT row_number() OVER (ORDER BY t DESC, s) - 1 AS walk_id, 0 AS attempt, state AS init FROM (SELECT state, sum(n) AS t, array_to_string(state, chr(32)) AS s FROM m WHERE NOT list_contains(state, {B}) GROUP BY state ORDER BY t DESC, s LIMIT 20)', model(DOCS, 2), 1.5)} SELECT walk_id, array_to_string(words, ' ') AS sentence, status FROM done",
    "walk_mapped": f"{walks(begin_requests(WALKS, 1, 1), model(BENCH, 1), 1.5)} SELECT walk_id, array_to_string(words, ' ') AS sentence, status FROM done",
    "make_sentence": sentences(50, 10, "true"),
    "make_sentence_bounded": sentences(50, 5, "len(words) BETWEEN 8 AND 16"),
    "make_short_sentence": sentences(50, 10, CHARS.format(20, 60), dead=False),
    "make_sentence_mapped": sentences(50, 10, "len(words) <= 12", test=False),
    "make_short_mapped": sentences(50, 10, CHARS.format(30, 80), test=False, dead=False),
    "start_candidates": f"SELECT array_to_string(state, ' ') AS state, rank FROM ({LOOSE})",
    "start_strict": started(f"SELECT 0::BIGINT AS walk_id, a::INTEGER AS attempt, [{B}, 'The'] AS init FROM range(10) y(a)", "true"),
    "start_loose": started(f"SELECT rank AS walk_id, a::INTEGER AS attempt, state AS init FROM ({LOOSE}), range(3) y(a)", "len(words) <= 12"),
    "overlap_grams": f"{walks(begin_requests(WALKS, 1, 1), model(BENCH, 1), 1.0, GRAMS)} SELECT walk_id, i, gram FROM grams",
    "overlap_reject": f"{walks(begin_requests(WALKS, 1, 1), model(BENCH, 1), 1.0, GRAMS + REJECT)} SELECT walk_id, bad.walk_id IS NOT NULL AS rejected FROM done LEFT JOIN bad USING (walk_id)",
    "source_rejoined": SOURCE.format(DOCS),
    "json_roundtrip": flat(model(DOCS, 2)),
    "json_model_meta": f"SELECT 2 AS state_size, 1.5::DOUBLE AS temperature, sum(n)::BIGINT AS n_transitions, count(*)::BIGINT AS n_pairs FROM ({model(BENCH, 2)})",
    "mapped_state_lookup": flat(f"SELECT * FROM ({model(DOCS, 2)}) WHERE state = [{B}, 'The']"),
    "binary_roundtrip": ROUND_TRIP,
    "mapped_roundtrip": ROUND_TRIP,
    "stream_equals_batch": flat(model(runs("conversations", "conv_id"), 1)),
    "zipf_corpus": f"""
WITH v AS (SELECT i, sum(1.0::DOUBLE / (i + 1)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS hi FROM range(500) r(i)),
c AS (SELECT i, hi, coalesce(lag(hi) OVER (ORDER BY i), 0.0) AS lo, max(hi) OVER () AS total FROM v),
r AS (SELECT id, unnest(range(0, 6 + floor({roll(42, "'n'", "id")} * 11)::INTEGER)) AS pos FROM range(2000) x(id))
SELECT id AS run, pos, 'w' || i AS word FROM r JOIN c ON {roll(42, "id", "pos")} * total >= lo AND {roll(42, "id", "pos")} * total < hi""",
}
SQL |= {f"transitions_k{k}": f"SELECT doc_id, pos, i, array_to_string(state, ' ') AS state, follow FROM ({transitions(DOCS, k)})" for k in (1, 2, 3)}
SQL["walk_int_ids"] = SQL["walk_csr"] = SQL["walk_travel"] = SQL["walk_begin"]
SQL["mapped_file_documents"] = flat(model(DOCS, 2))
SQL["walk_sql"] = SQL["walk_mapped"]
SQL["vocab_by_sight"] = f"""
SELECT word, row_number() OVER (ORDER BY first) + 1 AS word_id FROM (SELECT word, min([doc_id, pos, i]) AS first FROM (SELECT doc_id, pos, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM ({DOCS})) GROUP BY word)
WHERE word NOT IN ({B}, {E}) UNION ALL VALUES ({B}, 0), ({E}, 1)"""
SQL["followers_by_sight"] = f"""
WITH p AS (SELECT state, follow, count(*) AS n, min([doc_id, pos, i]) AS first FROM ({transitions(DOCS, 2)}) GROUP BY state, follow)
SELECT array_to_string(state, ' ') AS state, string_agg(follow || '=' || n, ',' ORDER BY first) AS followers, min(first)[1] AS doc_id, min(first)[2] AS pos, min(first)[3] AS i FROM p GROUP BY state"""
SQL["state_segments"] = f"""
WITH c AS MATERIALIZED ({cdf(model(DOCS, 1), 1.5)}), r AS (SELECT *, (row_number() OVER (PARTITION BY state ORDER BY follow) - 1) // 4096 AS b FROM c)
SELECT array_to_string(state, ' ') AS state, round(min(lo), 5) AS lo, round(max(hi), 5) AS hi, round(any_value(total), 5) AS total, count(*)::BIGINT AS degree, min(follow) AS first_follow FROM r GROUP BY r.state, b"""
SQL["start_candidates_indexed"] = f"SELECT array_to_string(state, ' ') AS state, rank FROM ({LOOSE.replace(model(BENCH, 2), model(DOCS, 2))})"
SQL["start_loose_saved"] = SQL["start_loose"]
SQL["overlap_positions"] = SQL["overlap_reject"]
SQL["source_chunks"] = f"""
WITH s AS MATERIALIZED (SELECT string_agg(array_to_string(w, ' ') || ' ', '' ORDER BY doc_id, pos) AS t FROM ({DOCS}))
SELECT c AS chunk, length(x)::BIGINT AS n_chars, md5(x) AS digest FROM (
  SELECT c, substr(t, greatest(c * 100000 - 1000, 0) + 1, (c + 1) * 100000 - greatest(c * 100000 - 1000, 0)) AS x
  FROM (SELECT t, unnest(range(0, (length(t) + 99999) // 100000)) AS c FROM s))"""
SQL["model_packed"] = f"{IDS}, b AS (SELECT (1::BIGINT << length(bin(max(word_id)))) AS base FROM v) SELECT id0 * base + id1 AS lo, follow_id, id1 * base + follow_id AS next_lo, n FROM enc, b"
SQL |= {f"model_k{k}": flat(model(DOCS, k)) for k in (1, 2, 3)}
SQL |= {"combine_default": combined(1.0, 1.0), "combine_weighted": combined(1.0, 2.0), "combine_fractional": combined(0.5, 1.5)}
SQL |= {name: f"SELECT array_to_string(state, ' ') AS state, follow, round(lo, 5) AS lo, round(hi, 5) AS hi, round(total, 5) AS total FROM ({cdf(model(DOCS, 2), t)})" for name, t in (("cdf_t1", 1.0), ("cdf_t0_5", 0.5), ("cdf_t2", 2.0))}
