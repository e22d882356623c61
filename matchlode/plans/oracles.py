"""The registered queries in DuckDB's SQL, from shared parts."""

from __future__ import annotations

Z = "1.959963984540054::DOUBLE"


def _norm(x: str) -> str:
    return rf"lower(trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')))"


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def _models(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[._-][a-z0-9]+)*'), lambda t: regexp_matches(t, '[0-9]')))"


def _rate(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END"


def _r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def _wilson(c: str, n: str, sign: str) -> str:
    p, n = f"(({c})::DOUBLE / ({n}))", f"({n})::DOUBLE"
    scale = f"(1 + {Z} * {Z} / {n})"
    value = f"(({p} + {Z} * {Z} / (2 * {n})) / {scale}) {sign} ({Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / {scale})"
    ends = f"greatest(0.0::DOUBLE, {value})" if sign == "-" else f"least(1.0::DOUBLE, {value})"
    return f"CASE WHEN {n} > 0 THEN {_r(ends)} END"


def _stats(support: str, correct: str, total: str, prefix: str, nulls: bool = False) -> str:
    low, high = (f"CASE WHEN {correct} IS NOT NULL THEN {_wilson(correct, support, sign)} END" if nulls else _wilson(correct, support, sign) for sign in "-+")
    return f"""({support})::BIGINT AS {prefix}_support, ({correct})::BIGINT AS {prefix}_correct_count, ({support} - {correct})::BIGINT AS {prefix}_error_count,
    CASE WHEN {support} > 0 THEN {_r(f"({correct})::DOUBLE / ({support})")} END AS {prefix}_empirical_precision,
    {low} AS {prefix}_precision_wilson_95_low, {high} AS {prefix}_precision_wilson_95_high,
    {_r(_rate(support, total))} AS {prefix}_coverage"""


LISTINGS = "l AS (SELECT CAST(doc_id AS VARCHAR) AS google_id, doc_id, split_part(text, chr(10), 1) AS title, lang, text FROM documents)"
CATALOG = "c AS (SELECT 'b' || item_id AS amazon_id, item_id AS ordinal, split_part(text, chr(10), 1) AS title, text FROM benchmark)"
GOLD = f"gold AS (SELECT google_id, amazon_id FROM (SELECT google_id, {_norm('text')} AS t FROM l) d JOIN (SELECT amazon_id, {_norm('text')} AS u FROM c) e ON u <> '' AND contains(t, u))"
BASE = f"WITH RECURSIVE {LISTINGS}, {CATALOG}, {GOLD}"
SIGNED = f"""s AS (SELECT google_id, doc_id, 'duplicate_' || substr(sha256(to_json([{_norm('title')}, {_norm('lang')}, {_norm('text')}, '<missing-price>'])::VARCHAR), 1, 16) AS duplicate_group_id FROM l),
last AS (SELECT max(doc_id) AS doc_id FROM s JOIN (SELECT DISTINCT google_id FROM gold) USING (google_id) GROUP BY duplicate_group_id),
part_gold AS (SELECT * FROM gold WHERE google_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM last)),
g AS (SELECT *, google_id IN (SELECT google_id FROM part_gold) AS mapped FROM s),
groups AS (SELECT google_id, duplicate_group_id, count(*) OVER w AS duplicate_group_size, bool_or(mapped) OVER w AND NOT mapped AS ambiguous_label FROM g WINDOW w AS (PARTITION BY duplicate_group_id))"""
COMPONENTS = """e AS (SELECT min('g:' || google_id) OVER (PARTITION BY duplicate_group_id) AS a, 'g:' || google_id AS b FROM groups UNION SELECT 'g:' || google_id, 'a:' || amazon_id FROM part_gold),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a),
comp AS (SELECT substr(node, 3) AS google_id, min(substr(seen, 3)) AS root FROM reach WHERE node LIKE 'g:%' AND seen LIKE 'g:%' GROUP BY node)"""

_cos = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
VECTORS = f"""q AS (SELECT CAST(vec_id AS VARCHAR) AS google_id, vec_id, embedding AS e, label FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT CAST(vec_id AS VARCHAR) AS amazon_id, vec_id AS ordinal, embedding AS e, label FROM embeddings),
sims AS (SELECT google_id, amazon_id, ordinal, round({_cos.format(a='q.e', b='v.e')}, 6) AS full_score, round({_cos.format(a='q.e[1:32]', b='v.e[1:32]')}, 6) AS half_score FROM q, v),
dense AS (SELECT google_id, amazon_id, full_score AS dense_score, row_number() OVER (PARTITION BY google_id ORDER BY full_score DESC, ordinal) AS dense_rank FROM sims QUALIFY dense_rank <= 20),
lexical AS (SELECT google_id, amazon_id, half_score AS lexical_score, row_number() OVER (PARTITION BY google_id ORDER BY half_score DESC, ordinal) AS lexical_rank FROM sims QUALIFY lexical_rank <= 20),
fused AS (SELECT google_id, amazon_id, lexical_score, dense_score, lexical_rank, dense_rank, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 12) AS rrf,
  concat_ws('+', CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS retrieval_sources FROM lexical FULL JOIN dense USING (google_id, amazon_id)),
pool AS (SELECT *, row_number() OVER (PARTITION BY google_id ORDER BY rrf DESC, amazon_id) AS rrf_rank FROM fused),
vgold AS (SELECT google_id, amazon_id FROM q JOIN v ON q.label = v.label AND abs(q.vec_id - v.ordinal) <= 40 AND google_id <> amazon_id)"""
POOL = f"WITH {VECTORS}"
GOLD_RANKS = "gr AS (SELECT google_id, min(rrf_rank) FILTER (WHERE g2 IS NOT NULL) AS best FROM (SELECT DISTINCT google_id FROM sgold) LEFT JOIN (SELECT s.google_id, rrf_rank, g.google_id AS g2 FROM (SELECT google_id, amazon_id, row_number() OVER (PARTITION BY google_id ORDER BY rrf DESC, amazon_id) AS rrf_rank FROM part_pool) s LEFT JOIN sgold g USING (google_id, amazon_id)) USING (google_id) GROUP BY google_id)"

SHOP = """pc AS (SELECT 'p' || p_partkey AS amazon_id, p_partkey AS ordinal, p_name || ' ' || lower(p_type) || ' m' || p_partkey || '-' || p_size AS title, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS maker,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type || ' ' || p_name || ' of size ' || p_size END AS text, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price FROM part),
pl AS (SELECT 'g' || p_partkey AS google_id, p_partkey AS ordinal, upper(p_name) || '  m' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ' new' ELSE '-' || p_size END AS title, CASE WHEN p_partkey % 4 <> 0 THEN lower(p_brand) END AS maker,
  CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS text, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice * 1.05::DOUBLE END AS price FROM part)"""
SPLIT = "['train', 'validation', 'test'][{} % 3 + 1]"
ASSIGNED = f"""named AS (SELECT google_id, dense_rank() OVER (ORDER BY root) - 1 AS number FROM comp),
assigned AS (SELECT google_id, printf('component_%05d', number) AS component_id, {SPLIT.format('number')} AS split, duplicate_group_id, duplicate_group_size, ambiguous_label FROM named JOIN groups USING (google_id)),
lines AS (SELECT google_id, concat_ws(',', google_id, component_id, split, duplicate_group_id, duplicate_group_size, CASE WHEN ambiguous_label THEN 'True' ELSE 'False' END) AS line FROM assigned)"""

SCORED = f"""scored AS (SELECT d.doc_id, (n_chars * 7919 + d.doc_id * 104729) % 1001 / 1000.0::DOUBLE AS score, quality AS label, md5({_norm('text')}) AS group_id, quality = 1 AS has_gold_listing,
  quality = 1 AND toxic = 0 AS is_gold_pair, (quality = 1 AND toxic = 0) OR d.doc_id % 7 <> 0 AS gold_retrieved FROM documents d JOIN labels y USING (doc_id))"""
DECIDED = f"""WITH {SCORED}, acted AS (SELECT *, CASE WHEN score >= 0.8::DOUBLE THEN 'auto_match' WHEN score <= 0.2::DOUBLE THEN 'auto_no_match' ELSE 'manual_review' END AS action,
  CASE WHEN NOT has_gold_listing THEN 'assumed_no_match' WHEN NOT gold_retrieved THEN 'retrieval_miss' WHEN NOT is_gold_pair THEN 'reranking_miss' ELSE 'top_gold_match' END AS ranking_outcome FROM scored),
decided AS (SELECT *, CASE action WHEN 'auto_match' THEN is_gold_pair WHEN 'auto_no_match' THEN NOT has_gold_listing END AS action_correct FROM acted)"""
CURVE = f"WITH {SCORED}, by_score AS (SELECT score, count(*) AS n, sum(label) AS p FROM scored GROUP BY score), curve AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM by_score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def _report(rows: str) -> str:
    auto = "count(*) FILTER (WHERE action <> 'manual_review')"
    right = "count(*) FILTER (WHERE action_correct)"
    counts = ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}_count, {_r(_rate(f'''count(*) FILTER (WHERE action = '{a}')''', 'count(*)'))} AS {a}_rate" for a in ("auto_match", "auto_no_match", "manual_review"))
    return f"""SELECT count(*) AS listings, {counts}, {right} AS correct_automatic, {_r(_rate(right, auto))} AS automatic_accuracy, {_r(_rate(auto, 'count(*)'))} AS automatic_coverage,
    count(*) FILTER (WHERE action = 'manual_review' AND has_gold_listing) AS review_matched, count(*) FILTER (WHERE action = 'manual_review' AND NOT has_gold_listing) AS review_no_match,
    {_r(_rate(right, 'count(*)'))} AS end_to_end_rate FROM {rows}"""


def _grams(rows: str) -> str:
    """key, gram for each n-gram of rows (key, t: normalised text)."""
    return f"""words AS (SELECT key, ' ' || w || ' ' AS p FROM (SELECT key, unnest(string_split(t, ' ')) AS w FROM {rows}) WHERE w <> ''),
grams AS (SELECT key, substr(p, i::INT, n::INT) AS gram FROM words, (VALUES (3), (4), (5)) z(n), unnest(range(1, greatest(2, length(p) - n + 2))) x(i) WHERE n = 3 OR length(p) >= n),
tf AS (SELECT key, gram, count(*) AS tf FROM grams GROUP BY ALL)"""


_WEIGHTS = """raw AS (SELECT key, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN vocabulary USING (gram)),
posting AS (SELECT key, gram, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM raw)"""


def _vocabulary(count: str) -> str:
    return f"vocabulary AS (SELECT gram, ln((1.0::DOUBLE + {count}) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram ORDER BY sum(tf) DESC, gram LIMIT 50000)"


def _detail(action: str, correct: str, selected: str, edge: str) -> str:
    return f"""SELECT '{action}' AS action, t.threshold, {{target}}::DOUBLE AS precision_target, 20 AS min_group_support,
  {_stats('gs', 'gc', 'gt', 'group')}, {_stats('ls', 'lc', 'lt', 'listing')}, gs >= 20 AS support_met, coalesce(gc::DOUBLE / nullif(gs, 0) >= {{target}}, false) AS precision_target_met,
  gs >= 20 AND coalesce(gc::DOUBLE / nullif(gs, 0) >= {{target}}, false) AS feasible
  FROM (SELECT threshold, count(*) FILTER (WHERE s {selected} threshold) AS gs, count(*) FILTER (WHERE s {selected} threshold AND ok) AS gc, count(*) AS gt
    FROM grid, (SELECT {edge}(score) AS s, bool_and({correct}) AS ok FROM scored GROUP BY group_id) GROUP BY threshold) t
  JOIN (SELECT threshold, count(*) FILTER (WHERE score {selected} threshold) AS ls, count(*) FILTER (WHERE score {selected} threshold AND {correct}) AS lc, count(*) AS lt FROM grid, scored GROUP BY threshold) u USING (threshold)"""


DIAGNOSTICS = (
    f"WITH {SCORED}, grid AS (SELECT round(i * 0.01::DOUBLE, 12) AS threshold FROM range(101) r(i)), diagnostics AS ("
    + _detail("auto_match", "is_gold_pair", ">=", "max").replace("{target}", "0.7")
    + " UNION ALL "
    + _detail("auto_no_match", "NOT has_gold_listing", "<=", "min").replace("{target}", "0.2")
    + ")"
)

_pair_texts = f"{BASE} SELECT google_id, amazon_id, {{}} FROM gold JOIN l USING (google_id) JOIN (SELECT amazon_id, title AS ctitle, text AS ctext FROM c) USING (amazon_id)"
_collisions = rf"""sig AS (SELECT google_id, doc_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS signature, google_id IN (SELECT google_id FROM gold) AS mapped FROM l),
hit AS (SELECT google_id, doc_id, signature FROM sig WHERE NOT mapped AND signature <> '' AND signature IN (SELECT signature FROM sig WHERE mapped))"""
_some = "part_pool AS (SELECT * FROM pool WHERE google_id::BIGINT % 700 <> 0), sgold AS (SELECT * FROM vgold WHERE google_id::BIGINT % 500 <> 300)"
_hits, _found = "count(*) FILTER (WHERE best = 1)", "count(best)"


def _jaccard(a: str, b: str) -> str:
    return _r(_rate(f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"))


_lcs = "list_reduce(string_split(a, ''), lambda r, x: list_reduce(range(1, length(b) + 1), lambda o, j: list_append(o, CASE WHEN substr(b, j, 1) = x THEN r[j] + 1 ELSE greatest(r[j + 1], o[j]) END), [0::BIGINT]), list_transform(range(0, length(b) + 1), lambda i: 0::BIGINT))[-1]"

_evidence = ", ".join(
    f"coalesce({k}_{c}, 0) AS {v}_{c}" if c in ("support", "correct_count", "error_count", "coverage") else f"{k}_{c} AS {v}_{c}"
    for v, k in (("group_evidence", "group"), ("listing_operation", "listing"))
    for c in ("support", "correct_count", "error_count", "empirical_precision", "precision_wilson_95_low", "precision_wilson_95_high", "coverage")
)
_token_set = """round(CASE WHEN s > 0 AND (la = 0 OR lb = 0) THEN 1.0::DOUBLE ELSE greatest(1 - (la + lb - 2 * common)::DOUBLE / (2 * (s + g) + la + lb),
          CASE WHEN s > 0 THEN 1 - (g + la)::DOUBLE / (2 * s + g + la) ELSE 0 END, CASE WHEN s > 0 THEN 1 - (g + lb)::DOUBLE / (2 * s + g + lb) ELSE 0 END) END, 6)"""
_vector = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda q: (length(t) - length(replace(t, q, '')))::DOUBLE)"
_shop_texts = f"""b AS (SELECT 'q' || google_id AS key, {_norm("concat_ws(' ', title, maker, text)")} AS t FROM pl UNION ALL SELECT 'c' || amazon_id, {_norm("concat_ws(' ', title, maker, text)")} FROM pc)"""
_shop_lexical = f"""WITH {SHOP}, {_shop_texts}, {_grams('b')}, {_vocabulary('(SELECT count(*) FROM b)')}, {_WEIGHTS},
  dots AS (SELECT q.key AS k, c.key AS m, sum(q.weight * c.weight) AS s FROM posting q JOIN posting c USING (gram) WHERE q.key LIKE 'q%' AND c.key LIKE 'c%' GROUP BY ALL),
  lex AS (SELECT google_id, amazon_id, pc.ordinal AS ordinal, coalesce(s, 0)::DOUBLE AS s FROM pl CROSS JOIN pc LEFT JOIN dots ON k = 'q' || google_id AND m = 'c' || amazon_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY google_id ORDER BY round(s, 6) DESC, ordinal) AS lexical_rank FROM lex)"""

ORACLES = {
    "clean_text": r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS clean FROM documents",
    "title_signature": f"WITH {LISTINGS} SELECT google_id AS product_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS signature FROM l",
    "model_tokens": f"SELECT doc_id, array_to_string(list_sort({_models('text')}), ' ') AS models FROM documents",
    "token_jaccard": _pair_texts.format(f"{_jaccard(_tokens('text'), _tokens('ctext'))} AS jaccard"),
    "numeric_token_conflict": f"WITH p AS ({_pair_texts.format(_models('text') + ' AS m, ' + _models(chr(39).join(['ctext || ', ' ', ' || amazon_id'])) + ' AS k')}) SELECT google_id, amazon_id, (len(m) > 0 AND len(k) > 0 AND list_sort(m) <> list_sort(k))::INT AS conflict FROM p",
    "relative_price_difference": f"SELECT l_orderkey, l_linenumber, {_r('coalesce(abs(u - p_retailprice) / greatest(u, p_retailprice), 0)')} AS difference FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem) JOIN part ON l_partkey = p_partkey",
    "price_parse": "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') AND round(o_totalprice, 2) > 0 THEN round(o_totalprice, 2) END AS price FROM orders",
    "gold_containment": f"{BASE} SELECT * FROM gold",
    "exact_duplicate_groups": f"{BASE}, {SIGNED} SELECT google_id, duplicate_group_id, duplicate_group_size FROM groups",
    "duplicate_summary": f"""{BASE}, {SIGNED} SELECT count(DISTINCT duplicate_group_id) AS groups, count(DISTINCT duplicate_group_id) FILTER (WHERE duplicate_group_size > 1) AS groups_of_many,
        count(*) FILTER (WHERE duplicate_group_size > 1) AS rows_in_them, count(*) FILTER (WHERE ambiguous_label) AS ambiguous_rows FROM groups""",
    "ambiguous_members": f"{BASE}, {SIGNED} SELECT google_id, duplicate_group_id FROM groups WHERE ambiguous_label",
    "connected_components": f"{BASE}, {SIGNED}, {COMPONENTS} SELECT google_id, root FROM comp",
    "component_labels": f"{BASE}, {SIGNED}, {COMPONENTS} SELECT google_id, printf('component_%05d', dense_rank() OVER (ORDER BY root) - 1) AS component_id FROM comp",
    "split_isolation_check": f"""{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED}, r AS (SELECT 'component' AS rule, * FROM assigned UNION ALL SELECT 'id', * REPLACE ({SPLIT.format('google_id::BIGINT')} AS split) FROM assigned)
        SELECT rule, 'component' AS kind, component_id AS key, count(DISTINCT split) AS splits FROM r GROUP BY ALL HAVING count(DISTINCT split) > 1
        UNION ALL SELECT rule, 'duplicate_group', duplicate_group_id, count(DISTINCT split) FROM r GROUP BY ALL HAVING count(DISTINCT split) > 1""",
    "assignment_csv": f"{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED} SELECT * FROM lines",
    "assignment_digest": f"{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED} SELECT count(*) AS rows, sha256('google_id,component_id,split,duplicate_group_id,duplicate_group_size,ambiguous_label' || chr(10) || string_agg(line || chr(10), '' ORDER BY google_id)) AS digest FROM lines",
    "assigned_split_counts": f"{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED} SELECT split, count(google_id) AS n FROM (VALUES ('train'), ('validation'), ('test')) z(split) LEFT JOIN assigned USING (split) GROUP BY split",
    "split_listings": f"{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED} SELECT google_id AS product_id, split FROM assigned",
    "training_summary": f"""{BASE}, {SIGNED}, {COMPONENTS}, {ASSIGNED}, own AS (SELECT google_id FROM assigned WHERE split = 'train' AND NOT ambiguous_label),
        learned AS (SELECT google_id, min(amazon_id) AS amazon_id FROM own, c GROUP BY google_id UNION SELECT google_id, amazon_id FROM part_gold SEMI JOIN own USING (google_id)),
        labelled AS (SELECT l.google_id, (g.google_id IS NOT NULL)::INT AS label FROM learned l LEFT JOIN part_gold g USING (google_id, amazon_id))
        SELECT split, (SELECT count(*) FROM assigned a WHERE a.split = z.split) AS listings, (SELECT count(*) FROM part_gold JOIN assigned a USING (google_id) WHERE a.split = z.split) AS gold_pairs,
        (SELECT count(*) FROM assigned a WHERE a.split = z.split AND ambiguous_label) AS ambiguous_rows, (SELECT count(*) FROM labelled JOIN assigned a USING (google_id) WHERE a.split = z.split) AS training_pairs,
        (SELECT coalesce(sum(label), 0) FROM labelled JOIN assigned a USING (google_id) WHERE a.split = z.split)::BIGINT AS training_positives FROM (VALUES ('train'), ('validation'), ('test')) z(split)""",
    "char_ngram_df": f"WITH b AS (SELECT item_id AS key, {_norm('text')} AS t FROM benchmark), {_grams('b')} SELECT gram, count(*) AS df FROM tf GROUP BY gram",
    "tfidf_postings": f"WITH b AS (SELECT item_id AS key, {_norm('text')} AS t FROM benchmark), {_grams('b')}, {_vocabulary('(SELECT count(*) FROM b)')}, {_WEIGHTS} SELECT key AS item_id, gram, {_r('weight')} AS weight FROM posting",
    "lexical_topk": f"""WITH {LISTINGS}, {CATALOG}, b AS (SELECT 'q' || google_id AS key, {_norm("concat_ws(' ', title, lang, text)")} AS t FROM l UNION ALL SELECT 'c' || amazon_id, {_norm("concat_ws(' ', title, '', text)")} FROM c),
        {_grams('b')}, {_vocabulary('(SELECT count(*) FROM b)')}, {_WEIGHTS},
        dots AS (SELECT q.key AS k, c.key AS m, sum(q.weight * c.weight) AS s FROM posting q JOIN posting c USING (gram) WHERE q.key LIKE 'q%' AND c.key LIKE 'c%' GROUP BY ALL)
        SELECT google_id, amazon_id, round(coalesce(s, 0)::DOUBLE, 6) AS score, row_number() OVER (PARTITION BY google_id ORDER BY round(coalesce(s, 0)::DOUBLE, 6) DESC, ordinal)::INT AS rank
        FROM l CROSS JOIN c LEFT JOIN dots ON k = 'q' || google_id AND m = 'c' || amazon_id QUALIFY rank <= 5""",
    "lexical_topk_postings": f"{_shop_lexical} SELECT google_id, amazon_id, round(s, 6) AS score, lexical_rank::INT AS rank FROM ranked WHERE lexical_rank <= 3",
    "hybrid_retrieval": f"""{_shop_lexical}, vec AS (SELECT key, {_vector} AS e FROM b), unit AS (SELECT key, list_transform(e, lambda q: q / sqrt(list_dot_product(e, e))) AS e FROM vec),
        den AS (SELECT google_id, amazon_id, pc.ordinal AS ordinal, list_dot_product(x.e, y.e) AS d FROM pl JOIN unit x ON x.key = 'q' || google_id CROSS JOIN pc JOIN unit y ON y.key = 'c' || amazon_id),
        drank AS (SELECT *, row_number() OVER (PARTITION BY google_id ORDER BY round(d, 6) DESC, ordinal) AS dense_rank FROM den),
        both_lists AS (SELECT google_id, amazon_id, CASE WHEN lexical_rank <= 10 THEN lexical_rank END AS lexical_rank, CASE WHEN dense_rank <= 10 THEN dense_rank END AS dense_rank, s, d FROM ranked JOIN drank USING (google_id, amazon_id) WHERE lexical_rank <= 10 OR dense_rank <= 10),
        f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 12) AS rrf FROM both_lists)
        SELECT google_id, amazon_id, {_r('s')} AS lexical_score, {_r('d')} AS dense_score, lexical_rank::INT AS lexical_rank, dense_rank::INT AS dense_rank, {_r('rrf')} AS rrf_score, (row_number() OVER (PARTITION BY google_id ORDER BY rrf DESC, amazon_id))::INT AS rrf_rank,
        concat_ws('+', CASE WHEN lexical_rank IS NOT NULL THEN 'lexical' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS retrieval_sources FROM f QUALIFY rrf_rank <= 10""",
    "dense_topk": f"{POOL} SELECT google_id, amazon_id, dense_score AS score, dense_rank::INT AS rank FROM dense",
    "union_pool": f"{POOL} SELECT google_id, amazon_id, lexical_rank::INT AS lexical_rank, dense_rank::INT AS dense_rank, round(rrf, 6) AS rrf_score, rrf_rank::INT AS rrf_rank, retrieval_sources FROM pool",
    "rrf_fusion": f"{POOL} SELECT google_id, amazon_id, round(rrf, 6) AS rrf_score, rrf_rank::INT AS rrf_rank, retrieval_sources FROM pool WHERE rrf_rank <= 10",
    "gold_injection": f"""{POOL} SELECT google_id, amazon_id, lexical_rank::INT AS lexical_rank, dense_rank::INT AS dense_rank, round(coalesce(rrf, 0), 6) AS rrf_score, rrf_rank::INT AS rrf_rank,
        CASE WHEN injected THEN concat_ws('+', nullif(retrieval_sources, ''), 'gold_injected') ELSE retrieval_sources END AS retrieval_sources, injected AS gold_injected
        FROM (SELECT *, is_gold IS NOT NULL AND coalesce(rrf_rank, 11) > 10 AS injected FROM pool FULL JOIN (SELECT *, true AS is_gold FROM vgold) USING (google_id, amazon_id)) WHERE rrf_rank <= 10 OR is_gold""",
    "label_pairs": f"{POOL} SELECT p.google_id, p.amazon_id, (g.google_id IS NOT NULL)::INT AS label FROM pool p LEFT JOIN vgold g USING (google_id, amazon_id)",
    "recall_at_k": f"""{POOL}, n AS (SELECT count(DISTINCT google_id) AS n FROM vgold), h AS (SELECT * FROM pool SEMI JOIN vgold USING (google_id, amazon_id)),
        r AS (SELECT google_id, unnest(['lexical', 'dense', 'rrf', 'union']) AS channel, unnest([lexical_rank, dense_rank, rrf_rank, least(lexical_rank, dense_rank)]) AS rank FROM h)
        SELECT channel, k::INT AS k, {_r('count(DISTINCT google_id) FILTER (WHERE rank <= k)::DOUBLE / any_value(n)')} AS recall FROM r, n, (VALUES (5), (10), (20)) z(k) GROUP BY channel, k""",
    "candidate_counts": f"{POOL} SELECT count(*) AS listings, {_r('avg(coalesce(m, 0))')} AS mean_candidates FROM q LEFT JOIN (SELECT google_id, count(*) AS m FROM pool GROUP BY google_id) USING (google_id)",
    "rank_features": f"{POOL} SELECT google_id, amazon_id, (lexical_rank IS NOT NULL AND dense_rank IS NOT NULL)::INT::DOUBLE AS source_agreement, {_r('coalesce(1.0::DOUBLE / lexical_rank, 0)')} AS lexical_reciprocal, {_r('coalesce(1.0::DOUBLE / dense_rank, 0)')} AS dense_reciprocal FROM pool",
    "pair_features": f"""WITH {SHOP}, pairs AS (SELECT 'g' || p_partkey AS google_id, 'p' || least(p_partkey + step, (SELECT max(p_partkey) FROM part)) AS amazon_id, step, p_partkey AS k, p_size FROM part, (VALUES (0), (1)) z(step)),
        j AS (SELECT google_id, amazon_id, step, k, p_size, {_norm('pl.title')} AS t1, {_norm('pc.title')} AS t2, {_norm('pl.maker')} AS m1, {_norm('pc.maker')} AS m2, {_norm('pl.text')} AS x1, {_norm('pc.text')} AS x2, pl.price AS p1, pc.price AS p2 FROM pairs JOIN pl USING (google_id) JOIN pc USING (amazon_id)),
        mk AS (SELECT *, {_r(f'2.0::DOUBLE * {_lcs} / (length(a) + length(b))')} AS maker_fuzzy FROM (SELECT DISTINCT m1 AS a, m2 AS b FROM j WHERE m1 <> '' AND m2 <> '')),
        w AS (SELECT google_id, amazon_id, step, string_split(t1, ' ') AS x, string_split(t2, ' ') AS y FROM j),
        v AS (SELECT google_id, amazon_id, step, array_to_string(list_sort(list_distinct(list_intersect(x, y))), ' ') AS i, array_to_string(list_sort(list_distinct(list_filter(x, lambda q: NOT list_contains(y, q)))), ' ') AS a, array_to_string(list_sort(list_distinct(list_filter(y, lambda q: NOT list_contains(x, q)))), ' ') AS b FROM w),
        u AS (SELECT *, length(i) AS s, (length(i) > 0)::INT AS g, length(a) AS la, length(b) AS lb, {_lcs} AS common FROM v),
        tf AS (SELECT google_id, amazon_id, step, {_token_set} AS title_fuzzy FROM u)
        SELECT google_id, amazon_id, step, {_r('CASE WHEN k % 9 <> 0 THEN p_size / 64 ELSE 0 END')} AS lexical_similarity, {_r('CASE WHEN k % 8 <> 0 THEN p_size / 50 - 0.25::DOUBLE ELSE 0 END')} AS dense_similarity,
        {_jaccard(_tokens('t1'), _tokens('t2'))} AS title_token_jaccard, title_fuzzy AS title_fuzzy_similarity, (m1 <> '' AND m1 = m2)::INT::DOUBLE AS manufacturer_exact, coalesce(maker_fuzzy, 0) AS manufacturer_fuzzy_similarity,
        {_jaccard(_models('t1'), _models('t2'))} AS model_token_jaccard, (len({_models('t1')}) > 0 AND len({_models('t2')}) > 0 AND list_sort({_models('t1')}) <> list_sort({_models('t2')}))::INT::DOUBLE AS numeric_token_conflict,
        {_r('coalesce(abs(p1 - p2) / CASE WHEN p1 > p2 THEN p1 ELSE p2 END, 0)')} AS relative_price_difference, (m1 = '')::INT::DOUBLE AS query_manufacturer_missing, (m2 = '')::INT::DOUBLE AS candidate_manufacturer_missing,
        (x1 = '')::INT::DOUBLE AS query_description_missing, (x2 = '')::INT::DOUBLE AS candidate_description_missing, (p1 IS NULL)::INT::DOUBLE AS query_price_missing, (p2 IS NULL)::INT::DOUBLE AS candidate_price_missing,
        (k % 3 <> 0 AND k % 4 <> 0)::INT::DOUBLE AS retrieval_source_agreement, {_r('CASE WHEN k % 3 <> 0 THEN 1.0::DOUBLE / (k % 5 + 1) ELSE 0 END')} AS reciprocal_lexical_rank, {_r('CASE WHEN k % 4 <> 0 THEN 1.0::DOUBLE / (k % 7 + 1) ELSE 0 END')} AS reciprocal_dense_rank
        FROM j JOIN tf USING (google_id, amazon_id, step) LEFT JOIN mk ON a = m1 AND b = m2""",
    "duplicate_signatures": f"""WITH {SHOP}, h AS (SELECT *, printf('%a', price) AS a FROM pl), x AS (SELECT *, CASE WHEN price IS NULL THEN '<missing-price>' ELSE '0x1.' || rpad(regexp_extract(a, '^0x1\\.?([0-9a-f]*)p', 1), 13, '0') || regexp_extract(a, 'p.*$') END AS number FROM h)
        SELECT google_id, 'duplicate_' || substr(sha256(to_json([{_norm('title')}, {_norm('maker')}, {_norm('text')}, number])::VARCHAR), 1, 16) AS duplicate_group_id FROM x""",
    "raw_files": f"""WITH {SHOP} SELECT amazon_id AS product_id, {_clean("'\"' || title || '\", x'")} AS title, maker AS manufacturer, text AS description, CASE WHEN ordinal % 3 < 2 THEN round(price, 2) END AS price, 'amazon' AS source FROM pc""",
    "manufacturer_fuzzy": f"WITH p AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part) SELECT a AS p_name, b AS kind, {_r(f'2.0::DOUBLE * {_lcs} / (length(a) + length(b))')} AS similarity FROM p",
    "title_fuzzy": f"""WITH p AS (SELECT DISTINCT p_name, lower(p_type) || ' ' || string_split(p_name, ' ')[-1] AS other FROM part), s AS (SELECT *, string_split(p_name, ' ') AS x, string_split(other, ' ') AS y FROM p),
        t AS (SELECT p_name, other, array_to_string(list_sort(list_distinct(list_intersect(x, y))), ' ') AS i, array_to_string(list_sort(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))), ' ') AS a, array_to_string(list_sort(list_distinct(list_filter(y, lambda w: NOT list_contains(x, w)))), ' ') AS b FROM s),
        u AS (SELECT *, length(i) AS s, (length(i) > 0)::INT AS g, length(a) AS la, length(b) AS lb, {_lcs} AS common FROM t)
        SELECT p_name, other, round(CASE WHEN s > 0 AND (la = 0 OR lb = 0) THEN 1.0::DOUBLE ELSE greatest(1 - (la + lb - 2 * common)::DOUBLE / (2 * (s + g) + la + lb),
          CASE WHEN s > 0 THEN 1 - (g + la)::DOUBLE / (2 * s + g + la) ELSE 0 END, CASE WHEN s > 0 THEN 1 - (g + lb)::DOUBLE / (2 * s + g + lb) ELSE 0 END) END, 6) AS similarity FROM u""",
    "top_candidate": f"{POOL} SELECT google_id, amazon_id, round(rrf, 6) AS rrf_score FROM pool WHERE rrf_rank = 1",
    "top_margin": f"{POOL} SELECT google_id, amazon_id, {_r('rrf - n')} AS top1_top2_margin FROM (SELECT *, lead(rrf, 1, 0) OVER (PARTITION BY google_id ORDER BY rrf_rank) AS n FROM pool) WHERE rrf_rank = 1",
    "ranking_metrics": f"""{POOL}, {_some}, {GOLD_RANKS} SELECT count(*) AS gold_listings, {_found} AS retrieved_listings, {_hits} AS hits, {_r(_rate(_hits, 'count(*)'))} AS overall_hit_at_1, {_r(_rate(_hits, _found))} AS conditional_hit_at_1,
        {_r(_rate('sum(coalesce(1.0::DOUBLE / best, 0))', 'count(*)'))} AS mrr, count(*) - {_found} AS retrieval_misses, {_found} - {_hits} AS reranking_misses FROM gr""",
    "score_baselines": f"""{POOL}, {_some}, n AS (SELECT count(DISTINCT google_id) AS n FROM sgold), st AS (SELECT google_id, amazon_id, unnest(['lexical_score', 'dense_score', 'rrf_score']) AS baseline, unnest([coalesce(lexical_score, 0), coalesce(dense_score, 0), rrf]) AS x FROM part_pool WHERE google_id::BIGINT % 500 <> 300),
        rk AS (SELECT *, row_number() OVER (PARTITION BY baseline, google_id ORDER BY x DESC, amazon_id) AS r FROM st), b AS (SELECT baseline, google_id, min(r) AS best FROM rk SEMI JOIN sgold USING (google_id, amazon_id) GROUP BY ALL),
        a AS (SELECT * FROM (VALUES ('lexical_score'), ('dense_score'), ('rrf_score')) z(baseline) LEFT JOIN b USING (baseline), n)
        SELECT baseline, {_r(_rate(_hits, 'any_value(n)'))} AS overall_hit_at_1, {_r(_rate(_hits, _found))} AS conditional_hit_at_1, {_r(_rate('coalesce(sum(1.0::DOUBLE / best), 0)', 'any_value(n)'))} AS mrr FROM a GROUP BY baseline""",
    "listing_predictions": f"""{POOL}, t AS (SELECT p.google_id, p.amazon_id, rrf, 'g' || label AS duplicate_group_id, p.google_id IN (SELECT google_id FROM vgold) AS has_gold_listing,
        EXISTS (SELECT 1 FROM vgold g WHERE g.google_id = p.google_id AND g.amazon_id = p.amazon_id) AS is_gold_pair, p.google_id IN (SELECT google_id FROM pool SEMI JOIN vgold USING (google_id, amazon_id)) AS gold_retrieved FROM pool p JOIN q USING (google_id) WHERE rrf_rank = 1),
        d AS (SELECT *, CASE WHEN rrf >= 0.032::DOUBLE THEN 'auto_match' WHEN rrf <= 0.017::DOUBLE THEN 'auto_no_match' ELSE 'manual_review' END AS action FROM t)
        SELECT google_id, amazon_id, duplicate_group_id, has_gold_listing, is_gold_pair, gold_retrieved, CASE WHEN NOT has_gold_listing THEN 'assumed_no_match' WHEN NOT gold_retrieved THEN 'retrieval_miss' WHEN NOT is_gold_pair THEN 'reranking_miss' ELSE 'top_gold_match' END AS ranking_outcome,
        action, CASE action WHEN 'auto_match' THEN is_gold_pair WHEN 'auto_no_match' THEN NOT has_gold_listing END AS action_correct FROM d""",
    "policy_actions": f"{DECIDED} SELECT doc_id, score, action, action_correct FROM decided",
    "ranking_outcome": f"{DECIDED} SELECT doc_id, ranking_outcome FROM decided",
    "action_statistics": f"""{DECIDED}, kinds AS (SELECT unnest(['auto_match', 'auto_no_match', 'manual_review']) AS kind), r AS (SELECT kind, group_id, action = kind AS picked, CASE kind WHEN 'auto_match' THEN is_gold_pair WHEN 'auto_no_match' THEN NOT has_gold_listing ELSE true END AS good FROM decided, kinds),
        l AS (SELECT kind, count(*) FILTER (WHERE picked) AS n, CASE WHEN kind <> 'manual_review' THEN count(*) FILTER (WHERE picked AND good) END AS k, count(*) AS t FROM r GROUP BY kind),
        g AS (SELECT kind, count(*) FILTER (WHERE p) AS gn, CASE WHEN kind <> 'manual_review' THEN count(*) FILTER (WHERE p AND c) END AS gk, count(*) AS gt FROM (SELECT kind, group_id, bool_or(picked) AS p, bool_and(good) AS c FROM r GROUP BY ALL) GROUP BY kind)
        SELECT kind AS action, {_stats('n', 'k', 't', 'listing', True)}, {_stats('gn', 'gk', 'gt', 'group', True)} FROM l JOIN g USING (kind)""",
    "group_evidence": f"{DECIDED}, g AS (SELECT bool_or(score <= 0.2::DOUBLE) AS s, bool_and(NOT has_gold_listing) AS c FROM decided GROUP BY group_id), a AS (SELECT count(*) FILTER (WHERE s) AS n, count(*) FILTER (WHERE s AND c) AS k, count(*) AS t FROM g) SELECT {_stats('n', 'k', 't', 'group')} FROM a",
    "wilson_interval": f"WITH a AS (SELECT l_suppkey, count(*) AS support, count(*) FILTER (WHERE l_returnflag = 'R') AS correct FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, support, correct, {_wilson('correct', 'support', '-')} AS low, {_wilson('correct', 'support', '+')} AS high FROM a",
    "threshold_grid": "SELECT round(i * 0.03::DOUBLE, 12) AS threshold FROM range(34) r(i) UNION SELECT 1.0::DOUBLE",
    "threshold_diagnostics": f"{DIAGNOSTICS} SELECT * FROM diagnostics",
    "threshold_selection": f"""{DIAGNOSTICS}, f AS (SELECT * FROM diagnostics WHERE feasible),
        p AS (SELECT a.threshold AS n, b.threshold AS m FROM f a JOIN f b ON a.action = 'auto_no_match' AND b.action = 'auto_match' AND a.threshold < b.threshold ORDER BY round(a.group_coverage + b.group_coverage, 6) DESC, a.threshold, b.threshold DESC LIMIT 1),
        s AS (SELECT action, threshold FROM f ORDER BY group_coverage DESC, group_empirical_precision DESC, action = 'auto_no_match' DESC, CASE action WHEN 'auto_no_match' THEN -threshold ELSE threshold END DESC LIMIT 1)
        SELECT coalesce((SELECT n FROM p), (SELECT threshold FROM s WHERE action = 'auto_no_match' AND NOT EXISTS (SELECT 1 FROM p))) AS no_match_threshold, coalesce((SELECT m FROM p), (SELECT threshold FROM s WHERE action = 'auto_match' AND NOT EXISTS (SELECT 1 FROM p))) AS match_threshold""",
    "selected_evidence": f"""{DIAGNOSTICS}, f AS (SELECT * FROM diagnostics WHERE feasible),
        p AS (SELECT a.threshold AS n, b.threshold AS m FROM f a JOIN f b ON a.action = 'auto_no_match' AND b.action = 'auto_match' AND a.threshold < b.threshold ORDER BY round(a.group_coverage + b.group_coverage, 6) DESC, a.threshold, b.threshold DESC LIMIT 1),
        s AS (SELECT action, threshold FROM f ORDER BY group_coverage DESC, group_empirical_precision DESC, action = 'auto_no_match' DESC, CASE action WHEN 'auto_no_match' THEN -threshold ELSE threshold END DESC LIMIT 1),
        plan AS (SELECT true AS chosen, 'auto_no_match' AS action, coalesce((SELECT n FROM p), (SELECT threshold FROM s WHERE action = 'auto_no_match' AND NOT EXISTS (SELECT 1 FROM p))) AS t
          UNION ALL SELECT true, 'auto_match', coalesce((SELECT m FROM p), (SELECT threshold FROM s WHERE action = 'auto_match' AND NOT EXISTS (SELECT 1 FROM p))) UNION ALL SELECT false, 'auto_no_match', 0.2::DOUBLE UNION ALL SELECT false, 'auto_match', NULL)
        SELECT chosen, plan.action, plan.action IN (SELECT action FROM f) AS feasible, t IS NOT NULL AS enabled, t AS threshold, {_evidence} FROM plan LEFT JOIN diagnostics d ON d.action = plan.action AND d.threshold = t""",
    "listing_policy_report": f"{DECIDED} {_report('decided')}",
    "sensitivity_report": f"{DECIDED}, {LISTINGS}, {CATALOG}, {GOLD}, {_collisions} {_report('decided ANTI JOIN hit USING (doc_id)')}",
    "no_match_detection": f"""{DECIDED}, s AS (SELECT 1 - score AS x, count(*) AS n, count(*) FILTER (WHERE NOT has_gold_listing) AS p FROM decided GROUP BY x), w AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen FROM s WINDOW o AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING))
        SELECT (SELECT {_r('sum(p * (tp::DOUBLE / seen)) / sum(p)')} FROM w) AS average_precision, {_r("count(*) FILTER (WHERE action = 'auto_no_match' AND NOT has_gold_listing)::DOUBLE / nullif(count(*) FILTER (WHERE action = 'auto_no_match'), 0)")} AS precision,
        {_r(_rate("count(*) FILTER (WHERE action = 'auto_no_match' AND NOT has_gold_listing)", "count(*) FILTER (WHERE NOT has_gold_listing)"))} AS recall FROM decided""",
    "title_collision": f"WITH {LISTINGS}, {CATALOG}, {GOLD}, {_collisions} SELECT google_id, signature FROM hit",
    "error_examples": f"""{DECIDED}, x AS (SELECT unnest(['false_automatic_match', 'false_automatic_no_match', 'reviewed_top_gold_match', 'retrieval_miss', 'reranking_miss']) AS error_type,
        unnest([action = 'auto_match' AND NOT is_gold_pair, action = 'auto_no_match' AND has_gold_listing, action = 'manual_review' AND is_gold_pair, ranking_outcome = 'retrieval_miss', ranking_outcome = 'reranking_miss']) AS hit, doc_id, action, ranking_outcome FROM decided)
        SELECT error_type, doc_id, action, ranking_outcome FROM x WHERE hit QUALIFY row_number() OVER (PARTITION BY error_type ORDER BY doc_id) <= 10""",
    "pair_error_examples": f"""WITH {SCORED} (SELECT 'pair_false_positive_at_0_5' AS error_type, doc_id, score FROM scored WHERE label = 0 AND score >= 0.5 ORDER BY score DESC, doc_id LIMIT 10)
        UNION ALL (SELECT 'pair_false_negative_at_0_5', doc_id, score FROM scored WHERE label = 1 AND score < 0.5 ORDER BY score, doc_id LIMIT 10)""",
    "average_precision": f"{CURVE} SELECT {_r('sum(p * (tp::DOUBLE / seen)) / sum(p)')} AS average_precision FROM curve",
    "roc_auc": f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored) SELECT {_r('(sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))')} AS roc_auc FROM r",
    "brier": f"WITH {SCORED} SELECT count(*) AS n, sum(label)::BIGINT AS positives, {_r('avg(label)')} AS observed_rate, {_r('avg(score)')} AS mean_score, {_r('avg((score - label) ** 2)')} AS brier FROM scored",
    "pr_curve": f"{CURVE} SELECT {_r('score')} AS score, {_r('tp::DOUBLE / seen')} AS precision, {_r('tp::DOUBLE / (SELECT sum(label) FROM scored)')} AS recall FROM curve",
    "reliability_bins": f"WITH {SCORED} SELECT len(list_filter([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda e: e < score))::INT AS bin, count(*) AS n, {_r('avg(score)')} AS mean_score, {_r('avg(label)')} AS positive_rate FROM scored GROUP BY bin",
    "pair_metrics": f"""WITH {SCORED}, a AS (SELECT *, count(*) FILTER (WHERE score >= 0.5 AND label = 1) OVER () AS hit, count(*) FILTER (WHERE score >= 0.5) OVER () AS said FROM scored)
        SELECT count(*) AS n, sum(label)::BIGINT AS positives, 0.5::DOUBLE AS threshold, {_r(_rate('any_value(hit)', 'any_value(said)'))} AS precision, {_r(_rate('any_value(hit)', 'sum(label)'))} AS recall, {_r(_rate('2 * any_value(hit)', 'any_value(said) + sum(label)'))} AS f1, {_r('avg((score - label) ** 2)')} AS brier FROM a""",
    "latency_summary": f"SELECT {_r('sum(value)')} AS total_ms, {_r('avg(value)')} AS mean_ms, {_r('quantile_cont(value, 0.95)')} AS p95_ms FROM events",
}
