"""DuckDB SQL that must give the same rows as the registered queries."""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------ expressions

# Fixed value: the whitespace class of the loose normaliser, spelled out.
WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strict(c):
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def loose(c):
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{WS}+', ' ', 'g'))"


def tokens(c):
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def words(c):
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+|[^\t\n\x0b\f\r \p{{L}}\p{{N}}]')"


def grams(c):
    t = f"replace({c}, ' ', '')"
    return (
        f"CASE WHEN length({t}) < 3 THEN [{t}] ELSE "
        f"list_distinct(list_concat(regexp_extract_all({t}, '...'), regexp_extract_all(substr({t}, 2), '...'), "
        f"regexp_extract_all(substr({t}, 3), '...'))) END"
    )


def hashed(*parts, seed=0):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"


def lcs(a, b):
    """Bit-parallel; a holds at most 60 characters."""
    full = f"((1::BIGINT << length({a})::INT) - 1)"
    mask = (
        f"list_sum(list_transform(range(1, length({a}) + 1), "
        f"lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END))::BIGINT"
    )
    # the mask is looked up twice per step, so it is computed once per character first
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    step = f"(((s + (s & m)) | (s - (s & m))) & {full})"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda s, m: {step}, {full})))"


def ratio(a, b):
    return (
        f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 "
        f"ELSE 2.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END"
    )


def r6(x):
    return f"round({x}, 6)"


def jaccard(a, b):
    inter = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) - {inter} > 0 THEN {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) ELSE 0.0 END"


def guarded(n, d):
    return f"CASE WHEN {d} > 0 THEN ({n})::DOUBLE / {d} ELSE 0.0 END"


# ----------------------------------------------------------------- tables

C = {}
C["parts"] = "SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS query FROM part"
C["pool"] = "SELECT DISTINCT query FROM parts"
C["features"] = """
SELECT query, count(DISTINCT l_orderkey)::BIGINT AS orders,
  sum(CAST(l_quantity AS BIGINT))::BIGINT AS volume,
  sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END)::BIGINT AS catalog_clicks,
  count(*)::BIGINT AS catalog_views
FROM lineitem JOIN parts ON l_partkey = p_partkey WHERE p_partkey % 10 <> 3 GROUP BY query"""
C["train"] = f"""
SELECT {hashed('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey', "strftime(l_shipdate, '%Y-%m-%d')")} AS row_id,
  substr(query, 1, CAST(2 + l_orderkey % 9 AS INT)) AS prefix, query
FROM lineitem JOIN parts ON l_partkey = p_partkey"""
C["prefixes"] = """
SELECT DISTINCT CASE p_partkey % 60 WHEN 0 THEN substr(query, 1, 2) WHEN 20 THEN substr(query, 1, 8)
  ELSE concat(substr(query, 1, 1), substr(query, 3, 8)) END AS prefix
FROM parts WHERE p_partkey % 20 = 0"""
C["products"] = """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS image_url FROM pages"""
C["products_ok"] = """
SELECT * FROM products WHERE title IS NOT NULL AND image_url IS NOT NULL AND length(title) > 10"""
C["counts"] = """
SELECT query, coalesce(orders, 0) AS orders, coalesce(volume, 0) AS volume,
  coalesce(catalog_clicks, 0) AS catalog_clicks, coalesce(catalog_views, 0) AS catalog_views
FROM pool LEFT JOIN features USING (query)"""
C["generated"] = r"""
SELECT concat('Prefix: ', substr(query, 1, 3), chr(10), 'Completions: ', query,
  CASE WHEN length(query) % 2 = 0 THEN ' zz' ELSE '' END) AS text FROM pool"""
C["completions"] = """
SELECT trim(split_part(text, 'Completions:', -1)) AS completion FROM generated WHERE contains(text, 'Completions:')"""
C["freq"] = f"""
SELECT {loose('prefix')} AS prefix, {loose('query')} AS query, count(*)::BIGINT AS freq FROM train GROUP BY 1, 2"""
C["clean_counts"] = f"""
SELECT {loose('query')} AS query, max(orders) AS orders, max(volume) AS volume,
  max(catalog_clicks) AS catalog_clicks, max(catalog_views) AS catalog_views FROM features GROUP BY 1"""
C["clean_pop"] = f"""
SELECT query, (coalesce(orders, 0) * 10 + coalesce(volume, 0) * 5 + coalesce(catalog_clicks, 0) * 2
  + coalesce(catalog_views, 0))::BIGINT AS popularity
FROM (SELECT DISTINCT {loose('query')} AS query FROM pool) LEFT JOIN clean_counts USING (query)"""
C["clean_pool"] = f"""
SELECT query, popularity, coalesce(CASE WHEN m > 0 THEN popularity::DOUBLE / m END, 0.0) AS pop
FROM clean_pop, (SELECT max(popularity) AS m FROM clean_pop)"""
C["prefix_hits"] = f"""
SELECT prefix, query, row_number() OVER (PARTITION BY prefix ORDER BY query)::INT AS rk
FROM (SELECT prefix, query FROM prefixes JOIN pool ON starts_with({strict('query')}, {strict('prefix')}))"""
C["train_hits"] = f"""
SELECT prefix, query, row_number() OVER (PARTITION BY prefix ORDER BY query)::INT AS rk
FROM (SELECT prefix, query FROM (SELECT DISTINCT prefix FROM train) JOIN pool ON starts_with({strict('query')}, {strict('prefix')}))"""

# lexical
C["pg"] = f"SELECT prefix, np, {grams('np')} AS g FROM (SELECT prefix, {strict('prefix')} AS np FROM asked)"
C["qg"] = f"SELECT query, nq, {grams('nq')} AS g FROM (SELECT query, {strict('query')} AS nq FROM pool)"
C["gram_pairs"] = """
SELECT prefix, query, n::DOUBLE / (np_ + nq_ - n) AS jac FROM (
  SELECT prefix, query, count(*) AS n, any_value(np_) AS np_, any_value(nq_) AS nq_
  FROM (SELECT prefix, len(g) AS np_, unnest(g) AS gram FROM pg)
  JOIN (SELECT query, len(g) AS nq_, unnest(g) AS gram FROM qg) USING (gram) GROUP BY prefix, query)"""
C["trigram"] = """
SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk
FROM (SELECT prefix, query, round(jac, 6) AS score FROM gram_pairs)"""
C["docs"] = f"SELECT query, {tokens(strict('query'))} AS ts FROM pool"
C["tf"] = """
SELECT query, token, len(ts) AS dl, count(*) AS tf FROM (SELECT query, ts, unnest(ts) AS token FROM docs) GROUP BY query, token, ts"""
C["corpus"] = "SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM docs"
C["token_raw"] = """
SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf
FROM (SELECT token, count(*) AS df FROM tf GROUP BY token), corpus"""
C["token_idf"] = """
SELECT token, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM token_raw) ELSE raw_idf END AS idf
FROM token_raw"""
C["bm25"] = f"""
SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk FROM (
  SELECT prefix, query, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM (SELECT prefix, unnest({tokens(strict('prefix'))}) AS token FROM asked)
  JOIN tf USING (token) JOIN token_idf USING (token), corpus GROUP BY prefix, query)"""
C["lcs_ratio"] = f"""
SELECT prefix, query, rk, score, {ratio('np', 'nq')} AS raw FROM
  (SELECT prefix, query, rk, score, {strict('prefix')} AS np, {strict('query')} AS nq FROM trigram WHERE rk <= 30)"""


def fuzzy_cte(threshold):
    return f"""
SELECT prefix, query, score, rk FROM (
  SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk
  FROM (SELECT prefix, query, round(raw, 6) AS score FROM lcs_ratio WHERE raw >= {threshold} AND length(prefix) >= 3))
WHERE rk <= 10"""


C["fuzzy"] = fuzzy_cte(0.7)

# hashed trigram vectors in long form
C["texts"] = f"""
SELECT DISTINCT txt FROM (SELECT {strict('prefix')} AS txt FROM asked UNION ALL SELECT {strict('query')} FROM pool)"""
C["slots"] = """
SELECT txt, slot, count(*)::DOUBLE AS c FROM (
  SELECT txt, (unicode(substr(pad, i::INT, 1))::BIGINT * 961 + unicode(substr(pad, i::INT + 1, 1)) * 31
    + unicode(substr(pad, i::INT + 2, 1))) % 64 AS slot
  FROM (SELECT txt, ' ' || txt || ' ' AS pad FROM texts), unnest(range(1, length(pad) - 1)) AS u(i)) GROUP BY txt, slot"""
C["unit"] = "SELECT txt, slot, c / sqrt(sum(c * c) OVER (PARTITION BY txt)) AS v FROM slots"
C["dots"] = f"""
SELECT prefix, query, coalesce(d, 0.0) AS d
FROM (SELECT prefix, {strict('prefix')} AS np FROM asked) CROSS JOIN (SELECT query, {strict('query')} AS nq FROM pool)
LEFT JOIN (SELECT a.txt AS np, b.txt AS nq, sum(a.v * b.v) AS d FROM unit a JOIN unit b USING (slot)
  WHERE a.txt IN (SELECT {strict('prefix')} FROM asked) GROUP BY 1, 2) USING (np, nq)"""
C["semantic"] = """
SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk
FROM (SELECT prefix, query, round(d, 6) AS score FROM dots)"""

# candidates and re-ranking
C["cands"] = """
SELECT prefix, query, coalesce(max(sem), 0.0) AS sem, coalesce(max(bm25), 0.0) AS bm25,
  coalesce(max(ngram), 0.0) AS ngram, coalesce(max(fuzzy), 0.0) AS fuzzy FROM (
  SELECT prefix, query, score AS sem, NULL::DOUBLE AS bm25, NULL::DOUBLE AS ngram, NULL::DOUBLE AS fuzzy FROM semantic WHERE rk <= 20
  UNION ALL SELECT prefix, query, NULL, score, NULL, NULL FROM bm25 WHERE rk <= 20
  UNION ALL SELECT prefix, query, NULL, NULL, score, NULL FROM trigram WHERE rk <= 10
  UNION ALL SELECT prefix, query, NULL, NULL, NULL, score FROM fuzzy)
GROUP BY prefix, query"""
C["cands_nofuzzy"] = C["cands"].replace("SELECT prefix, query, NULL, NULL, NULL, score FROM fuzzy", "SELECT prefix, query, NULL, NULL, NULL, NULL FROM trigram WHERE rk <= 10")


def pruned(n):
    return f"""
SELECT prefix, query, sem, bm25, ngram, fuzzy FROM (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY greatest(sem, bm25, ngram, fuzzy) DESC, query) AS n FROM cands)
WHERE n <= {n}"""


C["kept"] = pruned(50)
C["norm_pairs"] = f"SELECT DISTINCT {strict('prefix')} AS p, {strict('query')} AS q FROM kept"
# every pair as pattern and text; equal lengths in both directions
PARTIAL = {
    "sides": """
SELECT p, q, p AS a, q AS b FROM norm_pairs WHERE length(p) <= length(q) AND length(p) > 0
UNION ALL SELECT p, q, q, p FROM norm_pairs WHERE length(q) <= length(p) AND length(q) > 0""",
    "windows": """
SELECT DISTINCT a, b, substr(b, greatest(s, 1)::INT, (least(s + length(a) - 1, length(b)) - greatest(s, 1) + 1)::INT) AS w
FROM sides, unnest(range(2 - length(a), length(b) + 1)) AS u(s)""",
    "window_scores": f"SELECT a, w, 2.0::DOUBLE * {lcs('a', 'w')} / (length(a) + length(w)) AS s FROM (SELECT DISTINCT a, w FROM windows)",
    "best_windows": "SELECT a, b, max(s) AS s FROM windows JOIN window_scores USING (a, w) GROUP BY a, b",
    "partials": """
SELECT p, q, max(s) AS partial FROM (
  SELECT p, q, s FROM sides JOIN best_windows USING (a, b)
  UNION ALL SELECT p, q, CASE WHEN p = q THEN 1.0 ELSE 0.0 END FROM norm_pairs WHERE p = '' OR q = '') GROUP BY p, q""",
}
C.update(PARTIAL)
C["pair_scores"] = f"SELECT p, q, partial, {ratio('p', 'q')} AS ratio FROM partials"
C["described"] = f"""
SELECT k.*, p, q, partial, ratio, coalesce(orders, 0) AS orders, coalesce(volume, 0) AS volume,
  coalesce(catalog_clicks, 0) AS catalog_clicks, coalesce(catalog_views, 0) AS catalog_views
FROM (SELECT *, {strict('prefix')} AS p, {strict('query')} AS q FROM kept) k JOIN pair_scores USING (p, q)
LEFT JOIN features USING (query)"""

# The two weightings, in the order of the terms below.
WEIGHTS = {
    "a": (50, 20, 30, 25, 20, 15, 12, 10, 15, 15, 5, 10, 0, 20, 0),
    "b": (100, 50, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, -0.5),
}


def reranked(profile):
    lq, lp = "length(q)", "length(prefix)"
    terms = [
        "(p = q)::INT", "starts_with(q, p)::INT", "sem", "partial", "CASE WHEN bm25 > 0 THEN bm25 / 10 ELSE 0 END",
        "ln(1 + orders) / 10", "ratio", "ngram", "ln(1 + volume) / 15", "ln(1 + catalog_clicks) / 12",
        "contains(q, p)::INT", "ln(1 + catalog_views) / 12",
        f"CASE WHEN greatest({lp}, {lq}) > 0 THEN least({lp}, {lq})::DOUBLE / greatest({lp}, {lq}) ELSE 0 END",
        "fuzzy", f"abs({lq} - {lp})",
    ]
    total = " + ".join(f"{float(w)}::DOUBLE * ({t})" for w, t in zip(WEIGHTS[profile], terms))
    return f"""
SELECT prefix, query, score, rk FROM (
  SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk
  FROM (SELECT prefix, query, round({total}, 6) AS score FROM described)) WHERE rk <= 10"""


C["popular"] = """
SELECT query, (orders * 4 + volume * 3 + catalog_clicks * 2 + catalog_views)::BIGINT AS popularity
FROM counts ORDER BY popularity DESC, query LIMIT 1000"""
C["all_popular"] = "SELECT query, (orders * 4 + volume * 3 + catalog_clicks * 2 + catalog_views)::BIGINT AS popularity FROM counts"
C["short"] = f"""
SELECT prefix, query, popularity::DOUBLE AS score, rk FROM (
  SELECT prefix, query, popularity, row_number() OVER (PARTITION BY prefix ORDER BY popularity DESC, query)::INT AS rk
  FROM (SELECT DISTINCT prefix FROM asked WHERE length(prefix) <= 2) JOIN all_popular
    ON starts_with({strict('query')}, {strict('prefix')})) WHERE rk <= 10"""
C["completed"] = f"""
SELECT * FROM short
UNION ALL SELECT * FROM ({reranked('a')}) WHERE prefix NOT IN (SELECT prefix FROM short)"""

FEATURE_SQL = {
    "semantic_cosine": "sem", "bm25_score": "bm25", "ngram_score": "ngram", "fuzzy_score": "fuzzy",
    "edit_distance_ratio": "ratio", "partial_ratio": "partial", "token_sort_ratio": "ts_ratio",
    "exact_prefix_match": "starts_with(q, p)", "prefix_in_query": "contains(q, p)",
    "token_jaccard": jaccard("pd", "qd"), "token_overlap_count": "len(list_intersect(pd, qd))",
    "token_containment": guarded("len(list_intersect(pd, qd))", "len(pd)"),
    "trigram_jaccard": jaccard("pgr", "qgr"), "trigram_overlap_count": "len(list_intersect(pgr, qgr))",
    "prefix_length": "length(p)", "query_length": "length(q)", "length_diff": "abs(length(q) - length(p))",
    "length_ratio": guarded("length(p)", "length(q)"),
    "prefix_token_count": "len(pt)", "query_token_count": "len(qt)", "token_count_diff": "abs(len(qt) - len(pt))",
    "prefix_position": "CASE WHEN length(p) > 0 AND length(q) > 0 AND contains(q, p) THEN (instr(q, p) - 1)::DOUBLE / length(q) ELSE 1.0 END",
    "log_orders": "ln(1 + orders)", "log_volume": "ln(1 + volume)",
    "log_clicks": "ln(1 + catalog_clicks)", "log_views": "ln(1 + catalog_views)",
    "orders": "orders", "volume": "volume", "clicks": "catalog_clicks", "views": "catalog_views",
    "click_through_rate": guarded("catalog_clicks", "volume"), "order_rate": guarded("orders", "volume"),
    "views_per_click": guarded("catalog_views", "catalog_clicks"),
    "popularity_score": "0.4 * ln(1 + orders) + 0.3 * ln(1 + volume) + 0.2 * ln(1 + catalog_clicks) + 0.1 * ln(1 + catalog_views)",
}
C["token_sides"] = f"""
SELECT *, list_distinct(pt) AS pd, list_distinct(qt) AS qd,
  array_to_string(list_sort(pt), ' ') AS ps, array_to_string(list_sort(qt), ' ') AS qs
FROM (SELECT *, {tokens('p')} AS pt, {tokens('q')} AS qt, {grams('p')} AS pgr, {grams('q')} AS qgr FROM described)"""
C["pair_feature_rows"] = (
    "SELECT prefix, query, "
    + ", ".join(f"round(({x})::DOUBLE, 6) AS {n}" for n, x in FEATURE_SQL.items())
    + f" FROM (SELECT *, {ratio('ps', 'qs')} AS ts_ratio FROM token_sides)"
)

# hybrid
C["doc_terms"] = f"SELECT query, list_distinct({words('query')}) AS terms FROM pool"
C["sparse"] = """
SELECT query, terms, 1.0::DOUBLE / (1.6 * (1 - 0.75 + 0.75 * len(terms) / (SELECT avg(len(terms)) FROM doc_terms)) + 1) AS w
FROM doc_terms"""
C["sparse_long"] = "SELECT query, unnest(terms) AS term, w FROM sparse"
C["prefix_terms"] = f"""
SELECT prefix, term, ln(((SELECT count(*) FROM pool) + 1) / (coalesce(df, 0) + 0.5)) AS idf
FROM (SELECT prefix, unnest(list_distinct({words('prefix')})) AS term FROM asked)
LEFT JOIN (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM doc_terms) GROUP BY term) USING (term)"""
C["prefix_weights"] = """
SELECT prefix, term, share / (sqrt(sum(share * share) OVER (PARTITION BY prefix)) + 1e-10) * 0.4 AS w FROM (
  SELECT prefix, term, idf / sum(idf) OVER (PARTITION BY prefix) AS share FROM prefix_terms)"""
C["sparse_dots"] = """
SELECT prefix, query, sum(a.w * b.w) AS s FROM prefix_weights a JOIN sparse_long b USING (term) GROUP BY prefix, query"""
C["max_norm"] = """
SELECT query, CASE WHEN mo > 0 THEN orders::DOUBLE / mo ELSE 0 END * 0.4 + CASE WHEN mc > 0 THEN catalog_clicks::DOUBLE / mc ELSE 0 END * 0.3
  + CASE WHEN mv > 0 THEN volume::DOUBLE / mv ELSE 0 END * 0.2 + CASE WHEN mw > 0 THEN catalog_views::DOUBLE / mw ELSE 0 END * 0.1 AS pop
FROM counts, (SELECT max(orders) AS mo, max(catalog_clicks) AS mc, max(volume) AS mv, max(catalog_views) AS mw FROM counts)"""
C["parts_of_score"] = """
SELECT prefix, query, d / (1 + 1e-10) * 0.6 AS dense, coalesce(s, 0.0) AS s, pop * 0.15 AS bias
FROM dots LEFT JOIN sparse_dots USING (prefix, query) JOIN max_norm USING (query)"""
C["full_path"] = """
SELECT prefix, query, round(dense6 + s + bias, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY dense6 DESC, query) AS n
  FROM (SELECT *, round(dense, 6) AS dense6 FROM parts_of_score)) WHERE n <= 200"""
C["block_path"] = """
SELECT prefix, query, round(dense + s + bias, 6) AS score FROM parts_of_score
WHERE length(prefix) >= 3 AND substr(lower(query), 1, 3) = substr(lower(prefix), 1, 3)"""
C["mixed_path"] = """
SELECT * FROM block_path UNION ALL SELECT * FROM full_path WHERE prefix NOT IN (SELECT prefix FROM block_path)"""


def first_100(path):
    return f"""
SELECT prefix, query, score, rk FROM (
  SELECT prefix, query, score, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, query)::INT AS rk FROM {path})
WHERE rk <= 100"""


# cascade
C["ckeys"] = f"SELECT DISTINCT {loose('prefix')} AS key FROM prefixes"
C["c12"] = """
SELECT key, query, sum(score) AS score, min(tier) AS tier FROM (
  SELECT key, query, 100.0::DOUBLE * freq AS score, 1 AS tier FROM ckeys JOIN freq ON key = prefix
  UNION ALL SELECT key, query, 50.0::DOUBLE + 20.0::DOUBLE * pop, 2 FROM ckeys JOIN clean_pool ON key <> '' AND starts_with(query, key)) GROUP BY key, query"""
C["n12"] = "SELECT key, count(query) AS n FROM ckeys LEFT JOIN c12 USING (key) GROUP BY key"
C["c3all"] = """
SELECT key, query, max(lvl) AS lvl, max(25.0::DOUBLE * lvl / length(key) + 10.0::DOUBLE * pop) AS score FROM (
  SELECT key, query, pop, lvl FROM ckeys, unnest(range(2, least(length(key), 6) + 1)) AS u(lvl)
  JOIN clean_pool ON starts_with(query, substr(key, 1, lvl::INT)))
WHERE (key, query) NOT IN (SELECT (key, query) FROM c12) GROUP BY key, query"""
C["level_before"] = """
SELECT a.key, a.lvl, n + coalesce((SELECT count(*) FROM c3all b WHERE b.key = a.key AND b.lvl > a.lvl), 0) AS before
FROM (SELECT DISTINCT key, lvl FROM c3all) a JOIN n12 USING (key)"""
C["c3"] = "SELECT key, query, score, 3 AS tier FROM c3all JOIN level_before USING (key, lvl) WHERE before < 150"
C["c123"] = "SELECT key, query, score, tier FROM c12 UNION ALL SELECT key, query, score, tier FROM c3"
C["n123"] = "SELECT key, count(query) AS n FROM ckeys LEFT JOIN c123 USING (key) GROUP BY key"
C["fkeys"] = "SELECT key FROM n123 WHERE n < 150 AND length(key) >= 3"
C["fpool"] = "SELECT query, pop FROM clean_pool"
C["c4all"] = """
SELECT key, query, score FROM (
  SELECT p AS key, q AS query, score, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS n
  FROM (SELECT p, q, round(100 * partial, 6) AS score FROM partials)) WHERE n <= 50 AND score >= 60"""
C["c4"] = """
SELECT key, query, 30.0::DOUBLE * score / 100.0 + 10.0::DOUBLE * pop AS score, 4 AS tier FROM c4all JOIN clean_pool USING (query)
WHERE (key, query) NOT IN (SELECT (key, query) FROM c123)"""
C["c1234"] = "SELECT * FROM c123 UNION ALL SELECT * FROM c4"
C["n1234"] = "SELECT key, count(query) AS n FROM ckeys LEFT JOIN c1234 USING (key) GROUP BY key"
C["c5"] = """
SELECT key, query, 5.0::DOUBLE * pop AS score, 5 AS tier FROM (
  SELECT key, query, pop, n, row_number() OVER (PARTITION BY key ORDER BY popularity DESC, query) AS nth
  FROM (SELECT key, n FROM n1234 WHERE n < 150) CROSS JOIN (SELECT * FROM clean_pool ORDER BY popularity DESC, query LIMIT 300)
  WHERE (key, query) NOT IN (SELECT (key, query) FROM c1234)) WHERE n + nth <= 300"""
C["cascaded"] = f"""
SELECT prefix, query, score, tier, rk FROM (
  SELECT key, query, score, tier, row_number() OVER (PARTITION BY key ORDER BY score DESC, popularity DESC, query)::INT AS rk
  FROM (SELECT key, query, round(score, 6) AS score, tier::INT AS tier, coalesce(popularity, 0) AS popularity
        FROM (SELECT * FROM c1234 UNION ALL SELECT * FROM c5) LEFT JOIN (SELECT query, popularity FROM clean_pool) USING (query)))
JOIN (SELECT DISTINCT prefix, {loose('prefix')} AS key FROM prefixes) USING (key) WHERE rk <= 150"""

ASKED = {"asked": "SELECT prefix FROM prefixes"}


def sql(body, asked=None, **override):
    """WITH all tables the body needs, in order of definition."""
    env = {**C, **ASKED, **override}
    if asked:
        env["asked"] = asked
    order, seen = [], set()

    def need(text):
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in env and name not in seen:
                seen.add(name)
                need(env[name])
                order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({env[n].strip()})" for n in order) + "\n" + body.strip()


def add(name, body, **kw):
    ORACLES[name] = sql(body, **kw)


# ----------------------------------------------------------------- queries

add("scan_tables", """
SELECT 'pool' AS table_name, count(*) AS n_rows FROM pool UNION ALL SELECT 'query_features', count(*) FROM features
UNION ALL SELECT 'train', count(*) FROM train UNION ALL SELECT 'test_prefixes', count(*) FROM prefixes""")
add("features_clean", "SELECT query, orders, CASE WHEN volume % 2 = 0 THEN volume ELSE 0 END AS volume, catalog_clicks, catalog_views FROM features")
add("feature_map", """
SELECT substr(lower(query), 1, 3) AS query, max(orders) AS orders, max(volume) AS volume,
  max(catalog_clicks) AS catalog_clicks, max(catalog_views) AS catalog_views FROM features GROUP BY 1""")


add("feature_map_last", """
SELECT key AS query, arg_max(orders, query) AS orders, arg_max(volume, query) AS volume,
  arg_max(catalog_clicks, query) AS catalog_clicks, arg_max(catalog_views, query) AS catalog_views
FROM (SELECT *, substr(lower(query), 1, 3) AS key FROM features) GROUP BY 1""")


def _summary(name, table, column):
    return (
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {table}) AS n_rows, (SELECT string_agg(v, ' / ' ORDER BY v) "
        f"FROM (SELECT DISTINCT {column} AS v FROM {table} ORDER BY v LIMIT 3)) AS sample"
    )


add("dataset_summary", " UNION ALL ".join(_summary(*x) for x in [
    ("pool", "pool", "query"), ("query_features", "features", "query"), ("train", "train", "prefix"), ("test_prefixes", "prefixes", "prefix")]))
add("index_roundtrip", "SELECT * FROM trigram WHERE rk <= 10")
add("submission_wide", "SELECT p.prefix, " + ", ".join(
    f"coalesce(max(CASE WHEN rk = {i} THEN query END), '') AS completion_{i}" for i in range(1, 11))
    + " FROM prefixes p LEFT JOIN prefix_hits h USING (prefix) GROUP BY p.prefix")
add("submission_files", """
SELECT kind, prefix, (rk - 1)::INT AS pos, query FROM prefix_hits, (SELECT unnest(['wide', 'json', 'parquet']) AS kind) WHERE rk <= 10""")
add("submission_json", """
SELECT prefix, '[' || string_agg('"' || query || '"', ',' ORDER BY rk) || ']' AS retrieved_queries
FROM prefix_hits WHERE rk <= 10 GROUP BY prefix""")
add("submission_list", "SELECT prefix, (rk - 1)::INT AS pos, query FROM prefix_hits WHERE rk <= 10")

add("normalize_strict", f"SELECT doc_id, {strict('text')} AS norm FROM documents")
add("normalize_loose", f"SELECT doc_id, {loose('text')} AS norm FROM documents")
add("clean_query", f"SELECT doc_id, trim(regexp_replace({loose('text')}, '[^a-z0-9 \\-]', '', 'g')) AS norm FROM documents")


def _token_report(expr):
    return f"SELECT doc_id, len(ts)::INT AS n_tokens, md5(array_to_string(ts, '|')) AS token_hash FROM (SELECT doc_id, {expr} AS ts FROM documents)"


add("tokenize", _token_report(tokens(strict("text"))))
add("tokenize_words", _token_report(words("text")))
add("char_trigrams", f"""
SELECT doc_id, len(ts)::INT AS n_tokens, md5(array_to_string(ts, '|')) AS token_hash FROM (
  SELECT doc_id, list_sort({grams('n')}) AS ts FROM (SELECT doc_id, {strict('text')} AS n FROM documents))""")
add("block_key", "SELECT query, substr(lower(query), 1, 3) AS block FROM pool")
add("product_clean", "SELECT page_id, title, image_url FROM products_ok")
add("prompt_corpus", """
SELECT prefix, 'Prefix: ' || prefix || chr(10) || 'Completions: ' || string_agg(query, ', ' ORDER BY n DESC, query) AS text FROM (
  SELECT prefix, query, n, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, query) AS rk
  FROM (SELECT prefix, query, count(*) AS n FROM train GROUP BY prefix, query)) WHERE rk <= 10 GROUP BY prefix""")
add("parse_completions", "SELECT completion FROM completions")
add("prefix_length_stats", f"""
SELECT count(n) AS cnt, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::INT AS min_len,
  round(quantile_cont(n::DOUBLE, 0.25), 6) AS p25, round(quantile_cont(n::DOUBLE, 0.5), 6) AS p50,
  round(quantile_cont(n::DOUBLE, 0.75), 6) AS p75, max(n)::INT AS max_len
FROM (SELECT length({loose('prefix')}) AS n FROM prefixes)""")
add("string_similarity", f"""
SELECT prefix, query, round(ratio, 6) AS ratio, round(partial, 6) AS partial_ratio, round({ratio('ps', 'qs')}, 6) AS token_sort_ratio
FROM (SELECT prefix, query, p, q, array_to_string(list_sort({tokens('p')}), ' ') AS ps, array_to_string(list_sort({tokens('q')}), ' ') AS qs
  FROM (SELECT prefix, query, {strict('prefix')} AS p, {strict('query')} AS q FROM kept)) JOIN pair_scores USING (p, q)""",
    kept="SELECT prefix, query FROM trigram WHERE rk <= 10")
add("popularity_variants", """
SELECT query, round(0.4 * ln(1 + orders) + 0.3 * ln(1 + volume) + 0.2 * ln(1 + catalog_clicks) + 0.1 * ln(1 + catalog_views), 6) AS pop_log,
  orders * 4 + volume * 3 + catalog_clicks * 2 + catalog_views AS pop_4321, round(pop, 6) AS pop_max_norm,
  round((orders * 10 + volume * 5 + catalog_clicks * 2 + catalog_views)::DOUBLE
    / (SELECT max(orders * 10 + volume * 5 + catalog_clicks * 2 + catalog_views) FROM counts), 6) AS pop_share
FROM counts JOIN max_norm USING (query)""")
add("vector_normalize", """
SELECT vec_id, (i - 1)::INT AS pos, round(embedding[i]::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-10) * 0.6, 6) AS value
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)""")

add("pool_features", "SELECT query, orders, volume, catalog_clicks, catalog_views FROM counts")
add("pool_features_clean", f"SELECT query, popularity, {r6('pop')} AS pop FROM clean_pool")
add("prefix_query_freq", "SELECT prefix, query, freq FROM freq")
add("queries_per_prefix", "SELECT prefix, count(*) AS n_queries FROM train GROUP BY prefix")
add("avg_queries_per_prefix", f"SELECT round(avg(n), 6) AS avg_queries FROM (SELECT {loose('prefix')} AS p, count(*) AS n FROM train GROUP BY 1)")
add("prefix_queries", """
SELECT prefix, page, string_agg(query, '|' ORDER BY query) AS queries, string_agg(n::VARCHAR, '|' ORDER BY query) AS freqs
FROM (SELECT *, ('0x' || substr(md5(query), 1, 15))::BIGINT % ((count(*) OVER (PARTITION BY prefix) + 9999) // 10000) AS page
      FROM (SELECT prefix, query, count(*) AS n FROM train GROUP BY prefix, query)) GROUP BY prefix, page""")
add("group_histogram", """
SELECT bin, round(lo + bin * w, 6) AS bin_start, count(*) AS cnt FROM (
  SELECT least(floor((n - lo) / w), 49)::INT AS bin, lo, w FROM (SELECT count(*) AS n FROM train GROUP BY prefix),
    (SELECT min(n)::DOUBLE AS lo, (max(n) - min(n))::DOUBLE / 50 AS w FROM (SELECT count(*) AS n FROM train GROUP BY prefix)))
GROUP BY bin, lo, w""")
add("distinct_queries", "SELECT DISTINCT query FROM train")
add("history_match", f"SELECT p.prefix, f.query, f.freq FROM prefixes p JOIN freq f ON {loose('p.prefix')} = f.prefix")
BEGINS = f"{loose('prefix')} <> '' AND starts_with(query, {loose('prefix')})"
add("edge_prefix_match", f"SELECT prefix, query, {r6('pop')} AS pop FROM prefixes JOIN clean_pool ON {BEGINS}")
add("edge_long", """
SELECT prefix, query, popularity FROM (
  SELECT DISTINCT substr(query, 1, CAST(16 + p_partkey % 10 AS INT)) AS prefix FROM parts WHERE p_partkey % 20 = 1)
JOIN clean_pool ON starts_with(query, prefix) WHERE length(prefix) > 15""")
add("popular_ties", "SELECT concat(prefix, '|', query) AS query, count(*) AS popularity FROM train GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 11000")
add("missing_prefixes", "SELECT DISTINCT prefix FROM prefixes WHERE prefix NOT IN (SELECT prefix FROM train)")


def _coverage(name, keys):
    return f"""SELECT '{name}' AS strategy, count(*) FILTER (WHERE {loose('prefix')} IN ({keys})) AS covered, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (WHERE {loose('prefix')} IN ({keys})) / count(*), 6) AS share FROM prefixes"""


add("strategy_coverage", _coverage("history", "SELECT prefix FROM freq") + " UNION ALL " + _coverage("edge", f"SELECT {loose('prefix')} FROM prefixes JOIN clean_pool ON {BEGINS}"))
add("valid_in_pool", """
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid_in_pool, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*) * 100, 6) AS valid_pct
FROM (SELECT trim(lower(completion)) IN (SELECT trim(lower(query)) FROM pool) AS ok FROM completions)""")

add("prefix_match", "SELECT prefix, query, rk FROM prefix_hits WHERE rk <= 20")
add("bm25_stats", "SELECT token, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM token_idf")
add("bm25_topk", "SELECT * FROM bm25 WHERE rk <= 20")
add("trigram_topk", "SELECT * FROM trigram WHERE rk <= 10")
add("fuzzy_topk", "SELECT * FROM fuzzy", fuzzy=fuzzy_cte(0.4))
add("fuzzy_default", "SELECT * FROM fuzzy", asked="SELECT DISTINCT concat(substr(query, 1, 1), substr(query, 3)) AS prefix FROM pool")
add("popular_queries", "SELECT * FROM popular")
add("short_prefix", "SELECT * FROM short")
add("fuzzy_partial", """
SELECT key AS prefix, query, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, query)::INT AS rk FROM c4all""",
    norm_pairs=f"SELECT p, query AS q FROM (SELECT DISTINCT {loose('prefix')} AS p FROM prefixes), fpool WHERE length(p) >= 2")

add("fuzzy_partial_work", f"""
SELECT count(DISTINCT p) AS n_prefixes, count(*) AS pairs, true AS few_compared
FROM (SELECT DISTINCT {loose('prefix')} AS p FROM prefixes), (SELECT DISTINCT query FROM clean_pool WHERE query IS NOT NULL) WHERE length(p) >= 2""")

add("embed_hashed", f"""
SELECT query, slot::INT AS slot, round(v, 6) AS value FROM (SELECT query, {strict('query')} AS txt FROM pool) JOIN unit USING (txt)""")


def _vectors(score, where, k, extra=""):
    return f"""
SELECT qid, pid, {score} AS score, rk FROM (
  SELECT qid, pid, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, pid)::INT AS rk FROM (
    SELECT q.vec_id AS qid, p.vec_id AS pid, round(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS cos
    FROM embeddings q, embeddings p {where})) WHERE rk <= {k}"""


SPLIT = "WHERE q.vec_id % 50 = 0 AND p.vec_id % 50 <> 0"
add("vector_topk", _vectors("cos", SPLIT, 20))
add("vector_topk_l2", _vectors("round(2.0 - 2.0 * cos, 6)", SPLIT, 20))
add("vector_topk_blocks", _vectors("cos", "", 5))
add("semantic_topk", "SELECT * FROM semantic WHERE rk <= 20")
# queries are words 2 to 4 of every twentieth title; products are all clean ones
C["product_texts"] = f"""
SELECT page_id, title, image_url, {strict('title')} AS txt FROM products_ok"""
C["search_texts"] = f"""
SELECT page_id AS qid, {strict("array_to_string(list_slice(string_split(title, ' '), 2, 4), ' ')")} AS txt FROM products_ok WHERE page_id % 20 = 0"""
add("product_search", """
SELECT qid, rk, title, image_url, score FROM (
  SELECT qid, page_id, title, image_url, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id)::INT AS rk FROM (
    SELECT qid, page_id, title, image_url, round(coalesce(d, 0.0), 6) AS score
    FROM search_texts s CROSS JOIN product_texts p
    LEFT JOIN (SELECT a.txt AS at, b.txt AS bt, sum(a.v * b.v) AS d FROM unit a JOIN unit b USING (slot)
               WHERE a.txt IN (SELECT txt FROM search_texts) AND b.txt IN (SELECT txt FROM product_texts) GROUP BY 1, 2) u ON s.txt = u.at AND p.txt = u.bt))
WHERE rk <= 5""", texts="SELECT txt FROM product_texts UNION SELECT txt FROM search_texts")

# cell probing: the vectors of the 16 smallest pool ids are the centres
DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
C["centres"] = """
SELECT embedding AS c, row_number() OVER (ORDER BY vec_id) AS cell FROM embeddings WHERE vec_id % 50 <> 0 ORDER BY vec_id LIMIT 16"""
C["probed"] = f"""
SELECT vec_id, embedding, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {DOT.format('c', 'c')} / 2 - {DOT.format('embedding', 'c')}, cell) AS nth
FROM embeddings, centres"""


def _in_cells(nprobe, k):
    return f"""
SELECT qid, pid, score, rk FROM (
  SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid)::INT AS rk FROM (
    SELECT q.vec_id AS qid, p.vec_id AS pid, round({DOT.format('q.embedding', 'p.embedding')}, 6) AS score
    FROM probed q JOIN probed p ON q.cell = p.cell
    WHERE q.vec_id % 50 = 0 AND q.nth <= {nprobe} AND p.vec_id % 50 <> 0 AND p.nth = 1)) WHERE rk <= {k}"""


add("vector_topk_cells", _in_cells(4, 20))
add("vector_recall", """
SELECT count(*) AS total, count(b.pid) AS found, round(count(b.pid)::DOUBLE / count(*), 6) AS recall
FROM exact_ten a LEFT JOIN probed_ten b ON a.qid = b.qid AND a.pid = b.pid""",
    exact_ten=_vectors("cos", SPLIT, 10), probed_ten=_in_cells(8, 10))
# approximate searches: all exact pairs are asked for, and 0.9 of them must be found
for name, k in (("vector_recall_graph", 20), ("vector_recall_lsh", 20), ("vector_recall_fitted", 10)):
    add(name, "SELECT count(*) AS total, true AS enough FROM exact", exact=_vectors("cos", SPLIT, k))
add("fitted_encoder_checks", "SELECT count(*) AS n, count(*) AS unit, true AS energy FROM pool")
add("semantic_fitted_hits", """
SELECT count(*) AS total, true AS more FROM (SELECT DISTINCT prefix, query FROM train WHERE length(prefix) >= 3)""")
add("pca_norms", """
SELECT vec_id, round(sum((x - m) * (x - m)), 4) AS norm2
FROM (SELECT vec_id, x, avg(x) OVER (PARTITION BY pos) AS m FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)) GROUP BY vec_id""")

add("candidates", "SELECT * FROM cands")
add("candidate_prune", pruned(30))
add("rerank_profile_a", reranked("a"))
add("rerank_profile_b", reranked("b"))
add("complete", "SELECT * FROM completed")
add("complete_30", "SELECT * FROM completed", **{name: C[name].replace("rk <= 10", "rk <= 30") for name in ("short", "completed")})
add("complete_dirty", "SELECT * FROM completed")
add("hashed_bm25", "SELECT query, term, round(w, 6) AS weight FROM sparse_long")
BUCKETED = f"list_distinct(list_transform({{0}}, lambda w: ({hashed('w')} % 16384)::VARCHAR))"
IN_BUCKETS = {
    "doc_terms": f"SELECT query, {BUCKETED.format(words('query'))} AS terms FROM pool",
    "prefix_terms": C["prefix_terms"].replace(f"list_distinct({words('prefix')})", BUCKETED.format(words("prefix"))),
}
add("hashed_bm25_buckets", "SELECT query, term, round(w, 6) AS weight FROM sparse_long", **IN_BUCKETS)
LOW = "4294967295::UBIGINT"


def low_times(x, factor):
    return f"(({x}) * {factor}::UBIGINT) & {LOW}"


def rotated(x, by):
    return f"((({x}) << {by}) | (({x}) >> {32 - by})) & {LOW}"


def little(e):
    return "('0x' || " + " || ".join(f"substr({e}, {i}, 2)" for i in (7, 5, 3, 1)) + ")::UBIGINT"


def mixed(blocks):
    for step in (low_times("z", 0xCC9E2D51), rotated("z", 15), low_times("z", 0x1B873593)):
        blocks = f"list_transform({blocks}, lambda z: {step})"
    return blocks


EVERY_BLOCK = f"list_transform(range(0, length(x) // 8), lambda i: {little('substr(x, i * 8 + 1, 8)')})"
LAST_BLOCK = f"[{little('rpad(substr(x, length(x) // 8 * 8 + 1), 8, chr(48))')}]"
MURMUR = {
    "hex_words": f"SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT unnest({words('query')}) AS word FROM pool)",
    "mixed_words": f"SELECT word, (length(x) // 2)::UBIGINT AS bytes, {mixed(EVERY_BLOCK)} AS body, {mixed(LAST_BLOCK)} AS tail FROM hex_words",
    "body_words": f"""
SELECT word, xor(xor(list_reduce(body, lambda y, z: ({rotated('xor(y, z)', 13)}) * 5 + 3864292196::UBIGINT & {LOW}, 0::UBIGINT), tail[1]), bytes) AS y FROM mixed_words""",
    "first_words": f"SELECT word, {low_times('xor(y, y >> 16)', 0x85EBCA6B)} AS y FROM body_words",
    "second_words": f"SELECT word, {low_times('xor(y, y >> 13)', 0xC2B2AE35)} AS y FROM first_words",
    "signed_words": """
SELECT word, CASE WHEN y >= 2147483648 THEN y::BIGINT - 4294967296 ELSE y::BIGINT END AS y FROM (SELECT word, xor(y, y >> 16) AS y FROM second_words)""",
    "doc_terms": f"""
SELECT query, list(DISTINCT (abs(y) % 16384)::VARCHAR) AS terms
FROM (SELECT query, unnest({words('query')}) AS word FROM pool) JOIN signed_words USING (word) GROUP BY query""",
}
add("hashed_bm25_murmur", "SELECT query, term, round(w, 6) AS weight FROM sparse_long WHERE w >= 0.01", **MURMUR)
CENTRED = {
    "plain_dots": C["dots"],
    "middle": f"SELECT slot, sum(v) / (SELECT count(*) FROM pool) AS m FROM (SELECT {strict('query')} AS txt FROM pool) JOIN unit USING (txt) GROUP BY slot",
    "to_middle": "SELECT txt, sum(v * coalesce(m, 0)) AS dm, sum(v * v) AS own FROM unit LEFT JOIN middle USING (slot) GROUP BY txt",
    "dots": f"""
SELECT prefix, query, (d - coalesce(a.dm, 0) - coalesce(b.dm, 0) + mm) / (sqrt(coalesce(a.own, 0) - 2 * coalesce(a.dm, 0) + mm) + 1e-10) * (1 + 1e-10) AS d
FROM plain_dots CROSS JOIN (SELECT sum(m * m) AS mm FROM middle)
LEFT JOIN to_middle a ON a.txt = {strict('prefix')} LEFT JOIN to_middle b ON b.txt = {strict('query')}""",
}
add("hybrid_projected", first_100("full_path"), **CENTRED)
add("hybrid_buckets", first_100("mixed_path"), **IN_BUCKETS)
add("hybrid_full", first_100("full_path"))
add("hybrid_blocked", first_100("mixed_path"))
add("index_roundtrip_all", f"""
SELECT 'complete' AS source, prefix, query, rk FROM completed
UNION ALL SELECT 'bm25', prefix, query, rk FROM bm25 WHERE rk <= 20
UNION ALL SELECT 'trigram', prefix, query, rk FROM trigram WHERE rk <= 10
UNION ALL SELECT 'hybrid', prefix, query, rk FROM ({first_100("full_path")})""")
add("cascade", "SELECT * FROM cascaded", norm_pairs="SELECT key AS p, query AS q FROM fkeys, fpool")

add("hit_at_10", """
SELECT count(*) AS total, count(h.query) AS hits, round(count(h.query)::DOUBLE / count(*), 6) AS hit_rate
FROM train t LEFT JOIN (SELECT * FROM train_hits WHERE rk <= 10) h ON t.prefix = h.prefix AND t.query = h.query""")
add("hit_at_10_complete", """
SELECT count(*) AS total, count(h.query) AS hits, round(count(h.query)::DOUBLE / count(*), 6) AS hit_rate
FROM train t LEFT JOIN completed h ON t.prefix = h.prefix AND t.query = h.query""",
    asked="SELECT DISTINCT prefix FROM train")
add("result_analysis", f"""
SELECT prefix, count(*) AS n_results, round(avg(length(query)), 6) AS avg_length,
  count(*) FILTER (WHERE starts_with({strict('query')}, {strict('prefix')})) AS prefix_matches,
  round(avg(score), 5) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM completed GROUP BY prefix""")
add("validate_submission", """
SELECT count(*) AS n_predictions, (SELECT count(*) FROM prefixes) AS n_expected, count(*) = (SELECT count(*) FROM prefixes) AS count_matches,
  (SELECT count(DISTINCT prefix) FROM prefixes WHERE prefix NOT IN (SELECT prefix FROM prefix_hits)) AS n_missing,
  min(n)::INT AS min_len, max(n)::INT AS max_len, round(avg(n), 6) AS mean_len, bool_and(n = 20) AS all_full
FROM (SELECT prefix, count(*) AS n FROM prefix_hits WHERE rk <= 20 GROUP BY prefix)""")
add("training_candidates", """
SELECT prefix, query, max(sem) AS sem, max(bm25) AS bm25, max(ngram) AS ngram, max(fuzzy) AS fuzzy FROM (
  SELECT * FROM cands_nofuzzy UNION ALL
  SELECT DISTINCT prefix, query, 0.0, 0.0, 0.0, 0.0 FROM train) GROUP BY prefix, query""",
    asked="SELECT DISTINCT prefix FROM train")
LABEL = "CASE WHEN orders > 0 THEN 3 WHEN catalog_clicks > 0 THEN 2 WHEN catalog_views > 0 THEN 1 ELSE 3 END"
add("graded_labels", f"SELECT query, {LABEL} AS label FROM counts")
add("pair_features", "SELECT * FROM pair_feature_rows")


def _scaled(n):
    return f"CASE WHEN s_{n} > 0 THEN round((least({n}, q_{n}) - m_{n}) / s_{n}, 6) ELSE 0.0 END AS {n}"


ORACLES["normalize_features"] = sql(
    "SELECT prefix, query, " + ", ".join(_scaled(n) for n in FEATURE_SQL) + " FROM pair_feature_rows, tops, moments",
    tops="SELECT " + ", ".join(f"quantile_cont({n}, 0.99) AS q_{n}" for n in FEATURE_SQL) + " FROM pair_feature_rows",
    moments="SELECT " + ", ".join(f"avg(least({n}, q_{n})) AS m_{n}, stddev_samp(least({n}, q_{n})) AS s_{n}" for n in FEATURE_SQL)
    + " FROM pair_feature_rows, tops",
)
C["sampled"] = f"SELECT row_id, prefix, query FROM train ORDER BY {hashed('row_id', seed=42)} LIMIT 50000"
add("sample_rows", "SELECT * FROM sampled")


def _groups(rows, cands):
    return f"""
SELECT row_id AS group_id, prefix, query, true AS is_truth FROM {rows}
UNION ALL SELECT row_id, prefix, query, false FROM (
  SELECT r.row_id, r.prefix, c.query,
    row_number() OVER (PARTITION BY r.row_id ORDER BY {hashed('r.row_id', 'c.query', seed=42)}, c.query) AS n
  FROM {rows} r JOIN {cands} c ON r.prefix = c.prefix AND c.query <> r.query) WHERE n <= 10"""


add("training_summary", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_truth) AS n_groups,
  count(*) FILTER (WHERE is_truth) AS n_positive, count(*) FILTER (WHERE NOT is_truth) AS n_negative FROM drawn""",
    asked="SELECT DISTINCT prefix FROM train", drawn=_groups("train", "cands_nofuzzy"))
TRAIN_CANDS = """
SELECT prefix, query, max(sem) AS sem, max(bm25) AS bm25, max(ngram) AS ngram, max(fuzzy) AS fuzzy FROM (
  SELECT * FROM cands_nofuzzy UNION ALL SELECT DISTINCT prefix, query, 0.0, 0.0, 0.0, 0.0 FROM train) GROUP BY prefix, query"""
add("training_set", f"""
SELECT group_id, prefix, query, is_truth, CASE WHEN is_truth THEN {LABEL} ELSE 0 END AS label, {", ".join(f"f.{n}" for n in FEATURE_SQL)}
FROM drawn JOIN pair_feature_rows f USING (prefix, query) JOIN counts c USING (query)""".replace("WHEN orders", "WHEN c.orders"),
    asked="SELECT DISTINCT prefix FROM train", kept=TRAIN_CANDS, drawn=_groups("train", "cands_nofuzzy"))
add("ranker_checks", f"""
SELECT {len(FEATURE_SQL)} AS n_features, 1.0 AS importance_sum, 4 AS n_cuts, true AS ndcg_in_range,
  count(DISTINCT group_id) AS n_groups, count(*) AS n_rows
FROM (SELECT group_id, dense_rank() OVER (ORDER BY group_id) AS nth FROM drawn)
WHERE nth > floor((SELECT count(DISTINCT row_id) FROM train) * 0.9)""",
    asked="SELECT DISTINCT prefix FROM train", drawn=_groups("train", "cands_nofuzzy"))
add("negative_sample", "SELECT * FROM drawn", drawn=_groups("train", "train_hits20"), train_hits20="SELECT * FROM train_hits WHERE rk <= 20")
add("training_sink", "SELECT is_truth, count(*) AS n_rows FROM drawn GROUP BY is_truth", drawn=_groups("train", "train_hits20"), train_hits20="SELECT * FROM train_hits WHERE rk <= 20")
add("group_split", """
SELECT part, count(*) AS n_rows, min(row_id) AS first_id, max(row_id) AS last_id FROM (
  SELECT row_id, CASE WHEN dense_rank() OVER (ORDER BY row_id) <= floor((SELECT count(DISTINCT row_id) FROM train) * 0.9)
    THEN 'train' ELSE 'validation' END AS part FROM train) GROUP BY part""")
add("text_split", f"SELECT prefix, text, CASE WHEN {hashed('text', seed=42)} % 100 < 85 THEN 'train' ELSE 'validation' END AS part FROM corpus_rows",
    corpus_rows=ORACLES["prompt_corpus"])
add("pool_reduce", f"""
SELECT query, popularity FROM (SELECT * FROM clean_pop ORDER BY popularity DESC, query LIMIT 500)
UNION SELECT query, popularity FROM (SELECT * FROM clean_pop ORDER BY {hashed('query', seed=42)} LIMIT 125)""")
RANKED = {
    "drawn": _groups("train", "train_hits20"), "train_hits20": "SELECT * FROM train_hits WHERE rk <= 20",
    "labelled": f"SELECT group_id, query, orders * 4 + volume * 3 + catalog_clicks * 2 + catalog_views AS pop, CASE WHEN is_truth THEN {LABEL} ELSE 0 END AS label FROM drawn JOIN counts USING (query)",
    "ranked_rows": """SELECT group_id, query, label, pop, pow(2.0, label) - 1 AS gain, row_number() OVER (PARTITION BY group_id ORDER BY pop DESC, query) AS rk,
  row_number() OVER (PARTITION BY group_id ORDER BY label DESC, query) AS best FROM labelled""",
}
add("ndcg", """
SELECT k, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 1 END), 6) AS ndcg FROM (
  SELECT group_id, k, sum(CASE WHEN rk <= k THEN gain / log2(rk + 1) ELSE 0 END) AS dcg,
    sum(CASE WHEN best <= k THEN gain / log2(best + 1) ELSE 0 END) AS ideal
  FROM ranked_rows, unnest([1, 3, 5, 10]) AS u(k) GROUP BY group_id, k) GROUP BY k""", **RANKED)
add("ranker_lambda_checks", "SELECT 4::BIGINT AS n_cuts, true AS raised, true AS n_trees_in_range")
add("lambda_gradients", """
SELECT group_id, query, round(sum(g), 9) + 0.0 AS gradient, round(sum(h), 9) + 0.0 AS curvature FROM (
  SELECT group_id, query, 0.0::DOUBLE AS g, 0.0::DOUBLE AS h FROM ranked_rows
  UNION ALL SELECT group_id, better, -p * w, p * (1 - p) * w FROM ordered_pairs
  UNION ALL SELECT group_id, worse, p * w, p * (1 - p) * w FROM ordered_pairs)
GROUP BY group_id, query""", **RANKED,
    ideals="SELECT group_id, sum(gain / log2(best + 1)) AS ideal FROM ranked_rows GROUP BY group_id",
    ordered_pairs="""SELECT a.group_id, a.query AS better, b.query AS worse, 1 / (1 + exp(ln(1 + a.pop) - ln(1 + b.pop))) AS p,
  abs(a.gain - b.gain) * abs(1 / log2(a.rk + 1) - 1 / log2(b.rk + 1)) / ideal AS w
FROM ranked_rows a JOIN ranked_rows b ON a.group_id = b.group_id AND a.label > b.label JOIN ideals i ON i.group_id = a.group_id""")
