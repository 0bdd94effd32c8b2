"""The same queries as SQL over the same tables, written for DuckDB."""

from __future__ import annotations

from quilate.functions import fixed_values as V
from quilate.plans.title_cases import SQL_TABLES, TITLES, sql_literal

AS_OF, SINCE = "TIMESTAMP '2026-06-01 00:00:00'", "TIMESTAMP '2026-02-02 00:00:00'"

PRICES = "prices AS (SELECT *, timestamp AT TIME ZONE 'UTC' AS ts FROM price_snapshots WHERE price_usd IS NOT NULL AND price_usd::VARCHAR <> 'nan')"
#: Per week the rate most records agree on, records in dollars per peso or pesos per 100 dollars brought to pesos per dollar.
RATES = """
    straight AS (SELECT week_start, round(CASE WHEN usd_uyu_rate BETWEEN 5 AND 500 THEN usd_uyu_rate WHEN usd_uyu_rate BETWEEN 1/500.0 AND 1/5.0 THEN 1/usd_uyu_rate
                        WHEN usd_uyu_rate BETWEEN 500 AND 50000 THEN usd_uyu_rate/100 END, 4) AS r FROM feature_snapshots WHERE usd_uyu_rate::VARCHAR <> 'nan'),
    votes AS (SELECT week_start, r, count(*) AS k FROM straight WHERE r IS NOT NULL GROUP BY ALL),
    elected AS (SELECT week_start, r FROM votes QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY k DESC, r) = 1),
    rates AS (SELECT week_start, r AS usd_uyu_rate FROM (SELECT DISTINCT week_start FROM feature_snapshots) LEFT JOIN elected USING (week_start))"""


def _weekly(where: str = "true") -> str:
    return f"""
        {PRICES}, {RATES},
        w AS (SELECT canonical_product_id AS p, date_trunc('week', ts)::DATE AS wk, median(price_usd) AS m, stddev_samp(price_usd) AS s FROM prices WHERE {where} GROUP BY ALL),
        cal AS (SELECT unnest(generate_series((SELECT min(wk) FROM w)::TIMESTAMP, (SELECT max(wk) FROM w)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS wk),
        spine AS (SELECT p, wk FROM (SELECT DISTINCT p FROM w), cal),
        f AS (SELECT strftime(wk, '%Y-%m-%d') AS week_start, p AS canonical_product_id, m, s, lag(m, 1) OVER x AS l1, lag(m, 2) OVER x AS l2,
                     median(m) OVER (PARTITION BY p ORDER BY wk ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS r
              FROM spine LEFT JOIN w USING (p, wk) WINDOW x AS (PARTITION BY p ORDER BY wk))
    """


def _features(where: str) -> str:
    return f"""WITH {_weekly(where)}
        SELECT week_start, canonical_product_id, round(m, 6) AS mediana_semanal, round(s, 6) AS dispersion_precios, round(l1, 6) AS precio_lag_1, round(l2, 6) AS precio_lag_2,
               round(r, 6) AS mediana_movil, round(usd_uyu_rate, 6) AS usd_uyu_rate FROM f LEFT JOIN rates USING (week_start)"""


SUMMARY = f"""
    {PRICES},
    cur AS (SELECT * FROM prices WHERE ts >= {AS_OF} - INTERVAL 720 HOUR QUALIFY row_number() OVER (PARTITION BY canonical_product_id ORDER BY timestamp DESC, id DESC) = 1),
    med AS (SELECT canonical_product_id, median(price_usd) AS m FROM prices GROUP BY 1),
    summary AS (SELECT canonical_product_id, source, ts, price_usd AS current_price, floor(m * 100 + 0.5) / 100 AS historical_median, floor((CASE WHEN m <> 0 THEN (price_usd - m) / m * 100 ELSE 0 END) * 10 + 0.5) / 10 AS pct_diff
                FROM cur JOIN med USING (canonical_product_id)),
    signals AS (SELECT canonical_product_id, coalesce(category, 'Unknown') AS category, coalesce(brand_family, 'Unknown') AS brand_family, pct_diff,
                       CASE WHEN historical_median = 0 THEN 'fair' WHEN (current_price - historical_median) / historical_median * 100 <= -10 THEN 'deal'
                            WHEN (current_price - historical_median) / historical_median * 100 >= 10 THEN 'expensive' ELSE 'fair' END AS signal
                FROM summary LEFT JOIN canonical_catalog ON sku = canonical_product_id)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _normalized(column: str) -> str:
    # NFKD also turns a no-break space into a space.
    e = f"regexp_replace(strip_accents(replace({column}, chr(160), ' ')), {_quoted(V.SEPARATORS)}, ' ', 'g')"
    for pattern, replacement in V.TOKEN_REWRITES:
        e = f"regexp_replace({e}, {_quoted(pattern)}, {_quoted(replacement)}, 'gi')"
    noise = ", ".join(_quoted(w) for w in V.NOISE_WORDS)
    return f"array_to_string(list_filter(string_split_regex(lower({e}), '\\s+'), lambda w: w <> '' AND w NOT IN ({noise})), ' ')"


def _brand(column: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {_quoted(w)})' for w in words)} THEN {_quoted(b)}" for b, words in V.BRAND_WORDS)
    return f"CASE {cases} END"


def _variant(column: str) -> str:
    outer = " ".join(f"WHEN {_quoted(b)} THEN CASE " + " ".join(f"WHEN contains(lower({column}), {_quoted(p)}) THEN {_quoted(p.title())}" for p in phrases) + " END" for b, phrases in V.VARIANT_PHRASES)
    return f"CASE {_brand(column)} {outer} END"


EXACT = f"""
    t AS (SELECT id, {_normalized('title')} AS n FROM raw_listings),
    exact AS (SELECT id, sku AS exact_sku FROM t JOIN canonical_catalog ON contains(n, lower(sku)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(sku) DESC, pos) = 1)
"""


def _pattern_match() -> str:
    tries = []
    for i, pattern in enumerate(V.MODEL_PATTERNS):
        if pattern.endswith(r"(?!\d)"):
            # No look-ahead here: the next character is matched, but stays out of the group.
            found = f"regexp_extract(title, {_quoted('(?i)(' + pattern[: -len(r'(?!\d)')] + r')(?:[^\d]|$)')}, 1)"
        else:
            found = f"regexp_extract(title, {_quoted('(?i)' + pattern)}, 0)"
        e = f"trim(upper({found}))"
        for p, r in V.MODEL_REWRITES if i < len(V.MODEL_PATTERNS) - 3 else V.MODEL_REWRITES[:1]:
            e = f"regexp_replace({e}, {_quoted(p)}, {_quoted(r)}, 'g')"
        tries.append(f"(SELECT max(sku) FROM canonical_catalog WHERE lower(sku) = lower({e}))")
    return f"coalesce({', '.join(tries)})"


def _resolved(opened: str = "WHERE title IN (SELECT title FROM read WHERE sku IS NULL)") -> str:
    """Each title with its entry by containment, else by pattern, else by similarity (``V.FUZZY_THRESHOLD`` at least).

    Similarity of the shorter string a with stretches of the longer b: twice the longest common
    subsequence over both lengths, bit-parallel. An a shares at least a third of its pairs, less one,
    with any b that it resembles that much; the rest is not compared.
    """
    return f"""
    cat AS (SELECT sku, min(pos) AS pos, any_value(lower(trim(regexp_replace(sku, '\\s+', ' ', 'g')))) AS p FROM canonical_catalog WHERE sku IS NOT NULL GROUP BY sku),
    titles AS (SELECT title, {_normalized('title')} AS n FROM (SELECT DISTINCT title FROM raw_listings WHERE title IS NOT NULL)),
    held AS (SELECT title, sku FROM titles JOIN cat ON contains(n, p) QUALIFY row_number() OVER (PARTITION BY title ORDER BY length(sku) DESC, pos) = 1),
    read AS (SELECT title, {_pattern_match()} AS sku FROM (SELECT title FROM titles WHERE title NOT IN (SELECT title FROM held))),
    opened AS (SELECT title, n FROM titles {opened}),
    sides AS (SELECT title, sku, pos, CASE WHEN length(p) <= length(n) THEN p ELSE n END AS a, CASE WHEN length(p) <= length(n) THEN n ELSE p END AS b FROM opened, cat WHERE n <> ''),
    near AS (SELECT * FROM sides WHERE len(list_filter(range(1, length(a)), lambda i: contains(b, substr(a, i, 2)))) >= length(a) / 3.0 - 1),
    both_ways AS (SELECT * FROM near UNION ALL SELECT title, sku, pos, b, a FROM near WHERE length(a) = length(b)),
    masks AS (SELECT title, sku, pos, length(a) AS m, length(b) AS n, list_transform(range(1, length(b) + 1), lambda k: list_sum(list_transform(range(1, length(a) + 1), lambda j: CASE WHEN substr(a, j, 1) = substr(b, k, 1) THEN 1::BIGINT << (j - 1) ELSE 0 END))::BIGINT) AS x FROM both_ways),
    cuts AS (SELECT *, unnest(list_transform(range(1, n - m + 2), lambda i: [i, i + m - 1]) || list_transform(range(1, m), lambda k: [1, k]) || list_transform(range(1, m), lambda k: [n - k + 1, n])) AS cut FROM masks),
    common AS (SELECT title, sku, pos, m, cut, bit_count(list_reduce(list_slice(x, cut[1], cut[2]), lambda v, y: ((v + (v & y)) | (v - (v & y))) & ((1::BIGINT << m) - 1), (1::BIGINT << m) - 1)) AS open_bits FROM cuts),
    scored AS (SELECT title, sku, pos, max(2 * (m - open_bits)::DOUBLE / (m + cut[2] - cut[1] + 1)) AS score FROM common GROUP BY ALL),
    alike AS (SELECT title, sku, score FROM scored WHERE score >= {V.FUZZY_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, pos) = 1),
    resolved AS (SELECT title, sku, {V.EXACT_CONFIDENCE}::DOUBLE AS confidence, 'exact' AS matched_by FROM held UNION ALL SELECT title, sku, {V.PATTERN_CONFIDENCE}::DOUBLE, 'regex' FROM read WHERE sku IS NOT NULL UNION ALL SELECT title, sku, score, 'fuzzy' FROM alike)
    """


URL = """
    u AS (SELECT id, source, item_id, regexp_replace(rtrim(lower(url), '/'), '#.*$', '') AS full_url FROM raw_listings),
    parts AS (SELECT *, string_split(full_url, '?')[1] AS base,
                     list_filter(string_split(coalesce(string_split(full_url, '?')[2], ''), '&'),
                                 lambda q: regexp_matches(q, '^[^=]+=.+') AND string_split(q, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'fbclid', 'gclid')) AS q FROM u),
    urls AS (SELECT id, source, item_id, CASE WHEN len(q) > 0 THEN base || '?' || array_to_string(q, '&') ELSE base END AS canonical_url FROM parts)
"""

FOLD = """
    folded AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN lag(price) OVER w <> price THEN 'updated' ELSE 'unchanged' END AS outcome FROM raw_listings WINDOW w AS (PARTITION BY listing_key ORDER BY id))
"""

#: Arrivals in two loads: those of the first load come before those of the second, each in order.
STORED = """
    loads AS (SELECT *, created_at AT TIME ZONE 'UTC' < TIMESTAMP '2026-03-01 00:00:00' AS early FROM raw_listings),
    placed AS (SELECT * REPLACE (row_number() OVER (ORDER BY early DESC, id) AS id) FROM loads),
    arrivals AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN lag(price) OVER w <> price THEN 'updated' ELSE 'unchanged' END AS outcome FROM placed WINDOW w AS (PARTITION BY listing_key ORDER BY id))
"""

REJECT = """CASE WHEN trim(replace(title, chr(160), ' ')) = '' OR title IS NULL THEN 'title' WHEN source NOT IN ('thot', 'banifox', 'pccompu') THEN 'source' WHEN currency IS NULL OR currency NOT IN ('UYU', 'USD') THEN 'currency'
            WHEN condition NOT IN ('new', 'used') THEN 'condition' WHEN price IS NULL OR isnan(price) OR price <= 0 THEN 'price' WHEN base_price <= 0 THEN 'base_price' END"""

OUTCOMES = f"""
    {RATES}, {_resolved()},
    rebuilt AS (SELECT * REPLACE (nullif(condition, '') AS condition, nullif(base_price, 0) AS base_price) FROM raw_listings),
    j AS (SELECT l.*, {REJECT} AS reject_reason, r.sku AS canonical_product_id, r.matched_by, coalesce(r.confidence, 0) AS confidence, CASE currency WHEN 'USD' THEN price WHEN 'UYU' THEN price / nullif(usd_uyu_rate, 0) END AS price_usd
          FROM rebuilt l LEFT JOIN resolved r USING (title) LEFT JOIN rates ON rates.week_start = strftime(date_trunc('week', timestamp AT TIME ZONE 'UTC'), '%Y-%m-%d')),
    outcomes AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'error' WHEN canonical_product_id IS NULL THEN 'unmatched' WHEN coalesce(condition, '') <> 'new' THEN 'not_new' WHEN price_usd IS NULL THEN 'no_rate' ELSE 'resolved' END AS outcome FROM j)
"""

TARGETS = f"{PRICES}, targets AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, canonical_product_id, median(price_usd) AS target FROM prices GROUP BY ALL)"
_NUM = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in ("precio_lag_1", "precio_lag_2", "mediana_movil", "dispersion_precios", "usd_uyu_rate"))
_FILL = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("precio_lag_1", "precio_lag_2", "mediana_movil", "dispersion_precios", "usd_uyu_rate"))
_ALL = " AND ".join(f"{c} IS NOT NULL" for c in ("precio_lag_1", "precio_lag_2", "mediana_movil", "dispersion_precios", "usd_uyu_rate"))
FRAME = f"""
    {TARGETS},
    nums AS (SELECT id, week_start, canonical_product_id, {_NUM} FROM feature_snapshots),
    merged AS (SELECT nums.*, target FROM nums JOIN targets USING (week_start, canonical_product_id)),
    enough AS (SELECT * FROM merged QUALIFY count(*) OVER (PARTITION BY canonical_product_id) >= 12),
    filled AS (SELECT week_start, canonical_product_id, target, {_FILL} FROM enough WINDOW w AS (PARTITION BY canonical_product_id ORDER BY week_start ROWS UNBOUNDED PRECEDING)),
    frame AS (SELECT * FROM filled WHERE {_ALL}),
    buckets AS (SELECT *, least(floor((row_number() OVER (ORDER BY week_start, canonical_product_id) - 1) / floor(count(*) OVER () / 5)), 4)::INT AS bucket FROM frame)
"""
METRICS = "round(avg(abs(target - precio_lag_1)), 6) AS mae, round(sqrt(avg((target - precio_lag_1) * (target - precio_lag_1))), 6) AS rmse, round(avg(abs((target - precio_lag_1) / target)) * 100, 6) AS mape"
LATEST = f"""
    nums AS (SELECT week_start, canonical_product_id, {_NUM} FROM feature_snapshots WHERE week_start = (SELECT max(week_start) FROM feature_snapshots)),
    latest AS (SELECT * FROM nums WHERE {_ALL})
"""
TITLE = "trim(regexp_replace(replace(title, chr(160), ' '), '\\s+', ' ', 'g'))"


def _cards(site: str, currency: str) -> str:
    return f"SELECT id, {TITLE} AS title, 'https://{site}.example/item/' || id AS url, round(price, 2) AS price, {currency} AS currency FROM raw_listings WHERE round(price, 2) > 0"


TOP5 = f"""{PRICES},
    top AS (SELECT canonical_product_id, count(*) AS n FROM prices GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5),
    dm AS (SELECT canonical_product_id, strftime(ts, '%Y-%m-%d') AS day, round(median(price_usd), 6) AS median FROM prices WHERE canonical_product_id IN (SELECT canonical_product_id FROM top) GROUP BY ALL)"""

SQL = {
    "weekly_features": _features("true"),
    "weekly_features_since": _features(f"ts >= {SINCE}"),
    "calendar_spine": f"WITH {_weekly()} SELECT canonical_product_id, week_start FROM f",
    "lag_features": f"WITH {_weekly()} SELECT week_start, canonical_product_id, round(l1, 6) AS precio_lag_1, round(l2, 6) AS precio_lag_2 FROM f",
    "rolling_median_4w": f"WITH {_weekly()} SELECT week_start, canonical_product_id, round(r, 6) AS mediana_movil FROM f",
    "weekly_dispersion": f"WITH {_weekly()} SELECT strftime(wk, '%Y-%m-%d') AS week_start, p AS canonical_product_id, round(m, 6) AS mediana_semanal, round(s, 6) AS dispersion_precios FROM w",
    "market_summary": f"WITH {SUMMARY} SELECT canonical_product_id, source, current_price, historical_median, pct_diff FROM summary",
    "ordered_summary": f"WITH {SUMMARY} SELECT row_number() OVER (ORDER BY pct_diff, canonical_product_id)::INT AS place, canonical_product_id, pct_diff FROM summary",
    "current_prices_limit10": f"""WITH {PRICES},
        newest AS (SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY timestamp DESC, id DESC) AS rn FROM prices WHERE ts >= {AS_OF} - INTERVAL 720 HOUR),
        ten AS (SELECT * FROM newest WHERE rn <= 10 QUALIFY row_number() OVER (PARTITION BY canonical_product_id, source ORDER BY rn) = 1)
        SELECT canonical_product_id, source, seller, price_usd FROM ten""",
    "price_history": f"WITH {PRICES} SELECT id, source, price_usd FROM prices WHERE canonical_product_id = 'Ignivar 4000'",
    "distinct_skus": f"WITH {PRICES} SELECT DISTINCT canonical_product_id FROM prices",
    "deal_signals": f"WITH {SUMMARY} SELECT * FROM signals",
    "best_deals_by_category": f"WITH {SUMMARY} SELECT * FROM signals WHERE signal = 'deal' AND category IN ('GPU', 'CPU')",
    "display_rows": f"WITH {SUMMARY} SELECT canonical_product_id, printf('$%.2f', historical_median) AS median_text, printf('%+.1f%%', pct_diff) AS pct_text, strftime(ts, '%Y-%m-%d %H:%M') AS seen FROM summary",
    "normalize_title": f"SELECT id, {_normalized('title')} AS normalized FROM raw_listings",
    "normalize_sku": "SELECT sku, lower(trim(regexp_replace(sku, '\\s+', ' ', 'g'))) AS normalized FROM canonical_catalog",
    "extract_brand": f"SELECT id, {_brand('title')} AS brand FROM raw_listings",
    "extract_variant": f"SELECT id, {_variant('title')} AS variant FROM raw_listings",
    "exact_match": f"WITH {EXACT} SELECT id, exact_sku FROM raw_listings LEFT JOIN exact USING (id)",
    "regex_match": f"SELECT id, {_pattern_match()} AS pattern_sku FROM raw_listings",
    "normalize_url": f"WITH {URL} SELECT id, canonical_url FROM urls",
    "listing_key": f"WITH {URL} SELECT id, sha256(source || ':' || CASE WHEN coalesce(item_id, '') <> '' THEN item_id ELSE canonical_url END) AS computed_key FROM urls",
    "upsert_listings": """
        WITH f AS (SELECT listing_key, min_by(source, id) AS source, arg_min(title, id) AS title, arg_min(currency, id) AS currency, arg_max(price, id) AS price FROM raw_listings GROUP BY 1)
        SELECT *, true AS stamped FROM f""",
    "ingest_counters": f"""WITH checked AS (SELECT *, {REJECT} AS reject_reason FROM raw_listings),
        folded AS (SELECT source, CASE WHEN row_number() OVER w = 1 THEN 'inserted' WHEN lag(price) OVER w <> price THEN 'updated' ELSE 'unchanged' END AS outcome FROM checked WHERE reject_reason IS NULL WINDOW w AS (PARTITION BY listing_key ORDER BY id)
                   UNION ALL SELECT source, 'error' FROM checked WHERE reject_reason IS NOT NULL)
        SELECT source, outcome, count(*) AS n FROM folded GROUP BY ALL""",
    "upsert_into_stored": f"""WITH {STORED} SELECT listing_key, arg_min(source, id) AS source, arg_min(title, id) AS title, arg_min(currency, id) AS currency, arg_max(price, id) AS price,
        strftime(arg_max(CASE WHEN outcome <> 'unchanged' THEN created_at END, CASE WHEN outcome <> 'unchanged' THEN id END) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated FROM arrivals GROUP BY 1""",
    "stored_counters": f"WITH {STORED} SELECT outcome, count(*) AS n FROM arrivals WHERE NOT early GROUP BY 1",
    "validate_listings": """
        WITH r AS (SELECT CASE WHEN trim(replace(title, chr(160), ' ')) = '' THEN 'title' WHEN source NOT IN ('thot', 'banifox', 'pccompu') THEN 'source' WHEN currency NOT IN ('UYU', 'USD') THEN 'currency'
            WHEN condition NOT IN ('new', 'used') THEN 'condition' WHEN isnan(price) OR price <= 0 THEN 'price' WHEN base_price <= 0 THEN 'base_price' END AS reject_reason FROM raw_listings)
        SELECT reject_reason, count(*) AS n FROM r GROUP BY 1""",
    "fx_normalize": f"""WITH {RATES} SELECT l.id, round(CASE currency WHEN 'USD' THEN price WHEN 'UYU' THEN price / nullif(usd_uyu_rate, 0) END, 6) AS price_usd
        FROM raw_listings l LEFT JOIN rates ON rates.week_start = strftime(date_trunc('week', timestamp AT TIME ZONE 'UTC'), '%Y-%m-%d')""",
    "title_cases": f"""WITH {SQL_TABLES}, {EXACT} SELECT id, {_normalized('title')} AS normalized, {_brand('title')} AS brand, {_variant('title')} AS variant, exact_sku, {_pattern_match()} AS pattern_sku FROM raw_listings LEFT JOIN exact USING (id)""",
    "resolver_cases": f"WITH {SQL_TABLES}, {_resolved()} SELECT id, sku AS resolved_sku, round(coalesce(confidence, 0), 6) AS confidence, matched_by FROM raw_listings LEFT JOIN resolved USING (title)",
    "fuzzy_match": f"WITH {_resolved('')} SELECT title, sku AS fuzzy_sku, round(score, 6) AS fuzzy_score FROM alike",
    "resolve_priority": f"WITH {_resolved()} SELECT id, sku AS resolved_sku, round(coalesce(confidence, 0), 6) AS confidence, matched_by FROM raw_listings LEFT JOIN resolved USING (title)",
    "match_rate": f"WITH {_resolved()} SELECT matched_by, count(*) AS n FROM raw_listings LEFT JOIN resolved USING (title) GROUP BY 1",
    "resolve_snapshots": f"WITH {OUTCOMES} SELECT id, canonical_product_id, source, seller, price, currency, round(price_usd, 6) AS price_usd, matched_by, round(confidence, 6) AS confidence FROM outcomes WHERE outcome = 'resolved'",
    "resolve_counters": f"WITH {OUTCOMES} SELECT outcome, matched_by, count(*) AS n FROM outcomes GROUP BY ALL",
    "replace_features": f"""WITH {_weekly()}, new AS (SELECT week_start, canonical_product_id, r AS mediana_movil FROM f)
        SELECT week_start, canonical_product_id, round(CASE WHEN isnan(mediana_movil) THEN NULL ELSE mediana_movil END, 6) AS mediana_movil FROM feature_snapshots o
        WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.week_start = o.week_start AND n.canonical_product_id = o.canonical_product_id)
        UNION ALL SELECT week_start, canonical_product_id, round(mediana_movil, 6) FROM new""",
    "training_frame": f"WITH {FRAME} SELECT week_start, canonical_product_id, round(target, 6) AS target, round(precio_lag_1, 6) AS precio_lag_1, round(precio_lag_2, 6) AS precio_lag_2, round(mediana_movil, 6) AS mediana_movil, round(dispersion_precios, 6) AS dispersion_precios, round(usd_uyu_rate, 6) AS usd_uyu_rate FROM frame",
    "min_history_skus": f"WITH {TARGETS} SELECT canonical_product_id, count(*) AS weeks FROM feature_snapshots JOIN targets USING (week_start, canonical_product_id) GROUP BY 1 HAVING count(*) >= 12",
    "forward_fill": "SELECT id, round(last_value(CASE WHEN isnan(precio_lag_1) THEN NULL ELSE precio_lag_1 END IGNORE NULLS) OVER (PARTITION BY canonical_product_id ORDER BY week_start ROWS UNBOUNDED PRECEDING), 6) AS precio_lag_1 FROM feature_snapshots",
    "walk_forward_folds": f"""WITH {FRAME}, rows AS (SELECT b.*, fold::INT AS fold, CASE WHEN bucket = fold THEN 'test' ELSE 'train' END AS role FROM buckets b, range(1, 5) t(fold) WHERE bucket <= fold)
        SELECT fold, role, count(*) AS n, min(week_start) AS first_week, max(week_start) AS last_week FROM rows GROUP BY ALL""",
    "naive_cv_metrics": f"WITH {FRAME} SELECT bucket AS fold, {METRICS} FROM buckets WHERE bucket > 0 GROUP BY 1",
    "naive_cv_mean": f"""WITH {FRAME}, m AS (SELECT bucket, avg(abs(target - precio_lag_1)) AS mae, sqrt(avg((target - precio_lag_1) * (target - precio_lag_1))) AS rmse, avg(abs((target - precio_lag_1) / target)) * 100 AS mape FROM buckets WHERE bucket > 0 GROUP BY 1)
        SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(mape), 6) AS mape FROM m""",
    "latest_week_predictions_naive": f"WITH {LATEST} SELECT week_start, canonical_product_id, round(precio_lag_1, 6) AS predicted_price_usd FROM latest",
    "prediction_bounds": f"WITH {LATEST} SELECT week_start, canonical_product_id, round(precio_lag_1 * 0.9, 6) AS lower_bound, round(precio_lag_1 * 1.1, 6) AS upper_bound FROM latest",
    "replace_predictions": f"""WITH nums AS (SELECT week_start, canonical_product_id, {_NUM}, dense_rank() OVER (ORDER BY week_start DESC) AS age FROM feature_snapshots)
        SELECT week_start, canonical_product_id, round(precio_lag_1, 6) AS predicted_price_usd, CASE age WHEN 1 THEN 'naive' ELSE 'stored' END AS model_id, CASE age WHEN 1 THEN '2026-06-01 00:00:00' ELSE '2026-02-02 00:00:00' END AS run_at
        FROM nums WHERE age <= 2 AND {_ALL}""",
    "baseline_winner_counts": f"""WITH {FRAME} SELECT CASE WHEN abs(target - precio_lag_1) < abs(target - mediana_movil) THEN 'precio_lag_1' WHEN abs(target - mediana_movil) < abs(target - precio_lag_1) THEN 'mediana_movil' ELSE 'tie' END AS winner, count(*) AS n
        FROM frame GROUP BY 1""",
    "skus_by_brand": "SELECT sku FROM canonical_catalog WHERE upper(coalesce(brand_family, '')) = 'IGNIVAR'",
    "latest_listings": "SELECT id, title FROM raw_listings ORDER BY updated_at DESC, id DESC LIMIT 50",
    "parse_cards_thot": _cards("thot", "CASE WHEN currency = 'USD' THEN 'USD' ELSE 'UYU' END"),
    "parse_cards_banifox": _cards("banifox", "'USD'"),
    "parse_cards_pccompu": _cards("pccompu", "CASE WHEN currency = 'USD' THEN 'USD' ELSE 'UYU' END"),
    "all_sites_listings": "WITH p AS (" + " UNION ALL ".join(f"SELECT '{s}' AS site, url, price, currency FROM ({_cards(s, c)})" for s, c in (("thot", "CASE WHEN currency = 'USD' THEN 'USD' ELSE 'UYU' END"), ("banifox", "'USD'"), ("pccompu", "CASE WHEN currency = 'USD' THEN 'USD' ELSE 'UYU' END"))) + ") SELECT site, currency, count(*) AS n, count(DISTINCT url) AS urls, round(sum(price::DECIMAL(20,2))::DOUBLE, 2) AS total FROM p GROUP BY ALL",
    "safe_floats": "SELECT snapshot_id, try_cast(price_text AS DOUBLE) AS number, try_cast(regexp_replace(price_text, '[^0-9.]', '', 'g') AS DOUBLE) AS digits FROM price_texts",
    "unseen_snapshots": """WITH stored AS (SELECT * FROM price_snapshots WHERE created_at AT TIME ZONE 'UTC' < TIMESTAMP '2026-03-01 00:00:00')
        SELECT DISTINCT source, listing_id, strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS at FROM price_snapshots r
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = r.source AND s.listing_id IS NOT DISTINCT FROM r.listing_id AND s.timestamp = r.timestamp)""",
    "page_urls": """
        SELECT source, page::INT AS page, CASE source WHEN 'pccompu' THEN 'https://pccompu.example/c/?pagina=' || page
               ELSE 'https://' || source || '.example/c/' || CASE WHEN page = 1 THEN '' ELSE CASE source WHEN 'thot' THEN 'page/' ELSE 'pag/' END || page || '/' END END AS url
        FROM (SELECT DISTINCT source FROM raw_listings), range(1, 4) t(page)""",
    "pagination_stop": """
        WITH r AS (SELECT source AS base_url, url, ((row_number() OVER (PARTITION BY source ORDER BY id) - 1) // 40)::INT AS page_no FROM raw_listings),
        first AS (SELECT base_url, url, min(page_no) AS page_no FROM r GROUP BY ALL),
        pages AS (SELECT DISTINCT base_url, page_no FROM r),
        n AS (SELECT base_url, page_no, count(url) AS new_items FROM pages LEFT JOIN first USING (base_url, page_no) GROUP BY ALL)
        SELECT base_url, page_no, new_items FROM n QUALIFY min(CASE WHEN new_items = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY base_url ORDER BY page_no) = 1""",
    "dedup_urls": "SELECT id, url FROM raw_listings QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1",
    "zero_row_alerts": """
        WITH e AS (SELECT DISTINCT source FROM raw_listings UNION SELECT 'mercado')
        SELECT source, 'no rows from ' || source AS alert FROM e WHERE source NOT IN (SELECT source FROM raw_listings WHERE condition IS NOT NULL)""",
    "fx_json": f"WITH {RATES} SELECT week_start, round(usd_uyu_rate, 6) AS usd_uyu_rate FROM rates",
    "sku_stats": f"WITH {PRICES} SELECT canonical_product_id, count(*) AS n, floor(min(price_usd) * 100 + 0.5) / 100 AS least, floor(median(price_usd) * 100 + 0.5) / 100 AS median, floor(max(price_usd) * 100 + 0.5) / 100 AS most, floor(stddev_samp(price_usd) * 100 + 0.5) / 100 AS deviation FROM prices GROUP BY 1",
    "source_pivot": f"WITH {PRICES} SELECT canonical_product_id, " + ", ".join(f"round(median(price_usd) FILTER (source = '{s}'), 6) AS {s}" for s in ("thot", "banifox", "pccompu")) + " FROM prices GROUP BY 1",
    "daily_volume": f"WITH {PRICES} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM prices GROUP BY 1",
    "daily_median_top5": f"WITH {TOP5} SELECT * FROM dm",
    "rolling_mean_7": f"WITH {TOP5} SELECT canonical_product_id, day, round(avg(median) OVER (PARTITION BY canonical_product_id ORDER BY day ROWS 6 PRECEDING), 6) AS rolling_mean FROM dm",
    "hist_vs_current": f"""WITH {PRICES}, x AS (SELECT canonical_product_id, median(price_usd) FILTER (ts::DATE < (SELECT max(ts)::DATE FROM prices)) AS historical, median(price_usd) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM prices)) AS current FROM prices GROUP BY 1)
        SELECT canonical_product_id, round(historical, 6) AS historical, round(current, 6) AS current, floor((current - historical) / historical * 100 * 10 + 0.5) / 10 AS delta_pct FROM x WHERE historical IS NOT NULL AND current IS NOT NULL""",
    "signal_marks": f"WITH {SUMMARY} SELECT canonical_product_id, CASE signal WHEN 'deal' THEN '🟢' WHEN 'fair' THEN '🟡' WHEN 'expensive' THEN '🔴' ELSE '⚪' END AS mark, upper(signal) AS label FROM signals",
    "scan_listings": f"SELECT id, title, price FROM raw_listings WHERE source = 'thot' AND timestamp AT TIME ZONE 'UTC' >= {SINCE}",
    "least_current_price": f"""WITH {PRICES},
        newest AS (SELECT *, row_number() OVER (PARTITION BY canonical_product_id ORDER BY timestamp DESC, id DESC) AS rn FROM prices WHERE ts >= {AS_OF} - INTERVAL 720 HOUR),
        ten AS (SELECT * FROM newest WHERE rn <= 10 QUALIFY row_number() OVER (PARTITION BY canonical_product_id, source ORDER BY rn) = 1),
        least AS (SELECT canonical_product_id, min(price_usd) AS p FROM ten GROUP BY 1), med AS (SELECT canonical_product_id, median(price_usd) AS m FROM prices GROUP BY 1)
        SELECT canonical_product_id, round(p, 6) AS least_price, round(m, 6) AS median_all, CASE WHEN m = 0 THEN 'fair' WHEN (p - m) / m * 100 <= -10 THEN 'deal' WHEN (p - m) / m * 100 >= 10 THEN 'expensive' ELSE 'fair' END AS signal
        FROM least JOIN med USING (canonical_product_id)""",
    "price_describe": f"""WITH {PRICES} SELECT count(price_usd) AS n, floor(avg(price_usd) * 100 + 0.5) / 100 AS mean, floor(stddev_samp(price_usd) * 100 + 0.5) / 100 AS deviation, min(price_usd) AS least, max(price_usd) AS most,
        floor(quantile_cont(price_usd, 0.25) * 100 + 0.5) / 100 AS q25, floor(quantile_cont(price_usd, 0.5) * 100 + 0.5) / 100 AS q50, floor(quantile_cont(price_usd, 0.75) * 100 + 0.5) / 100 AS q75, floor(quantile_cont(price_usd, 0.99) * 100 + 0.5) / 100 AS q99 FROM prices""",
    "listing_overview": """WITH r AS (SELECT *, strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM raw_listings)
        SELECT count(*) AS rows, count(DISTINCT url) AS urls, count(DISTINCT title) AS titles, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days FROM r""",
    "top_products": f"WITH {PRICES} SELECT canonical_product_id, count(*) AS n FROM prices GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
    "value_counts_currency": "SELECT currency AS value, count(*) AS n FROM price_snapshots GROUP BY 1",
    "component_prices": "SELECT id, price FROM raw_listings WHERE currency = 'USD' AND price >= 43",
    "source_match_rate": f"WITH {_resolved()} SELECT source, round(avg(CASE WHEN sku IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM raw_listings LEFT JOIN resolved USING (title) GROUP BY 1",
    "per_source_counts": f"WITH {FOLD} SELECT source, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged FROM folded GROUP BY 1",
    "summary_history": f"WITH {SUMMARY} SELECT id, canonical_product_id, price_usd FROM prices WHERE canonical_product_id IN (SELECT canonical_product_id FROM summary)",
    "value_counts_condition": "SELECT condition AS value, count(*) AS n FROM raw_listings GROUP BY 1",
    "null_counts": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS rows FROM raw_listings" for c in ("item_id", "condition", "available_quantity", "base_price")),
    "outliers": "SELECT id, price FROM price_snapshots WHERE currency = 'USD' AND (price < 10 OR price > 10000)",
    "listing_outliers": "SELECT id, price, currency, source FROM raw_listings WHERE price < 10 OR price > 10000",
    "model_word_share": f"WITH cases AS (SELECT * FROM (VALUES {', '.join(f'({sql_literal(t)})' for t in TITLES)}) v(title)) SELECT count(*) AS titles, count(*) FILTER (regexp_matches(title, {_quoted(V.GRAPHICS_WORDS)})) AS graphics FROM (SELECT title FROM raw_listings UNION ALL SELECT title FROM cases)",
    "title_lengths": """SELECT count(n) AS n, floor(avg(n) * 100 + 0.5) / 100 AS mean, floor(stddev_samp(n) * 100 + 0.5) / 100 AS deviation, min(n) AS least, max(n) AS most, floor(quantile_cont(n, 0.25) * 100 + 0.5) / 100 AS q25,
        floor(quantile_cont(n, 0.5) * 100 + 0.5) / 100 AS q50, floor(quantile_cont(n, 0.75) * 100 + 0.5) / 100 AS q75, floor(quantile_cont(n, 0.99) * 100 + 0.5) / 100 AS q99 FROM (SELECT length(title)::DOUBLE AS n FROM raw_listings)""",
    "sharp_drops": f"""WITH {PRICES}, x AS (SELECT canonical_product_id, median(price_usd) FILTER (ts::DATE < (SELECT max(ts)::DATE FROM prices)) AS h, median(price_usd) FILTER (ts::DATE = (SELECT max(ts)::DATE FROM prices)) AS c FROM prices GROUP BY 1)
        SELECT canonical_product_id, floor((c - h) / h * 100 * 10 + 0.5) / 10 AS delta_pct FROM x WHERE h IS NOT NULL AND c IS NOT NULL AND floor((c - h) / h * 100 * 10 + 0.5) / 10 < -10""",
    "feature_uniques": "SELECT count(DISTINCT week_start) AS weeks, count(DISTINCT canonical_product_id) AS products FROM feature_snapshots",
    "title_keyword_share": "SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(title, '(?i)placa de video|tarjeta|vga|gpu|graphics')) AS gpu_words FROM raw_listings GROUP BY 1",
    "precision_recall": f"""WITH {_resolved()},
        truth AS (SELECT listing_id, min(canonical_product_id) AS truth FROM price_snapshots WHERE listing_id IS NOT NULL AND canonical_product_id IN (SELECT sku FROM canonical_catalog) GROUP BY 1 HAVING count(DISTINCT canonical_product_id) = 1),
        r AS (SELECT truth, sku FROM raw_listings JOIN truth ON listing_key = listing_id LEFT JOIN resolved USING (title)),
        c AS (SELECT count(*) FILTER (truth = sku) AS tp, count(*) FILTER (sku IS NOT NULL AND truth <> sku) AS fp, count(*) FILTER (sku IS NULL OR truth <> sku) AS fn FROM r)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "first_of_sources": "SELECT source, id FROM raw_listings QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 3",
}
