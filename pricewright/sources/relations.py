"""Relations of the price-intelligence model as views over the star-schema tables, in Spark and as SQL.

SQL holds, for each relation, a SELECT that gives the same rows from the same tables; with_views() puts the ones that a
query names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marketplaces whose search is watched; those that the server monitors.
WATCHED = ("wildberries", "ozon", "yandex_market", "megamarket", "aliexpress")
MONITORED = ("wildberries", "ozon", "yandex_market")
#: Event names of the product funnel and of operations.
NAMES = (
    "extension_installed", "extension_started", "marketplace_page_detected", "product_card_opened", "compare_started", "compare_completed",
    "comparison_failed", "ai_started", "ai_analysis_completed", "ai_analysis_cache_hit", "ai_analysis_failed", "product_tracking_added",
    "telegram_connected", "trial_claimed", "premium_page_opened", "marketplace_search_started", "marketplace_search_success", "marketplace_search_failed",
    "scrape_request", "scrape_cache_hit", "scrape_cache_miss", "telegram_monitor_check", "telegram_monitor_cache_hit", "telegram_monitor_scrape",
    "telegram_alert_sent", "telegram_monitor_error", "monitoring_refresh_failed",
)
SOURCES = ("scrappey", "tab", "legacy", "api", "cache")
REASONS = ("timeout", "network_error", "parser_error")
PROVIDERS = ("grok", "openai", "perplexity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def as_of(df: DataFrame, column: str) -> Column:
    """The newest time of a relation: what 'now' is unless a caller gives another."""
    return df.select(F.max(column)).scalar()


def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        pick(WATCHED, F.col("user_id")).alias("marketplace"), F.concat(F.lit("q"), F.col("user_id")).alias("search_query"),
        (F.col("event_type") != "error").alias("success"), F.floor(F.col("value") * 10).alias("response_time_ms"), F.col("ts").alias("created_at"),
    )


def ai_request_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    u, i = F.col("user_id"), F.col("event_id")
    return e.select(
        pick(PROVIDERS, u).alias("provider"), F.concat(F.lit("m"), u % 4).alias("model"), F.when(u % 4 != 0, F.concat(F.lit("p"), u % 3)).alias("pipeline"),
        (F.col("event_type") != "error").alias("success"), F.floor(F.col("value") * 10).alias("duration_ms"), F.when(u % 6 != 0, u).alias("prompt_tokens"),
        F.when(i % 5 != 0, i % 100).alias("completion_tokens"), (i % 3 == 0).alias("web_research_used"), (i % 6 == 0).alias("web_research_cached"), F.col("ts").alias("created_at"),
    )


def telemetry_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    u, i, t = F.col("user_id"), F.col("event_id"), F.col("event_type")
    payload = F.create_map(
        F.lit("source"), pick(SOURCES, i), F.lit("failure_reason"), pick(REASONS, u), F.lit("outcome"), F.when(i % 2 == 0, "success").otherwise("error"),
        F.lit("provider"), pick(PROVIDERS, u), F.lit("reason"), pick(REASONS, i),
    )
    return e.select(
        F.col("event_id"), F.when(t == "error", "error").when(t == "click", "warn").otherwise("info").alias("level"), pick(NAMES, i).alias("name"),
        F.when(u % 7 != 6, pick(WATCHED, u)).alias("marketplace"), F.when(i % 4 != 3, t != "error").alias("success"), F.floor(F.col("value") * 10).alias("elapsed_ms"),
        F.when(u % 2 == 0, F.concat(F.lit("E"), u % 5)).alias("error_code"), u.alias("install_id"), payload.alias("payload"), F.col("ts").alias("created_at"),
    )


def edge_request_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("endpoint"), "user_id", F.col("ts").alias("created_at"))


def match_feedback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").isin("purchase", "signup").alias("accepted"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"),
        F.floor(F.least(F.lit(100.0), F.col("value"))).alias("match_confidence"), F.concat(F.lit(" FP"), F.col("user_id") % 40).alias("fingerprint"),
    )


def newest_price(spark: SparkSession, d: str) -> Column:
    """as_of() of the price history, from the one table that its times come from: every line item's part is known."""
    return as_of(table(spark, d, "lineitem"), "l_shipdate")


def price_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("id"), (F.col("l_suppkey") % 2).alias("user_id"),
        pick(WATCHED, F.col("l_suppkey")).alias("marketplace"), F.col("p_brand").alias("product_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("recorded_at"),
    )


def tracked_products(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), pick(MONITORED, k).alias("marketplace"), (k % 200).cast("string").alias("product_id"),
        F.when(k % 5 != 0, F.concat(F.lit("https://shop.example/product/item-"), k % 200)).alias("product_url"), (F.col("o_totalprice") * 0.9).alias("target_price"),
        F.col("o_totalprice").alias("last_price"), F.when(k % 11 != 0, F.col("o_orderdate")).alias("last_checked"), (F.col("o_orderstatus") == "F").alias("deleted"),
        (k % 6).alias("consecutive_unavailable_count"), (F.col("o_orderpriority") == "1-URGENT").alias("priority"), F.col("o_orderdate").alias("updated_at"),
    )


def alert_settings(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        c.alias("user_id"), F.concat(F.lit("chat"), c % 900).alias("telegram_chat_id"), (s != "BUILDING").alias("notifications_enabled"), (c % 3 != 0).alias("server_monitoring"),
        (c % 4 != 0).alias("telegram_enabled"), F.lit(100.0).alias("min_drop_rub"), (c % 5).cast("double").alias("min_drop_percent"), F.col("c_acctbal").alias("updated_mark"),
    )


def user_premium(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    start = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return table(spark, d, "customer").where(c % 3 == 0).select(
        c.alias("user_id"), F.when(c % 2 == 0, start + F.make_dt_interval((c % 900).cast("int"))).alias("expires_at"), F.when(c % 6 != 3, c).alias("license_key_id"),
    )


def license_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    start = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    return table(spark, d, "customer").select(c.alias("id"), (c % 7 != 0).alias("is_active"), F.when(c % 5 == 0, start + F.make_dt_interval((c % 800).cast("int"))).alias("license_expires_at"))


def cross_market_mapping(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    keyed = li.groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("hits"), F.max(F.col("l_orderkey") % 60 + 40).alias("confidence"), F.max("l_returnflag").alias("flag"), F.max("l_shipdate").alias("updated_at")
    )
    return keyed.select(
        pick(MONITORED, F.col("l_partkey")).alias("source_marketplace"), F.col("l_partkey").alias("source_product_id"), pick(WATCHED, F.col("l_suppkey")).alias("target_marketplace"),
        F.col("l_suppkey").alias("target_product_id"), "confidence", "hits", (F.col("l_suppkey") % 3).alias("rank"),
        F.when(F.col("flag") == "A", "active").when(F.col("flag") == "N", "unverified").otherwise("disputed").alias("status"),
        pick(("auto", "manual", "multi_user"), F.col("hits")).alias("evidence"), (F.col("hits") % 5).alias("fail_count"), "updated_at",
    )


def price_cache(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(pick(WATCHED, s).alias("marketplace"), s.alias("product_id"), F.col("s_acctbal").alias("price"), F.concat(F.lit("https://shop.example/"), s).alias("url"))


def offers(spark: SparkSession, d: str) -> DataFrame:
    """One row a product and marketplace: the newest line item's price."""
    li = table(spark, d, "lineitem").select("l_partkey", pick(WATCHED, F.col("l_suppkey")).alias("marketplace"), "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    newest = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    last = li.groupBy("l_partkey", "marketplace").agg(F.max_by(F.struct("l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_orderkey"), newest).alias("m"))
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("title"), "p_retailprice", "p_brand", "p_type")
    return last.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("product"), "marketplace", "title", F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("reference_price"),
        F.when(F.col("m.l_orderkey") % 7 != 0, F.col("m.l_extendedprice") / F.col("m.l_quantity")).alias("price"), (F.col("m.l_orderkey") % 61 + 40).alias("confidence"),
        (F.col("m.l_orderkey") % 50 / 10.0).cast("double").alias("rating"), F.when(F.col("m.l_returnflag") == "A", "verified").when(F.col("m.l_returnflag") == "N", "probable").otherwise("needs_choice").alias("status"),
    )


def _sql_pick(values: tuple[str, ...], number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][(({number}) % {len(values)} + 1)::INT]"


SQL = {
    "search_metrics": f"""SELECT {_sql_pick(WATCHED, 'user_id')} AS marketplace, 'q' || user_id AS search_query, event_type <> 'error' AS success,
      floor(value * 10)::BIGINT AS response_time_ms, ts AS created_at FROM events""",
    "ai_request_log": f"""SELECT {_sql_pick(PROVIDERS, 'user_id')} AS provider, 'm' || user_id % 4 AS model, CASE WHEN user_id % 4 <> 0 THEN 'p' || user_id % 3 END AS pipeline,
      event_type <> 'error' AS success, floor(value * 10)::BIGINT AS duration_ms, CASE WHEN user_id % 6 <> 0 THEN user_id END AS prompt_tokens,
      CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS completion_tokens, event_id % 3 = 0 AS web_research_used, event_id % 6 = 0 AS web_research_cached, ts AS created_at FROM events""",
    "telemetry_events": f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level, {_sql_pick(NAMES, 'event_id')} AS name,
      CASE WHEN user_id % 7 <> 6 THEN {_sql_pick(WATCHED, 'user_id')} END AS marketplace, CASE WHEN event_id % 4 <> 3 THEN event_type <> 'error' END AS success,
      floor(value * 10)::BIGINT AS elapsed_ms, CASE WHEN user_id % 2 = 0 THEN 'E' || user_id % 5 END AS error_code, user_id AS install_id,
      {_sql_pick(SOURCES, 'event_id')} AS p_source, {_sql_pick(REASONS, 'user_id')} AS p_failure_reason, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'error' END AS p_outcome,
      {_sql_pick(PROVIDERS, 'user_id')} AS p_provider, {_sql_pick(REASONS, 'event_id')} AS p_reason, ts AS created_at FROM events""",
    "edge_request_log": "SELECT event_id, event_type AS endpoint, user_id, ts AS created_at FROM events",
    "match_feedback": """SELECT event_type IN ('purchase', 'signup') AS accepted, ts AS created_at, CASE WHEN user_id % 9 <> 0 THEN user_id END AS user_id,
      floor(least(100.0::DOUBLE, value))::BIGINT AS match_confidence, ' FP' || user_id % 40 AS fingerprint FROM events""",
    "price_history": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id, l_suppkey % 2 AS user_id,
      {_sql_pick(WATCHED, 'l_suppkey')} AS marketplace, p_brand AS product_id, l_extendedprice / l_quantity AS price, l_shipdate AS recorded_at FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tracked_products": f"""SELECT o_orderkey AS id, o_custkey AS user_id, {_sql_pick(MONITORED, 'o_orderkey')} AS marketplace, (o_orderkey % 200)::VARCHAR AS product_id,
      CASE WHEN o_orderkey % 5 <> 0 THEN 'https://shop.example/product/item-' || o_orderkey % 200 END AS product_url, o_totalprice * 0.9::DOUBLE AS target_price, o_totalprice AS last_price,
      CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS last_checked, o_orderstatus = 'F' AS deleted, o_orderkey % 6 AS consecutive_unavailable_count,
      o_orderpriority = '1-URGENT' AS priority, o_orderdate AS updated_at FROM orders""",
    "alert_settings": """SELECT c_custkey AS user_id, 'chat' || c_custkey % 900 AS telegram_chat_id, c_mktsegment <> 'BUILDING' AS notifications_enabled, c_custkey % 3 <> 0 AS server_monitoring,
      c_custkey % 4 <> 0 AS telegram_enabled, 100.0::DOUBLE AS min_drop_rub, (c_custkey % 5)::DOUBLE AS min_drop_percent, c_acctbal AS updated_mark FROM customer""",
    "user_premium": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1996-01-01' + to_days((c_custkey % 900)::INT) END AS expires_at,
      CASE WHEN c_custkey % 6 <> 3 THEN c_custkey END AS license_key_id FROM customer WHERE c_custkey % 3 = 0""",
    "license_keys": """SELECT c_custkey AS id, c_custkey % 7 <> 0 AS is_active, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '1996-01-01' + to_days((c_custkey % 800)::INT) END AS license_expires_at FROM customer""",
    "cross_market_mapping": f"""SELECT {_sql_pick(MONITORED, 'l_partkey')} AS source_marketplace, l_partkey AS source_product_id, {_sql_pick(WATCHED, 'l_suppkey')} AS target_marketplace,
      l_suppkey AS target_product_id, max(l_orderkey % 60 + 40) AS confidence, count(*) AS hits, l_suppkey % 3 AS rank,
      CASE max(l_returnflag) WHEN 'A' THEN 'active' WHEN 'N' THEN 'unverified' ELSE 'disputed' END AS status, {_sql_pick(('auto', 'manual', 'multi_user'), 'count(*)')} AS evidence,
      count(*) % 5 AS fail_count, max(l_shipdate) AS updated_at FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "price_cache": f"SELECT {_sql_pick(WATCHED, 's_suppkey')} AS marketplace, s_suppkey AS product_id, s_acctbal AS price, 'https://shop.example/' || s_suppkey AS url FROM supplier",
    "offers": f"""SELECT p_partkey AS product, marketplace, concat_ws(' ', p_brand, p_name, p_type) AS title, p_brand AS brand, p_type AS category, p_retailprice AS reference_price,
      CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice / l_quantity END AS price, l_orderkey % 61 + 40 AS confidence, ((l_orderkey % 50) / 10.0)::DOUBLE AS rating,
      CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'probable' ELSE 'needs_choice' END AS status
      FROM (SELECT *, {_sql_pick(WATCHED, 'l_suppkey')} AS marketplace, row_number() OVER (PARTITION BY l_partkey, {_sql_pick(WATCHED, 'l_suppkey')}
        ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE rn = 1""",
}


def with_views(sql: str) -> str:
    """The SQL with a common table for each relation that it names."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in used)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


#: What listings are made of: leads name a product, the others vary it.
LEADS = (
    "Смартфон Apple iPhone 15 Pro Max", "Apple iPhone 15", "Смартфон Apple iPhone 14", "Чехол для iPhone 15 силиконовый", "Смартфон Xiaomi Redmi Note 13", "Redmi Note 13 Pro", "Samsung Galaxy A55", "Google Pixel 9a", "Google Pixel 9 Pro",
    "Геймпад Sony DualSense для PlayStation 5", "Игровая приставка Sony PlayStation 5 Slim", "Ноутбук ASUS VivoBook X1504VA", "Ноутбук Lenovo IdeaPad L3-15", "Apple MacBook Air M2", "Apple MacBook Pro M2", "Видеокарта Palit GeForce RTX 4070",
    "Моноблок HP All-in-One", "Мини-ПК Intel NUC", "Телевизор Haier Smart TV S1", "Монитор LG UltraGear", "Наушники Xiaomi Redmi Buds 5", "Наушники Samsung Galaxy Buds 2", "Apple AirPods Pro 2", "Sony WH-1000XM5", "Sony WH-1000XM4",
    "Kingston Canvas Go Plus microSDXC Gen4", "Kingston Canvas Select Plus microSDXC Gen3", "Canon EOS 650D", "Nikon D5100", "Аккумулятор для Nikon D5100", "Картридж HP 12A для LaserJet 1020", "Капсулы для кофемашины Nespresso Lungo",
    "Робот-пылесос Roborock S8 Pro Ultra", "Фильтр для Dyson V15", "Фен Dyson Supersonic HD07", "Дрель Bosch GSB 18V-50", "Шампунь Head & Shoulders Ментол 400 мл", "Гель для стирки Persil 1,5 л", "Кроссовки Nike Air кожа", "Корм для кошек Whiskas 12 шт",
)
MEMORIES = ("128GB", "256 ГБ", "8/256 ГБ", "12+512GB", "1 ТБ", "")
VARIANTS = ("чёрный", "white", "синий", "midnight", "Graphite original", "новый", "refurbished", "USB-C", "lightning", "реплика", "Global", "ростест", "eSIM only", "digital", "размер 42", "size XL, хлопок", "2 кг", "citrus fresh", "women", "kit 18-55mm f3.5")


def listings(spark: SparkSession, d: str) -> DataFrame:
    """A title for each part: a lead, memory, a variant and the part's own name; its specs and price."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("product"), F.concat_ws(" ", pick(LEADS, k), pick(MEMORIES, F.expr("p_partkey div 3")), pick(VARIANTS, F.expr("p_partkey div 7")), F.col("p_name")).alias("title"),
        F.when(k % 6 == 0, F.lit("Артикул: AB1234, 3.5 mm")).alias("specs"), F.col("p_retailprice").alias("price"), F.pmod(F.expr(f"p_partkey div {len(LEADS)}"), F.lit(5)).alias("store"),
    )


def found_listings(spark: SparkSession, d: str) -> DataFrame:
    """Search results: four candidates for each listing, in order; every second one has the same lead."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").agg(F.max("p_partkey")).scalar()
    step = lambda i: F.pmod(k - 1 + len(LEADS) * (i * i + 1) + (i % 2) * i, n) + 1
    pairs = table(spark, d, "part").select(k.alias("reference"), F.posexplode(F.array(*[step(F.lit(i)) for i in range(4)])).alias("position", "candidate"))
    return pairs.where("reference <> candidate")


SQL |= {
    "listings": f"""SELECT p_partkey AS product, concat_ws(' ', {_sql_pick(LEADS, 'p_partkey')}, {_sql_pick(MEMORIES, 'p_partkey // 3')}, {_sql_pick(VARIANTS, 'p_partkey // 7')}, p_name) AS title,
      CASE WHEN p_partkey % 6 = 0 THEN 'Артикул: AB1234, 3.5 mm' END AS specs, p_retailprice AS price, p_partkey // {len(LEADS)} % 5 AS store FROM part""",
}
