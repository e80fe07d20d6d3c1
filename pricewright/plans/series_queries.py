"""Queries over price histories and other series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import near_minimum
from ..functions import text as t
from ..operators import series as s
from ..registry import query
from ..sources import relations as r
from ..sources.relations import as_of, micros, with_views

NOW = "(SELECT max(recorded_at) FROM price_history)"
TIERED = f"""tiered AS (SELECT *, CASE WHEN recorded_at >= {NOW} - INTERVAL 30 DAY THEN 'raw' WHEN recorded_at >= {NOW} - INTERVAL 365 DAY THEN 'week' ELSE 'month' END AS tier FROM price_history),
kept AS (SELECT *, CASE tier WHEN 'week' THEN date_trunc('week', recorded_at) WHEN 'month' THEN date_trunc('month', recorded_at) ELSE recorded_at END AS bucket FROM tiered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, marketplace, product_id, tier, bucket ORDER BY price, recorded_at, id) AS low,
  row_number() OVER (PARTITION BY user_id, marketplace, product_id, tier, bucket ORDER BY price DESC, recorded_at, id) AS high FROM kept)"""


@query("m3_compaction", with_views(f"WITH {TIERED} SELECT id, tier, price FROM ranked WHERE tier = 'raw' OR low = 1 OR high = 1"))
def m3(spark, d):
    """Points that compaction keeps (w2, x63; what it deletes is the rest: m1, m2)."""
    history = r.price_history(spark, d)
    return s.compacted(history, r.newest_price(spark, d)).select("id", "tier", "price")


@query("m1_m2_deleted", with_views(f"WITH {TIERED} SELECT tier, count(*) AS deleted FROM ranked WHERE NOT (tier = 'raw' OR low = 1 OR high = 1) GROUP BY 1"))
def m1(spark, d):
    """How many points compaction deletes by tier: what is in the relation less what stays (j4), counted by bucket."""
    return s.compacted_away(r.price_history(spark, d), r.newest_price(spark, d))


MINIMA = f"""minima AS (SELECT user_id, marketplace, product_id, min(price) FILTER (recorded_at >= {NOW} - INTERVAL 30 DAY) AS min30, min(price) FILTER (recorded_at >= {NOW} - INTERVAL 90 DAY) AS min90,
  min(price) AS min365, count(*) FILTER (recorded_at >= {NOW} - INTERVAL 90 DAY) AS points90 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY recorded_at DESC, id) AS n
  FROM price_history WHERE recorded_at >= {NOW} - INTERVAL 365 DAY) WHERE n <= 500 AND price > 0 GROUP BY 1, 2, 3)"""


@query("a21_price_minima", with_views(f"WITH {MINIMA} SELECT * FROM minima"))
def a21(spark, d):
    """Minima of each product's newest 500 points."""
    history = r.price_history(spark, d)
    return s.price_minima(history, r.newest_price(spark, d))


NEAR = "CASE WHEN coalesce(points90, 0) < 3 OR min90 IS NULL OR NOT min90 > 0 OR NOT {p} > 0 THEN 'insufficient' WHEN ({p} - min90) / min90 * 100 <= 3 THEN 'near_min' WHEN ({p} - min90) / min90 * 100 <= 10 THEN 'below_avg' WHEN ({p} - min90) / min90 * 100 <= 25 THEN 'above_avg' ELSE 'far' END"


@query("d43_near_minimum", with_views(f"""WITH {MINIMA}, last AS (SELECT * FROM (SELECT user_id, marketplace, product_id, price, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY recorded_at DESC, id) AS n FROM price_history) WHERE n = 1)
SELECT user_id, marketplace, product_id, price, {NEAR.format(p='price')} AS near FROM last LEFT JOIN minima USING (user_id, marketplace, product_id)"""))  # fmt: skip
def d43(spark, d):
    """Each product's newest price against its 90-day minimum."""
    history = r.price_history(spark, d)
    last = s.newest(history, s.KEY, F.desc("recorded_at"), F.col("id")).select(*s.KEY, "price")
    return last.join(a21(spark, d), s.KEY, "left").select(*s.KEY, "price", near_minimum(F.col("price"), F.col("min90"), F.coalesce("points90", F.lit(0))).alias("near"))


STATS = """cur AS (SELECT marketplace, product_id, price AS now, price * 1.3::DOUBLE AS strike FROM (SELECT *, row_number() OVER (PARTITION BY marketplace, product_id ORDER BY recorded_at DESC, id) AS n FROM price_history) WHERE n = 1),
st AS (SELECT h.marketplace, h.product_id, any_value(now) AS now, min(price) AS low, max(price) AS high, floor(avg(price) + 0.5::DOUBLE)::BIGINT AS mean, count(*) AS points,
  bool_or(abs(price - strike) / strike <= 0.02) AS seen FROM price_history h JOIN cur c ON h.marketplace = c.marketplace AND h.product_id = c.product_id GROUP BY 1, 2)"""


@query("d44_insights", with_views(f"""WITH {STATS} SELECT marketplace, product_id, low AS min_price, high AS max_price, mean AS avg_price, points,
CASE WHEN NOT seen AND points < 5 THEN 'unconfirmed_strikethrough' WHEN NOT seen THEN 'fake_discount' WHEN points < 2 THEN 'average' WHEN now <= low * 1.02::DOUBLE THEN 'great_deal'
WHEN now < mean * 0.97::DOUBLE THEN 'good_price' WHEN now >= high * 0.98::DOUBLE THEN 'high_price' ELSE 'average' END AS kind FROM st"""))  # fmt: skip
def d44(spark, d):
    """Price insight of each product's newest price (a22 summary, d45 strike price seen), with a strike price 30 % above it."""
    history = r.price_history(spark, d)
    key = ["marketplace", "product_id"]
    now = s.newest(history, key, F.desc("recorded_at"), F.col("id")).select(*key, F.col("price").alias("current_price"), (F.col("price") * 1.3).alias("old_price"))
    return s.insights(history, key, now, few=5)


E_NOW = "(SELECT max(ts) FROM events)"


@query("j8_nearest", f"""SELECT user_id, value, away FROM (SELECT user_id, value, abs(epoch_us(ts) - epoch_us({E_NOW} - INTERVAL 24 HOUR)) AS away,
row_number() OVER (PARTITION BY user_id ORDER BY abs(epoch_us(ts) - epoch_us({E_NOW} - INTERVAL 24 HOUR)), ts DESC, value) AS n FROM events WHERE ts >= {E_NOW} - INTERVAL 48 HOUR AND value > 0) WHERE n = 1 AND away <= 129600000000""")  # fmt: skip
def j8(spark, d):
    """As-of join: each user's value nearest to 24 hours ago, at most 36 hours from it."""
    events = r.table(spark, d, "events")
    now = as_of(events, "ts")
    return s.nearest(events, ["user_id"], "ts", "value", now - F.expr("INTERVAL '24' HOUR"), now - F.expr("INTERVAL '48' HOUR"), 36 * s.HOUR)


@query("d46_digest", with_views(f"""
WITH {MINIMA}, items AS (SELECT * FROM (SELECT user_id, marketplace, product_id, price AS last_price, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY recorded_at DESC, id) AS n FROM price_history) WHERE n = 1),
before AS (SELECT user_id, marketplace, product_id, price AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY abs(epoch_us(recorded_at) - epoch_us({NOW} - INTERVAL 24 HOUR)), recorded_at DESC, price) AS n,
  abs(epoch_us(recorded_at) - epoch_us({NOW} - INTERVAL 24 HOUR)) AS away FROM price_history WHERE recorded_at >= {NOW} - INTERVAL 48 HOUR AND price > 0) WHERE n = 1 AND away <= 129600000000)
SELECT user_id, marketplace, product_id, last_price, CASE WHEN value IS NULL THEN 'unknown' WHEN last_price - value <= -50 THEN 'down' WHEN last_price - value >= 50 THEN 'up' ELSE 'flat' END AS move,
  last_price - value AS delta, {NEAR.format(p='last_price')} AS near FROM items LEFT JOIN before USING (user_id, marketplace, product_id) LEFT JOIN minima USING (user_id, marketplace, product_id)"""))  # fmt: skip
def d46(spark, d):
    """The daily digest of every product: j8, a21 and d43 in one plan."""
    history = r.price_history(spark, d)
    now = r.newest_price(spark, d)
    items = s.newest(history, s.KEY, F.desc("recorded_at"), F.col("id")).select(*s.KEY, F.col("price").alias("last_price"))
    before = s.nearest(history, s.KEY, "recorded_at", "price", now - F.expr("INTERVAL '24' HOUR"), now - F.expr("INTERVAL '48' HOUR"), 36 * s.HOUR)
    return s.digest(items, before, s.price_minima(history, now), s.KEY)


@query("s9_cache_read", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND value > 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")
def s9(spark, d):
    """Newest value of each key if it is priced and at most six hours old."""
    events = r.table(spark, d, "events")
    last = s.newest(events, ["user_id"], F.desc("ts"), F.desc("event_id")).where("value > 0")
    return s.fresh(last, "ts", as_of(events, "ts"), "'6' HOUR").select("user_id", "event_id", "value")


@query("s10_m7_upsert", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, fresh DESC, event_id DESC) AS n
FROM (SELECT *, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS fresh FROM events)) WHERE n = 1""")  # fmt: skip
def s10(spark, d):
    """Merge of odd events into even ones on (user_id, event_type): last write wins."""
    events = r.table(spark, d, "events")
    both = events.where("event_id % 2 = 0").withColumn("fresh", F.lit(0)).unionByName(events.where("event_id % 2 = 1").withColumn("fresh", F.lit(1)))
    return s.newest(both, ["user_id", "event_type"], F.desc("ts"), F.desc("fresh"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("s8_last_points", """WITH l AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM l WHERE pv IS NULL OR pv <> value OR ts - pt >= INTERVAL 5 MINUTE) WHERE n <= 100""")  # fmt: skip
def s8(spark, d):
    """Points that differ from the one before or are five minutes younger (s7), the last 100 of each key."""
    key = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    events = r.table(spark, d, "events").withColumn("pv", F.lag("value").over(key)).withColumn("pt", F.lag("ts").over(key))
    kept = events.where(F.col("pv").isNull() | (F.col("pv") != F.col("value")) | (micros(F.col("ts")) - micros(F.col("pt")) >= 300_000_000))
    return s.newest(kept, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"), keep=100).select("user_id", "event_type", "event_id")


@query("s12_serp_cache", "SELECT event_id, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 45 MINUTE AND event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 80")
def s12(spark, d):
    """The newest 80 cacheable entries of the last 45 minutes (a bounded cache)."""
    events = r.table(spark, d, "events").where("event_type <> 'error'")
    return s.fresh(events, "ts", as_of(r.table(spark, d, "events"), "ts"), "'45' MINUTE").orderBy(F.desc("ts"), "event_id").limit(80).select("event_id", "value")


@query("w4_latest_n", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def w4(spark, d):
    """The newest 20 points of each key."""
    return s.newest(r.table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"), keep=20).select("user_id", "event_id", "value")


@query("m5_f29_retention", """SELECT 'events' AS relation, count(*) AS purged FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY""")  # fmt: skip
def m5(spark, d):
    """Rows beyond the time to live of each table."""
    events, orders, items = (r.table(spark, d, t) for t in ("events", "orders", "lineitem"))
    return s.purge_counts({
        "events": (events, "ts", as_of(events, "ts"), "'7' DAY"), "orders": (orders, "o_orderdate", as_of(orders, "o_orderdate"), "'90' DAY"),
        "lineitem": (items, "l_shipdate", as_of(items, "l_shipdate"), "'30' DAY"),
    })


@query("w6_a31_rolling", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS recent,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) > 3 AS limited FROM events""")  # fmt: skip
def w6(spark, d):
    """Requests of each user in the trailing hour, and whether they exceed three."""
    hour = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)
    counted = r.table(spark, d, "events").select("event_id", "user_id", micros(F.col("ts")).alias("t")).withColumn("recent", F.count(F.lit(1)).over(hour))
    return counted.select("event_id", "recent", (F.col("recent") > 3).alias("limited"))


@query("a32_daily_cap", "SELECT user_id, count(*) AS today, count(*) >= 10 AS capped FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events)) GROUP BY 1")
def a32(spark, d):
    """Requests of each user since midnight."""
    events = r.table(spark, d, "events")
    today = events.where(F.col("ts") >= F.date_trunc("day", as_of(events, "ts")).cast("timestamp_ntz"))
    return today.groupBy("user_id").agg(F.count(F.lit(1)).alias("today")).withColumn("capped", F.col("today") >= 10)


@query("w12_first_touch", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM events")
def w12(spark, d):
    """Each user's first event."""
    return r.table(spark, d, "events").select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1).alias("is_first"))


@query("d62_circuit_breaker", """WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, max(n) AS longest, max(n) >= 8 AS open FROM (SELECT user_id, island, count(*) AS n FROM g WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def d62(spark, d):
    """Longest run of errors of each user: gaps and islands."""
    order = ["ts", "event_id"]
    rows = r.table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "bad").orderBy(*order))
    runs = rows.withColumn("island", island).where("bad").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest")).withColumn("open", F.col("longest") >= 8)


#: A product's identity in SQL: the store and the digits of its id.
IDENTITY = r._sql_pick(r.MONITORED, "event_id") + " || ':' || (user_id % 40 + 123456)"


def _folded(keys: str, rows: str, kept: str, columns: str) -> str:
    """SQL of an order-dependent rule: row by row of each key, with the last kept row's time and price; kept says whether a row stays."""
    key, same = keys.split(", "), " AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))
    both = ", ".join(f"o.{k}" for k in key)
    return f"""WITH RECURSIVE o AS (SELECT {keys}, t, price, row_number() OVER (PARTITION BY {keys} ORDER BY t, price) AS n FROM ({rows})),
f AS (SELECT {keys}, n, t, price, true AS kept, t AS last_t, price AS last_p FROM o WHERE n = 1
UNION ALL SELECT {keys}, n, t, price, k, CASE WHEN k THEN t ELSE last_t END, CASE WHEN k THEN price ELSE last_p END FROM (SELECT {both}, o.n, o.t, o.price, f.last_t, f.last_p, {kept} AS k FROM f JOIN o ON {same} AND o.n = f.n + 1))
SELECT {columns} FROM f WHERE kept"""


COOLED = "o.t - f.last_t >= {rest} OR o.price < f.last_p * 0.98::DOUBLE"


@query("w3_kept_points", _folded("user_id", "SELECT user_id, epoch_us(ts) AS t, floor(value / 50)::BIGINT AS price FROM events", "o.price <> f.last_p OR o.t - f.last_t >= 1800000000", "user_id, t, price"))
def w3(spark, d):
    """Points of each user and type with repeats within 30 minutes of the last kept one removed: order-dependent, so folded."""
    points = r.table(spark, d, "events").select("user_id", "event_type", "ts", F.floor(F.col("value") / 50).alias("price"))
    return s.without_repeats(points, ["user_id"], "ts", "price", 30 * 60 * 1_000_000).select("user_id", micros(F.col("ts")).alias("t"), "price")


@query("w7_drop_cooldown", _folded("user_id", "SELECT user_id, epoch_us(ts) AS t, value AS price FROM events WHERE event_type = 'view'", COOLED.format(rest=28_800_000_000), "user_id, t, price"))
def w7(spark, d):
    """Drop alerts of each user that pass an eight-hour cooldown or go deeper by 2 % (w9 is the same rule on the client's key)."""
    drops = r.table(spark, d, "events").where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("price"))
    return s.cooled_alerts(drops, ["user_id"], "ts", "price", 8 * s.HOUR).select("user_id", micros(F.col("ts")).alias("t"), "price")


@query("w8_target_cooldown", _folded("user_id", "SELECT user_id, epoch_us(ts) AS t, value AS price FROM events WHERE event_type = 'purchase'", "o.t - f.last_t >= 86400000000", "user_id, t, price"))
def w8(spark, d):
    """Target alerts of each user, one in 24 hours."""
    drops = r.table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return s.cooled_alerts(drops, ["user_id"], "ts", "price", 24 * s.HOUR, deeper=None).select("user_id", micros(F.col("ts")).alias("t"), "price")


@query("w10_card_opens", _folded("user_id, event_type", "SELECT user_id, event_type, epoch_us(ts) AS t, 0.0 AS price FROM events", "o.t - f.last_t >= 1800000000", "user_id, event_type, t"))
def w10(spark, d):
    """Card openings of each user and type, one in 30 minutes."""
    opens = r.table(spark, d, "events").select("user_id", "event_type", "ts", F.lit(0.0).alias("price"))
    return s.cooled_alerts(opens, ["user_id", "event_type"], "ts", "price", 30 * 60 * 1_000_000, deeper=None).select("user_id", "event_type", micros(F.col("ts")).alias("t"))


@query("s7_appended_points", _folded("user_id, marketplace, product_id", "SELECT user_id % 50 AS user_id, event_type AS marketplace, (event_id % 3)::VARCHAR AS product_id, epoch_us(ts) AS t, floor(value / 100) AS price FROM events WHERE floor(value / 100) > 0", "o.price <> f.last_p OR o.t - f.last_t >= 1800000000", "user_id, marketplace, product_id, t, price"))
def s7(spark, d):
    """Price points as they are appended: none of an unknown price, none that repeats the last stored one within 30 minutes."""
    points = r.table(spark, d, "events").select((F.col("user_id") % 50).alias("user_id"), F.col("event_type").alias("marketplace"), (F.col("event_id") % 3).cast("string").alias("product_id"), "ts", F.floor(F.col("value") / 100).cast("double").alias("price"))
    kept = s.without_repeats(points.where("price > 0"), s.KEY, "ts", "price", 30 * 60 * 1_000_000)
    return kept.select(*s.KEY, micros(F.col("ts")).alias("t"), "price")


@query("w9_client_cooldown", _folded("identity", "SELECT " + IDENTITY + " AS identity, epoch_us(ts) AS t, value AS price FROM events WHERE event_type <> 'error'", COOLED.format(rest=28_800_000_000), "identity, t, price"))
def w9(spark, d):
    """Drops of each product identity (store and bare article, x39), whoever sees them: one in eight hours unless 2 % deeper."""
    store, k = r.pick(r.MONITORED, F.col("event_id")), (F.col("user_id") % 40 + 123456).cast("string")
    raw = F.concat(F.when(store == "wildberries", "WB-").when(store == "ozon", "ozon-").otherwise("ym-"), k)
    drops = r.table(spark, d, "events").where("event_type <> 'error'").select(F.concat_ws(":", store, t.bare_article(store, raw)).alias("identity"), "ts", F.col("value").alias("price"))
    return s.cooled_alerts(drops, ["identity"], "ts", "price", 8 * s.HOUR).select("identity", micros(F.col("ts")).alias("t"), "price")


@query("d46_near_minima", with_views(f"""WITH {MINIMA}, items AS (SELECT * FROM (SELECT user_id, marketplace, product_id, price AS last_price, row_number() OVER (PARTITION BY user_id, marketplace, product_id ORDER BY recorded_at DESC, id) AS n FROM price_history) WHERE n = 1)
SELECT user_id, marketplace, product_id, last_price, min90, round((last_price - min90) / min90 * 100, 6) AS above FROM items JOIN minima USING (user_id, marketplace, product_id) WHERE {NEAR.format(p='last_price')} = 'near_min'"""))
def d46_near(spark, d):
    """The digest's list of products near their 90-day minimum, and how far above it."""
    history = r.price_history(spark, d)
    now = r.newest_price(spark, d)
    items = s.newest(history, s.KEY, F.desc("recorded_at"), F.col("id")).select(*s.KEY, F.col("price").alias("last_price"))
    return s.near_minima(items, s.price_minima(history, now), s.KEY).withColumn("above", F.round("above", 6))
