"""Queries of these operators over the given tables, and their SQL. Owner-specified: no reference lists them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkloom.operators.asof import asof_join
from sparkloom.operators.interval import interval_join
from sparkloom.operators.ordering import with_row_numbers, with_running_total
from sparkloom.operators.sampling import weighted_sample
from sparkloom.operators.sketches import estimates, rolled_up, sketched
from sparkloom.session import written


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, kind, *names):
    return _table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(*names)


def asof_last_order(spark, sf_dir):
    """Each event with its user's last order by then."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    found = asof_join(events, orders, "ts", "o_orderdate", [("user_id", "o_custkey")], ties=["o_orderkey"])
    return found.select("event_id", "o_orderkey", "o_totalprice", "o_orderdate")


def asof_last_order_of_line(spark, sf_dir):
    """Each line with the last order of any customer placed on an earlier day than it was shipped: one time line without a key."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = _table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    found = asof_join(lines, orders, "l_shipdate", "o_orderdate", exact=False, ties=["o_orderkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderkey")


def asof_next_purchase(spark, sf_dir):
    """Each view with its user's next purchase within two days."""
    views = _events(spark, sf_dir, "view", "event_id", "user_id", "ts")
    bought = _events(spark, sf_dir, "purchase", F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("bought"), "value")
    found = asof_join(views, bought, "ts", "bought", ["user_id"], "forward", timedelta(days=2))
    return found.select("event_id", "purchase_id", "value")


def asof_nearest_click(spark, sf_dir):
    """Each error with the click of its user that is nearest in time, within a day."""
    errors = _events(spark, sf_dir, "error", "event_id", "user_id", "ts")
    clicks = _events(spark, sf_dir, "click", F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"))
    return asof_join(errors, clicks, "ts", "clicked", ["user_id"], "nearest", timedelta(days=1)).select("event_id", "click_id")


def interval_open_orders(spark, sf_dir):
    """Pairs of one customer's orders whose times from order to last shipment overlap."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "until")
    other = orders.select("o_custkey", F.col("o_orderkey").alias("other_orderkey"), F.col("o_orderdate").alias("other_from"), F.col("until").alias("other_until"))
    found = interval_join(orders, other, ("o_orderdate", "until"), ("other_from", "other_until"), ["o_custkey"], closed=True)
    return found.filter("o_orderkey < other_orderkey").select("o_orderkey", "other_orderkey")


def interval_errors_after_purchase(spark, sf_dir):
    """For each purchase the errors of any user within five minutes, and their number."""
    bought = _events(spark, sf_dir, "purchase", "event_id", "ts", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("until"))
    errors = _events(spark, sf_dir, "error", F.col("event_id").alias("error_id"), F.col("ts").alias("at"))
    found = interval_join(bought, errors, ("ts", "until"), ("at", "at"), how="left", closed=True)
    return found.groupBy("event_id").agg(F.count("error_id").alias("n_errors"), F.min("error_id").alias("first_error"))


def numbered_lines(spark, sf_dir):
    """The number of each line in one order of all lines by price."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    return with_row_numbers(lines, F.col("price").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), name="place")


def running_revenue(spark, sf_dir):
    """Revenue up to each order, in the order of dates."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    found = with_running_total(orders, F.col("price"), F.col("o_orderdate"), F.col("o_orderkey"), name="revenue")
    return found.select("o_orderkey", F.col("revenue").cast("double").alias("revenue"))


def asof_last_user_turn(spark, sf_dir):
    """Each turn of an assistant with the user's last turn before it in the conversation."""
    turns = _table(spark, sf_dir, "conversations")
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    asked = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"), F.length("text").cast("long").alias("user_chars"))
    return asof_join(said, asked, "turn", "user_turn", ["conv_id"], exact=False).select("conv_id", "turn", "n_chars", "user_turn", "user_chars")


def interval_like_length(spark, sf_dir):
    """For each benchmark item the documents whose length is within a hundredth of its own."""
    n = F.length("text").cast("long")
    items = _table(spark, sf_dir, "benchmark").select("item_id", (n - F.floor(n / 100)).alias("least"), (n + F.floor(n / 100)).alias("most"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"))
    found = interval_join(docs, items, ("n_chars", "n_chars"), ("least", "most"), closed=True)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


def numbered_documents(spark, sf_dir):
    """The number of each document in the order of lengths, and the characters up to it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    order = F.col("n_chars").desc(), F.col("doc_id")
    return with_running_total(with_row_numbers(docs, *order, name="place"), F.col("n_chars"), F.col("place"), name="chars_to_here")


def sample_documents(spark, sf_dir):
    """Forty documents of each language and source, drawn with chances in proportion to their length."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("n_chars"))
    return weighted_sample(docs, ["lang", "source"], "n_chars", 40, ["doc_id"], seed=1)


def sample_orders(spark, sf_dir):
    """A thousand orders of each priority, drawn with chances in proportion to their price."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return weighted_sample(orders, ["o_orderpriority"], "o_totalprice", 1000, ["o_orderkey"], seed=2)


def sketch_ship_days(spark, sf_dir):
    """Days and quantities of shipped lines by flag and status, by month, and of all, from one stored table of sketches; both are few, so the counts are exact."""
    lines = _table(spark, sf_dir, "lineitem")
    dims = {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus"), "month": F.date_format("l_shipdate", "yyyy-MM")}
    table = written(sketched(lines, dims, {"days": F.unix_date(F.col("l_shipdate").cast("date")), "quantities": F.col("l_quantity")}), "ship-days")
    return estimates(rolled_up(table, list(dims), [["l_returnflag", "l_linestatus"], ["month"], []]))


def sketch_words(spark, sf_dir):
    """Different words, and the median and ninth decile of their length, by language and source, by each, and of all documents."""
    docs = _table(spark, sf_dir, "documents")
    words = docs.select("lang", "source", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).filter(F.col("word") != "")
    dims = {"lang": F.col("lang"), "source": F.col("source")}
    table = written(sketched(words, dims, {"words": F.col("word")}, {"length": F.length("word")}), "words")
    found = estimates(rolled_up(table, list(dims), [["lang", "source"], ["lang"], ["source"], []]), (0.5, 0.9))
    return found.select("lang", "source", "level", "n_rows", "n_words", F.col("q_length")[0].alias("median_length"), F.col("q_length")[1].alias("ninth_decile"))


QUERIES = {
    f.__name__: f
    for f in (asof_last_order, asof_last_order_of_line, asof_next_purchase, asof_nearest_click, interval_open_orders, interval_errors_after_purchase, numbered_lines, running_revenue, asof_last_user_turn, interval_like_length, numbered_documents, sample_documents, sample_orders, sketch_ship_days, sketch_words)
}
SQL = {
    "asof_last_order": """
        WITH o AS (
            SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
            FROM orders GROUP BY 1, 2
        )
        SELECT event_id, o_orderkey, o_totalprice, o_orderdate
        FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts >= o_orderdate
    """,
    "asof_last_order_of_line": """
        WITH o AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey
        FROM lineitem ASOF LEFT JOIN o ON l_shipdate > o_orderdate
    """,
    "asof_next_purchase": """
        WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
        p AS (SELECT event_id AS purchase_id, user_id, ts AS bought, value FROM events WHERE event_type = 'purchase')
        SELECT event_id, CASE WHEN bought <= ts + INTERVAL 2 DAYS THEN purchase_id END AS purchase_id, CASE WHEN bought <= ts + INTERVAL 2 DAYS THEN value END AS value
        FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts <= p.bought
    """,
    "asof_nearest_click": """
        WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
        c AS (SELECT event_id AS click_id, user_id, ts AS clicked FROM events WHERE event_type = 'click'),
        b AS (
            SELECT e.event_id, c.click_id, epoch_us(e.ts) - epoch_us(c.clicked) AS apart, c.clicked
            FROM e ASOF JOIN c ON e.user_id = c.user_id AND e.ts >= c.clicked
            UNION ALL
            SELECT e.event_id, c.click_id, epoch_us(c.clicked) - epoch_us(e.ts), c.clicked
            FROM e ASOF JOIN c ON e.user_id = c.user_id AND e.ts <= c.clicked
        ), n AS (SELECT event_id, arg_min(click_id, (apart, clicked)) AS click_id FROM b WHERE apart <= 86400000000 GROUP BY 1)
        SELECT event_id, click_id FROM e LEFT JOIN n USING (event_id)
    """,
    "interval_open_orders": """
        WITH s AS (
            SELECT o_custkey, o_orderkey, o_orderdate, max(l_shipdate) AS until
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING until >= o_orderdate
        )
        SELECT a.o_orderkey, b.o_orderkey AS other_orderkey
        FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate <= b.until AND b.o_orderdate <= a.until
    """,
    "interval_errors_after_purchase": """
        WITH p AS (SELECT event_id, ts, ts + INTERVAL 5 MINUTES AS until FROM events WHERE event_type = 'purchase'),
        e AS (SELECT event_id AS error_id, ts AS at FROM events WHERE event_type = 'error')
        SELECT p.event_id, count(error_id) AS n_errors, min(error_id) AS first_error
        FROM p LEFT JOIN e ON e.at BETWEEN p.ts AND p.until GROUP BY 1
    """,
    "numbered_lines": """
        WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM lineitem)
        SELECT *, row_number() OVER (ORDER BY price DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS place FROM l
    """,
    "running_revenue": """
        SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS revenue
        FROM orders
    """,
    "asof_last_user_turn": """
        WITH a AS (SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE role = 'assistant'),
        u AS (SELECT conv_id, turn AS user_turn, length(text) AS user_chars FROM conversations WHERE role = 'user')
        SELECT a.conv_id, turn, n_chars, user_turn, user_chars FROM a ASOF LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn > u.user_turn
    """,
    "interval_like_length": """
        WITH i AS (SELECT item_id, length(text) AS n FROM benchmark), d AS (SELECT doc_id, length(text) AS n_chars FROM documents)
        SELECT item_id, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(doc_id) AS first_doc
        FROM i JOIN d ON n_chars BETWEEN n - n // 100 AND n + n // 100 GROUP BY 1
    """,
    "numbered_documents": """
        WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars FROM documents)
        SELECT *, row_number() OVER w AS place, CAST(sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars_to_here
        FROM d WINDOW w AS (ORDER BY n_chars DESC, doc_id)
    """,
    "sample_documents": """
        WITH d AS (SELECT doc_id, lang, source, length(text) AS n_chars FROM documents),
        w AS (SELECT *, -ln((CAST('0x' || substr(md5('1|v' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / n_chars AS wait FROM d WHERE n_chars > 0)
        SELECT doc_id, lang, source, CAST(n_chars AS INTEGER) AS n_chars, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY wait) AS INTEGER) AS drawn FROM w QUALIFY drawn <= 40
    """,
    "sample_orders": """
        WITH w AS (
            SELECT o_orderkey, o_orderpriority, o_totalprice,
                   -ln((CAST('0x' || substr(md5('2|v' || o_orderkey), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / o_totalprice AS wait
            FROM orders WHERE o_totalprice > 0
        )
        SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY wait) AS INTEGER) AS drawn FROM w QUALIFY drawn <= 1000
    """,
    "sketch_ship_days": """
        WITH l AS (SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_shipdate AS DATE) AS day, l_quantity FROM lineitem)
        SELECT l_returnflag, l_linestatus, month, CAST(grouping(l_returnflag, l_linestatus, month) AS INTEGER) AS level, count(*) AS n_rows,
               count(DISTINCT day) AS n_days, count(DISTINCT l_quantity) AS n_quantities
        FROM l GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (month), ())
    """,
}
