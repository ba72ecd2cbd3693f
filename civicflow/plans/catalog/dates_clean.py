"""Catalogue: date features (F1-F4) and cleaning / coercion / rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import functions as cf
from civicflow import sources
from civicflow.operators import clean, dates
from civicflow.plans.catalog import register
from civicflow.session import table

AS_OF = "2002-01-01 00:00:00"


@register("date_features", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(month(ts) AS INTEGER) AS ts_month,
       CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek
FROM events""")
def date_features(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return dates.add_date_features(ev, ["ts"]).select("event_id", "ts_hour", "ts_month", "ts_dayofweek")


@register("duration_days", """
SELECT l_orderkey, l_linenumber,
       round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 * 100.0, 0) / 100.0 AS duration_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def duration_days(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    j = dates.add_duration_days(j, "o_orderdate", "l_shipdate")
    return clean.round_columns(j, ["duration_days"], 2).select("l_orderkey", "l_linenumber", "duration_days")


@register("negative_duration_filter", """
SELECT l_orderkey, l_linenumber,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate + INTERVAL 30 DAY)) / 86400000000.0 AS duration_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE (epoch_us(l_shipdate) - epoch_us(o_orderdate + INTERVAL 30 DAY)) >= 0""")
def negative_duration_filter(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("due"))
    j = dates.add_duration_days(li.join(o, li.l_orderkey == o.o_orderkey), "due", "l_shipdate")
    return clean.drop_negative(j, "duration_days").select("l_orderkey", "l_linenumber", "duration_days")


@register("age_days_asof", f"""
SELECT o_orderkey, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400000000.0 AS age_days
FROM orders""")
def age_days_asof(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return dates.add_age_days(o, "o_orderdate", AS_OF).select("o_orderkey", "age_days")


@register("year_status_filter", """
SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS order_year
FROM orders
WHERE year(o_orderdate) IN (1996, 1997, 1998) AND o_orderpriority IS NOT NULL
  AND o_orderstatus = 'F' AND o_totalprice > 100000""")
def year_status_filter(spark, sf):
    """B3 on files with a zone map, and B4, B5, B24."""
    path = sources.scratch_path(spark, "orders-zones")
    sources.write_with_zones(table(spark, sf, "orders"), "o_orderdate", path)
    o = sources.read_zones(spark, path, "o_orderdate", [1996, 1997, 1998])
    keep = F.col("o_orderpriority").isNotNull() & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return o.filter(keep).select("o_orderkey", "o_orderstatus", "o_totalprice",
                                 F.year("o_orderdate").alias("order_year"))


_SPOILED_TEXT = """CASE WHEN o_orderkey % 7 = 0 THEN 'not a date'
            ELSE strftime(o_orderdate, '%m/%d/%Y %I:%M:%S %p') END"""


@register("fixed_format_parse", f"""
SELECT o_orderkey, raw_text, try_strptime(raw_text, '%m/%d/%Y %I:%M:%S %p') AS parsed
FROM (SELECT o_orderkey, {_SPOILED_TEXT} AS raw_text FROM orders)""")
def fixed_format_parse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", cf.TICKET_TS_FORMAT))
    return o.select("o_orderkey", raw.alias("raw_text")).withColumn("parsed", cf.parse_fixed_timestamp("raw_text"))


_DIRTY_TYPE = """CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  '
            WHEN event_id % 17 = 0 THEN 'NaN' ELSE event_type END"""


def _dirty_type():
    e = F.col("event_id")
    return (F.when(e % 11 == 0, F.lit(None).cast("string")).when(e % 13 == 0, F.lit("  "))
             .when(e % 17 == 0, F.lit("NaN")).otherwise(F.col("event_type")))


@register("missing_like_default", f"""
SELECT event_id, raw_type,
       CASE WHEN raw_type IS NULL OR trim(raw_type) = '' OR lower(raw_type) = 'nan' THEN 'none' ELSE raw_type END
         AS event_type_clean
FROM (SELECT event_id, {_DIRTY_TYPE} AS raw_type FROM events)""")
def missing_like_default(spark, sf):
    ev = table(spark, sf, "events").select("event_id", _dirty_type().alias("raw_type"))
    return ev.withColumn("event_type_clean", cf.default_if_missing("raw_type", "none"))


_KEY_TEXT = """CASE WHEN event_id % 10 = 1 THEN json_extract_string(props, '$.k') || '.0'
            WHEN event_id % 10 = 2 THEN json_extract_string(props, '$.k') || '-123'
            WHEN event_id % 10 = 3 THEN ''
            WHEN event_id % 10 = 4 THEN NULL
            WHEN event_id % 10 = 5 THEN json_extract_string(props, '$.k') || '.5'
            ELSE json_extract_string(props, '$.k') END"""


@register("key_drop_and_coerce", f"""
SELECT event_id, key_text,
       CASE WHEN try_cast(key_text AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(key_text AS DOUBLE))
                 AND try_cast(key_text AS DOUBLE) = floor(try_cast(key_text AS DOUBLE))
            THEN CAST(try_cast(key_text AS DOUBLE) AS BIGINT) END AS key_int,
       CASE WHEN regexp_matches(key_text, '^[0-9]+$') THEN CAST(key_text AS BIGINT) ELSE 0 END AS key_digits
FROM (SELECT event_id, {_KEY_TEXT} AS key_text FROM events)
WHERE key_text IS NOT NULL AND key_text <> ''""")
def key_drop_and_coerce(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id") % 10
    text = (F.when(e == 1, F.concat(k, F.lit(".0"))).when(e == 2, F.concat(k, F.lit("-123")))
             .when(e == 3, F.lit("")).when(e == 4, F.lit(None).cast("string"))
             .when(e == 5, F.concat(k, F.lit(".5"))).otherwise(k))
    t = clean.drop_missing_key(ev.select("event_id", text.alias("key_text")), "key_text")
    return t.select("event_id", "key_text", cf.to_int_or_null("key_text").alias("key_int"),
                    cf.digits_or_zero("key_text").alias("key_digits"))


@register("clip_share", """
SELECT l_orderkey, l_linenumber, l_discount * 12.0 - 0.1 AS share_raw,
       CASE WHEN l_discount IS NULL THEN NULL
            ELSE least(greatest(l_discount * 12.0 - 0.1, 0.0), 1.0) END AS share_clipped
FROM lineitem""")
def clip_share(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             (F.col("l_discount") * 12.0 - 0.1).alias("share_raw"))
    return li.withColumn("share_clipped", F.col("share_raw")).transform(
        lambda d: clean.clip_columns(d, ["share_clipped"], 0.0, 1.0))


@register("round2", """
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / l_quantity * 100.0, 0) / 100.0 AS unit_price
FROM lineitem""")
def round2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    return clean.round_columns(li, ["unit_price"], 2)


@register("rename_all", """
SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand_name, p_retailprice AS retail_price
FROM part""")
def rename_all(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("part key"), F.col("p_name").alias("part name"),
                                        F.col("p_brand").alias("brand name"),
                                        F.col("p_retailprice").alias("retail price"))
    return clean.clean_column_names(p)


@register("select_order", """
SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def select_order(spark, sf):
    li = table(spark, sf, "lineitem")
    return clean.select_features(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], target="l_returnflag")


@register("alias_map", """
SELECT c_custkey,
       CASE upper(trim(c_mktsegment)) WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'MACHINERY' THEN 'MACHINES'
            ELSE upper(trim(c_mktsegment)) END AS segment
FROM customer""")
def alias_map(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", cf.normalize_key("c_mktsegment").alias("segment"))
    return c.withColumn("segment", cf.alias_or_self("segment", {"AUTOMOBILE": "AUTO", "MACHINERY": "MACHINES"}))


# Fixed value: the event types a well-formed event may carry in these checks.
_KNOWN_TYPES = ["click", "view", "purchase", "signup"]


def _event_rules():
    return [
        ("hour_range", cf.hour_of("ts").between(0, 23)),
        ("value_non_negative", F.col("value") >= 0),
        ("value_below_400", F.col("value") < 400),
        clean.enum_rule("event_type", _KNOWN_TYPES),
        ("user_positive", F.col("user_id") > 0),
    ]


_RULE_SQL = [
    ("hour_range", "hour(ts) BETWEEN 0 AND 23"),
    ("value_non_negative", "value >= 0"),
    ("value_below_400", "value < 400"),
    ("event_type_in_set", "event_type IN ('click', 'view', 'purchase', 'signup')"),
    ("user_positive", "user_id > 0"),
]


@register("rule_report", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(sum(CASE WHEN coalesce({p}, false) THEN 0 ELSE 1 END) AS BIGINT) AS violations, "
    f"CAST(count(*) AS BIGINT) AS rows FROM events" for n, p in _RULE_SQL))
def rule_report(spark, sf):
    ev = table(spark, sf, "events")
    return clean.rule_report(ev, _event_rules())


@register("quarantine", f"""
SELECT event_id, n_failed = 0 AS is_valid, n_failed, failed
FROM (SELECT event_id,
             {' + '.join(f'(CASE WHEN coalesce({p}, false) THEN 0 ELSE 1 END)' for _, p in _RULE_SQL)} AS n_failed,
             concat_ws(',', {', '.join(f"CASE WHEN coalesce({p}, false) THEN NULL ELSE '{n}' END" for n, p in _RULE_SQL)})
               AS failed
      FROM events)""")
def quarantine(spark, sf):
    ev = table(spark, sf, "events")
    q = clean.quarantine(ev, _event_rules())
    return q.select("event_id", "is_valid", F.size("failed_rules").alias("n_failed"),
                    F.concat_ws(",", "failed_rules").alias("failed"))
