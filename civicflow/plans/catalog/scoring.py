"""Catalogue: ticket scoring (L1) in batch and as a Structured Stream, with
requests (A9) derived from ``events`` and result records (A10).

Tickets are events joined with ``part``: the part type is the descriptor
group, the brand the descriptor.  zip -> borough uses nation -> region; group
shares are the per-region segment shares; all codes are fitted on the tickets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow import sources
from civicflow.operators import models
from civicflow.operators.joins import literal_table
from civicflow.plans import scoring
from civicflow.plans.catalog import register
from civicflow.plans.catalog.enrich import _DIM_SQL, _SHARE_COLS, _SHARES_SQL, _shares, _zip_dim
from civicflow.plans.catalog.splits import _split_sql
from civicflow.session import cut_lineage, table

AS_OF = "2024-02-01 00:00:00"

# Class names of the event types; class 5 of the rule model has no name.
CLASS_NAMES = [(0, "click"), (1, "view"), (2, "purchase"), (3, "signup"), (4, "error")]
CLASS_GROUPS = [("click", "browse"), ("view", "browse"), ("purchase", "convert"), ("signup", "convert")]


def _ticket_rows(spark, sf):
    """Events with the type and brand of a part."""
    ev = table(spark, sf, "events")
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return ev.join(part, ev.user_id + 1 == part.p_partkey, "left")


_TICKET_SQL = "SELECT e.*, p.p_type, p.p_brand FROM events e LEFT JOIN part p ON e.user_id + 1 = p.p_partkey"


def _training_fields(spark, sf):
    """The request fields as training tickets have them."""
    e = F.col("event_id")
    dim = _zip_dim(spark, sf)
    t = _ticket_rows(spark, sf)
    return t.join(dim, F.col("user_id") % 25 == dim.zip, "left").select(
        F.upper("event_type").alias("Agency"), F.when(e % 4 != 0, F.lit("Residential Building/House")).otherwise(F.lit("Street/Sidewalk")).alias("Location_Type"),
        F.col("borough").alias("Borough"), F.when(e % 6 == 0, F.lit("CAR")).otherwise(F.lit("N/A")).alias("Vehicle_Type"),
        F.col("p_brand").alias("Descriptor"), F.col("p_type").alias("group"))


def _dims(spark, sf) -> scoring.ScoringDims:
    fitted = scoring.fit_dictionaries(_training_fields(spark, sf), group="group")
    return scoring.ScoringDims(
        zip_dim=_zip_dim(spark, sf), shares=_shares(spark, sf), share_cols=_SHARE_COLS, **fitted,
        class_names=literal_table(spark, CLASS_NAMES, "cls int, name string"),
        class_groups=literal_table(spark, CLASS_GROUPS, "name string, grp string"))


def _requests_raw(spark, sf):
    e = F.col("event_id")
    return _ticket_rows(spark, sf).select(
        e.alias("ticket_id"),
        F.when(e % 3 != 0, F.upper("event_type")).alias("Agency"),
        F.when(e % 4 != 0, F.lit("Residential Building/House")).alias("Location_Type"),
        F.when(e % 17 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" "))).alias("Incident_Zip"),
        F.when(e % 6 == 0, F.lit("CAR")).when(e % 7 == 0, F.lit("SUBMARINE")).alias("Vehicle_Type"),
        F.when(e % 11 == 0, F.lit("SOMETHING")).when(e % 13 != 0, F.col("p_type")).alias("Descriptor"),
        F.when(e % 23 == 0, F.lit("yesterday")).when(e % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_date"),
        F.when(e % 19 == 0, F.lit("")).when(e % 29 == 0, F.lit("EUROPE")).alias("Borough"))


def _requests(spark, sf):
    """Requests written as JSON lines and read back with schema + defaults."""
    path = sources.scratch_path(spark, "score-requests")
    sources.write_json(_requests_raw(spark, sf), path)
    return path, sources.read_requests_json(spark, path, as_of=AS_OF)


class RuleModel:
    """A fixed rule in place of a trained model, so that SQL can follow every
    column: class = (zip + hour) mod 6, with two class probabilities."""

    def transform(self, df):
        p = (F.col("zip_code") % 50 + 50) / F.lit(100.0)
        return (df.withColumn("prediction", ((F.col("zip_code") + F.col("created_hour")) % 6).cast("double"))
                  .withColumn("probability", F.array(1 - p, p)))


def _code_sql(field: str) -> str:
    return f"(SELECT {field} AS value, dense_rank() OVER (ORDER BY {field}) - 1 AS code FROM (SELECT DISTINCT {field} FROM training WHERE {field} IS NOT NULL))"


_FEATURES_SQL = f"""
WITH ticket AS ({_TICKET_SQL}), z AS ({_DIM_SQL}), s AS ({_SHARES_SQL}),
  training AS (
  SELECT upper(event_type) AS Agency, CASE WHEN event_id % 4 <> 0 THEN 'Residential Building/House' ELSE 'Street/Sidewalk' END AS Location_Type,
         z.borough AS Borough, CASE WHEN event_id % 6 = 0 THEN 'CAR' ELSE 'N/A' END AS Vehicle_Type, p_brand AS Descriptor, p_type AS grp
  FROM ticket LEFT JOIN z ON user_id % 25 = z.zip),
  brands AS (SELECT Descriptor AS d, count(*) AS n FROM training WHERE Descriptor IS NOT NULL GROUP BY 1 ORDER BY n DESC, d LIMIT 50),
  brand_codes AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS code FROM (
      SELECT d FROM brands UNION SELECT '{scoring.REST}' WHERE (SELECT sum(n) FROM brands) < (SELECT count(*) FROM training))),
  representative AS (SELECT grp, Descriptor AS d FROM (
      SELECT grp, Descriptor, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, Descriptor) AS r
      FROM training WHERE Descriptor IS NOT NULL GROUP BY grp, Descriptor) WHERE r = 1),
  r AS (
  SELECT event_id AS ticket_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END, 'DSNY') AS Agency,
         coalesce(CASE WHEN event_id % 4 <> 0 THEN 'Residential Building/House' END, 'Street/Sidewalk') AS Location_Type,
         CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS zip_text,
         coalesce(CASE WHEN event_id % 6 = 0 THEN 'CAR' WHEN event_id % 7 = 0 THEN 'SUBMARINE' END, 'N/A') AS Vehicle_Type,
         coalesce(CASE WHEN event_id % 11 = 0 THEN 'SOMETHING' WHEN event_id % 13 <> 0 THEN p_type END, 'Straßenzustand') AS grp,
         coalesce(CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END, TIMESTAMP '{AS_OF}') AS created_date,
         CASE WHEN event_id % 19 <> 0 AND event_id % 29 = 0 THEN 'EUROPE' END AS given
  FROM ticket WHERE event_id % 23 <> 0),
  m AS (SELECT {', '.join(f'round_even(avg({c}) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS {c}' for c in _SHARE_COLS)} FROM s),
  f AS (
  SELECT r.*, CASE WHEN regexp_matches(zip_text, '^[0-9]+$') THEN CAST(zip_text AS BIGINT) ELSE 0 END AS zip_code,
         coalesce(given, z.borough, '{scoring.NO_BOROUGH}') AS Borough
  FROM r LEFT JOIN z ON r.zip_text = CAST(z.zip AS VARCHAR))
SELECT f.ticket_id, f.zip_code, f.Borough,
       {', '.join(f'coalesce(s.{c}, m.{c}) AS {c}' for c in _SHARE_COLS)},
       (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(f.created_date)) / 86400000000.0 AS age_days,
       CAST(hour(f.created_date) AS INTEGER) AS created_hour, CAST(month(f.created_date) AS INTEGER) AS created_month,
       CAST(isodow(f.created_date) - 1 AS INTEGER) AS created_dayofweek,
       {', '.join(f"CAST(coalesce({out}.code, -1) AS INTEGER) AS {out}" for out in scoring.CODED.values())},
       coalesce(g.d, '{scoring.REST}') AS descriptor_used,
       CAST(coalesce(dc.code, (SELECT code FROM brand_codes WHERE d = '{scoring.REST}'), 99) AS INTEGER) AS descriptor_code
FROM f LEFT JOIN s ON upper(trim(f.Borough)) = upper(trim(s.region))
CROSS JOIN m
{' '.join(f"LEFT JOIN {_code_sql(field)} {out} ON f.{field} = {out}.value" for field, out in scoring.CODED.items())}
LEFT JOIN representative g ON f.grp = g.grp
LEFT JOIN brand_codes dc ON coalesce(g.d, '{scoring.REST}') = dc.d"""

_FEATURE_COLS = ["ticket_id", "Borough", "descriptor_used", *scoring.FEATURE_ORDER, *_SHARE_COLS]


@register("score_features", _FEATURES_SQL)
def score_features(spark, sf):
    _, req = _requests(spark, sf)
    return scoring.build_features(sources.accepted(req), _dims(spark, sf), AS_OF).select(*_FEATURE_COLS)


@register("rejected_requests", """
SELECT event_id AS ticket_id, 'created_date' AS request_error FROM events WHERE event_id % 23 = 0""")
def rejected_requests(spark, sf):
    """Requests that can't be accepted, with the field at fault."""
    _, req = _requests(spark, sf)
    return sources.rejected(req).select("ticket_id", "request_error")


def _flat(results):
    r = F.col("result")
    return results.select("ticket_id", r.group.alias("group"), r.specific_type.alias("specific_type"),
                          r.confidence.alias("confidence"), r.borough.alias("borough"),
                          r.descriptor_used.alias("descriptor_used"), r.duration_days.alias("duration_days"),
                          *[r.shares[c].alias(c) for c in _SHARE_COLS])


def _values(rows, cols):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")"
                                  for r in rows) + f") AS v({cols})"


_SCORE_SQL = f"""
SELECT f.ticket_id, coalesce(g.grp, '{scoring.NO_GROUP}') AS "group", coalesce(n.name, '{scoring.NO_CLASS}') AS specific_type,
       greatest((f.zip_code % 50 + 50) / 100.0::DOUBLE, 1 - (f.zip_code % 50 + 50) / 100.0::DOUBLE) AS confidence,
       f.Borough AS borough, f.descriptor_used, f.age_days AS duration_days, {', '.join(f'f.{c}' for c in _SHARE_COLS)}
FROM ({_FEATURES_SQL}) f LEFT JOIN (SELECT * FROM {_values(CLASS_NAMES, 'cls, name')}) n ON (f.zip_code + f.created_hour) % 6 = n.cls
LEFT JOIN (SELECT * FROM {_values(CLASS_GROUPS, 'name, grp')}) g ON coalesce(n.name, '{scoring.NO_CLASS}') = g.name"""


@register("score_batch", _SCORE_SQL)
def score_batch(spark, sf):
    """L1 batch: score every request."""
    _, req = _requests(spark, sf)
    return _flat(scoring.score(req, _dims(spark, sf), RuleModel(), AS_OF))


def _streamed(spark, sf, again: bool = False):
    """Folders of results and rejected requests of the stream; ``again``: all request files are delivered twice."""
    from civicflow.streaming import start_scoring
    path, _ = _requests(spark, sf)
    out, bad, checkpoint = (sources.scratch_path(spark, f"score-stream-{n}") for n in ("out", "rejected", "ckpt"))
    dims = _dims(spark, sf)  # fitted once for both deliveries
    for last in range(2 if again else 1):
        if last:
            _requests_raw(spark, sf).write.mode("append").json(path)
        q = start_scoring(spark, path, out, dims, RuleModel(), checkpoint, bad, AS_OF)
        q.awaitTermination()  # until the input is used up; a failed query raises
    return out, bad


@register("score_stream", _SCORE_SQL)
def score_stream(spark, sf):
    """L1 stream: the same scorer over a file stream of requests
    (availableNow trigger), results appended to parquet and read back."""
    return _flat(spark.read.parquet(_streamed(spark, sf)[0]))


@register("score_stream_rejected", """
SELECT event_id AS ticket_id, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS "Agency", 'yesterday' AS created_date, 'created_date' AS request_error
FROM events WHERE event_id % 23 = 0""")
def score_stream_rejected(spark, sf):
    """L1/A9 stream: the other sink, after every file has come twice."""
    return spark.read.parquet(_streamed(spark, sf, again=True)[1]).select("ticket_id", "Agency", "created_date", "request_error")


@register("score_json", f"""
SELECT ticket_id, "group", confidence, {_SHARE_COLS[0]} FROM ({_SCORE_SQL})""")
def score_json(spark, sf):
    """A10: result records as JSON lines, written and read back."""
    _, req = _requests(spark, sf)
    path = sources.scratch_path(spark, "results")
    scoring.score_json(scoring.score(req, _dims(spark, sf), RuleModel(), AS_OF)).write.json(path)
    j = lambda p: F.get_json_object("json", p)
    return spark.read.schema("ticket_id long, json string").json(path).select(
        "ticket_id", j("$.group").alias("group"), j("$.confidence").cast("double").alias("confidence"),
        j(f"$.shares.{_SHARE_COLS[0]}").cast("double").alias(_SHARE_COLS[0]))


@register("score_tree", "SELECT true AS all_scored, true AS same_again, true AS classes_known")
def score_tree(spark, sf):
    """L1 with a trained tree: every accepted request gets a class of the
    training labels, and a second fit gives the same results."""
    dims = _dims(spark, sf).written()
    req = cut_lineage(sources.accepted(_requests(spark, sf)[1]))
    codes = literal_table(spark, [(n, float(c)) for c, n in CLASS_NAMES], "et string, label double")
    ev = table(spark, sf, "events").select(F.col("event_id").alias("ticket_id"), "event_type")
    lab = ev.join(codes, F.col("event_type") == F.col("et")).select("ticket_id", "label")
    train = cut_lineage(models.with_features(scoring.build_features(req, dims, AS_OF).join(lab, "ticket_id"), scoring.feature_columns(dims)))
    first, second = (_flat(scoring.score(req, dims, models.estimator("dt", 14, 5).fit(train), AS_OF)) for _ in range(2))
    same = first.join(second.select("ticket_id", F.col("specific_type").alias("again"), F.col("confidence").alias("c2")), "ticket_id")
    return same.agg((F.count(F.lit(1)) == req.agg(F.count(F.lit(1))).scalar()).alias("all_scored"),
                    F.bool_and((F.col("specific_type") == F.col("again")) & (F.col("confidence") == F.col("c2"))).alias("same_again"),
                    F.bool_and(F.col("specific_type").isin([n for _, n in CLASS_NAMES])).alias("classes_known"))


def _raw_tickets(spark, sf):
    """Raw-ticket-shaped table derived from events (text columns, some blanks)."""
    ev = table(spark, sf, "events")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    dim = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name"))
    e = F.col("event_id")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    ev = ev.join(part, ev.user_id + 1 == part.p_partkey, "left")
    t = ev.join(dim, (F.col("user_id") % 25) == F.col("n_nationkey"), "left")
    return t.select(
        e.alias("ticket_id"),
        F.col("ts").alias("Created Date"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.floor(F.col("value") / 10).cast("int"), F.lit(0), F.lit(0)))
        .alias("Closed Date"),
        F.upper("event_type").alias("Agency"),
        F.col("event_type").alias("Complaint Type"),
        F.col("p_brand").alias("Descriptor"),
        F.when(e % 7 == 0, F.lit(" ")).otherwise(F.lit("Street/Sidewalk")).alias("Location Type"),
        (F.col("user_id") % 25).cast("string").alias("Incident Zip"),
        F.when(e % 9 == 0, F.lit(None)).otherwise(F.col("r_name")).alias("Borough"),
        F.when(e % 4 == 0, F.lit("nan")).otherwise(F.lit("CAR")).alias("Vehicle Type"),
        F.lit("somewhere").alias("Location"))


def _dense_sql(column: str) -> str:
    """Codes of the distinct values in ascending order, null last."""
    return f"(SELECT {column} AS value, row_number() OVER (ORDER BY {column} NULLS LAST) - 1 AS code FROM (SELECT DISTINCT {column} FROM joined))"


_CODED = ("ctype", "agency", "location_type", "vehicle", "borough", "zip")
_PREPARED_SQL = f"""
WITH z AS ({_DIM_SQL}), s AS ({_SHARES_SQL}),
  raw AS (
  SELECT e.event_id AS ticket_id, e.ts AS created, upper(e.event_type) AS agency, e.event_type AS ctype, p.p_brand AS descriptor,
         CASE WHEN e.event_id % 7 = 0 THEN 'Other' ELSE 'Street/Sidewalk' END AS location_type, e.user_id % 25 AS zip,
         CASE WHEN e.event_id % 9 <> 0 THEN z.borough END AS given, CASE WHEN e.event_id % 4 = 0 THEN 'none' ELSE 'CAR' END AS vehicle,
         round_even(floor(e.value / 10) * 3600000000 / 86400000000.0::DOUBLE * 100, 0) / 100 AS days
  FROM events e LEFT JOIN part p ON e.user_id + 1 = p.p_partkey LEFT JOIN z ON e.user_id % 25 = z.zip),
  cleaned AS (SELECT * FROM raw WHERE days IS NULL OR days >= 0),
  q AS (SELECT quantile_cont(days, 0.25) AS q1, quantile_cont(days, 0.75) AS q3 FROM cleaned),
  brands AS (SELECT descriptor AS d, count(*) AS n FROM cleaned WHERE descriptor IS NOT NULL GROUP BY 1 ORDER BY n DESC, d LIMIT 50),
  brand_codes AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS code FROM (
      SELECT d FROM brands UNION SELECT 'sonstiges' WHERE (SELECT sum(n) FROM brands) < (SELECT count(*) FROM cleaned))),
  joined AS (SELECT c.* EXCLUDE (given), coalesce(c.given, z.borough) AS borough, {', '.join(f's.{c}' for c in _SHARE_COLS)}
             FROM cleaned c LEFT JOIN z ON c.zip = z.zip JOIN s ON upper(trim(coalesce(c.given, z.borough))) = upper(trim(s.region)))
SELECT j.ticket_id, {', '.join(f'CAST({c}_c.code AS INTEGER) AS {name}' for c, name in zip(_CODED, ('Complaint_Type', 'Agency', 'Location_Type', 'Vehicle_Type', 'Borough', 'Incident_Zip')))},
       least(greatest(j.days, q.q1 - 1.5 * (q.q3 - q.q1)), q.q3 + 1.5 * (q.q3 - q.q1)) AS duration_days,
       CAST(hour(j.created) AS INTEGER) AS Created_Date_hour, CAST(month(j.created) AS INTEGER) AS Created_Date_month,
       CAST(isodow(j.created) - 1 AS INTEGER) AS Created_Date_dayofweek,
       CAST(coalesce(b.code, (SELECT code FROM brand_codes WHERE d = 'sonstiges')) AS INTEGER) AS Descriptor_encoded,
       {', '.join(f'j.{c}' for c in _SHARE_COLS)}
FROM joined j CROSS JOIN q LEFT JOIN brand_codes b ON j.descriptor = b.d
{' '.join(f'JOIN {_dense_sql(c)} {c}_c ON j.{c} IS NOT DISTINCT FROM {c}_c.value' for c in _CODED)}"""


def _prepared(spark, sf):
    from civicflow.plans.ticket_prep import TicketColumns, prepare_features
    zips = _zip_dim(spark, sf).select(F.col("zip").alias("ZipCode"), F.col("borough").alias("Borough"))
    shares = _shares(spark, sf).withColumnRenamed("region", "Stadtteil")
    return prepare_features(_raw_tickets(spark, sf), zips, shares, TicketColumns(share_cols=list(_SHARE_COLS)), key="ticket_id")


@register("ticket_features", _PREPARED_SQL)
def ticket_features(spark, sf):
    """The whole preparation chain on event-derived tickets."""
    return _prepared(spark, sf).features


@register("ticket_split", f"""
WITH f AS ({_PREPARED_SQL}), {_split_sql("f", "ticket_id", "Complaint_Type", 66000, 6000).replace("WITH", "", 1)}""")
def ticket_split(spark, sf):
    """P1 to its end: G2 on the prepared features."""
    from civicflow.plans.ticket_prep import split_features
    train, test = split_features(_prepared(spark, sf).features, "ticket_id", "Complaint_Type")
    cols = ["ticket_id", "Complaint_Type"]
    return train.select(*cols, F.lit("train").alias("split")).union(test.select(*cols, F.lit("test").alias("split")))
