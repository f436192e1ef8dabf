"""Catalogue: offline feature table, registry and serving snapshot
(S3 S4 J1 J2 J3 P6 P7 P8 P9 O1 O2 O5 F8 F9 A16).

Stand-in (FIXTURES.md B): events → entity user_id, feature event_type,
version event_id % 3, value, ts. The snapshot holds per-user activity statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.functions.columns import round6, ts_string
from sparkfeat.operators import feature_table as FT
from sparkfeat.operators import store as S
from sparkfeat.plans.registry import Tables, register
from sparkfeat.session import scratch_path

SPLIT_TS = "2024-01-16 00:00:00"
NOW = "2024-01-31 00:30:00"

_LONG_SQL = """SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS feature_name,
  CAST(event_id % 3 AS VARCHAR) AS feature_version, CAST(value AS VARCHAR) AS value, ts, event_id FROM events"""


def _long(t):
    return t.events.select(F.col("user_id").cast("string").alias("entity_id"),
                     F.col("event_type").alias("feature_name"),
                     (F.col("event_id") % 3).cast("string").alias("feature_version"),
                     F.col("value").cast("string").alias("value"), "ts", "event_id")


def _offline(t):
    """Offline table: one row per key, the latest write (ts, then event_id)."""
    rows = _long(t)
    return S.upsert(rows.limit(0), rows, tiebreak="event_id")


_OFFLINE_SQL = f"""(SELECT entity_id, feature_name, feature_version, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name, feature_version ORDER BY ts DESC, event_id DESC) AS rn
  FROM ({_LONG_SQL})) WHERE rn = 1)"""


def _out(df):
    return df.select(*S.FEATURE_KEY, "value", ts_string(F.col("ts")).alias("ts"))


@register("feature_upsert", f"""WITH u AS (SELECT *, CASE WHEN ts >= TIMESTAMP '{SPLIT_TS}' THEN 1 ELSE 0 END AS src FROM ({_LONG_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name, feature_version ORDER BY src DESC, ts DESC, event_id DESC) AS rn FROM u)
SELECT entity_id, feature_name, feature_version, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE rn = 1""",
          "S3 F9")
def feature_upsert(spark, sf_dir):
    rows = _long(Tables(spark, sf_dir))
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    root = scratch_path(spark, "offline")
    FT.upsert_features(spark, root, rows.where(F.col("ts") < split), 1, tiebreak="event_id")
    # the second half: the partitions of its features are merged and replaced, others stay
    FT.upsert_features(spark, root, rows.where(F.col("ts") >= split), 2, tiebreak="event_id")
    return _out(FT.read_features(spark, root))


@register("feature_latest", f"""SELECT entity_id, feature_name, feature_version, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, feature_name ORDER BY ts DESC, feature_version DESC) AS rn
  FROM {_OFFLINE_SQL}) WHERE rn = 1""", "J1")
def feature_latest(spark, sf_dir):
    return _out(S.latest_values(_offline(Tables(spark, sf_dir))))


_REQ_SQL = f"(SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-08')"


def _requests(t):
    return (t.events.where("event_type = 'signup' AND ts < TIMESTAMP_NTZ '2024-01-08 00:00:00'")
            .select(F.col("user_id").cast("string").alias("entity_id")))


@register("feature_get_version", f"""SELECT entity_id, value FROM {_OFFLINE_SQL} o
WHERE feature_name = 'purchase' AND feature_version = '1' AND entity_id IN {_REQ_SQL}""", "P6")
def feature_get_version(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.get_feature_data(_offline(t), _requests(t), "purchase", "1")


@register("feature_get_latest", f"""SELECT entity_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, feature_version DESC) AS rn
  FROM {_OFFLINE_SQL} WHERE feature_name = 'purchase' AND entity_id IN {_REQ_SQL}) WHERE rn = 1""", "P6 J1")
def feature_get_latest(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.get_feature_data(_offline(t), _requests(t), "purchase")


_TRANSFORM_SQL = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'sum(value)' ELSE 'mean of \"value\"' END"


def _json_sql(x):
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"' END"""


@register("feature_version_id", f"""SELECT name, transformation, substr(md5('{{"name": ' || {_json_sql('name')} ||
  ', "transformation": ' || {_json_sql('transformation')} || ', "type": ' || {_json_sql('type')} || '}}'), 1, 10) AS version_id
FROM (SELECT DISTINCT event_type AS name, {_TRANSFORM_SQL} AS transformation, 'numeric' AS type FROM events)""", "F8")
def feature_version_id(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    d = ev.select(F.col("event_type").alias("name"), F.expr(_TRANSFORM_SQL).alias("transformation"),
                  F.lit("numeric").alias("type")).distinct()
    return d.select("name", "transformation",
                    S.version_id(F.col("name"), F.col("type"), F.col("transformation")).alias("version_id"))


_REGISTRY_SQL = f"""(SELECT event_type AS name, CAST(event_id % 3 AS VARCHAR) AS version, 'numeric' AS feature_type,
  max(ts) AS updated_at, 'team_' || CAST(event_id % 3 AS VARCHAR) AS owner,
  'events,' || event_type AS tags, event_id % 3 <> 0 AS is_active
FROM events GROUP BY event_type, event_id % 3)"""


def _registry(t):
    v = (F.col("event_id") % 3)
    return t.events.groupBy(F.col("event_type").alias("name"), v.cast("string").alias("version")).agg(
        F.max("ts").alias("updated_at")).select(
        "name", "version", F.lit("numeric").alias("feature_type"), "updated_at",
        F.concat(F.lit("team_"), F.col("version")).alias("owner"),
        F.array(F.lit("events"), F.col("name")).alias("tags"),
        (F.col("version") != "0").alias("is_active"))


@register("registry_latest", f"""SELECT name, version, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, is_active FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY updated_at DESC, version DESC) AS rn FROM {_REGISTRY_SQL}) WHERE rn = 1""",
          "O1")
def registry_latest(spark, sf_dir):
    r = S.registry_latest(_registry(Tables(spark, sf_dir)))
    return r.select("name", "version", ts_string(F.col("updated_at")).alias("updated_at"), "is_active")


@register("registry_list", f"""SELECT name, version, feature_type AS type, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
  owner, tags, is_active AS active FROM {_REGISTRY_SQL}""", "O2")
def registry_list(spark, sf_dir):
    r = S.registry_list(_registry(Tables(spark, sf_dir)))
    return r.withColumns({"updated_at": ts_string(F.col("updated_at")),
                          "tags": F.array_join("tags", ",")})


def _user_stats(ev):
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 2).alias("purchase"))


def _snapshot(t):
    ev = t.events
    split = F.lit(SPLIT_TS).cast("timestamp_ntz")
    old = S.snapshot_rows(_user_stats(ev.where(F.col("ts") < split)), "user_stats", "user_id",
                          now=F.to_timestamp(F.lit(SPLIT_TS)), ttl_seconds=3600)
    new = S.snapshot_rows(_user_stats(ev.where(F.col("ts") >= split)), "user_stats", "user_id",
                          now=F.to_timestamp(F.lit("2024-01-31 00:00:00")), ttl_seconds=86400)
    return S.sync_snapshot(S.sync_snapshot(None, old), new)


def _stats_sql(cond, now, ttl):
    return f"""(SELECT 'user_stats' AS feature_set, CAST(user_id AS VARCHAR) AS entity_id,
   to_json({{'n': count(*), 'total': round(sum(value), 2), 'purchase': round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2)}}) AS features,
   TIMESTAMP '{now}' + INTERVAL {ttl} SECOND AS expires_at FROM events WHERE {cond} GROUP BY user_id)"""


_SNAPSHOT_SQL = f"""(SELECT feature_set, entity_id, features, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_set, entity_id ORDER BY src DESC, expires_at DESC) AS rn FROM (
    SELECT *, 0 AS src FROM {_stats_sql(f"ts < TIMESTAMP '{SPLIT_TS}'", SPLIT_TS, 3600)}
    UNION ALL SELECT *, 1 FROM {_stats_sql(f"ts >= TIMESTAMP '{SPLIT_TS}'", '2024-01-31 00:00:00', 86400)})) WHERE rn = 1)"""
_LIVE_SQL = f"(SELECT * FROM {_SNAPSHOT_SQL} WHERE expires_at > TIMESTAMP '{NOW}')"


@register("snapshot_sync", f"""SELECT feature_set, entity_id, features, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at
FROM {_SNAPSHOT_SQL}""", "S4")
def snapshot_sync(spark, sf_dir):
    s = _snapshot(Tables(spark, sf_dir))
    return s.withColumn("expires_at", ts_string(F.col("expires_at")))


@register("snapshot_sync_counts", f"""SELECT 'user_stats' AS feature_set, count(*) AS rows,
  CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches FROM {_stats_sql(f"ts >= TIMESTAMP '{SPLIT_TS}'", '2024-01-31 00:00:00', 86400)}""",
          "S4")
def snapshot_sync_counts(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    new = S.snapshot_rows(_user_stats(ev.where(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))),
                          "user_stats", "user_id", now=F.to_timestamp(F.lit("2024-01-31 00:00:00")),
                          ttl_seconds=86400)
    return S.sync_summary(new, batch_size=50)


@register("registry_delete", f"""SELECT name, count(*) AS versions_left FROM {_REGISTRY_SQL}
WHERE NOT (name = 'error') AND NOT (name = 'view' AND version = '0') GROUP BY name""", "P9 O1")
def registry_delete(spark, sf_dir):
    reg = _registry(Tables(spark, sf_dir))
    reg, _ = S.registry_delete(reg, "view", "0")
    reg, _ = S.registry_delete(reg, "error")
    return reg.groupBy("name").agg(F.count(F.lit(1)).alias("versions_left"))


@register("snapshot_get", f"""SELECT CAST(c.c_custkey AS VARCHAR) AS entity_id,
  CASE WHEN s.features IS NULL THEN '{{}}' ELSE '{{"n":' || json_extract_string(s.features, '$.n') || '}}' END AS features,
  s.features IS NOT NULL AS hit
FROM customer c LEFT JOIN {_LIVE_SQL} s ON CAST(c.c_custkey AS VARCHAR) = s.entity_id""", "J2 P7 P8")
def snapshot_get(spark, sf_dir):
    t = Tables(spark, sf_dir)
    req = t.customer.select(F.col("c_custkey").alias("entity_id"))
    return S.multi_get(_snapshot(t), req, "user_stats", NOW, features=["n"])


@register("snapshot_stats", f"""SELECT feature_set, count(*) AS keys, CAST(sum(octet_length(encode(features))) AS BIGINT) AS bytes,
  (SELECT count(*) FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT entity_id FROM {_LIVE_SQL})) AS hits,
  (SELECT count(*) FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT entity_id FROM {_LIVE_SQL})) AS misses,
  round((SELECT count(*) FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT entity_id FROM {_LIVE_SQL}))
    / (SELECT count(*) FROM customer), 6) AS hit_ratio
FROM {_LIVE_SQL} GROUP BY feature_set""", "A16")
def snapshot_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    snap = _snapshot(t)
    req = t.customer.select(F.col("c_custkey").alias("entity_id"))
    hm = S.hit_miss(S.multi_get(snap, req, "user_stats", NOW)).withColumn("feature_set", F.lit("user_stats"))
    return S.snapshot_stats(snap, NOW).join(hm, "feature_set").withColumn(
        "hit_ratio", round6(F.col("hit_ratio")))


@register("read_through", f"""WITH o AS (SELECT entity_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, feature_version DESC) AS rn
  FROM {_OFFLINE_SQL} WHERE feature_name = 'purchase') WHERE rn = 1),
s AS (SELECT entity_id, json_extract(features, '$.purchase') AS sv FROM {_LIVE_SQL})
SELECT CAST(c.c_custkey AS VARCHAR) AS entity_id,
  coalesce(CASE WHEN CAST(s.sv AS VARCHAR) = 'null' THEN NULL ELSE CAST(s.sv AS VARCHAR) END, o.value) AS value,
  CASE WHEN s.sv IS NOT NULL AND CAST(s.sv AS VARCHAR) <> 'null' THEN 'snapshot' WHEN o.value IS NOT NULL THEN 'offline' END AS source
FROM customer c LEFT JOIN s ON CAST(c.c_custkey AS VARCHAR) = s.entity_id
LEFT JOIN o ON CAST(c.c_custkey AS VARCHAR) = o.entity_id""", "J3")
def read_through(spark, sf_dir):
    t = Tables(spark, sf_dir)
    req = t.customer.select(F.col("c_custkey").alias("entity_id"))
    return S.read_through(_snapshot(t), S.latest_values(_offline(t)), req, "user_stats",
                          "purchase", NOW).withColumnRenamed("purchase", "value")


@register("snapshot_delete", f"""WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id FROM events
  WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29')
SELECT (SELECT count(*) FROM {_SNAPSHOT_SQL} WHERE entity_id IN (SELECT entity_id FROM d)) AS deleted,
  (SELECT count(*) FROM {_SNAPSHOT_SQL} WHERE entity_id NOT IN (SELECT entity_id FROM d)) AS remaining""", "P9")
def snapshot_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = (t.events.where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'")
           .select(F.col("user_id").alias("entity_id")))
    _, counts = S.delete_entities(_snapshot(t), "user_stats", ids)
    return counts


@register("snapshot_entity_ids", f"SELECT DISTINCT entity_id FROM {_LIVE_SQL}", "O5")
def snapshot_entity_ids(spark, sf_dir):
    return S.entity_ids(_snapshot(Tables(spark, sf_dir)), "user_stats", NOW)


_REG_FEATURES = [("n", "numeric"), ("total", "numeric"), ("has_error", "boolean"), ("last_type", "text")]


def _register_sql():
    parts = []
    for c, t in _REG_FEATURES:
        name = f"'user_stats.{c}'"
        doc = ("'{\"name\": \"' || " + name + " || '\", \"transformation\": null, \"type\": \"" + t + "\"}'")
        parts.append(f"SELECT {name} AS name, substr(md5({doc}), 1, 10) AS version, '{t}' AS feature_type, "
                     f"strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, 'team_features' AS owner, "
                     f"'events,users' AS tags, true AS is_active FROM events")
    return " UNION ALL ".join(parts)


@register("feature_register", _register_sql(), "P5 F8 E3")
def feature_register(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    stats = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        (F.count_if(F.col("event_type") == "error") > 0).alias("has_error"),
        F.max_by("event_type", "ts").alias("last_type"), F.max("ts").alias("last_ts"))
    reg = S.register_features(stats, "user_stats", [c for c, _ in _REG_FEATURES], "last_ts",
                              owner="team_features", tags=["events", "users"])
    return reg.select("name", "version", "feature_type", ts_string(F.col("updated_at")).alias("updated_at"),
                      "owner", F.array_join("tags", ",").alias("tags"), "is_active")
