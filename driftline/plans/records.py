"""Queries over records made from the driver's tables: validation, keyed reads, ids, orders, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records as R
from ..queries import events, on_events, query
from ..sources.events import read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


@query("SELECT 'srv-' || (user_id // 15) AS server_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, 'u' || user_id AS player_id, value / 100.0::DOUBLE AS x, event_id / 100.0::DOUBLE AS y, event_type AS dino_class FROM events")
def p1_to_metres(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("srv-"), F.expr("user_id div 15")).alias("server_id"), F.col("ts").cast("timestamp").alias("server_ts"), F.concat(F.lit("u"), "user_id").alias("player_id"), F.col("value").alias("x"), F.col("event_id").alias("y"), F.col("event_type").alias("dino_class"))
    return R.to_metres(rows)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per hour; some hold ids, classes, growths or coordinates that aren't allowed, some a player twice."""
    e = events(spark, sf_dir)
    n = F.col("event_id")
    player = F.struct(
        F.concat(F.when(n % 397 == 0, "u ").otherwise("u"), "user_id").alias("player_id"),
        F.concat(F.lit("p"), "user_id").alias("player_name"),
        F.when(n % 5 > 0, F.when(n % 389 == 0, "a-b").otherwise(F.col("event_type"))).alias("dino_class"),
        F.when(n % 3 > 0, F.when(n % 383 == 0, 1.5).otherwise(0.5)).alias("growth"),
        F.when(n % 379 == 0, F.lit(2e8)).otherwise(n.cast("double")).alias("x"),
        F.lit(0.0).alias("y"),
        F.lit(0.0).alias("z"),
    )
    return e.groupBy(F.expr("s div 3600").alias("snapshot_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", player.alias("p")))).alias("l")).select("snapshot_id", F.col("l.p").alias("players"))


@query(on_events("SELECT s // 3600 AS snapshot_id, CASE WHEN count(*) > 500 THEN 'too many players' WHEN bool_or(event_id % 397 = 0) THEN 'player id' WHEN bool_or(event_id % 5 > 0 AND event_id % 389 = 0) THEN 'class' WHEN bool_or(event_id % 3 > 0 AND event_id % 383 = 0) THEN 'growth' WHEN bool_or(event_id % 379 = 0) THEN 'coordinates' WHEN count(DISTINCT user_id) < count(*) THEN 'duplicate player' END AS problem FROM e GROUP BY 1"))
def p4_validation(spark, sf_dir):
    return snapshots(spark, sf_dir).select("snapshot_id", R.problem(F.col("players")).alias("problem"))


@query(on_events("SELECT s // 3600 AS snapshot_id, CASE WHEN event_id % 397 = 0 THEN 'u ' ELSE 'u' END || user_id AS player_id, CASE WHEN event_id % 379 = 0 THEN 2e8::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS x FROM e"))
def p2_flattened(spark, sf_dir):
    return R.flattened(snapshots(spark, sf_dir)).select("snapshot_id", "player_id", "x")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def p7_dynamic_filter(spark, sf_dir):
    return R.where(table(spark, sf_dir, "orders"), o_orderstatus="F", o_clerk=None, o_orderpriority="1-URGENT").select("o_orderkey", "o_orderstatus")


@query(on_events("SELECT s AS at FROM e WHERE user_id = 7 AND s > 1705000000"))
def s17_sightings(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.lit("org").alias("org_id"), F.col("user_id").cast("string").alias("player_id"), F.col("s").alias("at"))
    return R.sightings_after(rows, "org", "7", F.lit(1705000000)).select("at")


@query(on_events("SELECT event_type, min(s) AS first FROM e GROUP BY 1"))
def s6_first_times(spark, sf_dir):
    return R.first_times(events(spark, sf_dir), "event_type", "s")


@query("SELECT o_orderkey, CAST(1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS id FROM orders")
def k5_surrogate_keys(spark, sf_dir):
    return R.with_ids(table(spark, sf_dir, "orders"), 1000, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "id")


OUTBOX = "q AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'sent' ELSE 'pending' END AS status, s AS next_attempt_at FROM e)"


@query(on_events("SELECT id, next_attempt_at FROM q WHERE status = 'pending' AND next_attempt_at <= 1706000000 ORDER BY next_attempt_at, id LIMIT 50", OUTBOX))
def w20_due_deliveries(spark, sf_dir):
    e = events(spark, sf_dir)
    outbox = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "sent").otherwise("pending").alias("status"), F.col("s").alias("next_attempt_at"))
    return R.due(outbox, F.lit(1706000000)).select("id", "next_attempt_at")


@query(on_events("SELECT user_id, score, CAST(row_number() OVER (ORDER BY score DESC, user_id) AS BIGINT) - 1 AS place FROM (SELECT user_id, max(floor(value)) AS score FROM e GROUP BY 1)"))
def o1_scores_descending(spark, sf_dir):
    scores = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.floor("value").cast("double")).alias("score"))
    return R.numbered(scores, [F.desc("score"), F.col("user_id")], "place")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) - 1 AS place FROM orders")
def o2_newest_first(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], "place").select("o_orderkey", "place")


@query()
def o6_seeded_sample(spark, sf_dir):
    return R.drawn(table(spark, sf_dir, "customer"), ["c_custkey"], 100, 7).select("c_custkey")


@query(on_events("SELECT event_id FROM e WHERE event_id > 20 ORDER BY event_id LIMIT 32"))
def o7_queue_peek(spark, sf_dir):
    return R.peek(R.acknowledged(events(spark, sf_dir), 20, "event_id"), 32, "event_id").select("event_id")


@query("SELECT p_type AS value, CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) - 1 AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)")
def a22_vocabulary(spark, sf_dir):
    return R.vocabulary(table(spark, sf_dir, "part"), "p_type")


@query(on_events("SELECT user_id, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'error') AS error FROM e GROUP BY 1"))
def a23_run_counters(spark, sf_dir):
    return R.outcomes(events(spark, sf_dir), ["user_id"], "event_type", ("view", "error"))


HEALTH = "h AS (SELECT 'o' AS org_id, 's' || user_id AS server_id, count(*) % 7 AS polls, count(*) AS players, count(*) % 3 AS salvaged, count(*) % 5 AS unparsed, count(*) + 2 AS lines FROM e WHERE user_id % 4 > 0 GROUP BY 2)"


@query(on_events("SELECT c.org_id, c.server_id, h.server_id IS NOT NULL AS uploaded, CASE WHEN h.server_id IS NULL THEN NULL WHEN polls > 0 THEN players / CAST(polls AS DOUBLE) ELSE 0 END AS players_per_poll, (salvaged + unparsed) / CAST(greatest(1, lines + salvaged) AS DOUBLE) * 100 AS percent_bad FROM (SELECT DISTINCT 'o' AS org_id, 's' || user_id AS server_id FROM e) c LEFT JOIN h ON c.server_id = h.server_id", HEALTH))
def a25_server_status(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("org_id", F.lit("o")).withColumn("server_id", F.concat(F.lit("s"), "user_id"))
    n = F.count(F.lit(1))
    health = e.filter("user_id % 4 > 0").groupBy("org_id", "server_id").agg((n % 7).alias("polls"), n.alias("players"), (n % 3).alias("salvaged"), (n % 5).alias("unparsed"), (n + 2).alias("lines"))
    return R.server_status(e.select("org_id", "server_id").distinct(), health)


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority)))[1:3] AS names FROM orders GROUP BY 1")
def a13_union_of_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderpriority").alias("names"))
    return R.union_of_keys(rows, ["o_custkey"], "names", 3)


@query(on_events("SELECT org, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT 'o' || user_id % 3 AS org, s // 7200 AS w, arg_max(event_id, s * 1000000 + event_id) AS rows FROM e GROUP BY 1, 2) GROUP BY 1"))
def s9_manifest_rows(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.select(F.concat(F.lit("o"), F.col("user_id") % 3).alias("org"), F.expr("s div 7200").alias("window_end"), F.col("event_id").alias("rows"), (F.col("s") * 1000000 + F.col("event_id")).alias("written_at"))
    return R.manifests(rows)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stored, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, 'date=' || strftime(ts, '%Y-%m-%d') AS part, true AS same FROM events")
def f7_stored_times(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("at")).withColumn("stored", X.stored_time(F.col("at")))
    stamp = F.substring_index(X.window_name(F.lit("o"), F.col("at")), "-", -1)
    return rows.select("event_id", "stored", stamp.alias("stamp"), X.partition_name(F.col("at")).alias("part"), (X.parsed_time(F.col("stored")) == F.col("at")).alias("same"))


@query("SELECT c_custkey, 'sha256:' || sha256(c_name) AS hash, false AS plain, true AS shaped FROM customer")
def f13_key_hash(spark, sf_dir):
    key = F.concat(F.lit("espk_"), F.substring(F.sha2("c_name", 256), 1, 43))
    return table(spark, sf_dir, "customer").select("c_custkey", X.key_hash(F.col("c_name")).alias("hash"), X.looks_like_key(F.col("c_name")).alias("plain"), X.looks_like_key(key).alias("shaped"))


@query(r"""SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE p_name[1:11] || '…' END AS short, replace(regexp_replace(p_name || ' @*x*', '([\\*_~`|>#<\[\]()\-:.!+=])', '\\\1', 'g'), '@', '@' || chr(8203)) AS shown FROM part""")
def f18_shown_text(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.truncated(name, 12).alias("short"), X.escaped(F.concat(name, F.lit(" @*x*"))).alias("shown"))


@query("SELECT o_custkey, CASE WHEN n <= 2 THEN array_to_string(l, ', ') ELSE array_to_string(l[1:2], ', ') || ', +' || (n - 2) || ' more' END AS line FROM (SELECT o_custkey, list_sort(list(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'))) AS l, count(*) AS n FROM orders GROUP BY 1)")
def f18_joined(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).alias("l"))
    return rows.select("o_custkey", X.joined(F.col("l"), 30).alias("line"))


@query(on_events("""SELECT event_id, list_filter([
  CASE WHEN event_id % 4 > 0 THEN 'Beeline: ' || event_id % 9 || ' walks straight to players out of sight vs ' || printf('%.1f', value / 8) || ' expected (in ' || printf('%.0f', value) || ' min of moving, z ' || printf('%.1f', value / 16 - 2) || ')' END,
  CASE WHEN event_id % 5 > 0 THEN 'Ambush: ' || event_id % 5 || ' of ' || event_id % 7 || ' waits ended with a distant player arriving (z 6)' END,
  CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 6 = 1 THEN 'Time to contact: no contact after spawning' ELSE 'Time to contact: median ' || CASE WHEN value * 9 < 600 THEN printf('%.0f', value * 9) || ' s' ELSE printf('%.0f', value * 9 / 60) || ' min' END || ' after spawning' END
       || ' vs ' || CASE WHEN event_id % 1000 < 600 THEN event_id % 1000 || ' s' ELSE printf('%.0f', event_id % 1000 / 60.0::DOUBLE) || ' min' END || ' server median (' || event_id % 11 || ' contacts in ' || event_id % 13 || ' spawns)' END], lambda x: x IS NOT NULL) AS lines FROM e"""))
def f19_behaviours(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    beeline = F.struct((n % 4).alias("score"), (n % 9).alias("episodes"), (v / 8).alias("null_episodes"), v.alias("moving_minutes"), (v / 16 - 2).alias("z"))
    ambush = F.struct((n % 5).alias("score"), (n % 5).alias("hits"), (n % 7).alias("waits"), F.lit(6).alias("z"))
    ttc = F.struct((n % 3).alias("score"), F.when(n % 6 == 1, -1.0).otherwise(v * 9).alias("median_ttc_s"), (n % 1000).alias("server_median_ttc_s"), (n % 13).alias("episodes"), (n % 11).alias("contacts"))
    details = F.to_json(F.struct(beeline.alias("beeline"), ambush.alias("ambush"), ttc.alias("ttc")))
    return events(spark, sf_dir).select("event_id", X.behaviours(details).alias("lines"))


@query(on_events("SELECT user_id, printf('leakage z %.1f (sub-score %.2f): players nobody could have seen predict this player''s moves %+.3f nats per move better than the same players at other times, over %d moves (%.1f h observed)', n / 4.0::DOUBLE, v / 100, v / 50 - 1, n, n * 15.0::DOUBLE / 3600) || CASE WHEN n < 60 THEN '; too few moves to score (needs 60)' ELSE '' END AS line FROM (SELECT user_id, count(*) AS n, max(value) AS v FROM e GROUP BY 1)"))
def f25_gain_summary(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    return rows.select("user_id", X.gain_summary(F.col("n") / 4.0, F.col("v") / 100, F.col("v") / 50 - 1, F.col("n"), 15.0, 60).alias("line"))


@query(on_events("""SELECT user_id, '{"n":' || n || ',"name":"u' || user_id || '"}' AS json, n FROM (SELECT user_id, count(*) AS n FROM e GROUP BY 1)"""))
def f12_json(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("json", F.to_json(F.struct("n", F.concat(F.lit("u"), "user_id").alias("name"))))
    return rows.select("user_id", "json", F.from_json("json", "n long, name string")["n"].alias("n"))


@query(on_events("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Name ' ELSE '' END || upper(event_type) || ' PlayerID Slots' || CASE WHEN event_id % 2 = 0 THEN ' X' ELSE '' END AS shape FROM e"))
def f11_line_shape(spark, sf_dir):
    """Names with blanks and colons, keys of two words, and keys before an equals sign."""
    n = F.col("event_id")
    line = F.concat(F.when(n % 3 == 0, "Name: John Smith 3 ").otherwise("12 : "), F.upper("event_type"), F.lit(" : hi, PlayerID: 7"), n.cast("string"), F.lit(", Mutation Slots: x"), F.when(n % 2 == 0, ", X = 5").otherwise(", Y 5"))
    return events(spark, sf_dir).select("event_id", X.line_shape(line).alias("shape"))
