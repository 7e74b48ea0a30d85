"""Every query on the driver's tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import approach as A
from .operators import evidence as E
from .operators import grid as G
from .operators import leakage as L
from .operators import nearest as N
from .operators import relational as Q
from .operators import tracks as T
from .operators.state import Table
from .rules import EVENT_RULES as R
from .sources import events as S
from .sources import export as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.positions(S.read(spark, sf_dir, "events"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid and the headings on it, written once: most queries read them many times."""
    return Table(G.headings(G.resample(samples(spark, sf_dir), R), R)).df


def tracks(spark: SparkSession, sf_dir: str) -> G.Pieces:
    """The pieces of the tracks: what asks for steps near each other, or once only, makes them where it needs them."""
    return G.pieces(samples(spark, sf_dir), R)


def company(g: DataFrame | None, beside: DataFrame | None = None) -> DataFrame:
    return Table(E.associates(g, R, beside)).df


def beside(spark: SparkSession, sf_dir: str) -> tuple[G.Pieces, DataFrame]:
    """The pieces of the tracks, written once, and who is in company."""
    pieces = tracks(spark, sf_dir).kept()
    return pieces, company(None, E.near(None, R, pieces))


def with_(*parts: str) -> str:
    return "WITH " + ",".join([S.SQL, G.SQL, *parts])


@query(f"WITH {S.SQL} SELECT server_id, player_id, t, x, y, dino_class FROM pos")
def s5_positions(spark, sf_dir):
    return samples(spark, sf_dir)


@query(with_() + " SELECT server_id, player_id, idx, x, y, dino_class FROM grid")
def w1_resample(spark, sf_dir):
    return G.resample(samples(spark, sf_dir), R).select("server_id", "player_id", "idx", "x", "y", "dino_class")


@query(with_() + " SELECT server_id, dino_class, aware, count(*) AS steps FROM grid GROUP BY ALL")
def p8_awareness(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("server_id", "dino_class", "aware").agg(F.count(F.lit(1)).alias("steps"))


@query(with_(G.HEAD_SQL) + " SELECT server_id, player_id, count(*) FILTER (moving) * 5.0::DOUBLE AS moving_s FROM head GROUP BY ALL")
def p9_moving_seconds(spark, sf_dir):
    return E.moving_seconds(grid(spark, sf_dir), R)


RUNS = """
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS rn FROM {source}),
{name} AS (SELECT {keys}, min(idx) AS run_start, max(idx) AS run_end{extra} FROM {name}_n GROUP BY {keys}, idx - rn)"""


def runs(name: str, source: str, keys: str = "server_id, player_id", extra: str = "") -> str:
    return RUNS.format(name=name, source=source, keys=keys, extra=extra)


@query(with_(G.HEAD_SQL, runs("mr", "(SELECT * FROM head WHERE moving)")) + " SELECT * FROM mr")
def w2_moving_runs(spark, sf_dir):
    return E.moving_runs(grid(spark, sf_dir), R)


@query(with_(G.DEATH_SQL) + " SELECT server_id, player_id, count(*) AS steps, count(*) FILTER (died) AS dying FROM dead GROUP BY ALL")
def w5_deaths(spark, sf_dir):
    return G.deaths(grid(spark, sf_dir), R).groupBy(*G.PLAYER).agg(F.count(F.lit(1)).alias("steps"), F.count_if("died").alias("dying"))


WAITS = """
sp AS (SELECT *, sqrt(pow(max(x) OVER a - x, 2) + pow(max(y) OVER a - y, 2)) / 5 AS s FROM grid WINDOW a AS (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
sm AS (SELECT *, (CASE WHEN idx = 0 THEN 0 ELSE max(s) OVER b END + s + max(s) OVER c) / 3 AS m FROM sp
       WINDOW b AS (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING))""" + "," + runs("wr", "(SELECT * FROM sm WHERE m < 0.5)") + """,
wait AS (SELECT * FROM wr WHERE run_end - run_start + 1 >= 12)"""


@query(with_(WAITS) + " SELECT * FROM wait")
def p10_waits(spark, sf_dir):
    return E.waits(grid(spark, sf_dir), R)


ASSOC = """
near AS (SELECT a.server_id, a.player_id, b.player_id AS player_id_j, a.idx, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS d FROM grid a JOIN grid b ON a.server_id = b.server_id AND a.idx = b.idx AND a.player_id <> b.player_id),
assoc AS (SELECT server_id, player_id, player_id_j FROM near WHERE d <= 10000 GROUP BY ALL HAVING count(*) >= 12)"""


@query(with_(ASSOC) + " SELECT * FROM assoc")
def a4_associates(spark, sf_dir):
    return E.associates(None, R, E.near(None, R, tracks(spark, sf_dir)))


MEET = """
sh AS (SELECT dead.*, unnest(list_filter([0, 120, 240, 360], lambda s: s <= n // 2)) AS shift FROM dead),
mp AS (SELECT a.server_id, b.shift, a.player_id, b.player_id AS player_id_j, a.idx, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS d, a.died OR b.died AS fight
       FROM dead a JOIN sh b ON a.server_id = b.server_id AND a.idx = (b.idx + b.shift) % b.n AND a.player_id < b.player_id),
mc AS (SELECT *, sum(CASE WHEN d > 250000 THEN 1 ELSE 0 END) OVER (PARTITION BY server_id, shift, player_id, player_id_j ORDER BY idx) AS apart FROM mp)""" + "," + runs(
    "mq", "(SELECT * FROM mc WHERE d <= 22500)", "server_id, shift, player_id, player_id_j", ", min_by(apart, idx) AS before, max_by(apart, idx) AS after, max_by(fight, idx) AS fight"
) + """,
ml AS (SELECT *, lag(after) OVER (PARTITION BY server_id, shift, player_id, player_id_j ORDER BY run_start) AS previous FROM mq WHERE run_end - run_start + 1 >= 12),
mk AS (SELECT server_id, shift, player_id, player_id_j, count(*) FILTER (NOT fight AND (previous IS NULL OR before > previous)) AS meets FROM ml GROUP BY ALL),
us AS (SELECT DISTINCT server_id, len(list_filter([120, 240, 360], lambda s: s <= n // 2)) AS used FROM grid),
meet AS (SELECT server_id, player_id AS player_a, player_id_j AS player_b, CAST(sum(CASE WHEN shift = 0 THEN meets ELSE 0 END) AS BIGINT) AS meets,
         sum(CASE WHEN shift > 0 THEN meets ELSE 0 END) / CAST(greatest(1, max(used)) AS DOUBLE) AS null_meets FROM mk JOIN us USING (server_id) GROUP BY 1, 2, 3 HAVING sum(CASE WHEN shift = 0 THEN meets ELSE 0 END) > 0)"""


@query(with_(G.DEATH_SQL, MEET) + " SELECT * FROM meet")
def x7_meetups(spark, sf_dir):
    return E.meetups(None, R, tracks=tracks(spark, sf_dir).kept())


SPAWN = """
sl AS (SELECT *, coalesce(lag(idx) OVER w <> idx - 1, true) AS fresh, idx > 0 AND (coalesce(lag(idx) OVER w <> idx - 1, true) OR pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) > 90000 OR dino_class IS DISTINCT FROM lag(dino_class) OVER w) AS spawned
       FROM grid WINDOW w AS (PARTITION BY server_id, player_id ORDER BY idx)),
sf AS (SELECT *, sum(CASE WHEN spawned OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY server_id, player_id ORDER BY idx) AS life FROM sl),
th AS (SELECT DISTINCT near.server_id, near.player_id, near.idx AS hit FROM near LEFT JOIN assoc USING (server_id, player_id, player_id_j) WHERE d <= 2500 AND assoc.player_id IS NULL),
se AS (SELECT sf.server_id, sf.player_id, life, min(idx) AS idx, count(*) AS steps, min(hit) AS hit, min_by(spawned, idx) AS spawned, min_by(dino_class, idx) AS dino_class
       FROM sf LEFT JOIN th ON th.server_id = sf.server_id AND th.player_id = sf.player_id AND th.hit = sf.idx GROUP BY 1, 2, 3),
spawn AS (SELECT server_id, player_id, idx, dino_class, coalesce(hit - idx, steps) * 5.0::DOUBLE AS duration_s, hit IS NULL AS censored FROM se WHERE spawned AND (hit IS NOT NULL OR steps >= 12))"""


@query(with_(ASSOC, SPAWN) + " SELECT * FROM spawn")
def x5_spawn_episodes(spark, sf_dir):
    return spawns(spark, sf_dir)


def spawns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    beside = E.near(None, R, t)
    return E.spawn_episodes(t.steps(), company(None, beside), R, beside=beside)


AMBUSH = """
ws AS (SELECT w.server_id, w.player_id, run_start, run_end, avg(x) AS x, avg(y) AS y, min_by(aware, idx) AS aware, max(n) AS n FROM wait w JOIN grid g ON w.server_id = g.server_id AND w.player_id = g.player_id AND g.idx BETWEEN run_start AND run_end GROUP BY 1, 2, 3, 4),
wi AS (SELECT *, unnest(generate_series(run_start, least(run_end + 6, n - 1))) AS idx FROM ws),
ash AS (SELECT dead.*, unnest(list_filter([0, 120, 240, 360], lambda s: s <= n // 2)) AS shift FROM dead),
wp AS (SELECT wi.*, b.shift, b.player_id AS player_id_j, b.died, pow(b.x - wi.x, 2) + pow(b.y - wi.y, 2) AS d FROM wi JOIN ash b ON wi.server_id = b.server_id AND wi.idx = (b.idx + b.shift) % b.n AND wi.player_id <> b.player_id
       LEFT JOIN assoc a ON a.server_id = wi.server_id AND a.player_id = wi.player_id AND a.player_id_j = b.player_id WHERE a.player_id IS NULL),
we AS (SELECT server_id, player_id, shift, player_id_j, run_start, max(CASE WHEN idx = run_start THEN d > aware * aware END) AS far, min_by(died, idx) FILTER (d <= 2500) AS killed FROM wp GROUP BY ALL),
wh AS (SELECT server_id, player_id, count(DISTINCT run_start) FILTER (shift = 0) AS hits, count(DISTINCT shift * 100000 + run_start) FILTER (shift > 0) AS by_chance FROM we WHERE far AND killed GROUP BY ALL),
wc AS (SELECT server_id, player_id, count(*) AS waits FROM wait GROUP BY ALL),
wu AS (SELECT DISTINCT server_id, player_id, len(list_filter([120, 240, 360], lambda s: s <= n // 2)) AS used FROM grid),
ambush AS (SELECT server_id, player_id, coalesce(waits, 0) AS waits, coalesce(hits, 0) AS hits, coalesce(by_chance, 0) / CAST(greatest(1, used) AS DOUBLE) AS null_hits FROM wu LEFT JOIN wc USING (server_id, player_id) LEFT JOIN wh USING (server_id, player_id))"""


@query(with_(ASSOC, WAITS, G.DEATH_SQL, AMBUSH) + " SELECT * FROM ambush")
def x4_ambush(spark, sf_dir):
    p, assoc = beside(spark, sf_dir)
    return E.ambushes(None, assoc, R, tracks=p)


# The approach rules over all pair rows of the grid at every shift, in the order in which they narrow the runs.
APPROACH = """
osh AS (SELECT server_id, player_id, x, y, n, s.shift, (idx + s.shift) % n AS idx FROM grid, (VALUES (0), (120), (240), (360)) s(shift) WHERE s.shift <= n // 2),
dp AS (SELECT a.server_id, o.shift, a.player_id, o.player_id AS player_id_j, a.idx, a.n, a.x, a.y, a.dx, a.dy, a.aware, a.moving, o.x AS xj, o.y AS yj, (o.x - a.x) * (o.x - a.x) + (o.y - a.y) * (o.y - a.y) AS d
       FROM head a JOIN osh o ON a.server_id = o.server_id AND a.idx = o.idx AND a.player_id <> o.player_id),
al AS (SELECT dp.* FROM dp LEFT JOIN assoc c USING (server_id, player_id, player_id_j) WHERE c.server_id IS NULL AND moving AND d > 0 AND (xj - x) * dx + (yj - y) * dy >= 0.95 * sqrt(d * (dx * dx + dy * dy))),
ab AS (SELECT *, CASE WHEN idx - lag(idx) OVER w - 1 <= 3 THEN 0 ELSE 1 END AS fresh FROM al WINDOW w AS (PARTITION BY server_id, shift, player_id, player_id_j ORDER BY idx)),
ac AS (SELECT *, sum(fresh) OVER (PARTITION BY server_id, shift, player_id, player_id_j ORDER BY idx) AS g FROM ab),
ar AS (SELECT server_id, shift, player_id, player_id_j, min(idx) AS run_start, max(idx) AS run_end, min_by(d, idx) AS d0, min_by(aware, idx) AS aware0, max(n) AS n FROM ac GROUP BY server_id, shift, player_id, player_id_j, g),
as1 AS (SELECT * FROM ar WHERE d0 > aware0 * aware0 AND d0 <= 9000000 AND run_end - run_start + 1 >= 12),
as2 AS (SELECT r.server_id, r.shift, r.player_id, r.player_id_j, run_start, run_end, d0, r.n, count(*) FILTER (p.idx <= run_end AND p.d > p.aware * p.aware) AS far, min(p.idx) FILTER (p.d <= 90000) AS arrival
        FROM as1 r JOIN dp p ON p.server_id = r.server_id AND p.shift = r.shift AND p.player_id = r.player_id AND p.player_id_j = r.player_id_j AND p.idx BETWEEN run_start AND run_end + 3 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
as3 AS (SELECT r.* FROM as2 r WHERE far >= 12 AND arrival IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dp p WHERE p.server_id = r.server_id AND p.shift = r.shift AND p.player_id = r.player_id AND p.player_id_j = r.player_id_j AND p.idx BETWEEN run_start - 120 AND run_start AND p.d <= p.aware * p.aware)),
way AS (SELECT r.server_id, r.shift, r.player_id, r.player_id_j, run_start FROM as3 r JOIN head h ON h.server_id = r.server_id AND h.player_id = r.player_id AND h.idx = run_start - 12 AND h.moving JOIN head e ON e.server_id = r.server_id AND e.player_id = r.player_id AND e.idx = arrival
        WHERE (h.dx * h.dx + h.dy * h.dy) * ((e.x - h.x) * (e.x - h.x) + (e.y - h.y) * (e.y - h.y)) > 0
        AND h.dx * (e.x - h.x) + h.dy * (e.y - h.y) >= 0.95 * sqrt((h.dx * h.dx + h.dy * h.dy) * ((e.x - h.x) * (e.x - h.x) + (e.y - h.y) * (e.y - h.y)))),
came AS (SELECT r.server_id, r.shift, r.player_id, r.player_id_j, run_start FROM as3 r JOIN dp s ON s.server_id = r.server_id AND s.shift = r.shift AND s.player_id = r.player_id AND s.player_id_j = r.player_id_j AND s.idx = run_start
         JOIN dp e ON e.server_id = r.server_id AND e.shift = r.shift AND e.player_id = r.player_id AND e.player_id_j = r.player_id_j AND e.idx = arrival
         WHERE (e.xj - s.xj) * (s.x - s.xj) + (e.yj - s.yj) * (s.y - s.yj) > 0.3 * d0),
as4 AS (SELECT r.* FROM as3 r LEFT JOIN way w USING (server_id, shift, player_id, player_id_j, run_start) LEFT JOIN came c USING (server_id, shift, player_id, player_id_j, run_start) WHERE w.server_id IS NULL AND c.server_id IS NULL)"""
MERGE = """
mo AS (SELECT *, max(arrival) OVER (PARTITION BY server_id, shift, player_id ORDER BY run_start, arrival, player_id_j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
mg AS (SELECT *, sum(CASE WHEN before IS NULL OR run_start > before THEN 1 ELSE 0 END) OVER (PARTITION BY server_id, shift, player_id ORDER BY run_start, arrival, player_id_j) AS g FROM mo),
merged AS (SELECT server_id, shift, player_id, min(run_start) AS run_start, max(arrival) AS arrival, first(player_id_j ORDER BY run_start, arrival, player_id_j) AS player_id_j, first(sqrt(d0) ORDER BY run_start, arrival, player_id_j) AS distance FROM mg GROUP BY server_id, shift, player_id, g)"""
KNOWN = """
ev2 AS (SELECT server_id, player_id, n, unnest(generate_series(greatest(0, idx - 24), idx)) AS idx FROM de WHERE event = 1),
dy AS (SELECT DISTINCT server_id, player_id, s.shift, (idx + s.shift) % n AS idx FROM ev2, (VALUES (0), (120), (240), (360)) s(shift)),
kt AS (SELECT server_id, shift, player_id, player_id_j, run_start, unnest(generate_series(greatest(0, (run_start - shift + n) % n - 36), (run_start - shift + n) % n)) AS idx FROM as4),
known AS (SELECT DISTINCT k.server_id, k.shift, k.player_id, k.player_id_j, k.run_start FROM kt k JOIN near m ON m.server_id = k.server_id AND m.player_id_j = k.player_id_j AND m.idx = k.idx AND m.player_id <> k.player_id
          JOIN grid g ON g.server_id = m.server_id AND g.player_id = m.player_id AND g.idx = m.idx LEFT JOIN assoc c ON c.server_id = m.server_id AND c.player_id = m.player_id AND c.player_id_j = m.player_id_j
          WHERE m.d <= g.aware * g.aware AND m.d > 22500 AND c.server_id IS NULL),
pr AS (SELECT r.server_id, r.shift, r.player_id, r.player_id_j, r.run_start AS s, p.idx FROM as4 r JOIN dp p ON p.server_id = r.server_id AND p.shift = r.shift AND p.player_id = r.player_id AND p.player_id_j = r.player_id_j AND p.idx BETWEEN arrival AND arrival + 60
       WHERE p.d <= 22500 AND NOT EXISTS (SELECT 1 FROM dy WHERE dy.server_id = p.server_id AND dy.shift = p.shift AND dy.idx = p.idx AND dy.player_id = p.player_id) AND NOT EXISTS (SELECT 1 FROM dy WHERE dy.server_id = p.server_id AND dy.shift = p.shift AND dy.idx = p.idx AND dy.player_id = p.player_id_j)),
pn AS (SELECT *, row_number() OVER (PARTITION BY server_id, shift, player_id, player_id_j, s ORDER BY idx) AS rn FROM pr),
peace AS (SELECT DISTINCT server_id, shift, player_id, player_id_j, s AS run_start FROM (SELECT server_id, shift, player_id, player_id_j, s FROM pn GROUP BY server_id, shift, player_id, player_id_j, s, idx - rn HAVING count(*) >= 12)),
as5 AS (SELECT r.* FROM as4 r LEFT JOIN known k USING (server_id, shift, player_id, player_id_j, run_start) LEFT JOIN peace p USING (server_id, shift, player_id, player_id_j, run_start) WHERE k.server_id IS NULL AND p.server_id IS NULL)"""
BEELINE = """
bu AS (SELECT server_id, player_id, count(*) FILTER (moving) * 5.0::DOUBLE AS moving_s, max(len(list_filter([120, 240, 360], lambda s: s <= n // 2))) AS used FROM head GROUP BY ALL),
be AS (SELECT server_id, player_id, count(*) FILTER (shift = 0) AS episodes, count(*) FILTER (shift > 0) AS by_chance, sum(distance) FILTER (shift = 0) AS start_sum_m FROM merged GROUP BY ALL),
beeline AS (SELECT server_id, player_id, moving_s, coalesce(episodes, 0) AS episodes, coalesce(by_chance, 0) / CAST(greatest(1, used) AS DOUBLE) AS null_episodes, round(coalesce(start_sum_m, 0), 6) AS start_sum_m FROM bu LEFT JOIN be USING (server_id, player_id))"""


@query(with_(G.HEAD_SQL, ASSOC, APPROACH, MERGE.format(source="(SELECT * FROM as4 WHERE shift = 0)")) + " SELECT server_id, player_id, player_id_j, run_start, arrival, distance FROM merged")
def x27_display_episodes(spark, sf_dir):
    p, assoc = beside(spark, sf_dir)
    found = A.episodes(None, assoc, R, null=False, known=False, tracks=p)
    return A.merged(found).select("server_id", "player_id", "player_id_j", "run_start", "arrival", "distance")


@query(with_(G.HEAD_SQL, ASSOC, G.DEATH_SQL, APPROACH, KNOWN) + " SELECT server_id, shift, player_id, player_id_j, run_start, arrival FROM as5")
def x1_beeline_episodes(spark, sf_dir):
    p, assoc = beside(spark, sf_dir)
    return A.episodes(None, assoc, R, tracks=p).select(*E.PAIR, "run_start", "arrival")


@query(with_(G.HEAD_SQL, ASSOC, G.DEATH_SQL, APPROACH, KNOWN, MERGE.format(source="as5"), BEELINE) + " SELECT * FROM beeline")
def x2_beeline_evidence(spark, sf_dir):
    p, assoc = beside(spark, sf_dir)
    rows = A.beelines(None, A.episodes(None, assoc, R, tracks=p), R, tracks=p)
    return rows.withColumn("start_sum_m", F.round("start_sum_m", 6))


TIPS = """
town AS (SELECT *, row_number() OVER (PARTITION BY server_id, player_id ORDER BY run_start, arrival, player_id_j) AS ord FROM merged),
tex AS (SELECT server_id, player_id, player_id_j AS m, ord FROM town UNION ALL SELECT t.server_id, t.player_id, c.player_id_j, ord FROM town t JOIN assoc c ON c.server_id = t.server_id AND c.player_id = t.player_id_j),
tl AS (SELECT server_id, player_id, m, max(ord) AS last FROM tex GROUP BY ALL),
tt AS (SELECT server_id, player_id, player_id_j, ord, unnest(generate_series(greatest(0, run_start - 36), run_start)) AS idx FROM town),
ts AS (SELECT DISTINCT t.server_id, t.player_id, t.ord, o.player_id AS m, o.shift, o.n FROM tt t JOIN grid k ON k.server_id = t.server_id AND k.player_id = t.player_id_j AND k.idx = t.idx JOIN osh o ON o.server_id = t.server_id AND o.idx = t.idx AND o.player_id <> t.player_id AND o.player_id <> t.player_id_j
       LEFT JOIN grid r ON r.server_id = t.server_id AND r.player_id = o.player_id AND r.idx = t.idx
       WHERE (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= coalesce(r.aware, 300) * coalesce(r.aware, 300) AND (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) > 22500),
tip AS (SELECT ts.server_id, least(ts.player_id, ts.m) AS player_a, greatest(ts.player_id, ts.m) AS player_b, count(*) FILTER (shift = 0) AS tips,
        round(sum(CASE WHEN shift > 0 THEN 1.0::DOUBLE / greatest(1, len(list_filter([120, 240, 360], lambda s: s <= n // 2))) ELSE 0.0::DOUBLE END), 6) AS null_tips
        FROM ts LEFT JOIN tl USING (server_id, player_id, m) WHERE ord > coalesce(last, 0) GROUP BY 1, 2, 3)"""
TIP_CHAIN = (APPROACH, MERGE.format(source="(SELECT * FROM as4 WHERE shift = 0)"), TIPS)


@query(with_(G.HEAD_SQL, ASSOC, *TIP_CHAIN) + " SELECT * FROM tip")
def x8_tips(spark, sf_dir):
    p, assoc = beside(spark, sf_dir)
    return A.tips(None, assoc, R, tracks=p).withColumn("null_tips", F.round("null_tips", 6))


def pair_evidence(pieces, assoc):
    """Meetups and tips of each pair, over all servers."""
    meets = E.meetups(None, R, tracks=pieces).select("player_a", "player_b", "meets", "null_meets", F.lit(0).cast("long").alias("tips"), F.lit(0.0).alias("null_tips"))
    tips = A.tips(None, assoc, R, tracks=pieces).select("player_a", "player_b", F.lit(0).cast("long").alias("meets"), F.lit(0.0).alias("null_meets"), "tips", "null_tips")
    return meets.unionByName(tips).groupBy("player_a", "player_b").agg(*[F.sum(c).alias(c) for c in ("meets", "null_meets", "tips", "null_tips")])


#: On this table hardly any pair is linked at the default levels, so the query links from one meeting or tip on.
LOOSE = replace(R, link_min=1, link_z=0.5)
CLANS = """
pe AS (SELECT player_a, player_b, sum(meets) + sum(tips) AS seen, sum(null_meets) + sum(null_tips) AS chance FROM
       (SELECT player_a, player_b, meets, null_meets, 0 AS tips, 0.0::DOUBLE AS null_tips FROM meet UNION ALL SELECT player_a, player_b, 0, 0.0::DOUBLE, tips, null_tips FROM tip) GROUP BY 1, 2),
lk AS (SELECT player_a AS a, player_b AS b FROM pe WHERE seen >= 1 AND (seen - chance) / sqrt(chance + 1) >= 0.5),
both_ AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach AS (SELECT a AS p, a AS q FROM both_ UNION SELECT r.p, e.b FROM reach r JOIN both_ e ON e.a = r.q)"""


@query(with_(G.HEAD_SQL, ASSOC, G.DEATH_SQL, MEET, *TIP_CHAIN, CLANS).replace("WITH", "WITH RECURSIVE", 1) + " SELECT p AS player_id, min(q) AS clan FROM reach GROUP BY p")
def x9_clans(spark, sf_dir):
    return A.clans(A.clan_links(pair_evidence(*beside(spark, sf_dir)), LOOSE))


TTC = """
cr AS (SELECT player_id, coalesce(dino_class, '') AS c, duration_s AS d, censored AS k FROM spawn),
cq AS (SELECT r.player_id, r.k, (SELECT count(*) FROM cr o WHERE o.player_id <> r.player_id) AS na, (SELECT count(*) FROM cr o WHERE o.player_id <> r.player_id AND o.c = r.c) AS nc, (SELECT count(*) FROM cr o WHERE o.player_id = r.player_id) AS ma,
       (SELECT coalesce(sum(CASE WHEN o.k THEN 0.5::DOUBLE ELSE 1.0 END), 0) FROM cr o WHERE o.player_id <> r.player_id AND o.d < r.d) AS ba,
       (SELECT coalesce(sum(CASE WHEN o.k THEN 0.5::DOUBLE ELSE 1.0 END), 0) FROM cr o WHERE o.player_id <> r.player_id AND o.c = r.c AND o.d < r.d) AS bc FROM cr r),
cs AS (SELECT player_id, k, CASE WHEN nc < 10 THEN ba / na ELSE bc / nc END AS share FROM cq WHERE ma >= 2 AND na >= 10),
ct AS (SELECT player_id, count(*) AS episodes, count(*) FILTER (NOT k) AS contacts, avg(CASE WHEN k THEN (share + 1) / 2 ELSE share END) AS mean_rank FROM cs GROUP BY 1),
ttc AS (SELECT *, (0.5 - mean_rank) * sqrt(12.0::DOUBLE * episodes) AS z, least(1, greatest(0, ((0.5 - mean_rank) * sqrt(12.0::DOUBLE * episodes) - 1) / 2.5)) AS score FROM ct)"""


@query(with_(ASSOC, SPAWN, TTC) + " SELECT player_id, episodes, contacts, round(mean_rank, 8) AS mean_rank, round(z, 6) AS z, round(score, 6) AS score FROM ttc")
def x6_contact_scores(spark, sf_dir):
    rows = A.contact_scores(spawns(spark, sf_dir), R)
    return rows.select("player_id", "episodes", "contacts", F.round("mean_rank", 8).alias("mean_rank"), F.round("z", 6).alias("z"), F.round("score", 6).alias("score"))


SCORE = """
sb AS (SELECT player_id, sum(moving_s) AS moving_s, sum(episodes) AS e, sum(null_episodes) AS ne FROM beeline GROUP BY 1),
sa AS (SELECT player_id, sum(waits) AS waits, sum(hits) AS h, sum(null_hits) AS nh FROM ambush GROUP BY 1),
sc AS (SELECT player_id, CASE WHEN moving_s >= 600 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((e - ne) / sqrt(ne + 1) - 3) / 4)) END AS beeline, ttc.score AS ttc,
       CASE WHEN waits >= 3 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((h - nh) / sqrt(nh + 1) - 4) / 4)) END AS ambush FROM sb FULL JOIN sa USING (player_id) LEFT JOIN ttc USING (player_id)),
score AS (SELECT *, 1 - (1 - coalesce(beeline, 0)) * (1 - coalesce(0.35 * ttc, 0)) * (1 - coalesce(0.9 * ambush, 0)) AS score FROM sc)"""


@query(with_(G.HEAD_SQL, ASSOC, G.DEATH_SQL, APPROACH, KNOWN, MERGE.format(source="as5"), BEELINE, WAITS, AMBUSH, SPAWN, TTC, SCORE) + " SELECT player_id, round(beeline, 6) AS beeline, round(ttc, 6) AS ttc, round(ambush, 6) AS ambush, round(score, 6) AS score, score >= 0.6 AS flagged FROM score")
def x12_scores(spark, sf_dir):
    p = tracks(spark, sf_dir).kept()
    near = E.near(None, R, p)
    assoc = company(None, near)
    beeline = A.beelines(None, A.episodes(None, assoc, R, tracks=p), R, tracks=p)
    rows = A.scores(beeline, A.contact_scores(E.spawn_episodes(None, assoc, R, beside=near, tracks=p), R), E.ambushes(None, assoc, R, tracks=p), R)
    return rows.select("player_id", *[F.round(c, 6).alias(c) for c in ("beeline", "ttc", "ambush", "score")], "flagged")


# ---- relational operators, on tables derived from events ----
DAY = 86_400
EVENTS_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS s FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", s.alias("s"))


def on_events(body: str, *parts: str) -> str:
    return "WITH " + ", ".join([EVENTS_SQL, *parts]) + " " + body


EVIDENCE_SQL = "v AS (SELECT user_id, s // 86400 AS w, count(*) AS episodes, sum(value) AS moved, string_agg(DISTINCT event_type, ',') AS servers FROM e GROUP BY 1, 2)"


def window_evidence(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id", F.expr("s div 86400").alias("w")).agg(F.count(F.lit(1)).alias("episodes"), F.sum("value").alias("moved"), F.array_join(F.collect_set("event_type"), ",").alias("servers"))


@query(on_events("SELECT event_id, user_id, event_type, s FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s // 3600 ORDER BY event_id) AS n FROM e WHERE (user_id, s // 3600) NOT IN (SELECT (user_id, s // 3600) FROM e WHERE event_id % 5 = 0)) WHERE n = 1"))
def k1_ingest_dedupe(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.expr("s div 3600"))
    return Q.ingest(e, e.filter("event_id % 5 = 0").select("user_id", "hour").distinct(), ["user_id", "hour"], ["event_id"]).select("event_id", "user_id", "event_type", "s")


@query(on_events("SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.total ELSE o.total END AS total FROM o FULL JOIN n ON o.user_id = n.user_id", "o AS (SELECT user_id, count(*) AS total FROM e WHERE user_id % 3 > 0 GROUP BY 1)", "n AS (SELECT user_id, -count(*) AS total FROM e WHERE user_id % 2 = 0 GROUP BY 1)"))
def k3_upsert(spark, sf_dir):
    e = events(spark, sf_dir)
    old = e.filter("user_id % 3 > 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return Q.upsert(old, e.filter("user_id % 2 = 0").groupBy("user_id").agg((-F.count(F.lit(1))).alias("total")), ["user_id"])


@query(on_events("SELECT user_id, event_type, s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS n FROM e) WHERE n = 1"))
def k4_latest_version(spark, sf_dir):
    return Q.latest(events(spark, sf_dir), ["user_id"], ["s", "event_id"]).select("user_id", "event_type", "s")


@query(on_events("SELECT user_id, arg_max(event_type, s * 1000000 + event_id) AS name FROM e GROUP BY 1"))
def a3_latest_name(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", F.col("s") * 1000000 + F.col("event_id")).alias("name"))


@query(on_events("SELECT a, b, CAST(sum(n) AS BIGINT) AS meets, CAST(sum(n) FILTER (w % 2 = 0) AS BIGINT) AS tips FROM p WHERE w > 19730 GROUP BY 1, 2", "p AS (SELECT least(user_id, user_id * 7 % 15) AS a, greatest(user_id, user_id * 7 % 15) AS b, s // 86400 AS w, count(*) AS n FROM e GROUP BY 1, 2, 3)"))
def a1_pair_horizon(spark, sf_dir):
    other = F.col("user_id") * 7 % 15
    p = events(spark, sf_dir).groupBy(F.least("user_id", other).alias("a"), F.greatest("user_id", other).alias("b"), F.expr("s div 86400").alias("w")).agg(F.count(F.lit(1)).alias("meets"))
    p = p.withColumn("tips", F.when(F.col("w") % 2 == 0, F.col("meets")))
    return Q.horizon(p, ["a", "b"], F.col("w"), F.lit(19730), ["meets", "tips"])


@query(on_events("SELECT user_id, CAST(sum(episodes) AS BIGINT) AS episodes, array_to_string(list_sort(list_distinct(flatten(list(string_split(servers, ','))))), ',') AS servers FROM v WHERE w > 19730 GROUP BY 1", EVIDENCE_SQL))
def a2_player_horizon(spark, sf_dir):
    return Q.horizon(window_evidence(events(spark, sf_dir)), ["user_id"], F.col("w"), F.lit(19730), ["episodes"], ("servers",))


@query(on_events("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(s) AS last FROM e GROUP BY 1"))
def a10_status_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.max("s").alias("last"))


@query(on_events("SELECT DISTINCT s // 60 AS w FROM e WHERE s // 60 NOT IN (SELECT s // 60 FROM e WHERE event_id % 3 = 0) ORDER BY 1 LIMIT 12"))
def j5_pending_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("w", F.expr("s div 60"))
    return Q.pending(e, e.filter("event_id % 3 = 0").select("w").distinct(), ["w"], 12)


@query(on_events("SELECT v.user_id, v.w, episodes, coalesce(n, 0) AS purchases FROM v LEFT JOIN (SELECT user_id, s // 86400 AS w, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1, 2) USING (user_id, w)", EVIDENCE_SQL))
def j8_window_rows(spark, sf_dir):
    e = events(spark, sf_dir)
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", F.expr("s div 86400").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return window_evidence(e).join(bought, ["user_id", "w"], "left").select("user_id", "w", "episodes", F.coalesce("n", F.lit(0)).cast("long").alias("purchases"))


@query(on_events("SELECT event_id, user_id, s FROM e WHERE s >= 1705000000 OR user_id IN (SELECT user_id FROM e WHERE event_type = 'purchase' AND value > 90)"))
def k7_retention(spark, sf_dir):
    e = events(spark, sf_dir)
    return Q.retained(e, "s", F.lit(1705000000), e.filter("event_type = 'purchase' and value > 90"), "user_id").select("event_id", "user_id", "s")


@query(on_events("SELECT event_id, user_id FROM (SELECT *, sum(event_id % 97 + 1) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS b FROM e) WHERE b <= 1000"))
def k12_bounded_queue(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("size", F.col("event_id") % 97 + 1)
    return Q.bounded_queue(e, ["user_id"], "event_id", "size", 1000).select("event_id", "user_id")


@query(on_events("SELECT user_id, s, coalesce(gap_s, -1) AS gap_s FROM (SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap_s FROM e) WHERE gap_s IS NULL OR gap_s >= 21600"))
def w15_rejoins(spark, sf_dir):
    return Q.rejoins(events(spark, sf_dir).select("user_id", "s"), ["user_id"], "s", 21600).withColumn("gap_s", F.coalesce("gap_s", F.lit(-1)))


FLAG_SQL = "sc AS (SELECT user_id, avg(value) / 100 AS score FROM e GROUP BY 1), f AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'false_positive' END AS status, value / 100 AS max_score, s AS resolved_at FROM e WHERE event_id % 40 < 2)"


@query(on_events("SELECT sc.user_id AS player_id, round(score, 6) AS score, CASE WHEN o.user_id IS NOT NULL THEN 'refresh' WHEN x.user_id IS NOT NULL THEN 'suppressed' ELSE 'create' END AS action, round(greatest(score, coalesce(o.m, score)), 6) AS max_score FROM sc LEFT JOIN (SELECT user_id, max(max_score) AS m FROM f WHERE status = 'open' GROUP BY 1) o USING (user_id) LEFT JOIN (SELECT DISTINCT user_id FROM f WHERE status = 'false_positive' AND resolved_at >= 1706000000 - 2592000) x USING (user_id) WHERE score >= 0.2", FLAG_SQL))
def x13_flags(spark, sf_dir):
    e = events(spark, sf_dir)
    scores = e.groupBy(F.col("user_id").alias("player_id")).agg((F.avg("value") / 100).alias("score"))
    flags = e.filter("event_id % 40 < 2").select(F.col("user_id").alias("player_id"), F.when(F.col("event_id") % 2 == 0, "open").otherwise("false_positive").alias("status"), (F.col("value") / 100).alias("max_score"), F.col("s").alias("resolved_at"))
    rows = Q.apply_flags(scores, flags, F.lit(1706000000), 0.2, F.lit(30 * DAY))
    return rows.select("player_id", F.round("score", 6).alias("score"), "action", F.round("max_score", 6).alias("max_score"))


@query(on_events("SELECT event_id, user_id, s FROM e LEFT JOIN (SELECT user_id, max(s) AS last FROM e WHERE event_id % 3 = 0 GROUP BY 1) USING (user_id) WHERE event_id % 3 = 1 AND (last IS NULL OR s - last >= 3600)"))
def x14_cooldown(spark, sf_dir):
    e = events(spark, sf_dir)
    return Q.cooled_down(e.filter("event_id % 3 = 1"), e.filter("event_id % 3 = 0"), "user_id", "s", F.lit(3600)).select("event_id", "user_id", "s")


@query(on_events("SELECT event_id, CASE WHEN event_type = 'view' THEN 'sent' WHEN event_type = 'error' OR event_id % 6 + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status, event_id % 6 + 1 AS attempts, CASE WHEN event_type <> 'view' AND NOT (event_type = 'error' OR event_id % 6 + 1 >= 5) THEN greatest(least(600.0::DOUBLE, 30.0::DOUBLE * pow(2.0::DOUBLE, event_id % 6)), 45.0::DOUBLE) END AS wait_s FROM e"))
def x15_deliveries(spark, sf_dir):
    e = events(spark, sf_dir)
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "permanent").otherwise("later")
    return Q.deliveries(e.select("event_id", (F.col("event_id") % 6).alias("attempts"), outcome.alias("outcome"), F.lit(45.0).alias("retry_after")), 30, 600, 5)


@query(on_events("SELECT sum(CASE WHEN p.value > n.value THEN 1.0 WHEN p.value = n.value THEN 0.5 ELSE 0 END) / count(*) AS auc FROM (SELECT round(value) AS value FROM e WHERE event_type = 'purchase') p, (SELECT round(value) AS value FROM e WHERE event_type <> 'purchase') n").replace("AS auc", "AS raw").replace("SELECT sum", "SELECT round(raw, 9) AS auc FROM (SELECT sum", 1) + ")")
def a16_auc(spark, sf_dir):
    e = events(spark, sf_dir).select(F.round("value").alias("v"), (F.col("event_type") == "purchase").alias("p"))
    return Q.auc(e, "v", "p").select(F.round("auc", 9).alias("auc"))


@query(on_events("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e) WHERE r = ceil(0.995 * (n - 1))"))
def a19_quantile_higher(spark, sf_dir):
    return Q.quantile_higher(events(spark, sf_dir), ["event_type"], "value", 0.995)


@query(on_events("SELECT user_id, CAST(sum(m) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS g, CAST(sum(sq) AS BIGINT) AS gg, CAST(sum(s * s) AS BIGINT) AS ss, CAST(sum(s * m) AS BIGINT) AS sm, CAST(sum(m * m) AS BIGINT) AS mm FROM (SELECT user_id, (r - 1) // 8 AS b, count(*) AS m, sum(v) AS s, sum(v * v) AS sq FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e) GROUP BY 1, 2) GROUP BY 1"))
def a18_block_statistics(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.floor("value").cast("long"))
    return Q.block_statistics(e, ["user_id"], ["event_id"], "v")


@query(on_events("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2)) WHERE r = 1"))
def a14_mode(spark, sf_dir):
    return Q.mode(events(spark, sf_dir), ["user_id"], "event_type")


@query(on_events("SELECT window_end, count(*) FILTER (counted) AS counted, count(*) AS n FROM (SELECT t0 + (w + 1) * 7200 AS window_end, s >= t0 + w * 7200 AS counted FROM (SELECT s, t0, unnest(CASE WHEN (s - t0) % 7200 >= 5400 THEN [(s - t0) // 7200, (s - t0) // 7200 + 1] ELSE [(s - t0) // 7200] END) AS w FROM e, (SELECT min(s) AS t0 FROM e))) GROUP BY 1"))
def st1_windows_with_context(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.agg(F.min("s")).first()[0]
    rows = Q.windows_with_context(e, "s", F.lit(first), 7200, 1800)
    return rows.groupBy("window_end").agg(F.count_if("counted").alias("counted"), F.count(F.lit(1)).alias("n"))


@query(on_events("SELECT DISTINCT user_id, CAST(CAST('0x' || substr(sha256('valid:u' || user_id), 1, 16) AS UBIGINT) % 7 AS INTEGER) AS fold FROM e"))
def f14_folds(spark, sf_dir):
    from .functions.scalars import stable_fold

    users = events(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", stable_fold(F.concat(F.lit("u"), F.col("user_id").cast("string")), "valid", 7).alias("fold"))


EXPORT_KEY = b"an export key for tests"
_PADS = ["".join(f"\\x{x ^ p:02X}" for x in EXPORT_KEY.ljust(64, b"\0")) for p in (0x36, 0x5C)]


@query(on_events(f"SELECT DISTINCT user_id, substr(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode('player:u' || user_id)))), 1, 20) AS pseudonym FROM e"))
def p11_pseudonyms(spark, sf_dir):
    from .functions.scalars import pseudonym

    users = events(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", pseudonym("player", F.concat(F.lit("u"), F.col("user_id").cast("string")), EXPORT_KEY).alias("pseudonym"))


# Tokens in seconds, 43200 a token: shares of a token, added up, would round.
BUCKET = """c AS (SELECT user_id, CAST(s AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM e),
b AS (SELECT user_id, n, t, 43200.0::DOUBLE AS have, true AS allowed FROM c WHERE n = 1
      UNION ALL SELECT user_id, n, t, h - CASE WHEN h >= 43200 THEN 43200 ELSE 0 END, h >= 43200 FROM (SELECT c.*, least(86400.0::DOUBLE, b.have + (c.t - b.t)) AS h FROM b JOIN c ON c.user_id = b.user_id AND c.n = b.n + 1))"""


@query(on_events('SELECT user_id, t AS "at", allowed FROM b', BUCKET).replace("WITH", "WITH RECURSIVE", 1))
def f21_token_bucket(spark, sf_dir):
    return Q.token_bucket(events(spark, sf_dir), "user_id", "s", 1 / 43_200, 2)


@query(on_events("SELECT hit, n_true, n_found, hit / n_found AS precision, hit / n_true AS recall, round(2.0::DOUBLE * hit / (n_true + n_found), 9) AS f1 FROM (SELECT count(*) FILTER (t.a IS NOT NULL AND f.a IS NOT NULL) AS hit, count(t.a) AS n_true, count(f.a) AS n_found FROM t FULL JOIN f ON t.a = f.a AND t.b = f.b)", "t AS (SELECT DISTINCT user_id AS a, user_id + event_id % 3 AS b FROM e WHERE event_id % 2 = 0)", "f AS (SELECT DISTINCT user_id AS a, user_id + event_id % 3 AS b FROM e WHERE event_id % 7 = 0)"))
def a17_pair_quality(spark, sf_dir):
    e = events(spark, sf_dir)
    pair = [F.col("user_id").alias("player_a"), (F.col("user_id") + F.col("event_id") % 3).alias("player_b")]
    rows = Q.pair_quality(e.filter("event_id % 2 = 0").select(*pair).distinct(), e.filter("event_id % 7 = 0").select(*pair).distinct())
    return rows.withColumn("f1", F.round("f1", 9))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text responses made from events: one per hour, a line per event; the id is missing from some lines."""
    e = events(spark, sf_dir)
    person = F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(", PlayerID: u"), F.col("user_id").cast("string")))
    line = F.concat(F.lit("Name: p"), F.col("user_id").cast("string"), person, F.lit(", Location: X="), F.col("event_id").cast("string"), F.lit(" Y=-2.5 Z=1e2, Class: BP_"), F.initcap("event_type"), F.lit("_C, Growth: "), (F.col("event_id") % 101).cast("string"), F.lit("%"))
    rows = e.groupBy(F.expr("s div 3600").alias("response_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    return rows.select("response_id", F.concat(F.lit("[2026.01.02-03.04.05] PlayerData\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\nPlayerDataEnd\nrest")).alias("text"))


@query(on_events("SELECT h AS response_id, CAST(r + 1 AS INTEGER) AS line_no, CASE WHEN ok AND d = 1 THEN 'u' || user_id END AS player_id, CASE WHEN ok AND d = 1 THEN CAST(event_id AS DOUBLE) END AS x, CASE WHEN ok AND d = 1 THEN upper(event_type[1]) || event_type[2:] END AS dino_class, CASE WHEN ok AND d = 1 AND event_id % 101 <= 100 THEN (event_id % 101) / 100.0::DOUBLE END AS growth, CASE WHEN NOT ok THEN 'no id' WHEN d > 1 THEN 'duplicate id' END AS reason FROM (SELECT *, s // 3600 AS h, event_id % 13 <> 0 AS ok, row_number() OVER (PARTITION BY s // 3600 ORDER BY event_id) AS r, row_number() OVER (PARTITION BY s // 3600, CASE WHEN event_id % 13 <> 0 THEN user_id END ORDER BY event_id) AS d FROM e)"))
def s1_parse_lines(spark, sf_dir):
    from .sources.text import parse

    return parse(responses(spark, sf_dir)).select("response_id", "line_no", "player_id", "x", "dino_class", "growth", "reason")


# ---- step selection, on moves made from events ----
TERMS_SQL = """
m AS (SELECT user_id, event_id, event_id % 13 AS y, unnest(generate_series(0, 12)) AS cand FROM e),
ms AS (SELECT m.*, s.shift, ((event_id * 7 + cand * 5) % 11) / 8.0::DOUBLE AS a, ((event_id * 3 + cand * 2 + s.shift) % 7) / 8.0::DOUBLE AS b FROM m, (VALUES (0), (1), (2)) s(shift)),
mt AS (SELECT *, max(a) OVER w AS ta, max(a + b) OVER w AS tb FROM ms WINDOW w AS (PARTITION BY event_id, shift)),
mu AS (SELECT *, greatest(a - ta - ln(sum(exp(a - ta)) OVER w), ln(0.0001)) AS la, greatest(a + b - tb - ln(sum(exp(a + b - tb)) OVER w), ln(0.0001)) AS lb FROM mt WINDOW w AS (PARTITION BY event_id, shift)),
g AS (SELECT user_id, event_id, max(lb) FILTER (shift = 0) - avg(lb) FILTER (shift > 0) AS gain FROM mu WHERE cand = y GROUP BY 1, 2)"""


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 13).alias("y"))
    rows = L.candidate_rows(e, "y").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    a = (F.col("event_id") * 7 + F.col("cand") * 5) % 11 / 8.0
    b = (F.col("event_id") * 3 + F.col("cand") * 2 + F.col("shift")) % 7 / 8.0
    return L.terms(rows.withColumn("score_a", a).withColumn("score_b", b), ["user_id", "event_id"])


@query(on_events("SELECT user_id, event_id, round(gain, 8) AS gain FROM g", TERMS_SQL))
def x19_leakage_terms(spark, sf_dir):
    return gains(spark, sf_dir).withColumn("gain", F.round("gain", 8))


@query(on_events("""SELECT user_id, n, blocks, round(CASE WHEN blocks < 2 OR v <= 0 THEN 0 ELSE s / sqrt(v) END, 6) AS z FROM (SELECT *, greatest(greatest(gg - 2 * (s / n) * gm + pow(s / n, 2) * mm, 0) * blocks / (blocks - 1), greatest(q - n * pow(s / n, 2), 0) * n / greatest(n - 1, 1)) AS v FROM
 (SELECT user_id, CAST(sum(m) AS BIGINT) AS n, count(*) AS blocks, sum(s) AS s, sum(q) AS q, sum(s * s) AS gg, sum(s * m) AS gm, sum(m * m) AS mm FROM (SELECT user_id, (r - 1) // 8 AS b, count(*) AS m, sum(gain) AS s, sum(gain * gain) AS q FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM g) GROUP BY 1, 2) GROUP BY 1))""", TERMS_SQL))
def x20_leakage_z(spark, sf_dir):
    return L.statistics(gains(spark, sf_dir), ["user_id"], ["event_id"]).select("user_id", "n", "blocks", F.round(L.z(), 6).alias("z"))


@query(with_() + " SELECT substr(sha256('" + _PADS[1] + "'::BLOB || unhex(sha256('" + _PADS[0] + "'::BLOB || encode('org:org')))), 1, 20) AS org, CAST((idx * 5 // 7200 + 1) * 7200 AS BIGINT) AS window_end, count(*) AS rows, count(DISTINCT player_id) AS players, count(DISTINCT server_id) AS servers FROM grid GROUP BY 1, 2")
def k8_export_manifest(spark, sf_dir):
    rows = grid(spark, sf_dir).withColumn("org_id", F.lit("org")).withColumn("t", F.col("idx") * 5)
    out = X.manifest(X.pseudonymous(rows, EXPORT_KEY))
    return out.withColumn("window_end", F.col("window_end").cast("long"))


@query(with_(G.HEAD_SQL) + " SELECT server_id, player_id, idx, CASE WHEN NOT moving THEN 12 ELSE CAST(((floor((atan2(dy, dx) + pi() + pi() / 12) / (pi() / 6))) % 12 + 12) % 12 AS INTEGER) END AS move FROM head WHERE dx IS NOT NULL")
def x18_moves(spark, sf_dir):
    from .functions.scalars import direction_bin

    h = G.headings(grid(spark, sf_dir), R).filter("dx is not null")
    speed = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / R.heading_s
    return h.select("server_id", "player_id", "idx", direction_bin(F.col("dx"), F.col("dy"), speed).alias("move"))


# ---- more sequence operators ----
@query(with_() + " SELECT server_id, player_id, idx, round(avg(x) OVER w, 6) AS mean_x FROM grid WINDOW w AS (PARTITION BY server_id, player_id ORDER BY idx RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)")
def w8_trailing_mean(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.select("server_id", "player_id", "idx", F.round(T.trailing_mean(g, "x", 12), 6).alias("mean_x"))


LIFE_SQL = """
lf AS (SELECT *, CASE WHEN coalesce(lag(idx) OVER w <> idx - 1, true) OR pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) > 90000 OR dino_class IS DISTINCT FROM lag(dino_class) OVER w THEN idx END AS s FROM grid WINDOW w AS (PARTITION BY server_id, player_id ORDER BY idx)),
life AS (SELECT *, max(s) OVER (PARTITION BY server_id, player_id ORDER BY idx) AS life_start FROM lf)"""


@query(with_(LIFE_SQL) + " SELECT server_id, player_id, life_start, max(idx - life_start) AS lasted FROM life GROUP BY ALL")
def w9_lives(spark, sf_dir):
    return T.lives(grid(spark, sf_dir), R).groupBy("server_id", "player_id", "life_start").agg(F.max("since").alias("lasted"))


@query(with_(G.HEAD_SQL) + " SELECT server_id, player_id, idx, last_value(CASE WHEN moving THEN dx END IGNORE NULLS) OVER w AS hx, last_value(CASE WHEN moving THEN dy END IGNORE NULLS) OVER w AS hy FROM head WINDOW w AS (PARTITION BY server_id, player_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w10_last_heading(spark, sf_dir):
    return T.last_heading(G.headings(grid(spark, sf_dir), R)).select("server_id", "player_id", "idx", "hx", "hy")


@query(f"WITH {S.SQL}, sg AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 300 THEN 0 ELSE 1 END AS n FROM pos WINDOW w AS (PARTITION BY server_id, player_id ORDER BY t)), sh AS (SELECT *, CAST(sum(n) OVER (PARTITION BY server_id, player_id ORDER BY t) AS BIGINT) AS segment FROM sg) SELECT server_id, player_id, segment, min(t) AS first, max(t) AS last, count(*) AS points FROM sh GROUP BY 1, 2, 3")
def w14_segments(spark, sf_dir):
    return T.segments(samples(spark, sf_dir), 300)


NEAR_SQL = "np AS (SELECT a.server_id, a.player_id, a.idx, a.aware, b.player_id AS player_id_j, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS distance2 FROM grid a JOIN grid b ON a.server_id = b.server_id AND a.idx = b.idx AND a.player_id <> b.player_id)"


@query(with_(NEAR_SQL) + " SELECT server_id, player_id, idx, slot, player_id_j, distance2 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY server_id, player_id, idx ORDER BY distance2, player_id_j) AS INTEGER) AS slot FROM np WHERE distance2 <= 250000) WHERE slot <= 3")
def w17_nearest_slots(spark, sf_dir):
    return T.nearest_slots(tracks(spark, sf_dir).dealt_steps(), 3, 500.0)


@query(with_(NEAR_SQL) + " SELECT server_id, player_id, idx, count(*) FILTER (distance2 <= (aware + 50) * (aware + 50)) AS n_visible, count(*) FILTER (distance2 > (aware + 50) * (aware + 50) AND distance2 <= 9000000) AS n_beyond FROM np GROUP BY 1, 2, 3")
def a21_neighbourhood(spark, sf_dir):
    return T.neighbourhood(grid(spark, sf_dir), 50.0, 3000.0)


@query(f"WITH {S.SQL} SELECT server_id, player_id, t, 0.25::DOUBLE * x + -0.5::DOUBLE * y + 100.0::DOUBLE AS u, 0.5::DOUBLE * x + 0.25::DOUBLE * y + -7.0::DOUBLE AS v FROM pos")
def p13_map_points(spark, sf_dir):
    u, v = T.map_point(F.col("x"), F.col("y"), ((0.25, -0.5, 100.0), (0.5, 0.25, -7.0)))
    return samples(spark, sf_dir).select("server_id", "player_id", "t", u.alias("u"), v.alias("v"))


@query(on_events("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'see https://h' || event_id % 7 || '.example/***' ELSE 'no link ' || event_id END || ' or ' || CASE WHEN event_id % 2 = 0 THEN '***@***' ELSE event_type END || ', ' || CASE WHEN event_id % 5 = 0 THEN 'password = ***' ELSE 'pass word ' || user_id END AS line FROM e"))
def p14_redaction(spark, sf_dir):
    n, text = F.col("event_id"), F.col("event_id").cast("string")
    link = F.when(n % 3 == 0, F.concat(F.lit("see https://h"), (n % 7).cast("string"), F.lit(".example/"), text, F.lit("/x"))).otherwise(F.concat(F.lit("no link "), text))
    mail = F.when(n % 2 == 0, F.concat(F.lit("m"), text, F.lit("@mail.example"))).otherwise(F.col("event_type"))
    word = F.when(n % 5 == 0, F.concat(F.lit("password = p"), text)).otherwise(F.concat(F.lit("pass word "), F.col("user_id").cast("string")))
    line = F.concat(link, F.lit(" or "), mail, F.lit(", "), word)
    return events(spark, sf_dir).select("event_id", T.redacted(line).alias("line"))


@query(on_events("SELECT h AS response_id, count(*) AS lines, count(*) FILTER (ok AND d = 1) AS players, 0::BIGINT AS salvaged, count(*) FILTER (NOT ok OR d > 1) AS unparsed FROM (SELECT s // 3600 AS h, event_id % 13 <> 0 AS ok, row_number() OVER (PARTITION BY s // 3600, CASE WHEN event_id % 13 <> 0 THEN user_id END ORDER BY event_id) AS d FROM e) GROUP BY 1"))
def a13_parse_health(spark, sf_dir):
    from .sources.text import parse

    return T.parse_health(parse(responses(spark, sf_dir))).drop("errors")


@query(on_events("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS middle, round(avg(CASE WHEN value >= 60 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS flagged FROM e GROUP BY 1"))
def a15_summary(spark, sf_dir):
    rows = T.summary(events(spark, sf_dir), "event_type", "value", 60.0)
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "p90", "middle", "flagged")})


@query(with_(G.HEAD_SQL) + ", tr AS (SELECT a.server_id, a.player_id, a.idx, a.dx, a.dy, b.player_id AS j, b.x - a.x AS rx, b.y - a.y AS ry, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d FROM head a JOIN grid b ON a.server_id = b.server_id AND a.idx = b.idx AND a.player_id <> b.player_id WHERE a.moving), tm AS (SELECT *, row_number() OVER (PARTITION BY server_id, player_id, idx ORDER BY d, j) AS n FROM tr) SELECT server_id, player_id, idx, j AS player_id_j, (rx * dx + ry * dy) / nullif(sqrt(d * (dx * dx + dy * dy)), 0) AS cos FROM tm WHERE n = 1")
def w18_tracking(spark, sf_dir):
    g = grid(spark, sf_dir)
    return T.tracking(G.headings(g, R))


@query(with_() + ", na AS (SELECT DISTINCT server_id, player_id, x, y FROM grid), nc AS (SELECT a.server_id, a.player_id, b.player_id AS player_id_j, min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS distance2 FROM na a JOIN na b ON a.server_id = b.server_id AND a.player_id <> b.player_id GROUP BY 1, 2, 3) SELECT server_id, player_id, player_id_j, distance2 FROM (SELECT *, row_number() OVER (PARTITION BY server_id, player_id ORDER BY distance2, player_id_j) AS n FROM nc WHERE distance2 <= 250000) WHERE n <= 8")
def j11_nearest_approach(spark, sf_dir):
    return N.nearest_approach(tracks(spark, sf_dir), 500.0, 8)
