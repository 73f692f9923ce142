import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import geometry as g
from stratalog.functions import numeric as num
from stratalog.operators import agents, devtools, interest, nav, spatial


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(4)
    rows = [(i, *(random.uniform(-20, 20) for _ in range(3))) for i in range(300)]
    return rows, spark.createDataFrame(rows, "entity long, x double, y double, z double")


def test_ranges(cloud):
    rows, df = cloud
    near = {i for i, *p in rows if all(abs(a - b) <= 6 for a, b in zip(p, (1, 2, 3)))}
    assert {r.entity for r in spatial.in_range(df, (1, 2, 3), 6).collect()} == near
    ball = {i for i, *p in rows if math.dist(p, (1, 2, 3)) <= 6}
    assert {r.entity for r in spatial.in_range(df, (1, 2, 3), 6, exact=True).collect()} == ball
    assert near <= {r.entity for r in spatial.grid_candidates(df, (1, 2, 3), 6, 5.0).collect()}


def test_distance_join_is_an_equi_join(cloud):
    rows, df = cloud
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 4}
    pairs = spatial.neighbour_pairs(df, 4.0)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rays(spark, cloud):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 0.0)], "entity long, x double, y double, z double")
    hit = spatial.raycast(df, (-5, 0, 0), (2, 0, 0), 1.0).first()
    assert (hit.entity, hit.distance) == (0, 4.0)
    assert spatial.raycast(df, (-5, 0, 0), (1, 0, 0), 1.0, most=3.0).count() == 0
    assert one(spark, g.ray_sphere((0, 0, 0), (1, 0, 0), (0, 0, 0), 2)) == -1
    assert one(spark, g.ray_box((-5, 0, 0), (1, 0, 0), (-1, -1, -1), (1, 1, 1))) == 4
    assert one(spark, g.ray_box((-5, 3, 0), (1, 0, 0), (-1, -1, -1), (1, 1, 1))) == -1
    rows, points = cloud
    rays = [(i, 0.0, 0.0, 0.0, math.cos(i), math.sin(i), 0.0) for i in range(20)]
    found = {r.ray: r.entity for r in spatial.raycast_all(points, spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double"), 1.5, 40.0).collect()}
    want = {}
    for i, *r in rays:
        hits = []
        for e, *p in rows:
            along = sum(a * b for a, b in zip(p, r[3:]))
            off = sum(a * a for a in p) - along**2
            if along >= 0 and off <= 2.25 and 0 <= along - math.sqrt(2.25 - off) <= 40:
                hits.append((along - math.sqrt(2.25 - off), e))
        if hits:
            want[i] = min(hits)[1]
    assert found == want


def test_volumes(spark):
    at = lambda v, *p: one(spark, v.contains([F.lit(float(x)) for x in p]))
    assert at(g.Volume("sphere", (10, 0, 0), 5), 8, 0, 0) and not at(g.Volume("sphere", (10, 0, 0), 5), 4.9, 0, 0)
    box = g.Volume("box", (0, 0, 0), high=(10, 10, 10))
    assert at(box, 5, 0, 5) and at(box, 10, 10, 10) and not at(box, 12, 0, 5)
    eye = g.Volume("frustum", (0, 0, 0), hfov=0.7854, vfov=0.7854, far=100)
    assert at(eye, 0, 0, -20) and not at(eye, 0, 0, 20) and not at(eye, 20, 0, -20)
    assert box.bounding_sphere()[0] == (5, 5, 5)


def test_sectors(spark):
    s = one(spark, g.sector_of(1234.5, -999.25, 0))
    assert (s.sx, s.sy, s.sz, s.ox, s.oy) == (1, -1, 0, 210.5, 24.75)
    a, b = g.sector_of(511.5, 0, 0), g.sector_of(512.5, 0, 0)
    assert one(spark, g.sector_squared(a, b)) == 1
    assert one(spark, g.sector_squared(g.sector_of(1e9, 0, 0), g.sector_of(1e9 + 64, 0, 0))) == 64 * 64
    assert one(spark, g.sector_world(a)).x == 511.5 and one(spark, g.sector_delta(a, b)).dsx == 1


def test_numbers(spark):
    fix = lambda x: num.fix(F.lit(float(x)))
    assert one(spark, num.fix_value(num.fix_mul(fix(1.5), fix(2)))) == 3
    assert one(spark, num.fix_value(num.fix_div(fix(-7), fix(2)))) == -3.5
    assert one(spark, num.fix_div(fix(1), fix(0))) == num.MOST
    assert abs(one(spark, num.fix_value(num.fix_sqrt(fix(2)))) - 2**0.5) < 1e-3
    assert one(spark, num.fix_sin(F.lit(num.TAU))) == 0 and abs(one(spark, num.fix_sin(F.lit(num.HALF_PI))) - num.ONE) <= 1
    assert abs(one(spark, num.fix_cos(F.lit(num.PI))) + num.ONE) <= 8
    curve = [(0, 0), (50, 0.5), (100, 1)]
    assert [one(spark, num.curve(F.lit(float(x)), curve)) for x in (25, 75, -10, 200)] == [0.25, 0.75, 0, 1]
    assert [one(spark, num.quantized(F.lit(x), 0.5)) for x in (5.3, -2.25)] == [5.5, -2.5]
    assert [one(spark, num.lod_tier(F.lit(float(d)), [20, 100, 500])) for d in (20, 50, 100, 300, 600)] == [0, 1, 1, 2, None]


def test_streams():
    a, b = num.Stream(7), num.Stream(7)
    assert [a.u64() for _ in range(4)] == [b.u64() for _ in range(4)]
    seeds = [num.chain_seed(42, x, -1, 0, 3) for x in range(5)]
    many = num.chain_seeds(np.full(5, 42), np.arange(5), np.full(5, -1), np.zeros(5, np.int64), np.full(5, 3))
    assert many.tolist() == seeds and num.child_seed(seeds[0], 0) != num.child_seed(seeds[0], 1)
    draws = num.first_draws(many, 3)
    stream = num.Stream(seeds[2])
    assert draws[2].tolist() == [stream.u32() for _ in range(3)]
    assert num.fnv32("hp") != num.fnv32("hq") and num.fnv64(b"") == 14695981039346656037


def test_subscriptions(spark):
    moves = [(1, t, x) for t, x in enumerate([0.0, 8.0, 9.0, 20.0])]
    p = spark.createDataFrame(moves, "entity long, tick long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    flags = p.withColumn("inside", g.in_sphere([F.col(n) for n in "xyz"], (10, 0, 0), 5))
    assert [(r.tick, r.event) for r in interest.edges(flags, ["entity"], "inside").orderBy("tick").collect()] == [(1, "enter"), (3, "leave")]
    subs = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 5.0)], "sub long, cx double, cy double, cz double, r double")
    few = {(r.sub, r.entity) for r in interest.inside(p.where("tick = 1"), subs).collect()}
    old, interest.BROADCAST = interest.BROADCAST, 0
    try:
        assert {(r.sub, r.entity) for r in interest.inside(p.where("tick = 1"), subs).collect()} == few == {(1, 1)}
    finally:
        interest.BROADCAST = old


def test_levels_and_rates(spark):
    rules = [(20, 1, 0.0), (100, 1, 0.5), (500, 1, 1.0)]
    now = spark.createDataFrame([(1, 1, 5.0), (1, 2, 50.0), (1, 3, 300.0), (1, 4, 5000.0)], "sub long, entity long, d double")
    vals = spark.createDataFrame([(e, "x", 5.3, 1) for e in range(1, 5)], "entity long, comp string, value double, tick long")
    out = interest.subscriber_delta(now, now.select("sub", "entity"), vals, rules, 0).collect()
    assert {r.entity: r.value for r in out} == {1: 5.3, 2: 5.5, 3: 5.0}
    rows = spark.createDataFrame([(1, 1, "x", 1, t, t, 2) for t in (1, 2, 3)], "sub long, entity long, comp string, tier int, tick long, last_write long, every int")
    assert sorted(r.tick for r in interest.send_times(rows).collect()) == [1, 3]


def test_chunks(spark):
    c = spark.createDataFrame([(0, 0, 0, "DORMANT"), (1, 0, 0, "DORMANT"), (2, 0, 0, "DORMANT"), (0, 5, 0, "DORMANT"), (10, 0, 0, "ACTIVE")], "cx int, cy int, cz int, state string")
    plan = lambda **o: {(r.cx, r.cy, r.cz): r.action for r in interest.chunk_plan(c, {"x": 0.0, "y": 0.0, "z": 0.0, **o}).collect() if r.action}
    assert plan() == {(0, 0, 0): "load", (10, 0, 0): "unload"}
    assert plan(vx=1000.0)[2, 0, 0] == "load"


def test_agents(spark):
    act = [agents.Action(1, "gold", 1), agents.Action(2, "house", 1, "gold", 1)]
    assert agents.plan({}, {"house": 1}, act) == [1, 2] and agents.plan({}, {"x": 1}, act) is None
    assert agents.plan({"gold": 1}, {"house": 1}, act) == [2]
    df = spark.createDataFrame([(1, None), (2, 1.0)], "entity long, gold double")
    assert {r.entity: r.plan for r in agents.plans(df, ["gold"], {"house": 1.0}, act).collect()} == {1: [1, 2], 2: [2]}
    trees = agents.Trees()
    leaf = agents.Node("leaf", leaf="a")
    assert trees.register("t", leaf) == 1 and trees.register("t", leaf) == 2
    with pytest.raises(ValueError):
        trees.register("t", agents.Node("selector"))
    board = F.create_map(*(x for i in range(16) for x in (F.lit(i), F.lit(i))))
    assert len(one(spark, agents.board_set(board, F.lit(99), F.lit(1)))) == 16
    assert one(spark, agents.board_set(board, F.lit(3), F.lit(7)))[3] == 7


def test_navigation(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, False), (1, 0, 0, 0, False), (2, 1, 0, 0, False)], "node long, cx int, cy int, cz int, blocked boolean")
    ties = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "a long, b long")
    flips, touched = nav.obstacle_patch(nodes, ties, (1, 0, 0), (1, 0, 0), True)
    assert flips.count() == 1 and touched.count() == 2
    blocked, left = nav.patched(nodes, ties, flips, touched, True)
    assert nav.linked(ties, blocked, left).count() == 1
    assert nav.obstacle_patch(blocked, ties, (1, 0, 0), (1, 0, 0), True)[0].count() == 0
    assert nav.tiles_in_radius(spark.createDataFrame([(0, 0, 0)], "tx long, ty long, tz long"), 1).count() == 27
    rows = spark.createDataFrame([(i, float(i), float(i)) for i in range(20)], "row long, a double, b double")
    assert nav.lane_best(rows, "a", "b").first().lane == 1


def shuffled_rows(df):
    """Rows written to shuffles by the run of df, which must have been collected."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        written = plan.metrics().get("shuffleRecordsWritten")
        below = plan.children()
        return (written.get().value() if written.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("few", [10_000, 0])
def test_paths_shuffle_routes_not_points(spark, monkeypatch, few):
    monkeypatch.setattr(nav, "BROADCAST", few, raising=False)
    random.seed(9)
    ends = [[random.uniform(-600, 2600) for _ in range(6)] for _ in range(150)]
    ends += [[5.0] * 6, [0.0, 0, 0, 64, 0, 0], [0.0, 0, 0, 1024, 0, 0], [-1.0, 0, 0, 1, 0, 0], [900.0, 900, 900, 1100, 1100, 1100]]
    ends += [[0.0, 0, 0, 1e5, 0, 0], [None, 0.0, 0, 1, 1, 1]]
    routes = [(k, *e) for k, e in enumerate(ends)]
    routes += [(151, 5.0, 5.0, 5.0, 9e3, 5.0, 5.0), (None, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0), (None, 1.0, 1.0, 1.0, 9e3, 2.0, 2.0)]
    random.seed(2)
    resident = {(x, y, z) for x in range(-1, 3) for y in range(-1, 3) for z in range(-1, 3) if random.random() < 0.8} | {(0, 0, 0), (1, 0, 0)}
    want, asked = [], {}
    for route, *e in routes:
        if None in e:
            continue
        a, b = e[:3], e[3:]
        d = math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))
        n = 0 if d <= 64 else math.floor(d / 64)
        for i in range(n + 2):
            t = 1.0 if i > n else i / max(n, 1)
            at = [p + (q - p) * t for p, q in zip(a, b)]
            tile = tuple(math.floor(v / 1024) for v in at)
            if tile not in resident:
                rank = (0 if i == 0 else 1 if i > n else 2, i)
                asked[route] = min(asked.get(route, (rank, tile)), (rank, tile))
            if i > 0:
                want.append((route, i, *at))
    # a repeated route is passable if all its rows are; none is told from another by a null
    want = [w for w in want if w[0] is None or w[0] not in asked]
    assert len({w[0] for w in want}) > 20 and len(asked) > 50
    rows = [(route, *(v if v is None else float(v) for v in e)) for route, *e in routes]
    told = spark.createDataFrame(rows, "route long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    points, wanted = nav.straight_paths(told, spark.createDataFrame(sorted(resident), "tx long, ty long, tz long"))
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, points.collect()), key=key) == sorted(want, key=key)
    assert {r.route: tuple(r)[1:] for r in wanted.collect()} == {r: tile for r, (_, tile) in asked.items()}
    # points and their tiles: 1,000s; routes, and at most the tiles that each enters
    assert shuffled_rows(points) < (3 if few else 12) * len(routes) + 2 * len(resident)


def test_profile(spark):
    counts = spark.createDataFrame([(1, 300), (2, 5), (3, 256), (0, 0)], "signature long, entities long")
    got = {r.signature: r.o for r in counts.withColumn("o", devtools.occupancy(F.col("entities"))).collect()}
    assert got == {1: (1 + 44 / 256) / 2, 2: 5 / 256, 3: 1.0, 0: 0.0}
    row = devtools.profile(counts, spark.createDataFrame([("a", 1), ("b", 1)], "comp string, stride long")).first()
    assert row.sparse == 1 and row.health == pytest.approx(0.75 * 60 + 40)
    assert {r.comp: r.tier for r in devtools.tiers(spark.createDataFrame([("a", 64), ("b", 8), ("c", 9)], "comp string, accesses int")).collect()} == {"a": "HOT", "b": "COLD", "c": "WARM"}
