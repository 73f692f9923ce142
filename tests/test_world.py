import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.operators import delta, devtools, graph, schema, temporal
from stratalog.operators.delta import CODECS, Codec
from stratalog.sources import saves
from stratalog.world import World

LOG = "tick long, seq long, entity long, comp string, value double"


@pytest.fixture(scope="module")
def timeline(spark):
    """hp 100, 80 at 2, 0 at 3; x 0, 10, 20."""
    w = World.empty(spark).spawn(1)
    w = w.write((1, "hp", 100.0), (1, "x", 0.0)).advance().write((1, "x", 10.0)).advance()
    return w.write((1, "x", 20.0), (1, "hp", 80.0)).advance().write((1, "hp", 0.0))


def values(df):
    return {r.comp: r.value for r in df.collect()}


def test_as_of(timeline):
    assert values(timeline.state(1)) == {"hp": 100, "x": 10}
    assert values(timeline.state(2)) == {"hp": 80, "x": 20}
    assert values(timeline.state()) == {"hp": 0, "x": 20}


def test_scrub_and_last_write(timeline):
    rows = temporal.scrub(timeline.components.where("comp = 'hp'"), 0, 3).orderBy("tick").collect()
    assert [r.value for r in rows] == [100, 100, 80, 0]
    assert {r.comp: r.last_tick for r in temporal.last_write(timeline.components).collect()} == {"hp": 3, "x": 2}
    assert timeline.changed("x", 0).count() == 1 and timeline.changed("x", 2).count() == 0


def test_first_difference(timeline, spark):
    other = timeline.components.withColumn("value", F.when((F.col("tick") == 2) & (F.col("comp") == "hp"), 55.0).otherwise(F.col("value")))
    assert temporal.first_difference(timeline.components, other, 0, 3).first().tick == 2
    assert temporal.first_difference(timeline.components, timeline.components, 0, 3).first().tick == 4


def test_signatures(spark):
    w = World.empty(spark).spawn(1, 2, 3, 4, 1)
    w = w.write(*((i, "pos", float(i)) for i in range(1, 5)), (2, "hp", 100.0), (4, "hp", 100.0), (9, "hp", 1.0))
    assert w.matching(["pos"]).count() == 4 and w.matching(["pos", "hp"]).count() == 2
    assert sorted((r.signature, r.entities) for r in devtools.archetypes(w.wide(["pos", "hp"])).collect()) == [(1, 2), (3, 2)]
    assert w.despawn(2, 77).matching(["pos", "hp"]).count() == 1


def test_rebirth_forgets(spark):
    w = World.empty(spark).spawn(1).write((1, "hp", 5.0)).advance().despawn(1).advance().spawn(1)
    assert w.state().count() == 0 and w.live().count() == 1 and values(w.state(0)) == {"hp": 5}


def test_relations(spark):
    w = World.empty(spark).spawn(1, 2, 3).advance().relate((1, 0, 2, 0.0), (1, 2, 3, 2.5), (3, 1, 2, 1.0), (1, 0, 99, 1.0)).advance().relate((1, 2, 3, 9.0))
    assert {(r.src, r.kind, r.dst): r.payload for r in w.relations().collect()} == {(1, 0, 2): 0, (1, 2, 3): 9, (3, 1, 2): 1}
    assert {(r.entity, r.kind): r.degree for r in graph.degrees(w.relations()).collect()} == {(1, 0): 1, (1, 2): 1, (3, 1): 1}
    w = w.advance().unrelate((1, 0, 2))
    assert w.relations().count() == 2 and graph.removed_since(w.edges, 2).count() == 1
    assert w.despawn(3).relations().count() == 0


def test_resimulation(spark):
    log = spark.createDataFrame([(t, t, 1, "hp", float(100 - 10 * t)) for t in range(4)], LOG)
    inputs = spark.createDataFrame([(3, 0, 1, "hp", 75.0), (9, 0, 1, "hp", 1.0), (0, 0, 1, "hp", 1.0)], LOG)
    assert temporal.as_of(temporal.resimulated(log, inputs, 0, 3), None).first().value == 75


def test_delta_fold_and_apply(spark):
    w = World.empty(spark).spawn(1, 2, 3).write((1, "hp", 1.0), (2, "hp", 5.0)).advance().write((1, "hp", 10.0)).despawn(2)
    rows = delta.capture(w.components, w.lifecycle, w.edges, -1)
    folded = delta.fold(rows)
    assert sorted((r.op, r.entity, r.value) for r in folded.collect() if r.op == "update") == [("update", 1, 10.0)]
    assert {r.entity for r in folded.collect() if r.op == "spawn"} == {1, 3}
    copy = delta.applied(World.empty(spark), folded, 1)
    assert values(copy.state()) == {"hp": 10} and copy.live().count() == 2
    assert devtools.states_equal(copy.state(), w.state(), ["entity", "comp", "value"])


def test_saves(spark, tmp_path, timeline):
    path = str(tmp_path / "save")
    saves.save_world(timeline, path)
    later = timeline.advance().write((1, "hp", 50.0))
    saves.save_incremental(later, path)
    back = saves.load_world(spark, path)
    assert back.tick == 4 and values(back.state()) == {"hp": 50, "x": 20}
    small = saves.compact(back)
    assert values(small.state()) == {"hp": 50, "x": 20} and small.components.count() == 2
    saves.write_log(timeline.components, str(tmp_path / "log"), bucket=2)
    assert saves.read_log(spark, str(tmp_path / "log"), 2, 3, bucket=2).count() == 3


def test_replay(spark, tmp_path):
    w, path = World.empty(spark), str(tmp_path / "replay")
    for t in range(3):
        w = w.advance().spawn(t).write((t, "v", float(t)))
        saves.record(delta.capture(w.components, w.lifecycle, w.edges, t), path, t + 1)
    back = saves.replayed(spark, path, World.empty(spark))
    assert sorted((r.entity, r.value) for r in back.state().collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_codec_sizes():
    assert len(Codec.floats(struct.pack("<3f", 1.5, -2.25, 3000))) == 10
    assert len(Codec.runs(bytes([7]) * 10 + bytes([9]) * 6)) == 14
    packed = Codec.bits(struct.pack("<8H", 1, 2, 3, 255, 0, 0, 7, 300))
    assert Codec.unbits(packed, 16) == struct.pack("<8H", 1, 2, 3, 255, 0, 0, 7, 300)
    assert Codec.bits(bytes(16))[1] == 0 and len(Codec.sector(bytes(24))) == 22


@given(st.binary(min_size=1, max_size=64))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data):
    for name in ("raw", "runs", "bits"):
        encode, decode = CODECS[name]
        assert decode(encode(data), len(data)) == data
    rows = [(2, 5, 1, data), (0, 6, 0, b"")]
    wire = delta.serialized(rows, 1, 2, {1: "runs"})
    assert delta.deserialized(wire) == (1, 2, rows)
    for cut in (3, len(wire) - 1):
        with pytest.raises(ValueError):
            delta.deserialized(wire[:cut])


def test_divergence_and_trace(spark):
    kind = "tick long, seq long, system string, entity long, comp string, value double, input string"
    rows = [(1, 1, "Buffs", 1, "buffs", 1.0, None), (2, 2, "Damage", 1, "damage", 5.0, "buffs"), (3, 3, "Health", 1, "hp", 90.0, "damage"), (3, 4, "Other", 2, "hp", 1.0, None)]
    a = spark.createDataFrame(rows, kind)
    b = a.withColumn("value", F.when(F.col("entity") == 1, F.col("value") + 1).otherwise(F.col("value")))
    assert devtools.first_divergence(a, b).first().tick == 1 and devtools.first_divergence(a, a).first().tick is None
    assert [s for s, *_ in devtools.trace(a, b)] == ["Health", "Damage", "Buffs"]


def test_schema_tools(spark):
    rules = [schema.Rule(1, 2, {"hp": "hp", "most": None}), schema.Rule(2, 3, {"hp": "hp"})]
    assert [r.end for r in schema.path(rules, 1, 3)] == [2, 3] and schema.path(rules, 1, 9) == []
    df = spark.createDataFrame([((5.0,),), (None,)], "h struct<hp:double>")
    assert [r.h and (r.h.hp, r.h.most) for r in schema.migrated(df, "h", {"hp": "hp", "most": None}, 100.0).collect()] == [(5, 100), None]
    o = schema.Overlay({"Health": 3})
    assert o.resolve("a", ["Health"], ["Mana"]) and o.mods["a"] == {"Health": 3, "Mana": 4096}
    assert not o.resolve("a") and not o.resolve("b", ["Nope"]) and not o.resolve("c", ["Health", "Health"]) and not o.resolve("d", new=["Mana"])
    assert o.owner(4096) == "a" and o.owner(3) == "core" and o.schema_hash()


def test_sandbox(spark):
    df = spark.createDataFrame([(1, 100.0, 1.0), (2, None, 2.0)], "entity long, hp double, mana double")
    box = schema.Sandbox(df, frozenset({"hp"}), frozenset({"mana"}))
    assert box.query("hp").count() == 1
    assert sorted(r.mana for r in box.update(mana=F.lit(25.0)).query("mana").collect()) == [25, 25]
    for bad in (lambda: box.query("secret"), lambda: box.update(hp=F.lit(1.0))):
        with pytest.raises(PermissionError):
            bad()


def test_layers_and_sessions(spark):
    s = [schema.System("a", None, writes=frozenset("x")), schema.System("b", None, frozenset("x"), frozenset("y")), schema.System("c", None, frozenset("x"), frozenset("z")), schema.System("d", None, writes=frozenset("x"))]
    assert schema.layers(s) == [["a"], ["b", "c"], ["d"]]
    session = schema.Session(World.empty(spark).spawn(1).write((1, "rate", 1.0)))
    assert session.edit("rate", 2.0)[1] == 0
    session, n = session.possess(1).edit("rate", 2.5)
    assert n == 1 and values(session.world.state()) == {"rate": 2.5} and values(session.undo().world.state()) == {"rate": 1.0}
