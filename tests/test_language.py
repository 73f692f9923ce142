import pytest

from stratalog.engine import Engine
from stratalog.gql.lexer import GqlError, tokens
from stratalog.gql.parser import Select, parse


def test_tokens_comments_and_quotes():
    kinds = [(t.kind, t.text) for t in tokens("SELECT `a b`, [c], 'it''s' -- x\n FROM t /* y */ WHERE a != 1.5")]
    assert ("name", "a b") in kinds and ("name", "c") in kinds and ("string", "it's") in kinds and ("sign", "<>") in kinds


@pytest.mark.parametrize("text", ["SELECT", "SELECT * FROM t WHERE a LIKE 'x' junk", "SELECT * FROM t LIMIT", "FIND t NEAR (1) WITHIN 2", "LISTEN DELETE FROM t", "SELECT * FROM a CROSS JOIN b", "BEGIN"])
def test_bad_statements_raise(text):
    with pytest.raises(GqlError):
        parse(text)


def test_statements_of_the_manual():
    s = parse("SELECT * FROM players AT TICK 1 WHERE hp < 50;")
    assert isinstance(s, Select) and s.tick == 1
    assert parse("LISTEN SELECT * FROM players WHERE distance(pos, [10, 0, 0]) < 5;").listen
    assert parse("FIND players NEAR (0, -1.5, 0) WITHIN 7").near == (0, -1.5, 0)
    assert parse("SELECT a FROM t LIMIT 0").limit is None


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, slots=str(tmp_path))
    rows = [(1, 0.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, 10.0, 0.0, 0.0), (4, 100.0, 100.0, 100.0)]
    return e.register("players", spark.createDataFrame(rows, "entity long, x double, y double, z double"))


def ids(df, name="entity"):
    return sorted(r[name] for r in df.collect())


def test_find_near_is_a_box_and_exact_a_sphere(engine):
    assert ids(engine.query("FIND players NEAR (0, 0, 0) WITHIN 7")) == [1, 2]
    assert ids(engine.query("FIND players WHERE x > 5")) == [3, 4]
    assert ids(engine.find(parse("FIND players NEAR (95, 95, 95) WITHIN 7"), exact=True)) == []


def test_precedence(engine):
    assert ids(engine.query("SELECT entity FROM players WHERE x = 0 OR x = 5 AND y > 1")) == [1]
    assert ids(engine.query("SELECT entity FROM players WHERE NOT (x = 0) AND -x + 2 * 5 >= 0")) == [2, 3]
    assert ids(engine.query("SELECT entity FROM players WHERE 0 <= x < 1")) == []


def test_order_distinct_offset_aliases(engine):
    rows = engine.query("SELECT entity AS e, x + 1 AS v FROM players ORDER BY x DESC LIMIT 2 OFFSET 1").collect()
    assert [(r.e, r.v) for r in rows] == [(3, 11.0), (2, 6.0)]
    assert engine.query("SELECT DISTINCT z FROM players").count() == 2


def test_unknown_names(engine):
    for text in ("SELECT * FROM nobody", "SELECT nofn(x) FROM players", "UPDATE players SET q = 1", "CREATE TABLE players (a INT)"):
        with pytest.raises(GqlError):
            engine.query(text)


def test_writes_on_tables(engine):
    engine.query("CREATE TABLE t (id INT, name TEXT, ok BOOL)")
    engine.query("INSERT INTO t VALUES (1, 'a', TRUE), (-2, 'b', FALSE)")
    engine.query("UPDATE t SET name = 'c' WHERE id < 0")
    assert [tuple(r) for r in engine.query("SELECT * FROM t ORDER BY id").collect()] == [(-2, "c", False), (1, "a", True)]
    engine.query("DELETE FROM t WHERE ok")
    assert engine.query("SELECT COUNT(*) AS n FROM t").first().n == 1
    engine.query("DROP TABLE t")
    with pytest.raises(GqlError):
        engine.query("SELECT * FROM t")


def test_components_time_travel_and_slots(engine):
    engine.register_components("units", "hp", "x", prefab="tank")
    engine.advance_tick()
    engine.query("SPAWN PREFAB 'tank' WITH hp = 100, x = -3")
    engine.query("SPAWN 'tree' WITH hp = 5, x = 0")
    engine.advance_tick()
    engine.query("UPDATE units SET hp = hp - 30 WHERE x < 0")
    assert engine.query("SELECT hp FROM units").first().hp == 70
    assert engine.query("SELECT hp FROM units AT TICK 1").first().hp == 100
    assert engine.query("SELECT hp FROM units SINCE 1 TICKS").count() == 1
    engine.query("SNAPSHOT TO 'one'")
    engine.query("DELETE FROM units")
    assert engine.query("SELECT * FROM units").count() == 0
    engine.query("RESTORE FROM 'one'")
    assert engine.query("SELECT hp FROM units WHERE HAS COMPONENT hp").first().hp == 70
    engine.run_script(lambda e: e.set(1, "hp", e.get(1, "hp") + 50))
    assert engine.get(1, "hp") == 120


def test_explain(engine):
    assert "Filter" in engine.query("EXPLAIN SELECT entity FROM players WHERE x > 1").first().plan
