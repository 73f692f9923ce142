import builtins
import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names_without_the_corpus_operators(monkeypatch):
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name.endswith("stratalog.llm") or name == "corpus_pipeline" or "stratalog.llm" in name:
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert len(entry.queries()) > 60 and set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in entry.queries())
    sys.modules.pop("__spark_entry__", None)


@needs_data
def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["entity", "click", "purchase", "view"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["as_of_tick", "scrub_series", "living_state", "fold_last_write_wins", "distance_join", "subscriber_delta_lod", "first_state_difference", "gql_set_operations", "delta_capture", "delta_apply", "replay_state", "world_writes", "despawn_cleans_edges", "causal_trace", "state_hash", "lod_rate_limit"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from stratalog.plans import catalog

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple((v is None, round(v, 9) if isinstance(v, float) else v) for v in r)
    rows = sorted(([None if v is None else v for v in r] for r in want.fetchall()), key=lambda r: str(key(r)))
    mine = sorted(([r[n] for n in names] for r in got.collect()), key=lambda r: str(key(r)))
    assert [key(r) for r in mine] == [key(r) for r in rows]


@needs_data
def test_relations_and_paths_take_all_orders(spark):
    from stratalog.plans import catalog

    orders = catalog.table(spark, SF, "orders")
    assert catalog.queries()["relation_out"](spark, SF).count() == orders.count()
    routes = catalog.queries()["path_samples"](spark, SF).select("route").distinct()
    assert routes.count() == orders.where("o_custkey % 3000 < 2048").count()
