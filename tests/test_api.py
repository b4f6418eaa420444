import pytest
from pyspark.sql import functions as F

from strataspark.api import Engine


@pytest.fixture(scope="module")
def engine(spark, data):
    return Engine(spark, data)


def test_every_question_has_an_answer(engine, spark):
    name = engine.edges.groupBy("dst").count().orderBy("count", ascending=False).first().dst
    row = engine.entities.where(F.col("key") == name).first()
    path = engine.commits.groupBy("path").count().orderBy("count", ascending=False).first().path
    some = {
        "entity": engine.entity(row.name, "class"), "by_type": engine.by_type("class"), "in_file": engine.in_file(row.source_location.file), "dependents": engine.dependents(row.name, 2),
        "relations": engine.relations("class"), "cycles": engine.cycles(), "coupling": engine.high_coupling(2), "summary": engine.summary(), "packages": engine.package_stats(top=3),
        "fan_in": engine.package_fan_in(0), "fan_out": engine.package_fan_out(0), "layer": engine.layer("entity"), "risk": engine.change_risk(path), "context": engine.change_context(path),
        "cochange": engine.cochange(path), "ownership": engine.ownership(path), "test_issues": engine.test_issues(), "test_metrics": engine.test_metrics(), "coverage": engine.entity_coverage(),
        "diff": engine.diff(), "direction": engine.direction(), "check": engine.check([("scc_count", ">=", 0)], [("nothing.*", "*")]), "trend": engine.metric_trend("scc_count"), "scopes": engine.scopes(),
        "boundary": engine.cluster_boundary(3), "attributes": engine.by_attributes({"team": None}),
    }
    empty = [k for k, df in some.items() if df.limit(1).count() == 0]
    assert empty == []


def test_unknown_names_give_no_rows(engine):
    for df in (engine.entity("Nobody"), engine.dependencies("Nobody", 9), engine.implementers("Nobody"), engine.subclasses("Nobody"), engine.callers("Nobody.run", 2), engine.change_risk("no/such/file")):
        assert df.count() == 0
    pack = engine.evidence_pack(["no/such/file"]).collect()
    assert [(r.path, r.found) for r in pack] == [("no/such/file", False)]
    got = {r.name: r.found for r in engine.cognitive_summary(["Nobody"]).collect()}
    assert got == {"Nobody": False}


def test_scopes_and_drift(engine):
    key = engine.scopes().where("key <> 'commonlib'").orderBy("key").first().key
    one = engine.with_scope(key)
    assert one.scope == key and {r.scope_key for r in one.entities.select("scope_key").distinct().collect()} <= {key, "commonlib"}
    assert one.drift(one).where("drift > 0").count() == 0
    assert engine.drift(one, "moderate", 5).count() <= 5
    assert engine.test_patterns(["pytest", "unheard"]) == {"pytest": ["assert "], "unheard": []}
    with pytest.raises(ValueError):
        engine.check([])


def test_an_exact_scope_is_found_among_many(spark, data):
    class Many(Engine):
        def scopes(self):
            return spark.range(3000).selectExpr("concat('scope', 9999 - id) AS key", "id AS entities").unionByName(spark.createDataFrame([("scope", 1)], "key string, entities bigint"))

    assert Many(spark, data).with_scope("scope").scope == "scope"
    assert Many(spark, data).with_scope("e7123").scope == "scope7123"
    with pytest.raises(KeyError):
        Many(spark, data).with_scope("scope9")
