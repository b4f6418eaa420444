import json

import pytest

from strataspark.sources import stores


def df(spark, rows, schema="k string, v int"):
    return spark.createDataFrame(rows, schema)


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        stores.load_history(spark, path)
    stores.save_history(spark, path, df(spark, [("a", 1)]), df(spark, [("p", 2)]), 3)
    manifest, files, packages = stores.load_history(spark, path)
    assert manifest["package_depth"] == 3 and files.first().k == "a" and packages.first().v == 2
    stores.write_manifest(spark, path, {"version": "1", "tables": ["files", "packages"]})
    with pytest.warns(UserWarning):
        assert stores.load_history(spark, path)[0]["package_depth"] == 1


def test_index_is_rebuilt_when_it_must(spark, tmp_path):
    path, built = str(tmp_path / "i"), []

    def build(source):
        built.append(1)
        return source.withColumnRenamed("v", "w")

    a, b = df(spark, [("a", 1), ("b", None)]), df(spark, [("b", None), ("a", 1)]).repartition(3)
    assert sorted(r.k for r in stores.load_index(spark, path, a, build).collect()) == ["a", "b"]
    stores.load_index(spark, path, b, build)  # the same rows in another order
    assert len(built) == 1
    stores.load_index(spark, path, df(spark, [("a", 1), ("b", 2)]), build)
    assert len(built) == 2
    stores.write_manifest(spark, path, stores.read_manifest(spark, path) | {"version": "0.9"})
    stores.load_index(spark, path, df(spark, [("a", 1), ("b", 2)]), build)
    assert len(built) == 3
    assert stores.digest(df(spark, [("a", 1)])) != stores.digest(df(spark, [("a", 1), ("a", 1)])) and stores.digest(a.limit(0))


def test_health_series(spark, tmp_path):
    path = str(tmp_path / "s")
    assert stores.load_health(spark, path) is None
    stores.append_health(spark, path, df(spark, [("2025-01-02", 2)], "timestamp string, v int"))
    got = stores.append_health(spark, path, df(spark, [("2025-01-01", 1), ("2025-01-03", 3)], "timestamp string, v int"), keep=2)
    assert sorted(r.v for r in got.collect()) == [2, 3]
    stores.write_manifest(spark, path, {"version": "other", "tables": ["series"]})
    assert stores.load_health(spark, path) is None


def test_smells(spark, tmp_path):
    path = str(tmp_path / "m")
    assert stores.load_smells(spark, path) is None
    stores.save_smells(spark, path, df(spark, [("T", "a", 2), ("T", "b", 5), ("U", "a", 4)], "type_name string, value string, files int"))
    count = lambda **x: stores.load_smells(spark, path, **x).count()
    assert (count(), count(type_name="T"), count(value="a"), count(least=3), count(type_name="T", value="b", least=6)) == (3, 2, 2, 2, 0)
    assert stores.load_smells(spark, path).first().layer == "literal-dispersion"


def test_broken_manifest_is_an_error(spark, tmp_path):
    path = tmp_path / "b"
    df(spark, [("not json",)], "manifest string").write.parquet(str(path / "manifest"))
    with pytest.raises(ValueError):
        stores.load_results(spark, str(path))


def test_semantics():
    good = {"nonProductionPatterns": ["examples/**"], "architecturalLayers": {"src/core": "kernel"}, "suggestedDepth": 2}
    assert stores.semantics(json.dumps(good)) == good and stores.semantics(None) is None and stores.semantics("{}") == {}
    bad = {"barrelFiles": ["../x", "/etc", ""], "architecturalLayers": {"src": 3}, "suggestedDepth": 9, "more": 1, "additionalTestPatterns": "x"}
    with pytest.raises(ValueError) as e:
        stores.semantics(json.dumps(bad))
    assert str(e.value).count("\n  - ") == 7
    for text in ("[]", "{", json.dumps({"suggestedDepth": True})):
        with pytest.raises(ValueError):
            stores.semantics(text)
