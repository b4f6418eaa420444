import pytest

from strataspark.sources import scopes


def test_resolve():
    two = [{"key": "a1", "label": "Web App"}, {"key": "b2", "label": "API"}]
    assert scopes.resolve(two, "b2") == "b2" and scopes.resolve(two, "web") == "a1" and scopes.resolve(two, "global", "b2") == "b2"
    assert scopes.resolve(two[:1], None) == "a1" and scopes.resolve(two, None, "b2") == "b2"
    for args in ((two, "p"), (two, "zzz"), (two, None), (two, "global")):
        with pytest.raises(KeyError):
            scopes.resolve(*args)


def test_manifest_and_global_scope(spark):
    schema = "key string, kind string, entities int"
    old = spark.createDataFrame([("a", "derived", 90), ("b", "parsed", 5)], schema)
    new = spark.createDataFrame([("b", "parsed", 7), ("c", "parsed", 7), ("d", None, None)], schema)
    merged = scopes.merge_manifest(old, new)
    assert sorted((r.key, r.entities) for r in merged.where("entities is not null").collect()) == [("a", 90), ("b", 7), ("c", 7)]
    assert scopes.global_scope(merged).collect()[0].key == "b"
    assert scopes.global_scope(merged.limit(0)).count() == 0


def test_series_skip_broken_lines_and_prune(spark, tmp_path):
    path = str(tmp_path / "series")
    df = spark.createDataFrame([("s", f"2025-01-0{i}", i) for i in range(1, 6)], "scope string, day string, v int")
    scopes.append_series(df.coalesce(1), path)
    (tmp_path / "series" / "part-bad.json").write_text('{"scope": "s", "day": \n')
    back = scopes.read_series(spark, path, "scope string, day string, v int").where("scope is not null")
    assert back.count() == 5
    assert sorted(r.v for r in scopes.prune(back, ["scope"], "day", 2).collect()) == [4, 5]
    assert sorted(r.v for r in scopes.prune(back, [], "day", 1).collect()) == [5]


def test_replace_and_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, scope_key string")
    scopes.save_scope(df, path)
    scopes.save_scope(spark.createDataFrame([(9, "y")], "v int, scope_key string"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 9]
    scopes.replace_table(spark.read.parquet(path).where("v = 9"), path)
    assert [r.v for r in spark.read.parquet(path).collect()] == [9]
    h = scopes.content_key(df, "v", "scope_key").collect()
    assert len({r.content_hash for r in h}) == 2


def test_replacement_cut_short_is_recovered(spark, tmp_path):
    path, old = tmp_path / "t", tmp_path / "t.replaced"
    df = lambda v: spark.createDataFrame([(v,)], "v int")
    df(1).write.parquet(str(old))  # moved aside, the new one not yet in place
    scopes.recover_table(spark, str(path))
    assert [r.v for r in spark.read.parquet(str(path)).collect()] == [1] and not old.exists()
    df(0).write.parquet(str(old))  # in place, the old one not yet deleted
    scopes.recover_table(spark, str(path))
    assert [r.v for r in spark.read.parquet(str(path)).collect()] == [1] and not old.exists()
    scopes.replace_table(df(2), str(path))
    assert [r.v for r in spark.read.parquet(str(path)).collect()] == [2] and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_pruning_ends_ties(spark):
    rows = [("s", "d", v) for v in range(20)]
    kept = [sorted(r.v for r in scopes.prune(spark.createDataFrame(rows[::step], "scope string, day string, v int").repartition(n), ["scope"], "day", 3).collect()) for step, n in ((1, 1), (-1, 7))]
    assert kept[0] == kept[1]


def test_clusters_need_a_shared_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace as N

    from strataspark.plans.storage import ensure_checkpoint_dir

    def session(master, folder=None):
        said = []
        jsc = N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
        sc = N(_jsc=jsc, master=master, getConf=lambda: N(get=lambda k, d: folder), setCheckpointDir=said.append)
        return N(sparkContext=sc), said

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master)[0])
        s, said = session(master, "hdfs:/shared")
        ensure_checkpoint_dir(s)
        assert said == ["hdfs:/shared"]
    s, said = session("local[4]")
    ensure_checkpoint_dir(s)
    assert len(said) == 1


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one")
    (tmp_path / "a" / "x_test.py").write_text("two")
    (tmp_path / "y.txt").write_text("three")
    got = scopes.source_files(spark, str(tmp_path), "*.py", "_test").collect()
    assert [r.text for r in got] == ["one"]


def test_scope_hash():
    h = scopes.scope_hash(["src/b", "src\\a"])
    assert len(h) == 8 and h == scopes.scope_hash(["src/a", "src/b"]) != scopes.scope_hash(["src/a", "src/b"], "go")
