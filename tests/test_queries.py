import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF, same_rows
from vidspark import queries
from vidspark.functions import vision


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["item_id"]
    assert set(queries.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_core_queries_stay_when_the_training_part_cannot_be_imported(monkeypatch):
    real = entry_module.importlib.import_module

    def broken(name):
        if name.startswith("vidspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name)

    monkeypatch.setattr(entry_module.importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="xxhash"):
        assert set(entry_module.queries()) == set(queries.QUERIES)
    with pytest.warns(UserWarning):
        assert set(entry_module.oracle_sql()) == set(queries.SQL)


def test_volume_reaches_the_scan(spark, tmp_path):
    w = queries.world(spark, SF)
    w.bboxes.write.parquet(str(tmp_path / "b"))
    w.trajectories.write.parquet(str(tmp_path / "t"))
    stored = w.with_tables(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "b")))
    found = stored.predicate(lambda obj: obj.location in queries.VOLUME).get_time().execute()
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(bbox.xmin" in plan and "Join" not in plan


def test_gate_leaves_out_nulls_and_zero_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vision.cosine_pairs(e, e.filter("vec_id > 1")).collect())) == [(1, 2), (2, 2)]
