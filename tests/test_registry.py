import pytest

import __spark_entry__ as entry

CHEAP = ["p1_allowed_entities", "p5_encode_gender", "w5_stratified_folds", "a47_errors", "a36_fitted_line", "f1_path_stem"]


def test_names_line_up():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_sql(spark, name):
    import duckdb
    from tools.check import TABLES, normal

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(res.fetchall(), names)


def test_csv_logs_keyed_by_directory(spark, tmp_path):
    from pyspark.sql import types as T

    from folioscope.sources import tables

    for ent, body in {"e1": "0,1.5,1\n1,NaN,1\n", "e2": "0,2.5,1\n"}.items():
        (tmp_path / ent).mkdir()
        (tmp_path / ent / tables.RAW_FILE).write_text("frame,speed,segment_id\n" + body)
    schema = T.StructType([T.StructField("frame", T.LongType()), T.StructField("speed", T.DoubleType()), T.StructField("segment_id", T.IntegerType())])
    out = tables.read_frame_logs(spark, str(tmp_path), schema)
    assert sorted((r["entity_id"], r["speed"]) for r in out.collect() if r["speed"]) == [("e1", 1.5), ("e2", 2.5)]
    assert out.where("speed IS NULL").count() == 1 and out.columns == ["speed", "entity_id"]


def test_frame_logs_are_one_path_whatever_the_number_of_entities(spark, tmp_path):
    from pyspark.sql import types as T

    from folioscope.sources import tables

    for entity in ("a", "b c", "d"):
        (tmp_path / entity / "deeper").mkdir(parents=True)
        (tmp_path / entity / "log.csv").write_text("frame_no,value\n1,0.5\n")
        (tmp_path / entity / "deeper" / "log.csv").write_text("frame_no,value\n1,9.5\n")
    (tmp_path / "log.csv").write_text("frame_no,value\n1,9.5\n")
    schema = T.StructType([T.StructField("frame_no", T.LongType()), T.StructField("value", T.DoubleType())])
    out = tables.read_frame_logs(spark, str(tmp_path), schema, "log.csv")
    assert sorted(r["value"] for r in out.collect()) == [0.5] * 3
    assert "InMemoryFileIndex(1 paths)" in out._jdf.queryExecution().executedPlan().toString()
