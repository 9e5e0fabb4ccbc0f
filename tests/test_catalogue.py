import duckdb
import pytest
from lumenfold.operators.constant import constant_greeting
from lumenfold.plans import catalogue
from lumenfold.sources import table
from lumenfold.streaming import events_by_window

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want)


def test_constant(spark):
    found = constant_greeting(spark)
    assert found.dtypes == [("greeting", "string")] and not found.schema[0].nullable
    assert [r.greeting for r in found.collect()] == ["Hello World!"]


def test_constant_does_not_depend_on_the_folder(spark):
    assert catalogue.r1_constant_greeting(spark, "/no/such/folder").count() == 1


def test_stream_counts_equal_batch(spark, tmp_path):
    batch = table(spark, SF, "events")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, events_by_window(batch).collect()))
