"""Sessions whose tasks are cut by the rows of the tables in use."""

from pyspark.sql import functions as F

from lodgeframe import session
from lodgeframe.operators import availability
from lodgeframe.sources.projection import HotelData


def _write(spark, folder, orders):
    key = F.col("id")
    spark.range(3).selectExpr("id s_suppkey", "'h' s_name", "1 s_nationkey", "0D s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(5).selectExpr("id c_custkey", "'c' c_name", "1 c_nationkey", "0D c_acctbal", "'m' c_mktsegment").write.parquet(
        f"{folder}/customer.parquet"
    )
    spark.range(orders).select(
        key.alias("o_orderkey"),
        (key % 5).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(1.0).alias("o_totalprice"),
        F.lit("1995-01-01").cast("timestamp_ntz").alias("o_orderdate"),
        F.lit("1").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(orders * 2).selectExpr(
        "id DIV 2 l_orderkey", "id % 60 l_partkey", "id % 3 l_suppkey", "CAST(id % 2 AS INT) l_linenumber", "1D l_quantity",
        "1D l_extendedprice", "0D l_discount", "0D l_tax", "'N' l_returnflag", "'O' l_linestatus",
        "TIMESTAMP_NTZ'1995-01-01' l_shipdate",
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    _write(spark, tmp_path, 90)
    given = dict(spark.conf.getAll)
    data = HotelData(spark, str(tmp_path))
    stays = availability.active_stays(data.reservations, data.details_reservations)
    conflicts = availability.room_conflicts(stays)
    for rows in (stays, conflicts):
        assert rows.sparkSession.conf.get("spark.sql.shuffle.partitions") == "18"
        assert rows.sparkSession.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert stays.count() == 180
    assert dict(spark.conf.getAll) == given


def test_small_tables_keep_the_number_of_partitions(spark, tmp_path):
    _write(spark, tmp_path, 6)
    data = HotelData(spark, str(tmp_path))
    assert data.details_reservations.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get(
        "spark.sql.shuffle.partitions"
    )


def test_a_file_is_read_in_small_pieces(spark, tmp_path):
    _write(spark, tmp_path, 6)
    data = HotelData(spark, str(tmp_path))
    assert data.reservations.sparkSession.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    assert data.reservations.sparkSession.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
