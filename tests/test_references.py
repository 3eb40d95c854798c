"""Foreign keys against a brute-force look-up, and which keys travel."""

import random

from lodgeframe.operators import quality

RULES = [("houses", "city", "towns"), ("beds", "house", "houses"), ("beds", "city", "towns"), ("beds", "next_bed", "beds")]


def _tables(spark, folder):
    """Repeated ids, absent keys and keys without a parent."""
    rng = random.Random(3)

    def pick(top):
        return rng.choice([None, *range(top)])

    rows = {
        "towns": [(n,) for n in (0, 1, 2, 2, None)],
        "houses": [(rng.randrange(20), pick(4)) for _ in range(30)],
        "beds": [(rng.randrange(60), pick(30), pick(5), pick(80)) for _ in range(200)],
    }
    columns = {"towns": "id long", "houses": "id long, city int", "beds": "id long, house long, city int, next_bed long"}
    tables = {}
    for name, ddl in columns.items():
        spark.createDataFrame(rows[name], ddl).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.schema(ddl).parquet(f"{folder}/{name}")
    return rows, tables


def test_orphans_equal_a_look_up(spark, tmp_path):
    rows, tables = _tables(spark, tmp_path)
    places = {"houses": ["id", "city"], "beds": ["id", "house", "city", "next_bed"]}
    expected = []
    for child, column, parent in RULES:
        known = {row[0] for row in rows[parent]}
        at = places[child].index(column)
        expected += [(child, column, r[0], r[at]) for r in rows[child] if r[at] is not None and r[at] not in known]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    for given in (usual, "-1"):
        spark.conf.set(threshold, given)
        try:
            got = [tuple(r) for r in quality.broken_references(tables, RULES).collect()]
        finally:
            spark.conf.set(threshold, usual)
        assert sorted(got) == sorted(expected)


def test_keys_of_small_tables_do_not_travel(spark, tmp_path, capsys):
    _, tables = _tables(spark, tmp_path)
    quality.broken_references(tables, [("houses", "city", "towns"), ("beds", "house", "houses")]).explain()
    assert "hashpartitioning" not in capsys.readouterr().out


def test_details_travel_once(data, capsys):
    """Lines are told apart and joined to their orders in one dealing by order."""
    spark = data.details_reservations.sparkSession
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        data.details_reservations.explain()
    finally:
        spark.conf.set(threshold, usual)
    assert capsys.readouterr().out.count("hashpartitioning") == 2
