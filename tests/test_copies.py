"""Followed copies: changes across the cut arrive once, batches rewrite only their buckets, and parity finds planted differences."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodgeframe.operators import replication
from lodgeframe.plans import replication_queries as queries
from lodgeframe.sources.copies import CentreTable, SubscribedCopy
from lodgeframe.sources.store import files_under

FEED = "seq long, op string, key long, name string, size int"
TABLE = "id long, name string, size int, city long"


def replayed(rows, changes):
    """The table after its changes one at a time."""
    table = {r[0]: r[1:] for r in rows}
    for _, op, key, name, size in sorted(changes):
        if op == "D":
            table.pop(key, None)
        elif key in table:
            table[key] = (name, size, table[key][2])
        elif op == "I":
            table[key] = (name, size, None)
    return {(key, *values) for key, values in table.items()}


def feed_rows(seed, count=300, keys=25):
    rng = random.Random(seed)
    return [
        (n, rng.choice("IUUD"), rng.randrange(keys), None if n % 11 == 0 else f"n{n}", rng.choice([None, n])) for n in range(count)
    ]


@pytest.mark.parametrize("cut", [-1, 0, 120, 299])
def test_changes_around_the_copy_arrive_once(spark, tmp_path, cut):
    rows = [(k, f"first{k}", k, 100 + k) for k in range(0, 25, 2)]
    changes = feed_rows(cut + 5)
    table, feed = spark.createDataFrame(rows, TABLE), spark.createDataFrame(changes, FEED)
    copy = SubscribedCopy(spark, str(tmp_path / "copy"), table.schema, ["name", "size"])
    at_cut = replication.replay(table, feed.where(F.col("seq") <= cut), ["name", "size"])
    assert {tuple(r) for r in at_cut.collect()} == replayed(rows, [c for c in changes if c[0] <= cut])
    copy.take(at_cut, cut)
    assert copy.position() == cut
    for low, high in [(0, cut + 40), (cut - 20, cut + 40), (cut + 10, 400), (0, 400)]:
        copy.deliver(feed.where(F.col("seq").between(low, high)))
    assert {tuple(r) for r in copy.current().collect()} == replayed(rows, changes)
    held = files_under(spark, str(tmp_path / "copy"))
    copy.deliver(feed)
    assert files_under(spark, str(tmp_path / "copy")) == held and copy.position() == max(cut, 299)


def test_an_empty_table_can_be_copied(spark, tmp_path):
    empty = spark.createDataFrame([], TABLE)
    copy = SubscribedCopy(spark, str(tmp_path), empty.schema, ["name", "size"])
    copy.take(empty, 7)
    copy.deliver(spark.createDataFrame([(7, "I", 1, "old", 1), (8, "I", 2, "new", 2)], FEED))
    assert [tuple(r) for r in copy.current().collect()] == [(2, "new", 2, None)]


CHANGES = "seq long, ts timestamp_ntz, origin string, op string, key long, name string"


def _changes(seed, count):
    """Three origins that write some of the same keys, each in its own order of time."""
    rng = random.Random(seed)
    at = datetime.datetime(2024, 1, 1)
    return [
        (n, at + datetime.timedelta(minutes=n // 3), f"filial{1 + n % 3}", rng.choice("IUUD"), rng.randrange(40), f"v{n}")
        for n in range(count)
    ]


def test_batches_rewrite_their_own_buckets_only(spark, tmp_path):
    changes = _changes(4, 240)
    centre = CentreTable(spark, str(tmp_path / "centre"), StructType.fromDDL("name string"), buckets=8)

    def frame(rows):
        return spark.createDataFrame(rows, CHANGES)

    # Origins are behind each other: the third is delivered last of all.
    assert centre.apply(frame([c for c in changes if c[2] != "filial3" and c[0] < 150])) == 8
    assert centre.apply(frame([c for c in changes if c[2] != "filial3"])) == 8
    centre.apply(frame(changes))
    last = {}
    for c in changes:
        last[c[4]] = max(last.get(c[4], c), c, key=lambda c: (c[1], c[2], c[0]))
    expected = {(c[2], key, c[5]) for key, c in last.items() if c[3] != "D"}
    assert {tuple(r) for r in centre.current().collect()} == expected
    before = files_under(spark, f"{centre.root}/rows")
    assert centre.apply(frame(changes)) == 0 and files_under(spark, f"{centre.root}/rows") == before
    late = [(1000, datetime.datetime(2024, 2, 1), "filial1", "U", 3, "late")]
    assert centre.apply(frame(late)) == 1
    after = files_under(spark, f"{centre.root}/rows")
    touched = {f.split("/")[0] for f in set(after) ^ set(before)}
    assert len(touched) == 1 and len(set(after) & set(before)) >= 7
    assert ("filial1", 3, "late") in {tuple(r) for r in centre.current().collect()}
    old = [(1001, datetime.datetime(2023, 1, 1), "filial2", "U", 3, "too old")]
    centre.apply(frame(old))
    assert ("filial1", 3, "late") in {tuple(r) for r in centre.current().collect()}


def test_parity_finds_what_was_planted(spark):
    rng = random.Random(9)
    rows = [(f"filial{1 + k % 2}", k * 37, k * k) for k in range(-50, 400)]
    other = list(rows)
    expected = set()
    for at in sorted(rng.sample(range(len(rows)), 9), reverse=True):
        node, key, digest = rows[at]
        kind = at % 3
        if kind == 0:
            del other[at]
            expected.add(("t", node, key, "missing at centre"))
        elif kind == 1:
            other[at] = node, key, digest + 1
            expected.add(("t", node, key, "different"))
        else:
            other.append((node, 10_000_000 + key, digest))
            expected.add(("t", node, 10_000_000 + key, "only at centre"))
    form = "node string, key long, digest long"
    here, there = spark.createDataFrame(rows, form), spark.createDataFrame(other, form)
    got = replication.differing_keys(here, there, "t", fan=16)
    assert {tuple(r) for r in got.collect()} == expected
    assert replication.differing_keys(here, here, "t").count() == 0
    assert replication.differing_keys(here, there.limit(0), "t").count() == len(rows)


def test_branch_changes_are_put_together_once(spark, data, monkeypatch):
    """Each parity query puts together what the branches sent once, and both see the same rows differ."""
    made, calls = queries._at_branches, []
    monkeypatch.setattr(queries, "_at_branches", lambda d: calls.append(d) or made(d))
    differing = {tuple(r) for r in queries._differences(spark, data.path).collect()}
    assert len(calls) == 1
    parity = {(r.table_name, r.node): (r.missing_at_centre, r.only_at_centre) for r in queries._parity(spark, data.path).collect()}
    assert len(calls) == 2 and differing
    for (table, node), counts in parity.items():
        kinds = [r[3] for r in differing if r[:2] == (table, node)]
        assert (kinds.count("missing at centre"), kinds.count("only at centre")) == counts
