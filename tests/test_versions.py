"""Replacing a table whole, and upserting into slots: what readers see before, during and after, and what stays untouched."""

import pytest
from pyspark.sql import functions as F

from filmfold.session import scratch_path
from filmfold.sources import slots, versions

SCHEMA = "id bigint, name string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _table(spark, n, first=0):
    return spark.range(first, first + n).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), "id")).alias("name"))


def test_refresh_replaces_and_counts(spark):
    path = scratch_path(spark, "versions")
    assert versions.current(spark, path) is None and versions.read(spark, path, SCHEMA).count() == 0
    first = versions.refresh(_table(spark, 10), path)
    assert (first.number, first.n_rows, first.n_null) == (1, 10, {"id": 0, "name": 4})
    second = versions.refresh(_table(spark, 3), path)
    assert second.number == 2 and versions.current(spark, path) == second
    assert _rows(versions.read(spark, path, SCHEMA)) == _rows(_table(spark, 3))
    assert [v.number for v in versions.history(spark, path).collect()] == [2, 1]
    counts = versions.column_counts({"a": first, "b": second}, spark)
    assert _rows(counts) == [("a", "id", 10, 0), ("a", "name", 10, 4), ("b", "id", 3, 0), ("b", "name", 3, 1)]


def test_a_load_that_fails_midway_changes_nothing(spark):
    path = scratch_path(spark, "versions")
    before = versions.refresh(_table(spark, 100), path)
    open_reader = versions.read(spark, path, SCHEMA)
    seen = []

    def fails(batches):
        for batch in batches:
            if 500 in batch["id"].to_pylist():
                raise ValueError("source went away")
            yield batch

    broken = _table(spark, 1000, first=200).repartitionByRange(6, "id").mapInArrow(fails, SCHEMA)
    with pytest.raises(Exception, match="source went away"):
        versions.refresh(broken, path)
    seen.append(_rows(versions.read(spark, path, SCHEMA)))
    assert versions.current(spark, path) == before
    after = versions.refresh(_table(spark, 7, first=900), path)
    assert after.number == 2 and _rows(versions.read(spark, path, SCHEMA)) == _rows(_table(spark, 7, first=900))
    seen.append(_rows(open_reader))  # a reader that began earlier still has its files
    assert seen == [_rows(_table(spark, 100))] * 2


def test_rows_are_read_once(spark):
    """Counts come from the write itself: the source is passed over a single time."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    entry = versions.refresh(_table(spark, 500).mapInArrow(counted, SCHEMA), scratch_path(spark, "versions"))
    assert entry.n_rows == passes.value == 500


def test_old_versions_are_dropped(spark):
    path = scratch_path(spark, "versions")
    assert versions.drop_old(spark, path) == 0
    entries = [versions.refresh(_table(spark, n), path) for n in (1, 2, 3, 4)]
    assert versions.drop_old(spark, path) == 2
    assert [v.number for v in versions.history(spark, path).collect()] == [4, 3]
    assert versions.read(spark, path, SCHEMA).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/{entries[0].folder}")
    assert versions.refresh(_table(spark, 5), path).number == 5


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, None)], "`a.b` bigint, `null a` string")
    assert versions.refresh(df, scratch_path(spark, "versions")).n_null == {"a.b": 0, "null a": 1}


# --- slots ----------------------------------------------------------------------------------------------------------------

def _posters(spark, ids, tag):
    return spark.createDataFrame([(i, f"{tag}{i}") for i in ids], "movieId bigint, url string")


def _files(spark, path):
    rows = slots.read(spark, path).select("slot", "_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    return {(r.slot, r.file_path, r.file_modification_time) for r in rows}


def test_upsert_rewrites_touched_slots_only(spark):
    path = scratch_path(spark, "slots")
    assert slots.read(spark, path).count() == 0
    assert slots.upsert(_posters(spark, range(0, 500, 2), "old"), path, 100) == 5
    before = _files(spark, path)
    new = _posters(spark, [1, 3, 4, 250, 301, 907], "new").unionByName(
        spark.createDataFrame([(None, "x"), (11, None), (907, "a907"), (301, "new301")], "movieId bigint, url string"))
    assert slots.upsert(new, path, 100) == 3  # slots 0, 3 and 9; 4 and 250 have an entry
    after = _files(spark, path)
    assert {f for f in before if f[0] in (1, 2, 4)} == {f for f in after if f[0] in (1, 2, 4)}
    assert not {f[1] for f in before if f[0] in (0, 3)} & {f[1] for f in after}
    expected = {i: f"old{i}" for i in range(0, 500, 2)} | {1: "new1", 3: "new3", 301: "new301", 907: "a907"}
    rows = slots.read(spark, path).collect()
    assert {r.movieId: r.url for r in rows} == expected and len(rows) == len(expected)
    assert all(r.slot == r.movieId // 100 for r in rows)
    assert slots.upsert(new, path, 100) == 0 and _files(spark, path) == after


def test_one_slot_is_one_folder(spark):
    path = scratch_path(spark, "slots")
    slots.upsert(_posters(spark, range(1000), "p"), path, 100)
    plan = slots.read(spark, path).filter("slot = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan
    assert slots.read(spark, path).filter("slot = 3").count() == 100


def test_a_failing_upsert_changes_nothing(spark):
    path = scratch_path(spark, "slots")
    slots.upsert(_posters(spark, range(300), "old"), path, 100)
    before = _files(spark, path)

    def fails(batches):
        for batch in batches:
            if 5005 in batch["movieId"].to_pylist():
                raise ValueError("search went away")
            yield batch

    found = _posters(spark, range(5000, 5010), "new").repartition(5).mapInArrow(fails, "movieId bigint, url string")
    with pytest.raises(Exception, match="search went away"):
        slots.upsert(found, path, 100)
    assert _files(spark, path) == before
