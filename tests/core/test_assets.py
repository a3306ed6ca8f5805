"""Loads, versions and loss artifacts on small made files."""

import pytest
from pyspark.sql import functions as F

BOOK = "id long, state string, elevation_m double"


def test_a_failed_load_leaves_the_old_book(spark, tmp_path):
    from perilmesh.sources.book_table import BookTable

    held = BookTable(spark, f"file://{tmp_path}/book", buckets=4)
    assert held.read().count() == 0
    rows = [(i, "FL", float(i)) for i in range(20)]
    assert held.replace(spark.createDataFrame(rows, BOOK)) == 1

    @F.udf("double")
    def broken(x):
        raise ValueError("bad row")

    with pytest.raises(Exception, match="bad row"):
        held.replace(spark.createDataFrame(rows, BOOK).withColumn("elevation_m", broken("elevation_m")))
    for bad in ([(1, "TX", 0.0), (1, "TX", 1.0)], [(None, "TX", 0.0)]):
        with pytest.raises(ValueError):
            held.replace(spark.createDataFrame(bad, BOOK))
    assert sorted(tuple(r) for r in held.read().collect()) == rows and held.manifest()["version"] == 1


def test_updates_touch_their_buckets_only(spark, tmp_path):
    from perilmesh.sources.book_table import BookTable

    held = BookTable(spark, f"file://{tmp_path}/book", buckets=8)
    held.replace(spark.createDataFrame([(i, "FL", float(i)) for i in range(40)], BOOK))
    before = held.manifest()["folders"]
    changes = spark.createDataFrame([(3, 7.0, None, 1), (3, None, "TX", 2), (3, 9.0, None, 3), (99, 1.0, "LA", 1)], "id long, elevation_m double, state string, seq int")
    assert held.update(changes, order="seq") == 2
    after = held.manifest()["folders"]
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    assert {r.id: (r.state, r.elevation_m) for r in held.read().collect()} == {i: ("FL", float(i)) for i in range(40)} | {3: ("TX", 9.0)}
    assert held.read(1).where("id = 3").first().elevation_m == 3.0
    late = BookTable(spark, held.path, buckets=8)
    old = late.manifest(1)
    with pytest.raises(RuntimeError):  # a writer that began before the last change
        late._commit(old, old["schema"], old["folders"])
    held.vacuum()
    assert held.read().count() == 40 and held._versions() == [2]


def test_book_csv_is_bound_by_its_header(spark, tmp_path):
    from perilmesh.sources.feeds import BOOK_COLUMNS, read_book_csv

    (tmp_path / "a.csv").write_text('﻿TIV,note, State ,zip3,lat,lon,policy_id,build_type,flood_zone,county\n100,x,FL,337,27.5,-82.5,1,"wood\nframe","A""E",Lee\n', encoding="utf-8")
    r = read_book_csv(spark, f"file://{tmp_path}/a.csv").first()
    assert (r.policy_id, r.tiv, r.state, r.flood_zone, r.build_type, r.county, r.elevation_m) == ("1", "100", "FL", 'A"E', "wood\nframe", "Lee", None) and "note" not in r.asDict()
    (tmp_path / "b.csv").write_text("policy_id,state,state,lat\n1,FL,TX,2\n")
    with pytest.raises(ValueError, match="absent: zip3.*twice: state"):
        read_book_csv(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "1.csv").write_text(",".join(BOOK_COLUMNS) + "\n1,FL,337,1,2,3,masonry,X\n")
    (tmp_path / "two" / "2.csv").write_text(",".join(reversed(BOOK_COLUMNS)) + "\nX,masonry,3,2,1,337,FL,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_book_csv(spark, f"file://{tmp_path}/two").collect()


def test_sims_are_pruned_by_name(spark, tmp_path):
    from perilmesh.sources.feeds import missing_sims, read_sims, sim_files

    for name in ("s1", "s2"):
        spark.createDataFrame([("337_q0", 1.0)], "cohort_key string, k0000 double").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "s3.parquet").write_bytes(b"not a loss file")  # would fail if it were opened
    (tmp_path / "notes.txt").write_text("x")
    path = f"file://{tmp_path}"
    got = read_sims(spark, path, ["s2", "zz"])
    assert [tuple(r) for r in got.collect()] == [("s2", "337_q0", 1.0)] and len(got.inputFiles()) == 1
    assert read_sims(spark, path, []).count() == 0
    known = spark.createDataFrame([("s1",), ("s9",)], "sim_id string")
    assert [r.sim_id for r in missing_sims(known, sim_files(spark, path)).collect()] == ["s9"]
