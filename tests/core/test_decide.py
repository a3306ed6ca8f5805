import itertools
import random

import pytest
from pyspark.sql import functions as F


def test_solver_is_near_the_best_mix(spark):
    from perilmesh.operators import decide as D

    rng = random.Random(3)
    rows = [(f"c{i}", 1e6 * rng.uniform(0.5, 2), 1e4 * rng.uniform(1, 3), 1e3 * rng.uniform(1, 9)) for i in range(5)]
    cohorts = spark.createDataFrame(rows, "cohort_id string, total_tiv double, total_premium double, loss_p50 double").withColumn("loss_p99", F.col("loss_p50") * 7.2)
    coef = D.coefficients(cohorts).collect()
    by = {}
    for r in coef:
        by.setdefault(r.cohort_id, []).append((r.profit, r.capital, r.cession, r.nonrenew))
    tiv, p99 = sum(r[1] for r in rows), sum(r[3] for r in rows) * 7.2
    budgets = (0.6 * p99, 0.05 * p99, 0.5 * tiv)
    best = max(sum(c[0] for c in mix) for mix in itertools.product(*by.values()) if all(sum(c[i + 1] for c in mix) <= b for i, b in enumerate(budgets)))
    got = D.solve(cohorts, capital=budgets[0], cession=budgets[1], nonrenew_share=0.5, rounds=40)
    assert got.status in ("Optimal", "Feasible") and got.objective <= best + 0.01 and got.objective >= 0.99 * best
    assert got.actions.count() == 5
    assert D.solve(cohorts, capital=-1.0, cession=0.0, nonrenew_share=0.0, rounds=3).status == "Infeasible"


def test_a_cut_search_is_no_proof(spark):
    from perilmesh.operators import decide as D

    cohorts = spark.createDataFrame([("a", 1e6, 2e4, 5e3), ("b", 1e6, 2e4, 4e3)], "cohort_id string, total_tiv double, total_premium double, loss_p50 double").withColumn("loss_p99", F.col("loss_p50") * 7.2)
    how = dict(capital=0.5 * 9e3 * 7.2, cession=0.05 * 9e3 * 7.2, nonrenew_share=1.0)
    assert D.solve(cohorts, rounds=1, **how).status == "Undecided"  # non-renewing all meets the budgets


def test_relaxed_retry_and_replications(spark):
    from perilmesh.operators import decide as D

    cohorts = spark.createDataFrame([("a", "337", "masonry", 1, 1e6, 2e4, 5e3), ("b", "338", "masonry", 2, 2e6, 3e4, 4e3)], "cohort_id string, zip3 string, build_type string, tiv_quintile int, total_tiv double, total_premium double, loss_p50 double")
    priced = cohorts.withColumn("loss_p99", F.col("loss_p50") * 7.2)
    tight = dict(nonrenew_share=0.0, cession=0.0)
    kept = sum(r.capital for r in D.coefficients(priced).collect() if r.action == "retain")
    found, factor = D.solve_relaxed(priced, capital=kept, **tight)
    assert found.objective is not None and factor is None
    found, factor = D.solve_relaxed(priced, capital=kept / 1.4, **tight)
    assert (found.status, factor) == ("Infeasible_relaxed", 1.5) and found.objective is not None
    found, factor = D.solve_relaxed(priced, capital=-1.0, **tight)
    assert (found.objective, factor) == (None, 1.5)
    sampled = D.replications(cohorts, draws=50, times=3, capital=1e6, nonrenew_share=1.0, cession=1e6).collect()
    assert [r.replication for r in sampled] == [0, 1, 2] and len({r.x for r in sampled}) == 3


def test_caps_defer_smallest_first(spark):
    from perilmesh.operators.decide import territory_caps

    rng = random.Random(4)
    rows = [(f"c{i:02d}", rng.choice(["337", "338", "774", "289"]), {"337": "FL", "338": "FL", "774": "TX", "289": "NC"}, float(rng.randrange(1, 30))) for i in range(30)]
    rows = [(c, z, s[z], t) for c, z, s, t in rows]
    names = {"337": ("FL:coastal", 0.03), "338": ("FL:inland", 0.05), "774": ("TX:tier_1", 0.04), "289": ("NC:coastal", 0.05)}
    totals = [("FL:coastal", 900.0), ("FL:inland", 1e9), ("TX:tier_1", 0.0)]
    want = set()
    for z, (bucket, cap) in names.items():
        own = sorted((t, c) for c, zz, _, t in rows if zz == z)
        running = sum(t for t, _ in own)
        denom = dict(totals).get(bucket, running)
        for t, c in own if denom > 0 else ():
            if running <= cap * denom:
                break
            want.add(c)
            running -= t
    frame = spark.createDataFrame(rows, "cohort_id string, zip3 string, state string, total_tiv double")
    assert {r.cohort_id for r in territory_caps(frame, spark.createDataFrame(totals, "bucket string, bucket_tiv double")).collect()} == want


def test_layer_window_equals_the_sequence(spark):
    from perilmesh.operators.loss import layer_capacity

    rng = random.Random(5)
    rows = [(n % 3, n, float(rng.randrange(0, 90))) for n in range(60)]
    want, left = {}, {0: 80.0, 1: 80.0, 2: 80.0}
    for layer, n, loss in rows:
        ceded = min(max(0.0, min(loss, 60.0) - 20.0), left[layer])
        left[layer] -= ceded
        want[n] = ceded
    got = {r.event_id: r.ceded for r in layer_capacity(spark.createDataFrame(rows, "layer long, event_id long, loss double"), 20.0, 60.0, 1).collect()}
    assert got == pytest.approx(want)


def test_tails_and_merge(spark):
    from perilmesh.operators import loss as L

    prior = spark.createDataFrame([("a", k, float(k)) for k in range(100)] + [("b", k, 5.0) for k in range(100)], "cohort_id string, k long, loss double")
    t = {r.cohort_id: r for r in L.tails(prior).collect()}
    assert t["b"].tvar == 5 and t["a"].p50 == 49.5 and t["a"].tvar >= t["a"].p99
    assert L.top_mean(L.book_losses(prior), 100).first()[0] == 104
    sim = spark.createDataFrame([("a", 0, 1.0), ("zz", 0, 1.0)], "cohort_id string, k long, loss double")
    assert L.merged(prior, sim, 100).count() == 201


def test_ledger_keeps_first_writes(spark, tmp_path):
    from perilmesh.operators import ledger as G

    rows = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 3, "only")], "id string, seq long, note string")
    path = f"file://{tmp_path}/ledger"
    assert G.append(rows.limit(0), rows, "id", path, "seq") == 2
    known = spark.read.parquet(path)
    assert {r.id: r.note for r in known.collect()} == {"x": "early", "y": "only"}
    assert G.append(known, rows, "id", path, "seq") == 0
    moves = [("d", 1, "claim"), ("d", 2, "enqueue"), ("d", 3, "claim"), ("d", 4, "complete"), ("d", 5, "cancel"), ("e", 1, "enqueue"), ("e", 2, "cancel")]
    assert {r.decision_id: r.state for r in G.fold_queue(spark.createDataFrame(moves, "decision_id string, seq long, move string")).collect()} == {"d": "completed", "e": "cancelled"}


def test_feed_files(spark, tmp_path):
    from perilmesh.plans.feeds import TRACKS
    from perilmesh.sources import feeds

    (tmp_path / "best.txt").write_text(TRACKS.replace("\n", "\r\n"))
    track = feeds.parse_hurdat2(feeds.numbered_lines(spark, f"file://{tmp_path}/best.txt"))
    assert track.count() == 6 and feeds.landfalls(track).count() == 2 and all(r.lon < 0 for r in track.collect())
    first = feeds.seed_track(track, "AL012001", points=2).orderBy("ts").collect()
    assert [(r.hours_from_now, r.peak_wind) for r in first] == [(0.0, 51.8), (6.0, 86.3)]
    (tmp_path / "book.csv").write_text('policy_id,state,zip3,lat,lon,tiv,build_type,flood_zone\n1,FL,337,27.5,-82.5,100,"wood\nframe","A""E"\n')
    assert feeds.read_book_csv(spark, f"file://{tmp_path}/book.csv").first().flood_zone == 'A"E'
    losses = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)], "cohort_id string, k long, loss double")
    wide = feeds.wide_losses(losses, 3)
    assert {(r.cohort_id, r.k): r.loss for r in feeds.long_losses(wide).collect()} == {("a", 0): 1, ("a", 1): 0, ("a", 2): 3, ("b", 0): 0, ("b", 1): 2, ("b", 2): 0}


def test_streams(spark, tmp_path):
    from perilmesh.streaming import refresh

    source = f"file://{tmp_path}/in"
    rows = [("s1", "1", "2024-01-01 00:00:00"), ("s1", "1", "2024-01-01 01:00:00"), ("s1", "2", "2024-01-01 02:00:00"), ("s2", "9", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "storm_id string, advisory string, t string").select("storm_id", "advisory", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema("storm_id string, advisory string, ts timestamp").parquet(source)
    refresh.changed(stream()).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.storm_id, r.advisory) for r in spark.table("changes").collect()) == [("s1", "1"), ("s1", "2"), ("s2", "9")]
    for n in ("c2", "c3"):  # a replay from scratch adds nothing
        refresh.append_ledger(stream(), f"file://{tmp_path}/out", f"{tmp_path}/{n}", "storm_id", "ts").awaitTermination()
    assert {r.storm_id: r.advisory for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"s1": "1", "s2": "9"} and spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_search_is_near_the_best_mix(spark):
    from perilmesh.operators import decide as D
    from perilmesh.operators import portfolio as P

    rng = random.Random(11)
    rows = [(f"c{i}", 1e6 * rng.uniform(0.5, 2), 1e4 * rng.uniform(1, 3), 1e3 * rng.uniform(1, 9)) for i in range(6)]
    cohorts = spark.createDataFrame(rows, "cohort_id string, total_tiv double, total_premium double, loss_p50 double").withColumn("loss_p99", F.col("loss_p50") * 7.2)
    by = {}
    for r in D.coefficients(cohorts).collect():
        by.setdefault(r.cohort_id, {})[r.action] = (r.profit, r.capital, r.cession, r.nonrenew)
    tiv, p99 = sum(r[1] for r in rows), sum(r[3] for r in rows) * 7.2
    problems = {"wide": (0.9 * p99, 0.05 * p99, 0.5 * tiv), "tight": (0.55 * p99, 0.02 * p99, 0.3 * tiv), "least": (0.3 * p99, 0.06 * p99, 0.2 * tiv), "none": (0.1 * p99, 0.0, 0.1 * tiv), "below": (-1.0, 0.0, 0.0)}
    found, actions = P.search(cohorts, problems)
    chosen = {}
    for r in actions.collect():
        chosen.setdefault(r.problem, {})[r.cohort_id] = r.action
    # plain search over distinct options
    options = [list({v for v in own.values()}) for own in by.values()]
    for name, b in problems.items():
        best = max((sum(c[0] for c in mix) for mix in itertools.product(*options) if all(sum(c[i + 1] for c in mix) <= x for i, x in enumerate(b))), default=None)
        f = found[name]
        if best is None:
            assert f.objective is None and name not in chosen
            assert f.status == "Infeasible" if name in ("none", "below") else f.status in ("Infeasible", "Undecided")
            continue
        mix = [by[c][a] for c, a in chosen[name].items()]
        assert len(mix) == 6 and all(sum(c[i + 1] for c in mix) <= x * (1 + 1e-6) for i, x in enumerate(b))
        assert f.objective == pytest.approx(sum(c[0] for c in mix), abs=0.01) and f.objective <= best + 0.01 <= f.bound + 0.02
        assert f.objective >= best - 0.01 * abs(best), name


def test_search_of_an_empty_book(spark):
    from perilmesh.operators import portfolio as P

    cohorts = spark.createDataFrame([], "cohort_id string, total_tiv double, total_premium double, loss_p50 double, loss_p99 double")
    found, actions = P.search_one(cohorts, capital=1.0, nonrenew_share=0.5, cession=1.0)
    assert actions.count() == 0 and found.bound >= 0
