import pytest

from evenkeel.plans import experiments


def test_trace_and_csv(spark, tmp_path):
    rows = list(experiments.trace(spark, "quick_sota", 0.01))
    assert [r["kind"] for r in rows] == ["plain", "fixed", "sharded"]
    assert len({r["found"] for r in rows}) == 1 and all(r["updates"] == 1000 and r["seconds"] > 0 for r in rows)
    experiments.write_csv(spark, rows, str(tmp_path), "quick_sota")
    got = spark.read.option("header", True).csv(str(tmp_path / "quick_sota.csv"))
    assert got.columns == list(rows[0]) and got.count() == 3


@pytest.mark.parametrize("name, index", [("query_scaling", -1), ("ddos_telemetry", 3), ("z_a_sweep", 0)])
def test_runs(spark, name, index):
    run = experiments.scaled(experiments.EXPERIMENTS[name][index], 0.002)
    row = experiments.measure(spark, name, run)
    assert 0 < row["found"] <= min(run.keys, run.updates)
    assert (row["grown"] > 0) == (run.kind == "growing")


def test_names(spark):
    assert len(experiments.EXPERIMENTS) == 10
    with pytest.raises(ValueError):
        next(experiments.trace(spark, "another"))
