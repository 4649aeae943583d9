from pathlib import Path

from evenkeel.sources import scratch


def test_materialised_tables_can_be_cleaned(spark):
    df = scratch.materialise(spark.range(10))
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 10 and path.exists()
    assert scratch.clean(spark) >= 1 and not path.exists()
