import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from vitalcurve import build_session  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "vitalcurve-tests",
        master="local[8]",
        shuffle_partitions=8,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_panel(spark):
    """The panel of the smallest tables, kept for the whole run."""
    from vitalcurve.plans import clean_panel

    return clean_panel(spark, str(TESTDATA / "sf0.001")).persist()


@pytest.fixture(scope="session")
def small_dirty_panel(spark):
    from vitalcurve import standardise_panel
    from vitalcurve.plans import dirty_panel

    return standardise_panel(dirty_panel(spark, str(TESTDATA / "sf0.001"))).persist()


@pytest.fixture
def panel(spark):
    """Build a panel from rows given as dicts; columns not named are null."""
    schema = (
        "dish_id string, genotype string, housing string, density_category string, cross_id string,"
        " genotype_housing string, days_since_fertilization bigint, initial_count bigint,"
        " vol_water_total bigint, survival_rate double, survival_rate_change double, remaining double,"
        " cumulative_deaths double, volume_per_fish double, fish_density double"
    )
    names = [part.split()[0] for part in schema.split(",")]
    short = {"unit": "dish_id", "day": "days_since_fertilization"}

    def build(*rows):
        full = []
        for row in rows:
            row = {short.get(k, k): v for k, v in row.items()}
            assert set(row) <= set(names), row
            full.append(tuple(row.get(n) for n in names))
        return spark.createDataFrame(full, schema)

    return build
