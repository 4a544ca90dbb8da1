import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    session = local_session("8", "tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Rows -> frame with the keys of one snapshot in front."""
    def build(columns: str, rows: list[tuple], snapshot: str = "s1"):
        schema = "repository_id string, snapshot_id string, " + columns
        return spark.createDataFrame([("repo", snapshot, *row) for row in rows], schema)
    return build


@pytest.fixture(scope="session")
def edge_frame(facts):
    """'A CALLS B' or 'A CALLS B inferred' -> edge rows."""
    def build(*lines: str, snapshot: str = "s1"):
        rows = []
        for line in lines:
            source, kind, target, *rest = line.split()
            rows.append((source, kind, target, rest[0] if rest else "exact"))
        return facts("source_id string, relationship string, target_id string, resolution string", rows, snapshot)
    return build


@pytest.fixture(scope="session")
def start(facts):
    return lambda *ids: facts("start string", [(i,) for i in ids])
