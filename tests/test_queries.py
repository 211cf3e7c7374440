"""Every query against its SQL on the driver's smallest tables; the others against plain Python."""

import pytest

from spanweave.plans.queries import ORACLES, QUERIES
from tests.oracle import TESTDATA, differences

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def test_moving_average(spark):
    rows = sorted(QUERIES["w2_ema"](spark, SF).collect())
    samples = {}
    from spanweave.sources.adapters import trace

    for e in sorted(trace(spark, SF).select("process", "start_us", "duration_us").collect()):
        samples.setdefault(e.process, []).append((e.start_us, e.duration_us / 3e10))
    want = []
    for process, series in samples.items():
        grid, ema = series[0][0], 0.0
        for t, x in series:
            while t > grid + 3_600_000_000:
                grid += 3_600_000_000
                want.append((process, grid, pytest.approx(ema)))
            ema = 0.99 * x + 0.01 * ema
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: r[:2])


def test_lanes_as_plain_version(spark):
    """Each event takes the lane that was used last among those that are free, else a new one; so no lane has overlapping ones."""
    groups = {}
    for r in QUERIES["o14_lanes"](spark, SF).collect():
        groups.setdefault((r.process, r.category), []).append((r.start_us, r.end_us, r.event_id, r.lane))
    for rows in groups.values():
        ends = []
        for start, end, _, lane in sorted(rows):
            free = [i for i, e in enumerate(ends) if e <= start]
            want = max(free, key=lambda i: (ends[i], -i)) if free else len(ends)
            assert lane == want
            ends[want:want + 1] = [end]
