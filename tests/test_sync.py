"""Fetching what is absent, stopping in the middle, and going on."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.sources import sync as Y

STEP, START, END = 900, 1_700_000_100, 1_700_000_100 + 900 * 100


def service(log, stop_at=None, gap=(), wrong=None, flaky=None):
    """Candles of whole steps, from which ``gap`` is missing; notes each request in ``log``."""

    def fetch(a, b):
        os.makedirs(log, exist_ok=True)
        first = not os.path.exists(f"{log}/{a}-{b}")
        open(f"{log}/{a}-{b}", "a").write("x")
        if stop_at is not None and a >= stop_at:
            raise RuntimeError("the line is cut")
        if flaky is not None and first:
            raise OSError("try again")
        for t in range(-(-a // STEP) * STEP, b, STEP):
            if t not in gap:
                yield (t, 1.0, 2.0, -1.0 if t == wrong else 0.5, 1.5, 3.0)

    return fetch


def times(spark, path):
    return sorted(r["epoch"] for r in Y.stored_history(spark, path).collect())


WHOLE = list(range(-(-START // STEP) * STEP, -(-END // STEP) * STEP, STEP))


def test_a_stop_loses_only_the_open_round(spark, tmp_path):
    path, log = str(tmp_path / "table"), str(tmp_path / "log")
    cut = WHOLE[60]
    with pytest.raises(Exception, match="the line is cut"):
        Y.sync_history(spark, service(log, stop_at=cut), path, START, END, page=10, pages_a_round=2)
    assert times(spark, path) == WHOLE[:60]
    before = set(os.listdir(log))
    found = Y.sync_history(spark, service(str(tmp_path / "again")), path, START, END, page=10, pages_a_round=2)
    assert found == {"pages": 4, "received": 40, "stored": 100, "absent": 0} and times(spark, path) == WHOLE
    assert len(os.listdir(tmp_path / "again")) == 4 and len(before) >= 7
    assert Y.sync_history(spark, service(str(tmp_path / "none")), path, START, END)["pages"] == 0 and not os.path.exists(tmp_path / "none")


def test_gaps_of_the_service_stay_gaps(spark, tmp_path):
    path, gap = str(tmp_path / "table"), set(WHOLE[20:23]) | {WHOLE[0], WHOLE[-1]}
    found = Y.sync_history(spark, service(str(tmp_path / "log"), gap=gap, flaky=True), path, START, END, page=30, wait=0.01)
    assert found == {"pages": 4, "received": 95, "stored": 95, "absent": 5}
    ranges = sorted((r["start"], r["end"]) for r in Y.absent_ranges(Y.stored_history(spark, path), START, END).collect())
    assert ranges == [(WHOLE[0], WHOLE[1]), (WHOLE[20], WHOLE[23]), (WHOLE[-1], WHOLE[-1] + STEP)]
    assert Y.absent_ranges(Y.stored_history(spark, path).filter(F.lit(False)), START, END).collect() == [(WHOLE[0], WHOLE[-1] + STEP)]


def test_wrong_pages_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(Exception, match="no candle"):
        Y.sync_history(spark, service(str(tmp_path / "log"), wrong=WHOLE[15]), path, START, END, page=10, pages_a_round=1)
    assert times(spark, path) == WHOLE[:10]
    for rows in ([(STEP, 1, 2, 0.5, 1, 1)] * 2, [(5 * STEP, 1, 2, 0.5, 1, 1)], [(STEP + 1, 1, 2, 0.5, 1, 1)]):
        with pytest.raises(Y.InvalidPage):
            Y.checked(rows, 0, 3 * STEP, STEP)
