"""States of batches whose messages arrive in any order, against the batch form."""

import time
from datetime import datetime, timedelta

import pytest

from trendloom.operators.requests import batch_state
from trendloom.streaming import ledger
from trendloom.streaming.ledger import NEWS, track_batches, tracked_states

PAST, LATER, FAR = datetime(2020, 1, 1), datetime(2020, 1, 2), datetime(2999, 1, 1)
HOUR = timedelta(hours=1)


@pytest.fixture()
def arrive(spark, tmp_path):
    """Give messages as one arrival; returns {id: (file, status, state, overdue)} after it."""
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))

    def give(*messages, **options):
        spark.createDataFrame(messages, NEWS).coalesce(1).write.mode("append").parquet(src)
        track_batches(spark, src, out, log, HOUR, **options)
        return {r["id"]: (r["jsonl_file"], r["status"], r["state"], r["overdue"]) for r in tracked_states(spark, out).collect()}

    return give


def test_last_message_counts_in_any_order(arrive):
    got = arrive(("b1", "f1", "validating", PAST), ("b2", None, "completed", LATER), ("b3", "f3", "validating", FAR),
                 ("b3", None, "in_progress", FAR + HOUR), ("b3", None, "validating", FAR), ("b4", "f4", "new", FAR))
    # b2 has no ledger line yet; b1 was last heard of long ago
    assert got == {"b1": ("f1", "validating", "active", True), "b3": ("f3", "in_progress", "active", False),
                   "b4": ("f4", "new", "unknown", False)}
    got = arrive(("b2", "f2", "validating", PAST), ("b1", None, "completed", LATER), ("b3", None, "finalizing", FAR))
    assert got == {"b1": ("f1", "completed", "done", False), "b2": ("f2", "completed", "done", False),
                   "b3": ("f3", "in_progress", "active", False), "b4": ("f4", "new", "unknown", False)}


def test_ties_repeats_and_gaps(arrive):
    line = ("b", "f", "validating", FAR)
    got = arrive(line, line, ("b", None, "failed", FAR), (None, "f", "failed", FAR), ("b", None, None, FAR),
                 ("b", None, "completed", None), ("", "g", "expired", PAST))
    assert got == {"b": ("f", "failed", "ended", False), "": ("g", "expired", "ended", False)}
    assert arrive(line) == got


def test_a_busy_batch_and_many_files_at_a_time(spark, arrive):
    steps = [("hot", None, "in_progress", PAST + timedelta(seconds=i)) for i in range(20000)]
    got = arrive(*steps, ("hot", "f", "validating", PAST), ("hot", None, "cancelled", FAR), max_files=1)
    assert got == {"hot": ("f", "cancelled", "ended", False)}


def test_nothing_arrived(spark, tmp_path):
    spark.createDataFrame([], NEWS).write.parquet(str(tmp_path / "src"))
    track_batches(spark, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "log"), HOUR)
    assert tracked_states(spark, str(tmp_path / "out")).count() == 0


def test_equal_to_the_batch_form(spark, arrive):
    ledger = spark.createDataFrame([(f"f{i}", (f"b{i}", "validating")) for i in range(50)],
                                   "jsonl_file string, batch struct<id string, status string>")
    status = spark.createDataFrame([(f"b{i}", ["completed", "failed", "odd"][i % 3]) for i in range(0, 80, 2)],
                                   "id string, status string")
    arrive(*[(f"b{i}", f"f{i}", "validating", PAST) for i in range(25)],
           *[(r["id"], None, r["status"], LATER) for r in status.collect()[:10]])
    got = arrive(*[(f"b{i}", f"f{i}", "validating", PAST) for i in range(25, 50)],
                 *[(r["id"], None, r["status"], LATER) for r in status.collect()[10:]])
    assert {(f, i, s, st) for i, (f, s, st, _) in got.items()} == {tuple(r) for r in batch_state(ledger, status).collect()}
    assert all(overdue == (state in ("active", "unknown")) for _, _, state, overdue in got.values())


def test_an_arrival_calls_the_state_by_buckets_not_by_batches(spark, arrive, monkeypatch):
    """With two buckets: overdue by the clock, ended, still open, not named and told again, side by side in one state."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(ledger._LastStatus):
        def handleInputRows(self, *given):
            calls.add(1)
            yield from super().handleInputRows(*given)

    monkeypatch.setattr(ledger, "BUCKETS", 2, raising=False)
    monkeypatch.setattr(ledger, "_LastStatus", Counted)
    kinds = [("validating", PAST), ("completed", PAST), ("in_progress", FAR), ("failed", FAR)]
    lines = [(f"b{i}", f"f{i}", *kinds[i % 4]) for i in range(400)]
    got = arrive(*lines, *[(f"c{i}", None, "completed", FAR) for i in range(40)])
    states = [("active", True), ("done", False), ("active", False), ("ended", False)]
    assert got == {f"b{i}": (f"f{i}", kinds[i % 4][0], *states[i % 4]) for i in range(400)}
    again = arrive(*lines[:200], ("b0", None, "completed", LATER), ("b4", "g4", "validating", PAST),
                   *[(f"c{i}", f"d{i}", "validating", PAST) for i in range(20)])
    got |= {"b0": ("f0", "completed", "done", False), "b4": ("g4", "validating", "active", True)}
    assert again == got | {f"c{i}": (f"d{i}", "completed", "done", False) for i in range(20)}
    assert 0 < calls.value <= 4


def test_a_timer_gives_out_what_has_become_overdue(spark, arrive):
    soon = datetime.now() - HOUR + timedelta(seconds=20)
    got = arrive(*[(f"b{i}", f"f{i}", "validating", soon + timedelta(seconds=i % 3)) for i in range(30)], ("c", "f", "new", FAR))
    assert not any(overdue for *_, overdue in got.values())
    time.sleep(max(0.0, (soon + HOUR + timedelta(seconds=4) - datetime.now()).total_seconds()))
    got = arrive(("d", "f", "completed", PAST))
    assert {i for i, (*_, overdue) in got.items() if overdue} == {f"b{i}" for i in range(30)} and len(got) == 32
