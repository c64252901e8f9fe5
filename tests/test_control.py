"""Control messages: run once, time-outs, restarts, repeated batches."""

import time

import pytest

from atalaia.streaming import control


@pytest.fixture
def served(spark, tmp_path):
    """Say messages and serve them, as often as wanted; what was started."""
    started = []

    def serve(*messages, timeout="PT1H", forget=None, fail=False):
        if messages:
            spark.createDataFrame([(i, t, s) for i, t, s in messages], "id string, task string, state string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

        def start(begun):
            if fail:
                raise OSError("no room")
            started.extend((r.id, r.attempt, r.task) for r in begun.collect())

        stream = spark.readStream.schema(control.MESSAGE).json(str(tmp_path / "in"))
        control.serve(stream, start, str(tmp_path / "out"), str(tmp_path / "check"), timeout, forget)
        return {r.id: (r.state, r.attempt, r.runs) for r in control.states(spark, str(tmp_path / "out")).collect()}

    serve.started = started
    return serve


def test_steps():
    assert control.step("", "run") == "running" == control.step("timed_out", "run") == control.step("failed", "run")
    assert control.step("running", "completed") == "completed" and control.step("running", "failed") == "failed"
    assert not any(control.step(a, b) for a, b in (("running", "run"), ("completed", "run"), ("", "completed"), ("timed_out", "completed"), ("running", "odd")))


def test_runs_once_and_survives_restarts(served):
    assert served(("a", "index", "run"), ("a", "index", "run"), ("b", "x", "run"), ("c", "y", "completed"), (None, "z", "run"), ("d", "z", "odd")) == {"a": ("running", 1, 1), "b": ("running", 1, 1)}
    assert served.started == [("a", 1, "index"), ("b", 1, "x")] or sorted(served.started) == [("a", 1, "index"), ("b", 1, "x")]
    # Every call is a new query on the same checkpoint: a restart.
    assert served(("a", "index", "run"), ("b", None, "failed"))["b"] == ("failed", 1, 1) and len(served.started) == 2
    assert served(("a", None, "completed"), ("b", "again", "run")) == {"a": ("completed", 1, 1), "b": ("running", 2, 2)}
    assert served(("a", "index", "run"))["a"] == ("completed", 1, 1) and len(served.started) == 3 and served.started[-1] == ("b", 2, "again")
    assert served(("e", "both", "run"), ("e", None, "completed"))["e"] == ("completed", 1, 1)


def test_stuck_runs_time_out(served):
    assert served(("a", "x", "run"), ("b", "y", "run"), timeout="PT2S")["a"] == ("running", 1, 1)
    served(("b", None, "completed"), ("a", "x", "run"), timeout="PT2S")  # asking again does not put it off
    time.sleep(2.5)
    got = served(("c", "z", "run"), timeout="PT2S")
    if got["a"][0] == "running":  # the batch that takes messages may come before the timers
        got = served(("d", "z", "run"), timeout="PT2S")
    assert got["a"] == ("timed_out", 1, 1) and got["b"] == ("completed", 1, 1)
    assert served(("a", "x", "run"), timeout="PT1H")["a"] == ("running", 2, 2)


def test_failed_batches_are_taken_up(served):
    with pytest.raises(Exception, match="no room"):
        served(("a", "x", "run"), fail=True)
    assert served.started == []
    assert served()["a"] == ("running", 1, 1) and served.started == [("a", 1, "x")]
