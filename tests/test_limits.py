"""Calls in flight: overlap, bound, order, retries, deadlines and failures, in a task and outside."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessella import hooks
from tessella.functions.limits import SERIAL, Limits, in_order
from tessella.operators import evaluation


class Gauge:
    """A call that sleeps and notes how many are in flight."""

    def __init__(self, seconds=0.05, fails=()):
        self.lock, self.now, self.most, self.calls, self.seconds, self.fails = threading.Lock(), 0, 0, 0, seconds, set(fails)

    def __call__(self, item):
        with self.lock:
            self.now, self.calls = self.now + 1, self.calls + 1
            self.most = max(self.most, self.now)
        try:
            time.sleep(self.seconds if item % 3 else self.seconds / 5)
            if item in self.fails:
                raise RuntimeError(f"bad {item}")
            return item * 10
        finally:
            with self.lock:
                self.now -= 1


def test_calls_overlap_within_the_bound_and_keep_their_order():
    gauge, began = Gauge(), time.monotonic()
    got = list(in_order(gauge, range(40), Limits(parallel=8)))
    assert got == [(i * 10, None) for i in range(40)] and gauge.most == 8 and time.monotonic() - began < 40 * 0.05 / 3
    alone = Gauge(0.001)
    assert [r for r, _ in in_order(alone, range(5), SERIAL)] == [0, 10, 20, 30, 40] and alone.most == 1


def test_failures_leave_no_place_taken():
    gauge = Gauge(0.01, fails=range(0, 60, 2))
    got = list(in_order(gauge, range(60), Limits(parallel=3, retries=0)))
    assert [e is not None for _, e in got] == [i % 2 == 0 for i in range(60)] and str(got[0][1]) == "bad 0"
    assert gauge.most == 3 and gauge.now == 0 and gauge.calls == 60


def test_retries_with_growing_pauses():
    at = []

    def flaky(item):
        at.append(time.monotonic())
        if len(at) < 4:
            raise RuntimeError("not yet")
        return item

    assert list(in_order(flaky, ["x"], Limits(retries=3, pause=0.05))) == [("x", None)]
    gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
    assert gaps[0] >= 0.05 and gaps[1] >= 0.1 and gaps[2] >= 0.2
    at.clear()
    ((result, error),) = in_order(flaky, ["x"], Limits(retries=1, pause=0.01))
    assert result is None and str(error) == "not yet" and len(at) == 2


def test_deadlines_give_up_and_the_bound_holds():
    let, most, lock, now = threading.Event(), [0], threading.Lock(), [0]

    def call(item):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        if item < 2:
            let.wait(20)
        with lock:
            now[0] -= 1
        return item

    began = time.monotonic()
    got = list(in_order(call, range(6), Limits(parallel=2, deadline=0.3)))
    assert time.monotonic() - began < 3 and all(isinstance(e, TimeoutError) for _, e in got) and most[0] == 2  # both places hang
    let.set()
    got = list(in_order(call, [5, 6], Limits(parallel=2, deadline=5)))
    assert got == [(5, None), (6, None)]


def test_items_are_taken_as_needed_and_threads_end():
    taken = []

    def items():
        for i in range(10**9):
            taken.append(i)
            yield i

    before = threading.active_count()
    results = in_order(lambda i: i, items(), Limits(parallel=4))
    assert [next(results) for _ in range(10)] == [(i, None) for i in range(10)] and len(taken) <= 10 + 8
    results.close()
    for _ in range(100):
        if threading.active_count() <= before:
            break
        time.sleep(0.02)
    assert threading.active_count() <= before
    with pytest.raises(ValueError, match="at least one"):
        next(in_order(lambda i: i, [1], Limits(parallel=0)))


def test_answers_in_a_task_overlap_and_keep_their_keys(spark):
    def slow(prompt, history=None):
        import time as t

        t.sleep(0.05)
        if prompt.endswith("7"):
            raise RuntimeError("seven")
        return prompt.upper()

    rows = spark.range(60).select("id", F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)

    def seconds(limits):
        began = time.monotonic()
        got = {r.id: (r.answer, r.error) for r in hooks.answered(rows, slow, limits=limits).collect()}
        assert got == {i: (None, "seven") if i % 10 == 7 else (f"P{i}", None) for i in range(60)}
        return time.monotonic() - began

    seconds(Limits(parallel=60, retries=0))  # starts the workers
    assert seconds(Limits(parallel=20, retries=0)) < 0.6 * seconds(SERIAL)


def test_embedding_scores_and_judges_use_the_limits(spark, tmp_path):
    folder = str(tmp_path)

    def once(name):
        """Whether this is the first call of that name."""
        import os

        try:
            os.close(os.open(f"{folder}/{name}", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True

    def embed(texts):
        if once("embed"):
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    def score(query, texts):
        if once("score"):
            return []
        return [float(len(t)) for t in texts]

    def judge(rows):
        if once("judge"):
            raise RuntimeError("busy")
        return [0.5 for _ in rows]

    again, rows = Limits(retries=1, pause=0.01), spark.createDataFrame([(i, "x" * i, "q") for i in range(1, 6)], "id long, content string, query string").coalesce(1)
    assert {r.id: r.vector for r in hooks.embedded(rows, embed, batch=2, limits=again).collect()} == {i: [float(i)] for i in range(1, 6)}
    assert {r.id: r.score for r in hooks.scored(rows, score, batch=2, limits=again).collect()} == {i: float(i) for i in range(1, 6)}
    assert {(r.score, r.error) for r in evaluation.judged(rows, judge, ["content"], batch=2, limits=again).collect()} == {(0.5, None)}
    with pytest.raises(Exception, match="vectors for"):
        hooks.embedded(rows, lambda texts: [], limits=SERIAL).collect()


def test_the_router_counts_right_with_many_threads():
    seen, lock = {0: 0, 1: 0, 2: 0}, threading.Lock()

    def model(k):
        def complete(prompt, history=None):
            with lock:
                seen[k] += 1
            return str(k)

        return complete

    list(in_order(hooks.routed([model(k) for k in range(3)]), ["p"] * 300, Limits(parallel=16)))
    assert seen == {0: 100, 1: 100, 2: 100}
