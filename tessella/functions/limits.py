"""Bounded concurrency for calls of foreign models: in order, with retries, back-off and a deadline."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from queue import SimpleQueue
from typing import Any


@dataclass(frozen=True)
class Limits:
    """How a task calls a model.

    ``parallel`` calls of a task are in flight at most; a stage has that many for each task that runs
    at a time. A call that fails is made again up to ``retries`` times, after ``pause`` seconds and
    each time twice as long (at most ``longest``). ``deadline`` is the seconds that an item may take
    from the begin of its first call with all its retries; none for as long as it takes.
    """

    parallel: int = 16
    retries: int = 2
    pause: float = 0.5
    longest: float = 30.0
    deadline: float | None = None


#: One call after another and none again.
SERIAL = Limits(parallel=1, retries=0)


class _Job:
    """An item on its way: its result or error is there once ``done`` is set."""

    def __init__(self, item: Any):
        self.item, self.result, self.error, self.began = item, None, None, None
        self.started, self.done = threading.Event(), threading.Event()


def _work(queue: SimpleQueue, call: Callable, limits: Limits) -> None:
    while (job := queue.get()) is not None:
        job.began = time.monotonic()
        job.started.set()
        for attempt in range(limits.retries + 1):
            if job.done.is_set():  # given up meanwhile
                break
            try:
                job.result, job.error = call(job.item), None
                break
            except Exception as failure:  # noqa: BLE001  the model is foreign code
                job.error = failure
                pause = min(limits.pause * 2**attempt, limits.longest)
                spent = time.monotonic() - job.began
                if attempt == limits.retries or (limits.deadline is not None and spent + pause >= limits.deadline):
                    break
                job.done.wait(pause)
        job.done.set()


def in_order(call: Callable[[Any], Any], items: Iterable, limits: Limits = Limits()) -> Iterator[tuple[Any, Exception | None]]:
    """``(result, error)`` of ``call`` on every item, in the order of the items.

    Items are taken as places become free, some of them ahead of the result that is awaited, so an
    endless stream of items needs no more memory than twice ``parallel`` results. A call that is
    given up at its deadline goes on in its thread and keeps its place until it returns, as the model
    still works on it: the bound holds. Items for which no place becomes free within the deadline
    fail too. Threads end with the last item, also where the caller stops early or an error is raised.
    """
    if limits.parallel < 1:
        raise ValueError("at least one call has to be in flight")
    queue: SimpleQueue = SimpleQueue()
    threads = 0
    waiting: deque[_Job] = deque()
    source = iter(items)
    ended = False
    try:
        while True:
            while not ended and len(waiting) < 2 * limits.parallel:
                try:
                    job = _Job(next(source))
                except StopIteration:
                    ended = True
                    break
                waiting.append(job)
                queue.put(job)
                if threads < limits.parallel:
                    threading.Thread(target=_work, args=(queue, call, limits), daemon=True).start()
                    threads += 1
            if not waiting:
                return
            yield _awaited(waiting.popleft(), limits)
    finally:
        for job in waiting:
            job.done.set()
        for _ in range(threads):
            queue.put(None)


def _awaited(job: _Job, limits: Limits) -> tuple[Any, Exception | None]:
    if limits.deadline is None:
        job.done.wait()
        return job.result, job.error
    if not job.started.wait(limits.deadline):
        job.done.set()
        return None, TimeoutError(f"no call could begin within {limits.deadline:g} s")
    if not job.done.wait(max(0.0, job.began + limits.deadline - time.monotonic())):
        job.done.set()
        return None, TimeoutError(f"no answer within {limits.deadline:g} s")
    return (None, job.error) if job.error is not None else (job.result, None)
