"""When to try a failed model call again, how calls share an engine's rate, and what a failed
batch becomes."""

from __future__ import annotations

import math
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class RetryPolicy:
    """``attempts`` calls at most; ``waits[k]`` seconds after failed call k.

    A failure is tried again only when its message holds one of ``retry_on``.
    ``on_error`` is ``keep`` (the originals stand in) or ``raise``.

    ``gap`` is the time in seconds between two calls of the engine, whatever task makes them.
    ``in_flight`` calls of a task run at once. ``latency`` is how long an answer is expected to
    take: it tells how many tasks it needs to use the rate up. ``split_calls`` further calls
    may be spent on a failed batch, to find the texts that it fails for.
    """

    attempts: int = 1
    waits: tuple[float, ...] = ()
    retry_on: tuple[str, ...] = ()
    gap: float = 0.0
    on_error: str = "keep"
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)
    in_flight: int = 1
    latency: float = 0.0
    split_calls: int = 0
    clock: Callable[[], float] = field(default=time.time, repr=False)

    def lanes(self, partitions: int) -> int:
        """How many tasks call the engine: all, or as many as its gap leaves work for."""
        if not self.gap:
            return partitions
        return max(1, min(partitions, math.ceil(self.latency / (self.gap * self.in_flight))))

    def call(self, fn: Callable, *args, before: Callable[[], None] = lambda: None):
        """``(result, attempts used)``; raises the last error. ``before`` comes before each attempt."""
        for k in range(1, self.attempts + 1):
            before()
            try:
                return fn(*args), k
            except Exception as e:  # noqa: BLE001 - any engine error counts
                again = any(mark.lower() in str(e).lower() for mark in self.retry_on)
                if not again or k == self.attempts:
                    e.attempts = k
                    raise
                if k <= len(self.waits):
                    self.sleep(self.waits[k - 1])
        raise ValueError("attempts must be at least 1")


class Pace:
    """One task's share of its engine's rate; every call stage uses one.

    Time is cut into slots of one gap, counted from the epoch, and slot s belongs to lane
    s modulo ``lanes``. A call starts where a slot of its lane starts, so no two calls of the
    engine ever start in one slot, on whatever executor: the lanes share nothing but the clock.
    A task that calls alone, one call after another, waits the gap between them instead.
    """

    def __init__(self, policy: RetryPolicy, lane: int = 0, lanes: int = 1) -> None:
        self.policy, self.lane, self.lanes = policy, int(lane), lanes
        self.last = -1
        self.lock = threading.Lock()

    def wait(self) -> None:
        policy = self.policy
        if not policy.gap:
            return
        if self.lanes == 1 and policy.in_flight == 1:
            if self.last >= 0:
                policy.sleep(policy.gap)
            self.last = 0
            return
        with self.lock:
            now = policy.clock()
            slot = max(math.ceil(now / policy.gap), self.last + 1)
            slot += (self.lane - slot) % self.lanes
            self.last = slot
        if slot * policy.gap > now:
            policy.sleep(slot * policy.gap - now)


def in_order(jobs: Iterable[Any], call: Callable[[Any], Any], in_flight: int = 1) -> Iterator[Any]:
    """``call`` of each job, in the order of the jobs, up to ``in_flight`` at once.

    At most as many again wait behind them, so memory does not grow with the jobs. The first
    error ends it; calls that have not begun are dropped.
    """
    if in_flight <= 1:
        yield from map(call, jobs)
        return
    pool = ThreadPoolExecutor(in_flight)
    try:
        waiting: deque = deque()
        for job in jobs:
            waiting.append(pool.submit(call, job))
            if len(waiting) >= 2 * in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        pool.shutdown(cancel_futures=True)


def ask_batch(fn: Callable, policy: RetryPolicy, texts: list[str], *args, pace: Pace | None = None) -> tuple[list, list, list]:
    """(answers, statuses, attempts), one of each for each text.

    Status is ``ok``, ``kept`` (the call failed) or ``misaligned`` (another number of answers);
    in the last two the original stands in. With ``split_calls`` the halves of a failed batch
    are asked again, the largest first, down to single texts or until the calls are spent.
    Attempts are the calls that held the text.
    """
    def ask(part: list[str]) -> tuple[list, str, int]:
        try:
            result, used = policy.call(fn, part, *args, before=pace.wait if pace else lambda: None)
            result = list(result)
        except Exception as e:  # noqa: BLE001
            if policy.on_error == "raise":
                raise
            return part, "kept", getattr(e, "attempts", 1)
        if len(result) != len(part):
            # pairs by position would be wrong from some line on: keep the originals
            return part, "misaligned", used
        return (result, "ok", used) if all(isinstance(r, str) for r in result) else (part, "kept", used)

    n = len(texts)
    outs, stats, tries = list(texts), ["kept"] * n, [0] * n
    parts, left = deque([(0, n)]), policy.split_calls + 1
    while parts and left:
        a, b = parts.popleft()
        left -= 1
        result, status, used = ask(texts[a:b])
        outs[a:b], stats[a:b] = result, [status] * (b - a)
        tries[a:b] = [t + used for t in tries[a:b]]
        if status != "ok" and b - a > 1:
            half = (a + b + 1) // 2
            parts += [(a, half), (half, b)]
    return outs, stats, tries


# --- fixed values: how each engine retries and paces -------------------------
POLICIES = {
    "gemini": RetryPolicy(4, (10, 20, 30), ("429", "RESOURCE_EXHAUSTED"), gap=5),
    "sarvam": RetryPolicy(4, (10, 20, 30), ("429", "rate_limit"), gap=3, on_error="raise"),
    "anthropic": RetryPolicy(3, (1, 2), ("529",)),
    "openai": RetryPolicy(),
    "indictrans2": RetryPolicy(),
}
