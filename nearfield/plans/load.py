"""Closed-loop load: clients that each ask again as soon as they are answered. A benchmark, not a query."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence


def closed_loop(ask: Callable[[object], object], requests: Sequence, clients: int, seconds: float) -> dict:
    """Run ``ask`` over the requests from several threads for some time.

    Client 0 first goes once through all requests, and its answers are returned; the others start spread over
    them. Errors are counted and do not stop a client.
    """
    if clients < 1 or not requests:
        raise ValueError("a load needs clients and requests")
    latencies: list[list[float]] = [[] for _ in range(clients)]
    errors, answers = [0] * clients, [None] * len(requests)
    ready, began = threading.Barrier(clients), time.monotonic()
    end: list[float] = []

    def client(number: int) -> None:
        at = number * len(requests) // clients
        if ready.wait() == 0:
            end.append(time.monotonic() + seconds)
        done = 0
        while not end:
            time.sleep(0)
        while time.monotonic() < end[0] or (number == 0 and done < len(requests)):
            i, start = at % len(requests), time.monotonic()
            try:
                found = ask(requests[i])
                latencies[number].append(1000 * (time.monotonic() - start))
                if number == 0 and done < len(requests):
                    answers[i] = found
            except Exception:  # a failing request is a result of a load test
                errors[number] += 1
            at, done = at + 1, done + 1

    threads = [threading.Thread(target=client, args=(n,)) for n in range(clients)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    took = time.monotonic() - began
    flat = [x for each in latencies for x in each]
    return {"clients": clients, "seconds": took, "queries_done": len(flat), "errors": sum(errors), "qps": len(flat) / took, "latency_ms": flat, "answers": answers}
