"""An exact solver for small assignments, to hold the auction against."""

from collections.abc import Sequence

import numpy as np


class Flow:
    """Min-cost flow by successive shortest paths (Bellman-Ford with a queue), exact for integral capacities."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[float] = []

    def edge(self, u: int, v: int, room: int, cost: float) -> int:
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += [v, u]
        self.left += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, s: int, t: int, want: int) -> int:
        sent = 0
        while sent < want:
            far, via, waiting, queued = [float("inf")] * len(self.out), [-1] * len(self.out), [s], [False] * len(self.out)
            far[s] = 0.0
            while waiting:
                u = waiting.pop(0)
                queued[u] = False
                for e in self.out[u]:
                    v = self.to[e]
                    if self.left[e] and far[u] + self.cost[e] < far[v] - 1e-12:
                        far[v], via[v] = far[u] + self.cost[e], e
                        if not queued[v]:
                            queued[v] = True
                            waiting.append(v)
            if via[t] < 0:
                break
            push, v = want - sent, t
            while v != s:
                push, v = min(push, self.left[via[v]]), self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.left[via[v]] -= push
                self.left[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]
            sent += push
        return sent


def solve_assignment(score: np.ndarray, document: Sequence[int], per_chunk: int, quota: int, least: int) -> list[tuple[int, int]]:
    """(chunk, group) pairs with the largest sum of scores: at most ``per_chunk`` groups for a chunk, exactly ``quota`` chunks for a group,
    at least min(least, all it can give) pairs for a document. Raises ValueError if that can't be met.

    A flow network: source, documents (lower bound as a large bonus), chunks, groups, sink.
    """
    n, m = score.shape
    docs = sorted(set(document))
    bonus = (float(np.abs(score).max(initial=0.0)) + 1.0) * (n * m + 1)
    f = Flow(2 + len(docs) + n + m)
    s, t, d0, c0, g0 = 0, 1, 2, 2 + len(docs), 2 + len(docs) + n
    firm = []
    for i, d in enumerate(docs):
        room = per_chunk * sum(x == d for x in document)
        need = min(least, room)
        firm.append((f.edge(s, d0 + i, need, -bonus), need))
        f.edge(s, d0 + i, room - need, 0.0)
    cells = []
    for c in range(n):
        f.edge(d0 + docs.index(document[c]), c0 + c, per_chunk, 0.0)
        cells += [(c, g, f.edge(c0 + c, g0 + g, 1, -float(score[c, g]))) for g in range(m)]
    for g in range(m):
        f.edge(g0 + g, t, quota, 0.0)
    if f.run(s, t, quota * m) < quota * m or any(f.left[e] for e, need in firm if need):
        raise ValueError("no assignment meets the constraints")
    return [(c, g) for c, g, e in cells if not f.left[e]]
