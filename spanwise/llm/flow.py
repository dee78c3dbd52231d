"""Maximum flow on small networks: Dinic's blocking flows on level graphs, without recursion."""

from __future__ import annotations

from collections import deque


class Network:
    """Arcs with whole-number capacities between nodes 0..n-1; arc 2i runs forward, arc 2i + 1 is its return."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, there: int, back: int = 0) -> int:
        """The new arc's number; its flow, less that of ``back``, is what its return can give back."""
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.cap += (there, back)
        return len(self.to) - 2

    def _levels(self, source: int, sink: int) -> list[int]:
        to, cap, out = self.to, self.cap, self.out
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        return level

    def saturate(self, source: int, sink: int) -> list[int]:
        """Adds flow until there is no path left; the levels of what the source still reaches (-1 for the rest)."""
        to, cap, out = self.to, self.cap, self.out
        while True:
            level = self._levels(source, sink)
            if level[sink] < 0:
                return level
            at, path, v = [0] * len(out), [], source
            while True:
                if v == sink:
                    pushed = min(cap[e] for e in path)
                    keep = len(path)
                    for i, e in enumerate(path):
                        cap[e] -= pushed
                        cap[e ^ 1] += pushed
                        if not cap[e] and i < keep:
                            keep = i
                    v = to[path[keep] ^ 1]  # go on from before the first arc that is full
                    del path[keep:]
                    continue
                edges, i = out[v], at[v]
                while i < len(edges) and not (cap[edges[i]] and level[to[edges[i]]] == level[v] + 1):
                    i += 1
                at[v] = i
                if i < len(edges):
                    path.append(edges[i])
                    v = to[edges[i]]
                elif v == source:
                    break
                else:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
