"""Plain single-machine versions to test the operators against."""

from __future__ import annotations


def components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """node -> (least weakly linked id, least mutually reachable id), by search from every node."""
    nodes = {x for r in rows for x in r if x is not None}
    out: dict[int, set] = {n: set() for n in nodes}
    back: dict[int, set] = {n: set() for n in nodes}
    for u, v in rows:
        if u is not None and v is not None:
            out[u].add(v)
            back[v].add(u)

    def reach(start: int, *ways: dict) -> set:
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for w in ways:
                for y in w[x] - seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    weak: dict[int, int] = {}
    strong: dict[int, int] = {}
    for n in sorted(nodes):
        if n not in weak:
            weak.update(dict.fromkeys(reach(n, out, back), n))
        if n not in strong:
            strong.update({x: n for x in reach(n, out) & reach(n, back)})
    return {n: (weak[n], strong[n]) for n in nodes}
