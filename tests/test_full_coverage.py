"""The coverage queries against brute force over the full closure, on chains longer than any fixed depth."""

from collections import deque

import pytest

from codeweft.model import Graph
from codeweft.plans import suite


def small() -> tuple[list[dict], list[tuple[str, str, str]]]:
    node = lambda i, project="EUROPE", **more: {"node_id": i, "type": "Method", "name": i, "project": project} | more
    nodes = [node(f"m{i:02}", "europe" if i % 2 else "EUROPE") for i in range(14)] + [node(f"a{i}", "ASIA") for i in range(3)]
    nodes += [node("t1", "TESTS", is_test=True, declaring_type="k"), node("t2", "EUROPE", is_test=True, declaring_type="j"), node("t3", None, is_test=True), node("hook", "TESTS", is_test_lifecycle=True, declaring_type="k"), node("none", None), node("abstract", is_abstract=True)]
    edges = [(f"m{i:02}", "Calls", f"m{i + 1:02}") for i in range(9)] + [("t1", "Calls", "m00"), ("m09", "Calls", "m03"), ("m09", "Calls", "ghost"), ("ghost", "Calls", "m13")]
    edges += [("hook", "Calls", "m11"), ("m12", "Implements", "m11"), ("t2", "Calls", "m13"), ("m13", "Calls", "a0"), ("a0", "Calls", "a1"), ("a1", "Calls", "a2"), ("a2", "Calls", "m05"), ("t3", "Calls", "a1"), ("t3", "Calls", "none")]
    return nodes, edges


def brute(nodes, edges) -> dict[tuple[str, str], int]:
    known = {n["node_id"]: n for n in nodes}
    steps: dict[str, list[str]] = {}
    for a, kind, b in edges:
        a, b = (b, a) if kind == "Implements" else (a, b)
        if b in known:
            steps.setdefault(a, []).append(b)
    out = {}
    for t in (n for n in nodes if n.get("is_test")):
        starts = [t["node_id"]] + [n["node_id"] for n in nodes if n.get("is_test_lifecycle") and t.get("declaring_type") and n["declaring_type"] == t["declaring_type"]]
        depth, queue = dict.fromkeys(starts, 0), deque(starts)
        while queue:
            at = queue.popleft()
            for b in steps.get(at, []):
                if b not in depth:
                    depth[b] = depth[at] + 1
                    queue.append(b)
        for b, d in depth.items():
            n = known[b]
            if d and not n.get("is_test") and not n.get("is_test_lifecycle") and n["project"] and n["project"].lower() != (t["project"] or "").lower():
                out[t["node_id"], b] = d
    return out


@pytest.fixture
def run(spark, monkeypatch):
    nodes, edges = small()
    g = Graph.build(spark, nodes, [{"src": a, "dst": b, "type": t} for a, t, b in edges])
    monkeypatch.setattr(suite, "layered_graph", lambda spark, sf_dir: g)
    return lambda name: [tuple(r) for r in suite.QUERIES[name](spark, "").collect()]


def test_full_closure(run):
    nodes, edges = small()
    want = brute(nodes, edges)
    assert max(want.values()) > 9
    assert sorted(run("coverage")) == sorted((a, b, d) for (a, b), d in want.items())
    hit = {b for _, b in want}
    assert sorted(run("uncovered_methods")) == sorted((n["node_id"],) for n in nodes if (n["project"] or "").lower() == "europe" and not n.get("is_test") and not n.get("is_abstract") and n["node_id"] not in hit)
    assert sorted(run("covering_tests")) == sorted((a, d) for (a, b), d in want.items() if b == min(hit))
    assert sorted(run("covered_methods")) == sorted((b, d) for (a, b), d in want.items() if a == "t1")
