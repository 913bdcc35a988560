from test_graph import edge, make, rows, sym

from semgraph.operators import analysis as A


def test_modules_beyond_the_hops_and_by_contains_edges(spark):
    s = [sym("mod:a", "module", props={"referenceClosure": "DirectOnly"}), sym("mod:b", "module"), sym("ns:0", "namespace", "mod:a")]
    s += [sym(f"ns:{i}", "namespace", f"ns:{i - 1}") for i in range(1, 5)]
    s += [sym("deep", "type", "ns:4"), sym("tied"), sym("b", "type", "mod:b"), sym("loose")]
    g = make(spark, s, [edge("ns:0", "tied", "contains"), edge("deep", "b"), edge("tied", "b"), edge("loose", "b")])
    found = dict(rows(A.any_module_of(g, 2)))
    assert found["deep"] == found["tied"] == found["ns:4"] == "mod:a" and found["b"] == "mod:b" and "loose" not in found
    assert rows(A.module_boundary(g)) == [("mod:a", "mod:b", 2, "deep -> b")]
