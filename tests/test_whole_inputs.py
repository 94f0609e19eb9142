"""Queries that work on all rows of their tables, whatever their keys."""

import pytest

from vellum.plans import registry


@pytest.fixture
def run(spark, tmp_path):
    def of(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        return sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))

    return of


def test_points_in_boxes_of_large_keys(run):
    parts = [(k, k % 50 + 1) for k in (1, 1999, 2001, 5003, 70000, 70001)]
    items = [(o, n, float(o % 50 + n), (o + n) % 11 / 100) for o in (5, 5999, 6001, 80000, 80001, 900003) for n in range(1, 8)]
    got = run("points_in_boxes", part=(parts, "p_partkey long, p_size int"), lineitem=(items, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double"))
    want = [(o, n, k) for o, n, x, y in items for k, z in parts if z <= x <= z + k % 5 and z * 20 <= y * 10000 <= z * 20 + 25]
    counts = {k: (k, sum(b == k for _, _, b in want), sum(o for o, _, b in want if b == k)) for k in {b for _, _, b in want}}
    assert got == sorted(counts.values()) and any(o > 6000 and k > 2000 for o, _, k in want)


def test_merged_documents_of_all_conversations(run):
    turns = [(c, t) for c in range(12) for t in range(c % 3 + 1)]
    got = run("merged_documents", conversations=(turns, "conv_id long, turn int"))
    parts = [(p, c, t) for p, c, t in [(p, *x) for p in (0, 1) for x in turns] if (c % 2 == 0 if p == 0 else c % 2 or c % 5 == 0)]
    assert got == [(*x, k) for k, x in enumerate(parts)] and {x[1] for x in parts} == set(range(12))


def test_revision_diff_of_all_events(run):
    got = run("revision_diff", events=([(k, k, "a") for k in range(12)] + [(20, 13, "a"), (20, 14, "b"), (20, 15, "b"), (21, 16, "a"), (21, 19, "b")], "user_id long, event_id long, event_type string"))
    changes = {k: "added" if k % 2 else "deleted" for k in range(12) if k % 2 or k % 6 == 0} | {21: "changed"}
    assert got == sorted(changes.items())


def test_hex_decode_of_whole_texts(run):
    texts = [(0, ""), (1, "é" * 199 + "end"), (2, "ab\n> \U0001f600" * 5000), (3, "x" * 201)]
    assert run("hex_decode", documents=(texts, "doc_id long, text string")) == texts
