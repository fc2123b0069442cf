import numpy as np
import pyarrow as pa

from keyloom.llm import near_dedup, quality_rules
from keyloom.llm.bytetext import column_bytes, row_groups


def test_groups_of_rows_hold_every_row_in_order():
    texts = ["", None, "é" * 700, "a b", None, "x" * 5000, "", "tail"]
    column = pa.array(["skipped", *texts]).slice(1)
    for limit in (1, 10, 1500, 1 << 20):
        groups = [g.to_pylist() for g in row_groups(column, limit)]
        assert sum(groups, []) == texts
        assert all(len(g) == 1 or sum(len((x or "").encode()) for x in g) <= limit for g in groups)
    assert list(row_groups(pa.array([], pa.string()))) == []


def test_a_group_is_measured_as_its_rows_are():
    rng = np.random.default_rng(4)
    texts = ["\n".join(" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(n)) for n in (0, 1, 50, 3)] + [None, "é # \n# é"]
    column = pa.array(texts)
    whole = quality_rules._measure_group(column, quality_rules.Limits())
    assert whole == [quality_rules._measure_group(column.slice(i, 1), quality_rules.Limits())[0] for i in range(len(texts))]
    sets = list(near_dedup.shingle_sets(column))
    assert [s.tolist() for s in sets] == [next(near_dedup.shingle_sets(column.slice(i, 1))).tolist() for i in range(len(texts))]


def test_the_memory_of_a_batch_is_that_of_a_group():
    import tracemalloc

    column = pa.array([" ".join(f"w{i}x{j}" for j in range(400)) for i in range(3000)])  # some 7 MB
    tracemalloc.start()
    for group in row_groups(column, 1 << 18):
        quality_rules._measure_group(group, quality_rules.Limits())
    assert tracemalloc.get_traced_memory()[1] < 40 * (1 << 18)
    tracemalloc.stop()
    assert len(column_bytes(column)[0]) > 6_000_000
