"""The stored dense index: brute force over all cells, recall, changes, parts of cells, odd vectors."""

import numpy as np
import pytest

from folioscan.operators import cells, dense


def table(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)


def clustered(n, dim=16, groups=12, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dim)) * 3
    return [(i, middle[r.integers(groups)] + r.normal(size=dim)) for i in range(n)]


def asked(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors], "query_id long, embedding array<double>")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def brute(spark, known, questions, k):
    return rows_of(dense.retrieve(table(spark, known.items()), asked(spark, questions), k))


def test_changes_and_all_cells_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 40)
    index = cells.Cells(spark, str(tmp_path / "index"), cells=9)
    first, more = clustered(300), clustered(90, seed=2)
    questions = clustered(20, seed=3)
    index.upsert(table(spark, first))
    known = dict(first)
    index.upsert(table(spark, [(i + 250, v) for i, v in more]))  # some replace, some are new
    known |= {i + 250: v for i, v in more}
    gone = list(range(0, 330, 7))
    index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (99999,)], "doc_id long"))
    known = {i: v for i, v in known.items() if i not in gone}
    want = brute(spark, known, questions, 5)
    assert rows_of(index.retrieve(asked(spark, questions), 5, visit=9)) == want and index.count() == len(known)
    index.merge()
    assert rows_of(index.retrieve(asked(spark, questions), 5, visit=9)) == want and len(index.store.manifest()["segments"]) == 1
    index.store.prune()
    assert index.store.validate() == [] and rows_of(index.retrieve(asked(spark, questions), 5, visit=99)) == want


def test_recall_and_partition_filters(spark, tmp_path):
    vectors, questions = clustered(2000, groups=40), clustered(60, groups=40, seed=1)
    index = cells.Cells(spark, str(tmp_path / "index"))
    index.upsert(table(spark, vectors))
    m = index.store.manifest()
    got = index.retrieve(asked(spark, questions), 10)
    assert m["visit"] < 45 // 2
    truth = {(q, d) for q, _, d, _ in brute(spark, dict(vectors), questions, 10)}
    assert len({(q, d) for q, _, d, _ in rows_of(got)} & truth) >= 0.9 * len(truth)
    one = index.retrieve(asked(spark, questions[:1]), 10)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_recall_of_vectors_without_clusters(spark, tmp_path):
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(size=24)) for i in range(1200)]
    questions = [(i, r.normal(size=24)) for i in range(40)]
    index = cells.Cells(spark, str(tmp_path / "index"))
    index.upsert(table(spark, vectors))
    truth = {(q, d) for q, _, d, _ in brute(spark, dict(vectors), questions, 10)}
    assert len({(q, d) for q, _, d, _ in rows_of(index.retrieve(asked(spark, questions), 10))} & truth) >= 0.9 * len(truth)


def test_odd_vectors(spark, tmp_path):
    index = cells.Cells(spark, str(tmp_path / "index"))
    q = asked(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0])])
    assert index.retrieve(q, 3).collect() == []
    index.upsert(table(spark, [(1, None), (2, [0.0, 0.0])]))
    assert index.retrieve(q, 3).collect() == []
    odd = [(1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [-1.0, 1e-9])]
    index.upsert(table(spark, odd))
    assert rows_of(index.retrieve(q, 3, visit=99)) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.0)]
    assert index.retrieve(q.limit(0), 3).collect() == []
    with pytest.raises(ValueError, match="repeat"):
        index.upsert(table(spark, [(1, [1.0, 1.0]), (1, [1.0, 2.0])]))
    index.upsert(table(spark, [(1, [0.0, 0.0])]))  # in place of the one before, and takes no part
    assert [r[2] for r in rows_of(index.retrieve(q, 3, visit=99))] == [2, 3, 9]
    with pytest.raises(TypeError):
        index.upsert(spark.createDataFrame([(1, "x")], "vec_id long, embedding string"))


def test_codes_leave_out_what_they_say():
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(size=(50, 8)), np.zeros((1, 8))])
    code, step, rest = cells.coded(x)
    assert np.allclose(np.sqrt(((x - code * step[:, None]) ** 2).sum(axis=1)), rest) and rest[-1] == 0 and np.abs(code).max() <= 127


def test_large_batches_of_questions_are_dealt_to_blocks(spark):
    vectors, questions = clustered(200), clustered(30, seed=7)
    odd = [(900, None), (901, [1.0] * 5), (902, vectors[3][1] * 2)]  # another length; a tie
    t, q = table(spark, [*vectors, *odd]), asked(spark, [*questions, (77, [1.0] * 5)])
    want = rows_of(dense.retrieve(t, q, 4))
    assert len(want) == 121 and rows_of(dense.retrieve(t, q, 4, most=100)) == want
