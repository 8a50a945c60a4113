"""Many vector queries at once: a task's scores are bounded, and so are truths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strataspan.operators import retrieval
from strataspan.queries import texts

from .test_spatial_sql import plan_of


class Held:
    def __init__(self, names, vectors):
        self.value = names, vectors


def test_scores_in_parts(monkeypatch):
    """No more scores than CELLS at a time, and the same best ones as all at once."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(70, 8)), rng.normal(size=(40, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(v.tolist())], ["vec_id", "embedding"])
    monkeypatch.setattr(retrieval, "CELLS", 400)
    out = list(retrieval._best_of_batches(iter([batch]), Held(pa.array(range(70)), q), 3))
    assert len(out) == 7
    got = {(a, b): s for part in out for a, b, s in zip(*[c.to_pylist() for c in part.columns], strict=True)}
    want = {(a, int(b)): s for a, row in enumerate(q @ v.T) for b, s in zip(np.argsort(-row)[:3], np.sort(row)[::-1][:3], strict=True)}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_truth_is_not_listed(spark, sf_dir):
    assert "collect_list" not in plan_of(texts.x10_evaluate(spark, sf_dir))
