import numpy as np
import pytest

from strataline.operators import vector
from strataline.plans import search


@pytest.mark.parametrize("metric, least", [("cosine", 0.92), ("l2", 0.7)])
def test_duplicates_of_all_symbols(spark, monkeypatch, metric, least):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((40, 64)), 8, axis=0) + 0.2 * rng.standard_normal((320, 64))
    x[5] = x[6]
    kinds = ["variable" if i % 8 == 7 else "function" for i in range(320)]
    placed = spark.createDataFrame([(f"s{i}", k, i % 16 == 4, 0, 59 if i == 12 else 60) for i, k in enumerate(kinds)], "stable_id string, kind string, is_test boolean, byte_start int, byte_end int")
    raw = {
        "embedding_meta": spark.createDataFrame([(f"s{i}", i + 1) for i in range(320)], "symbol_stable_id string, symbol_id long"),
        "symbol_embeddings": spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "symbol_id long, embedding array<double>"),
    }
    tables = type("T", (), {"placed": placed, "raw": lambda self, n: raw[n]})()
    monkeypatch.setattr(vector, "ROWS", 150)
    got = {(r["symbol_a_id"], r["symbol_b_id"]): r["similarity"] for r in search.duplicates(tables, least=least, metric=metric).collect()}
    ok = [i for i in range(320) if i % 8 != 7 and i % 16 != 4 and i != 12]
    u = x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
    s = u @ u.T
    s = s if metric == "cosine" else 1 - np.sqrt(np.maximum(2 - 2 * s, 0))
    np.fill_diagonal(s, -9)
    want = {(min(ok[i], ok[j]) + 1, max(ok[i], ok[j]) + 1): round(s[i, j], 6) for i in range(len(ok)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= least}
    assert got.keys() == want.keys() and len(got) > 300
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)
