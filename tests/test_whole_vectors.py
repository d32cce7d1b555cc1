"""Vector operators over all places of the embeddings agree with NumPy."""

from pathlib import Path

import numpy as np
import pytest

from corpusloom.plans import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def attended(v):
    parts = v.reshape(-1, Q.HEAD)
    scores = parts @ parts.T / np.sqrt(Q.HEAD)
    scores[:, -1] = -np.inf
    weight = np.exp(scores - scores.max(1, keepdims=True))
    return (weight / weight.sum(1, keepdims=True) @ parts).ravel()


WHOLE = {
    "linear_whole": lambda v: np.array(Q.WHOLE_WEIGHT) @ v + np.array(Q.WHOLE_BIAS),
    "position_add_whole": lambda v: v + np.array(Q.POSITIONS).ravel(),
    "attention_whole": attended,
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, name):
    vectors = {r.vec_id: np.array(r.v) for r in Q._vectors(spark, str(DATA)).collect()}
    assert {v.size for v in vectors.values()} == {Q.PLACES}
    rows = Q.queries()[name](spark, str(DATA)).collect()
    got = {(r.vec_id, r.place): r.y for r in rows}
    expected = {(k, i): y for k, v in vectors.items() for i, y in enumerate(WHOLE[name](v).tolist())}
    assert len(rows) == len(got) and got.keys() == expected.keys()
    assert max(abs(got[k] - y) for k, y in expected.items()) < 1e-5
