"""Nearest neighbours where many different vectors tie: the smaller id decides."""

import numpy as np

from vitalcurve.llm import neighbours


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(0)
    vectors = np.unique((rng.random((1_500, 12)) < 0.4).astype(float), axis=0)
    vectors = vectors[vectors.any(1)]
    rng.shuffle(vectors)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest_neighbours(frame, frame.where("vec_id % 5 = 0"), list_vectors=10**6).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, ids in got.items():
        scores = neighbours.cosine(vectors[q][None], vectors)
        order = [i for i in np.lexsort((np.arange(len(vectors)), -scores)).tolist() if i != q]
        assert ids == order[:5]
    assert len(got) == -(-len(vectors) // 5)
