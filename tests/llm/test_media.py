"""Small crops of larger images find their image."""

import numpy as np

from quillstone.llm import media


def test_small_crops_of_larger_images(spark):
    rng = np.random.default_rng(9)
    images, crops = [], []
    for i in range(8):
        grey = np.kron(rng.integers(0, 256, (32, 32)), np.ones((8, 8)))
        y, x = rng.integers(0, 256 - 72, 2)
        images.append((i, media.encode_pgm(grey)))
        crops.append((i, media.encode_pgm(grey[y : y + 72, x : x + 72] * 0.85 + 15 + rng.normal(0, 3, (72, 72)))))
    schema = "id bigint, image binary"
    _, found = media.find_copies(spark.createDataFrame(images, schema), spark.createDataFrame(crops, schema))
    assert {(r["query"], r["class_id"]) for r in found.collect()} == {(i, i) for i in range(8)}


def test_recall_of_the_query_against_all_pairs(spark, sf_dir):
    """Every edit of the query finds at least nine of ten of the images that comparing all pairs finds; unlike images are left alone."""
    from quillstone.llm import queries

    vectors = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/embeddings.parquet").where("vec_id < 40").collect()
    images = {r.vec_id: np.kron(np.clip(128 + 400 * np.array(r.embedding, float), 0, 255).reshape(8, 8), np.ones((8, 8))) for r in vectors}
    asked = {(i, k): np.clip(np.rint(queries.edited(images[i], 20 * (k + 7 * i))), 0, 255) for i in images if i < 20 for k in range(7)}
    read = lambda a: media.describe(media.decode_image(media.encode_pgm(a)))
    stored = {i: read(a) for i, a in images.items()}
    all_pairs = set()
    for (i, k), a in asked.items():
        u = read(a)
        all_pairs |= {(i, k, j) for j, v in stored.items() if media.enough(media.agreeing(*u, *v), u[1], v[1])}
    for k in range(7):
        assert sum((i, k, i) in all_pairs for i in range(20)) >= 18, k
    schema = "id bigint, image binary"
    number = {q: n for n, q in enumerate(asked)}
    _, found = media.find_copies(spark.createDataFrame([(i, media.encode_pgm(a)) for i, a in images.items()], schema), spark.createDataFrame([(number[q], media.encode_pgm(a)) for q, a in asked.items()], schema))
    back = {n: q for q, n in number.items()}
    got = {(*back[r["query"]], r["class_id"]) for r in found.collect()}
    assert got <= all_pairs
    for k in range(7):
        want = {x for x in all_pairs if x[1] == k}
        assert len(got & want) >= 0.9 * len(want), k
    assert sum(i != j for i, _, j in got) <= 0.02 * len(got)
