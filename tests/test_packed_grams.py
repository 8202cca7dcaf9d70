"""Grams meet packed: what is written are counts, and packing loses nothing."""

import numpy as np

from quillstone.operators import overlap
from quillstone.queries.measures import R


def test_no_table_holds_a_row_for_each_shared_gram(spark, tmp_path, monkeypatch):
    # before, each gram of each copy was a written row of 24 bytes, twice shuffled after that
    words = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(words)) for k in range(1, 41)] + [(99, " ".join(words[:1000])), (100, "none of it is here at all")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    held, write = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    got = R.queries["U05_true_jaccard"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.other): r.jaccard for r in got} == {(k, 1): 1.0 for k in range(2, 41)} | {(99, 1): round(996 / 2996, 6)}
    assert sum(df.count() for df in held) < 41 * 2996 / 10


def test_packed_grams_come_back():
    rng = np.random.default_rng(0)
    ids = np.array([7, -3, 2**62, -(2**62), 7, 0])
    row, names, part = rng.integers(0, 6, 500), rng.integers(0, 2**63, (500, 2)).astype(np.uint64), rng.integers(0, 9, 500)
    batch = overlap._packed(ids, row, names, part)
    docs = np.concatenate([overlap._ids(x) for x in batch.column(1).to_pylist()])
    parts = np.repeat(batch.column(0).to_pylist(), [len(x) // overlap.NAME_BYTES for x in batch.column(2).to_pylist()])
    raw = b"".join(batch.column(2).to_pylist())
    got = sorted((int(p), int(d), raw[12 * i : 12 * i + 12]) for i, (p, d) in enumerate(zip(parts, docs, strict=True)))
    assert got == sorted((int(p), int(ids[r]), x.tobytes()[:12]) for p, r, x in zip(part, row, names, strict=True))
    assert overlap._packed(ids[:0], row[:0], names[:0], part[:0]).num_rows == 0


def test_names_of_one_first_half_are_told_apart():
    raw = lambda a, b: np.uint64(a).tobytes() + np.uint32(b).tobytes()
    names = np.frombuffer(raw(5, 1) + raw(5, 2) + raw(5, 1) + raw(5, 2) + raw(6, 1) + raw(5, 1), np.uint8)
    doc, m, n = overlap._owned(np.array([1, 2, 3, 3, 4, 1]), names)
    assert list(zip(doc.tolist(), m.tolist(), n.tolist(), strict=True)) == [(3, 1, 1), (3, 2, 1)]
    assert [len(x) for x in overlap._owned(np.zeros(0, np.int64), np.zeros(0, np.uint8))] == [0, 0, 0]


def test_shuffle_files_go_with_their_job(spark):
    from quillstone.plans.store import shuffles_dropped, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    with shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        assert written(spark.range(1000).repartition(3), "some").count() == 1000
    assert spark.conf.get(key) == held
