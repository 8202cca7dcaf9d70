"""Words and counts made in numpy are those of the JVM's expressions, whatever the text."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as queries
from quillstone.functions import text as T
from quillstone.functions import wording
from quillstone.operators import contamination, dedup, grams, quality

ODD = list("aZé'''...#-* \n\n\t\r\x0b\x0c\x1c\x1f0ßİΣς٣") + ["•", "…", "\x85", "\xa0", " ", " ", " ", " ", " ", " ", " ", "　", "᠎", "​"]
ODD += ["中", "\U0001d400", "\U0001f600", "́", "don't", "a'b'c'd", "...", " - x", "\n• y", "\n\xa0* z", "\x00", "²", "_", "’"]


def _texts():
    rng = np.random.default_rng(11)
    made = ["".join(rng.choice(ODD, k)) for k in [0, 1, 1, 2, 3, 3, 3, *rng.integers(0, 60, 600)]]
    return [*made, ".", "..", "x ..", ".'", "'a", "a'", "a''b", "中'文", None, "\n", "", "#", "a" * 40 + " " + "é" * 8 + " " + "é" * 7]


def test_words_and_counts_are_those_of_the_jvm(spark):
    rows = list(enumerate(_texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {r.doc_id: r for r in quality.prepared(docs).collect()}
    text = F.coalesce("text", F.lit(""))
    low = {r.doc_id: r for r in docs.select("doc_id", F.lower(text).alias("low"), text.alias("text")).collect()}
    flags = wording.unpacked(wording.letters(spark))
    # a slice, as parts of batches are
    lows, texts = (pa.array(["x y z"] + [low[i][name] for i, _ in rows], pa.string())[1:] for name in ("low", "text"))
    ends, data = wording.bytes_of(lows)
    row, lo, hi = wording.words(ends, data, flags)
    got = [[] for _ in rows]
    for r, a, b in zip(row, lo, hi, strict=True):
        got[r].append(data[a:b].tobytes().decode())
    assert got == [want[i].w for i, _ in rows]
    assert wording.joined(data, row, lo, hi, len(rows)).to_pylist() == [" ".join(want[i].w) for i, _ in rows]
    counts = wording.counts(texts) | {"words": np.bincount(row, minlength=len(rows)), "word_chars": wording.word_chars(data, row, lo, hi, len(rows))}
    for name in quality.COUNTED:
        assert counts[name].tolist() == [want[i][name] for i, _ in rows], name


def test_names_of_words_differ_and_do_not_depend_on_the_batch():
    words = ["", "a", "a\0", "\0", "b", "a" * 15, "a" * 16, "a" * 15 + "\0", "é" * 8, "a" * 17]
    names = grams.word_names(pa.array(["x", *words])[1:])
    assert len({tuple(x) for x in names.tolist()}) == len(words)
    assert (grams.word_names(pa.array(words[::-1]))[::-1] == names).all()
    assert (grams.names_in(grams.binary(names)[2:5]) == names[2:5]).all()


def test_slices_are_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, "", "b" * 50, "c", "d" * 9, ""])], names=["i", "t"])
    for most in (1, 10, 15, 1000):
        parts = list(wording.slices(batch, 1, most))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
        assert all(p.num_rows == 1 or sum(len(t) for t in p.column(1).to_pylist()) <= most for p in parts)
    assert list(wording.slices(batch[:0], 1)) == []


def test_validation_grams_that_training_lacks_are_no_rows(spark):
    words = [f"w{i}" for i in range(2000)]
    docs = [(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(10)] + [(10, " ".join(words[40:60])), (11, " ".join(words[1990:])), (12, None)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    val = contamination.validation(docs, 10)
    train = contamination.met_grams(docs.where("doc_id >= 10"), "doc_id", contamination.filter_of(val, "doc_id"))
    _, met = contamination._met(val, train, 13)
    assert met.count() == 8
    leak, overlap = contamination.leaks(docs, 10, val, train)
    assert sorted(map(tuple, leak.collect())) == [(i, 88, 8 if i == 0 else 0) for i in range(10)]
    assert sorted(map(tuple, overlap.collect())) == [(10, 8), (11, 0), (12, 0)]


def test_the_audit_takes_no_regular_expression_for_each_text(spark, sf_dir, monkeypatch):
    # before, the pass over all texts split them four times by the JVM's regular expressions
    def refuse(*_):
        raise AssertionError("words of the JVM")

    for name in ("normalized_words", "raw_words", "lines"):
        monkeypatch.setattr(T, name, refuse)
    for name in ("A10_audit_summary", "F04_curated_documents", "O02_audit_examples"):
        assert queries.queries()[name](spark, sf_dir).columns


def test_equal_bands_have_equal_keys():
    sig = np.random.default_rng(2).integers(0, 2**32, (3, dedup.PERMUTATIONS))
    sig[2, 8:] = sig[0, 8:]
    sig[1, 8:16] = sig[0, 16:24]
    keys = dedup.band_keys(pa.array([list(sig[0]), None, list(sig[1]), list(sig[2])], pa.list_(pa.int64()))).to_pylist()
    assert keys[1] is None and len({*keys[0], *keys[2], *keys[3]}) == 2 * dedup.BANDS + 1
    assert keys[0][1:] == keys[3][1:] and keys[0][0] != keys[3][0]


def test_clusters_read_no_signatures_to_meet(spark, sf_dir):
    # before, all signatures were read and hashed twice for their bands
    sigs = dedup.signed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert dedup.clusters_of(dedup.written(sigs, "signatures")).count() == sigs.count()
    want = dedup.candidates(sigs).collect()
    assert sorted(dedup.met_by(sigs.where("keys is not null").select("doc_id", F.explode("keys").alias("key"))).collect()) == sorted(want) != []
