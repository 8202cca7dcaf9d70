"""Operators with hand-checked inputs and planted problems."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import audit, bytepairs, contamination, dedup, quality, serving, shards
from quillstone.operators.components import connected_components
from quillstone.plans import store
from quillstone.queries.jobs import calculate, dispatch


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_normalised_words(spark):
    got = frame(spark, ["Hello, World! It's 2024.", "", None]).select(T.normalized_words(F.col("text")).alias("w")).collect()
    assert [r.w for r in got] == [["hello", "world", "it's", "2024"], [], None]


def test_quality_rules(spark):
    rng = random.Random(1)
    good = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    texts = [good, "Buy now. Click here.", "best cheap flights book today " * 40, "это текст на русском " * 30, "", None, "# a " * 60, "\n".join(["- item of a list with words"] * 30)]
    flags = {r.doc_id: set(r.flags) for r in quality.flags(quality.counted(frame(spark, texts))).collect()}
    assert flags[0] == set() and flags[1] == {"too_short"} and "repetitive" in flags[2] and "non_english_chars" in flags[3]
    assert "too_short" in flags[4] and "too_short" in flags[5] and "symbol_heavy" in flags[6] and "mostly_bullets" in flags[7]
    s = {r.doc_id: r for r in quality.signals(quality.counted(frame(spark, texts))).collect()}
    assert s[2].repetition > 0.9 and s[4].mean_word_len == 0.0


def test_minhash_estimates_and_clusters(spark):
    rng = random.Random(2)
    base = [words(rng, 300) for _ in range(30)]

    def edited(w, share):
        return [f"e{rng.randrange(9999)}" if rng.random() < share else x for x in w]

    texts = [" ".join(w) for w in base] + [" ".join(edited(base[3], 0.01)), " ".join(base[7]), " ".join(edited(base[3], 0.015)), "one two", "one two", "two one"]
    df = frame(spark, texts)
    sets = {r.doc_id: set(r.shingles) for r in dedup.shingle_sets(df).collect()}
    sigs = {r.doc_id: r.sig for r in dedup.signatures(dedup.shingle_sets(df)).collect()}
    for a, b in ((3, 30), (7, 31), (3, 32), (1, 2)):
        true = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert abs(sum(x == y for x, y in zip(sigs[a], sigs[b])) / 128 - true) < 0.12
    cluster = {r.doc_id: r.cluster for r in dedup.near_duplicates(df).collect()}
    assert cluster[30] == cluster[32] == 3 and cluster[31] == 7 and cluster[34] == 33 and cluster[35] == 35
    assert all(cluster[i] == i for i in range(30))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(60, 90)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 60 for i in [*range(60, 90), 100]) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_planted_corpus(spark):
    rng = random.Random(3)
    docs = [words(rng, 120) for _ in range(50)]
    question = [f"q{i}" for i in range(21)]
    docs[15] = docs[3][:]
    docs[16], docs[17] = docs[16], docs[16][:]
    docs[19] = ["x"] + docs[18][1:]
    docs[20] = docs[20] + question
    docs[21] = ("best cheap flights book today " * 30).split()
    df = frame(spark, [" ".join(w) for w in docs])
    items = spark.createDataFrame([(0, " ".join(question).upper()), (1, "too short")], "item_id bigint, text string")
    a = {r.doc_id: r for r in audit.audit(df, items, 10).collect()}
    assert [i for i, r in a.items() if r.near_dup] and a[15].val_cluster and a[17].near_dup and a[19].near_dup
    assert {i for i in range(10, 50) if not a[i].keep} == {15, 17, 19, 20, 21} and not any(a[i].keep for i in range(10)) and all(a[i].keep_strict for i in range(10) if not a[i].near_dup)
    hits = contamination.benchmark_hits(df, items).collect()
    assert [(h.doc_id, h.item_id, h.matched) for h in hits] == [(20, 0, 9)]


def test_owners_of_a_shared_gram(spark):
    shared = " ".join(f"s{i}" for i in range(13))
    items = spark.createDataFrame([(1, shared), (2, shared + " more")], "item_id bigint, text string")
    df = frame(spark, [shared])
    assert [h.item_id for h in contamination.benchmark_hits(df, items).collect()] == [1]
    assert sorted(h.item_id for h in contamination.benchmark_hits(df, items, owners="all").collect()) == [1, 2]


def test_shards_keep_every_token(spark):
    rng = random.Random(4)
    sizes = [(i, rng.randint(0, 400), rng.randint(0, 999)) for i in range(300)] + [(300, 7000, 1)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, text_bytes bigint")
    placed = {r.doc_id: r.first_token for r in shards.positions(df, parts=7).collect()}
    total = 0
    for i, n, _ in sizes:
        assert placed[i] == total
        total += n
    rows = shards.manifest(df, 1000, 3000).orderBy("shard").collect()
    assert rows[0].tokens == 1000 and all(r.tokens == 3000 for r in rows[1:-1]) and sum(r.tokens for r in rows) == total
    assert sum(r.docs for r in rows) == sum(n > 0 for _, n, _ in sizes) and rows[0].file == "val_0000.parquet" and rows[1].file == "train_0001.parquet"


def test_byte_pairs():
    assert bytepairs.pair_counts([1, 2, 3, 2, 3]) == {(1, 2): 1, (2, 3): 2, (3, 2): 1} and not bytepairs.pair_counts([7])
    for ids in ([], [5], [4, 4, 4, 4, 4, 8, 4, 4], [8, 4, 8, 4, 4, 8], [3] * 7):
        for pair in ((4, 4), (8, 4), (3, 3)):
            # as text, one character an id, replacing goes left to right without overlap too
            want = "".join(map(chr, ids)).replace("".join(map(chr, pair)), chr(77))
            assert bytepairs.merge(ids, pair, 77) == [ord(c) for c in want]
            x = bytepairs.np.array(ids, bytepairs.np.int64)
            assert len(bytepairs.places(x, pair)) == want.count(chr(77))
    with pytest.raises(ValueError):
        bytepairs.train({"a": 1}, 255)
    merges = bytepairs.train({"banana": 5, " band": 3, "café 日本語": 2}, 280)
    for text in ("banana band", "naïve café 日本語", "", "x\n\t y"):
        assert bytepairs.decode(bytepairs.encode(text, merges), merges) == text
    assert bytepairs.encode("abc", [(97, 98), (256, 99)]) == [257] and bytepairs.load(bytepairs.dump(merges)) == merges
    # the incremental counts choose what counting afresh would
    pieces, again = {"abab": 3, "bcbc": 4, "abc": 2}, []
    ids = {p: list(p.encode()) for p in pieces}
    for k in range(4):
        count = {}
        for p, n in pieces.items():
            for pair, c in bytepairs.pair_counts(ids[p]).items():
                count[pair] = count.get(pair, 0) + c * n
        if not count:
            break
        best = max(count, key=lambda p: (count[p], (-p[0], -p[1])))
        again.append(best)
        ids = {p: bytepairs.merge(x, best, 256 + k) for p, x in ids.items()}
    assert bytepairs.train(pieces, 256 + len(again)) == again


def test_trained_merges_of_any_pieces():
    rng = random.Random(5)
    for _ in range(30):
        pieces = {"".join(rng.choices("ab\0é", k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 12]))}
        least, ids, want = rng.choice([1, 2]), {p: list(p.encode()) for p in pieces}, []
        while True:
            count = {}
            for p, n in pieces.items():
                for pair, c in bytepairs.pair_counts(ids[p]).items():
                    count[pair] = count.get(pair, 0) + c * n
            best = max(count, key=lambda p: (count[p], -p[0], -p[1]), default=None)
            if best is None or count[best] < least:
                break
            want.append(best)
            ids = {p: bytepairs.merge(x, best, 255 + len(want)) for p, x in ids.items()}
        assert bytepairs.train(pieces, 1000, least) == want


def test_a_thread_deletes_its_own_tables_only(spark):
    kept, began = store.written(spark.range(5), "kept"), store.written_so_far()
    other = threading.Thread(target=lambda: (store.written(spark.range(3), "other"), store.drop_written(spark)))
    other.start()
    mine = [store.written(spark.range(n), "mine") for n in (6, 7)]
    other.join()
    assert [df.count() for df in (kept, *mine)] == [5, 6, 7] and store.written_so_far() == began + 2
    store.drop_written(spark, began, keep=1)
    assert kept.count() == 5 and mine[1].count() == 7 and store.written_so_far() == began + 1


def test_scheduler_and_pages():
    done = serving.continuous_batching([(0, 2), (1, 1), (2, 3)], 2)
    assert {r: (a, f) for r, a, f in done} == {0: (0, 2), 1: (0, 1), 2: (1, 4)}
    pool = serving.PagePool(3)
    assert pool.grow(1, 17) == [2, 1] and pool.grow(1, 20) == [2, 1]
    with pytest.raises(MemoryError):
        pool.grow(2, 33)
    pool.release(1)
    assert sorted(pool.free) == [0, 1, 2]


def test_tools():
    assert dispatch("calculator", {"expression": "2 * (3 - 1)"}) == "4" and dispatch("echo", {}).startswith("error: missing") and dispatch("rm", {}) == "error: unknown tool rm"
    assert dispatch("calculator", {"expression": "__import__('os')"}).startswith("error")
    with pytest.raises(ValueError):
        calculate("abs(1)")


def test_files(spark, tmp_path):
    from quillstone.sources import files

    (tmp_path / "a.txt").write_text("one\nline\n\n  \n two \n\n\n")
    assert [r.text for r in files.text_blocks(spark, str(tmp_path / "a.txt")).orderBy("block").collect()] == ["one\nline", "two"]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in [{"step": 1, "val_bpb": 1.5, "val_loss": 2.0}, {"step": 1, "train_loss": 3.0, "lr": 0.1}]))
    evals, logs = files.metrics_log(spark, str(tmp_path / "log.jsonl"))
    assert evals.count() == logs.count() == 1
    (tmp_path / "ch_1.md").write_text("intro\n## First\ntext\n```\n## not a heading\n```\n## Second\nend")
    got = files.chapters(spark, str(tmp_path / "ch_1.md")).orderBy("section_no").collect()
    assert [r.title for r in got] == [None, "First", "Second"]
    (tmp_path / "t.bin").write_bytes(bytes([1, 0, 255, 255]))
    assert [r.token for r in files.uint16_tokens(spark, str(tmp_path / "t.bin")).orderBy("pos").collect()] == [1, 65535]
    df = spark.createDataFrame([(1, "val", 0), (2, "train", 1)], "token int, split string, shard int")
    files.write_shards(df, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).where("split = 'val'").count() == 1
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.csv_table(spark, str(tmp_path / "csv"), "token int, split string, shard int").count() == 2
    files.append_json(df, str(tmp_path / "json"))
    files.append_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    assert files.digests(spark, str(tmp_path / "a.txt")).count() == 1


def test_streaming_ingestion_resumes(spark, tmp_path):
    from quillstone.streaming import ingest

    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    one = frame(spark, ["a b c", "d e"]).selectExpr("doc_id", "text", "'en' lang", "'s' source", "5L n_chars")
    one.coalesce(1).write.parquet(source)
    assert ingest.ingest_documents(spark, source, target, check) == 5
    one.coalesce(1).write.mode("append").parquet(source)
    assert ingest.ingest_documents(spark, source, target, check) == 10
    one.coalesce(1).write.mode("append").parquet(source)
    assert ingest.ingest_documents(spark, source, target, check, max_tokens=10) == 10
    # what lay beyond the budget is still to be done, and is done by a run without one
    assert ingest.ingest_documents(spark, source, target, check) == 15


def test_event_windows(spark, sf_dir):
    from quillstone.streaming import ingest

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()
    assert ingest.windowed_events(events).agg(F.sum("n")).first()[0] == n and ingest.sessions(events).agg(F.sum("events")).first()[0] == n
    folder_schema = events.schema
    stream = spark.readStream.schema(folder_schema).parquet(f"{sf_dir}/events.parquet*")
    q = ingest.windowed_events(stream).writeStream.format("memory").queryName("windows_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows_out").agg(F.sum("n")).first()[0] == n


def test_whole_sequence_merges_take_the_first_met_of_equals():
    assert bytepairs.train_whole(b"xyxyabab", 258) == [(120, 121), (97, 98)]
    assert bytepairs.train_whole(b"aaaa", 300) == [(97, 97)] and bytepairs.train_whole(b"", 300) == [] and bytepairs.train_whole(b"abc", 300) == []


def test_closed_loop_users():
    from quillstone.operators.serving import closed_loop_run

    # one user alone never waits: latencies are the answers' lengths
    tokens, waits = closed_loop_run([0], 1, 40)
    assert waits == [1 + (5 * k) % 23 for k in range(len(waits))] and tokens == sum(waits) <= 40
    # no more than the capacity is decoded in a step, and with enough users it is all used
    tokens, waits = closed_loop_run(list(range(12)), 3, 200)
    assert tokens <= 600 and tokens > 500 and min(waits) >= 1


def test_gpt2_ids(spark):
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from quillstone.operators import tokenizer

    texts = ["Hello world", "", None, "naïve <|endoftext|> 日本", "  x\n\n"]
    got = {r.doc_id: list(r["ids"]) for r in tokenizer.encode_with_ends(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    import base64

    with open(tokenizer.gpt2_ranks(), "rb") as lines:
        table = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
    plain = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
    assert got == {i: [*plain.encode_ordinary(t or ""), len(table)] for i, t in enumerate(texts)}


def test_vector_search_takes_every_row(spark):
    from quillstone.operators import retrieval

    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(30)] + [(40, None), (None, [1.0] * 4), (41, [0.0] * 4), (3, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    packed = retrieval.blocks(df)
    assert {r.q for r in retrieval.top_k(packed, packed, 2).collect()} == {*range(30), 41}
    none = retrieval.blocks(df.where("false"))
    assert retrieval.top_k(none, packed, 2).count() == retrieval.top_k(packed, none, 2).count() == 0


def test_audit_examples_are_the_worst_of_each_kind(spark):
    rng = random.Random(8)
    leaked, half = words(rng, 60), words(rng, 60)
    texts = [leaked, half, words(rng, 60), words(rng, 60)]  # validation
    texts += [leaked + words(rng, 40), half[:30] + words(rng, 40)] + [words(rng, 80)] * 3 + [words(rng, 50)]
    df = frame(spark, [" ".join(w) for w in texts] + [None, "few words"])
    got = {(r.measure, r.place): r for r in audit.examples(df, 4, k=2).collect()}
    assert set(got) == {(m, p) for m in ("cluster", "leak", "overlap") for p in (1, 2)}
    assert (got["cluster", 1].doc_id, got["cluster", 1].value, got["cluster", 1].grams) == (6, 3.0, 68) and got["cluster", 2].doc_id == 0
    assert (got["leak", 1].doc_id, got["leak", 1].value) == (0, 1.0) and (got["leak", 2].doc_id, got["leak", 2].value) == (1, 18 / 48)
    assert (got["overlap", 1].doc_id, got["overlap", 1].value, got["overlap", 1].grams) == (4, 48.0, 88) and got["overlap", 2].doc_id == 5
    assert got["leak", 1].snippet == " ".join(leaked)[:300]
    assert audit.examples(df.where("doc_id < 0"), 0).count() == 0


@pytest.mark.parametrize(("shard_tokens", "num_tokens"), [(30, None), (31, None), (33, None), (1000, None), (1000, 17), (1000, 3), (5, None), (0, None)])
def test_fixed_windows_look_one_token_ahead(spark, shard_tokens, num_tokens):
    texts = [list("abcdefg"), [], None, list("hi"), list("jklmnopqrstuvwxyzABCDEFGHIJ"), ["K"], list("LMN")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, tokens array<string>")
    data = [t for w in texts for t in w or []][:shard_tokens]
    count = min((len(data) if num_tokens is None else num_tokens) // 5, max(len(data) - 1, 0) // 5)
    got = {r.win: (r.x, r.y) for r in shards.fixed_windows(df, 5, shard_tokens, num_tokens).collect()}
    assert got == {i: (data[5 * i : 5 * i + 5], data[5 * i + 1 : 5 * i + 6]) for i in range(count)}
