"""The pipeline's near-duplicate stage against brute force."""

import random

from quillstone.llm import near


def _edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def _rows():
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = rng.choices([f"w{j}" for j in range(4000)], k=rng.choice([6, 30, 120, 400]))
        rows += [" ".join(base)] + [" ".join(_edited(rng, base, min(len(base), n))) for n in (0, 1, 2, 4, 8)]
    rows += ["A  b c", "a b c", "a b", "", "  ", None, "tail " + rows[18]]
    # one crowd whose members differ from each other
    crowd = [f"c{j}" for j in range(300)]
    rows += [" ".join(_edited(rng, crowd, 2)) for _ in range(60)]
    order = list(enumerate(rows))
    rng.shuffle(order)
    return order


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute_force(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and (not either or both / either >= 0.8):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_components_equal_brute_force(spark):
    rows = _rows()
    want = _brute_force(rows)
    df = spark.createDataFrame(rows + [rows[0], (None, "a b c")], "doc_id bigint, text string")
    got = near.near_components(df).collect()
    assert len(got) == len(rows) + 1 and {r.doc_id: r.component_id for r in got} == want
    assert near.near_components(df.where("false")).count() == 0


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    import corpus_pipeline

    rows = _rows()
    want = _brute_force(rows)
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()}
    assert kept == {i for i, r in want.items() if i == r}


def test_texts_meet_through_fingerprint_groups(spark, sf_dir, monkeypatch):
    """Without any band, the texts whose fingerprints are near still meet, and are still decided by their shingles."""
    import corpus_pipeline

    base = [f"w{j}" for j in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (3, " ".join(f"v{j}" for j in range(400)))]
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id bigint, component_id bigint")
    monkeypatch.setattr(near, "BANDS", 0)
    assert {r.doc_id: r.component_id for r in near.near_components(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.component_id for r in near.near_components(df, groups=groups).collect()} == {1: 1, 2: 1, 3: 3}
    used = []
    find = corpus_pipeline.simhash.simhash_components
    monkeypatch.setattr(corpus_pipeline.simhash, "simhash_components", lambda d, **k: used.append(k) or find(d, **k))
    assert corpus_pipeline.near_dedup(spark, df, sf_dir).count() in (2, 3) and used == [{"width": near.WIDTH}]
