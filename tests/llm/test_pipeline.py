"""run() against a brute-force version of its stages."""

import re
from collections import Counter, defaultdict
from itertools import combinations

from test_ops import WORD, raw

import corpus_pipeline
from erspark.llm import mixing, quality_rules, secret_scan


def shingles(t, width=5):
    w = WORD.findall(raw(t).lower())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset([()])


def groups_of(sets, similarity=0.8):
    """The least index that each set is linked to."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def survivors(rows):
    """The rows that the first two stages keep."""
    kept = [r for r in rows if len(WORD.findall(raw(r[1]))) >= 50 and 100 * quality_rules.text_stats(raw(r[1]))[4] <= 50 * len(WORD.findall(raw(r[1])))]
    groups = defaultdict(list)
    for r, g in zip(kept, groups_of([shingles(r[1]) for r in kept]), strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_run_keeps_what_brute_force_keeps(spark, docs, rows, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    # one label certifies nothing: the base rule alone decides
    want = survivors(rows)
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter({(r.doc_id, r.piece) for r in out}) == Counter((r.doc_id, r.piece) for r in out)
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r[0] for r in want)
    room = defaultdict(list)
    for r in out:
        room[r.sequence_id].append((r.offset, r.length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_one_by_one(spark, docs, rows, tmp_path):
    """Secrets go from the texts, the order of the mixture is that of the rows, and
    sequences are numbered by it."""
    from erspark.llm import common

    for stage in (corpus_pipeline.secrets, corpus_pipeline.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == docs.count()
    path = secret_scan.vocabulary_path()
    clean = corpus_pipeline.secrets(spark, docs, "").collect()
    assert not any(re.search("AKIA[A-Z0-9]{16}", r.text or "") or secret_scan.find_spans(raw(r.text), path) for r in clean if r.doc_id == 906)
    mixed = mixing.mix(docs.where("doc_id < 900")).collect()
    order = [r.doc_id for r in sorted(mixed, key=lambda r: r[-1].position)]
    written = common.materialize(corpus_pipeline.mix(spark, docs.where("doc_id < 900"), ""), "m")
    out = corpus_pipeline.pack(spark, written, "").collect()
    first = defaultdict(list)
    for r in out:
        first[r.sequence_id].append(order.index(r.doc_id))
    leads = [min(first[s]) for s in sorted(first)]
    assert leads == sorted(leads)


def test_empty_tables_and_clashing_columns(spark, docs, tmp_path):
    d = str(tmp_path)
    more = docs.selectExpr("*", "'a' as kept", "'b' as _mark", "1 as _place", "2 as t", "3 as fp", "4 as keys", "5 as _k_id", "6 as length")
    more.where("doc_id < -5").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name != "quality rules":
            out = stage(spark, more, d)
            assert out.columns == more.columns and out.where("kept <> 'a' or _mark <> 'b' or t <> 2").count() == 0


def test_similar_texts_meet_whatever_their_fingerprints(spark):
    """Pairs of similarity 0.8 beyond the radius of the trees, pairs whose least
    shingles others hold more seldom, and a shingle with many holders."""
    import random

    from erspark.llm import simhash

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    rows, far = [], 0
    while far < 4:
        w = rng.sample(vocab, 9)
        x, y = " ".join(w), " ".join(w[:8])
        if (simhash.fingerprint(x.encode(), 5) ^ simhash.fingerprint(y.encode(), 5)).bit_count() > simhash.WIDE:
            rows += [x, y]
            far += 1
    base = rng.sample(vocab, 60)
    rows += [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join(base + ["more", "words"])]
    # the least shingles of one side, each in another text that has little else in common
    h = simhash.shingle_hashes
    at = sorted(range(56), key=lambda i: int(next(h(" ".join(base[i : i + 5]).encode(), 5))[0]))[:16]
    rows += [" ".join(rng.sample(vocab, 30) + base[i : i + 5]) for i in at[:8]]
    rows += ["one line that all of them quote " + " ".join(rng.sample(vocab, k % 12)) for k in range(200)]
    rows = [(i, x) for i, x in enumerate(rows)]
    want = groups_of([shingles(x) for _, x in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == sorted(set(want))
    # holders of one shingle over many tasks
    before = simhash.HOLDERS
    simhash.HOLDERS = 8
    try:
        assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == sorted(set(want))
    finally:
        simhash.HOLDERS = before
