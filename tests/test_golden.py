"""Worked cases and brute force for the library."""

import random
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from erspark import sources, streaming
from erspark.functions import similarity as sim
from erspark.functions import text as tx
from erspark.operators import blocking, decode, evaluate, features, learn, prepare, ranking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,want", [("S.A.S. Dupont", "sas dupont"), ("O'Brien & Sons", "obrien and sons"), ("12e", "12"), ("15bis", "15 bis"), ("<NULL> x", "x"), ("", "")])
def test_base_clean(spark, raw, want):
    assert one(spark, raw, tx.base_clean) == want


def test_names(spark):
    df = spark.createDataFrame([("Avidelta DBA: Jain International Private Limited",)], "n string")
    after, before = tx.marker_split(F.col("n"))
    kept, forms = tx.strip_legal(tx.words(tx.base_clean(after)))
    assert tuple(df.select(tx.join(kept), tx.join(forms), tx.base_clean(before)).first()) == ("jain international", "ltd pvt", "avidelta")
    assert {one(spark, x, tx.skeleton) for x in ("agarwal", "aggarwal", "agrawal")} == {"agrvl"}
    assert one(spark, "mr dr", lambda c: tx.join(tx.strip_lead(tx.words(c), tx.HONORIFIC))) == "dr"
    assert one(spark, "", tx.country_key) == "unk" and one(spark, " US ", tx.country_key) == "us"
    assert one(spark, "Élan Straße ١٢ दिल्ली", tx.romanise).startswith("Elan Strasse 12 ")
    assert [one(spark, x, tx.is_native) for x in ("Élan 12°", "दिल्ली", "东")] == [0, 1, 1]


def test_numbers(spark):
    for raw, nums, house, postal in (("11900 54th Avenue", ["11900", "54"], "11900", []), ("#0406 Udyog Vihar", ["406"], "406", []), ("12 x 560001", ["12", "560001"], "12", ["560001"]), ("000", ["0"], "0", []), ("", [], "", [])):
        df = spark.createDataFrame([(raw,)], "a string").select(tx.numbers(F.col("a")).alias("n"))
        h, p = tx.house_postal(F.col("n"))
        assert tuple(df.select("n", h, p).first()) == (nums, house, postal)
    close = spark.createDataFrame([("12", "12"), ("1490", "490"), ("204", "205"), ("10", "999")], "a string, b string")
    assert [r[0] for r in close.select(sim.number_close(F.col("a"), F.col("b"))).collect()] == [1.0, 0.8, 0.6, 0.0]
    houses = spark.createDataFrame([("204", "205"), ("204", "204"), ("", "5")], "a string, b string")
    assert [r[0] for r in houses.select(sim.house_one_digit(F.col("a"), F.col("b"))).collect()] == [1, 0, -1]
    tri = spark.createDataFrame([(["1"], ["1", "2"]), (["1"], ["2"]), ([], ["2"])], "a array<string>, b array<string>")
    assert [r[0] for r in tri.select(sim.tri_state(F.col("a"), F.col("b"))).collect()] == [1, -1, 0]


def test_ratios():
    assert round(sim.jaro_winkler("martha", "marhta"), 6) == 0.961111 and sim.indel("", "") == 100
    slow = lambda a, b: max([0, *(len(s) for s in {"".join(c for c, k in zip(a, m) if k) for m in product((0, 1), repeat=len(a))} if all(c in it for it in [iter(b)] for c in s))])
    for a, b in (("abcde", "badce"), ("aab", "abab"), ("xyz", "abc"), ("kitten", "sitting")):
        assert sim.lcs(a, b) == slow(a, b)
        assert sim.indel(a, b) == sim.indel(b, a)
    assert sim.set_ratio("a b c", "c b a d") == 100 and sim.set_ratio("", "a") == 0 and sim.sorted_ratio("b a", "a b") == 100
    assert sim.partial("abc", "xxabcxx") == 100


@pytest.mark.parametrize("p,outside,want", [([0.9, 0.5, 0.3], 0, [0.035, 0.786429, 0.707172, 0.607527]), ([0.9, 0.5, 0.3], 0.1, [0.0315, 0.774616, 0.700659, 0.603467]), ([0.3, 0.2], 0, [0.56, 0.29, 0.271111]), ([0.95, 0.9, 0.85, 0.1], 0, [0.000675, 0.698309, 0.852769, 0.90728, 0.740303]), ([0.5], 0, [0.5, 0.5])])
def test_expected_f(p, outside, want):
    assert np.allclose(decode.expected_f(p, outside), want, atol=1e-6)


def test_expected_f_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        p = np.sort(rng.random(rng.integers(1, 6)))[::-1]
        for k, got in enumerate(decode.expected_f(p.tolist())):
            total = 0.0
            for y in product((0, 1), repeat=len(p)):
                w = np.prod([q if t else 1 - q for q, t in zip(p, y)])
                tp = sum(y[:k])
                total += w * (1.0 if not k and not sum(y) else 0.0 if not tp else 1.25 * tp / (0.25 * sum(y) + k))
            assert abs(total - got) < 1e-9


def test_f_beta(spark):
    cases = [("abc", "ac", 0.714286), ("ax", "a", 0.555556), ("a", "ab", 0.833333), ("abc", "abcd", 0.9375), ("", "", 1.0), ("a", "", 0.0), ("", "a", 0.0)]
    df = spark.createDataFrame([(list(a), list(b)) for a, b, _ in cases], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(evaluate.f_beta(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_owner_modes(spark):
    df = spark.createDataFrame([("A", "r", 0.8, 0.5), ("B", "r", 0.8, 0.9)], "s1_id string, cand_id string, p double, rk double")
    assert [r.s1_id for r in ranking.one_owner(df).collect()] == ["B"]
    assert ranking.one_owner(df, tie=None).count() == 2


def test_decode_returns_every_owner(spark):
    pairs = spark.createDataFrame([("A", "x", 0.9, 1.0), ("A", "y", 0.1, 1.0), ("B", "x", 0.5, 1.0)], "s1_id string, cand_id string, p double, rk double")
    s1 = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    assert {r.s1_id: r.ids for r in decode.decode(pairs, s1).collect()} == {"A": ["x"], "B": [], "C": []}


def test_cap_equals_the_disjunction(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), float(rng.integers(0, 9))) for a in range(12) for b in rng.choice(30, 8, False)]
    df = spark.createDataFrame(rows, "s1_id long, cand_id long, score double")
    ranked = ranking.group_rank(ranking.group_rank(df, "s1_id", "score", "cand_id", "x"), "cand_id", "score", "s1_id", "y")
    want = {tuple(r) for r in ranked.where("x_rank <= 2 or y_rank <= 1").select("s1_id", "cand_id", "score").collect()}
    assert {tuple(r) for r in blocking.either_top(df, "score", 2, 1).collect()} == want


def test_budget_bounds_the_join(spark):
    df = spark.createDataFrame([("x", f"t{i}", i, i) for i in range(1, 60)], "ctry string, tok string, df_a long, df_b long").withColumn("idf", F.lit(1.0)).withColumn("cost", F.col("df_a") * F.col("df_b"))
    kept = [r.cost for r in blocking.affordable(df, 5000).collect()]
    assert 0 < sum(kept) <= 5000 and max(kept) <= 24**2


def test_tsv_keeps_text(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t "Q\t\tNA\nS1-2\tNone\ta, b\t\n', encoding="utf-8")
    got = [tuple(r) for r in sources.read_tsv(spark, str(p)).collect()]
    assert got == [("S1-1", '"Q', "", "NA"), ("S1-2", "None", "a, b", "")]
    lists = spark.createDataFrame([("k", " a, b,,a "), ("z", "")], "k string, ids string")
    assert {tuple(r) for r in sources.pairs_of(lists, "k", "ids").collect()} == {("k", "a"), ("k", "b")}


def test_checker_rules(spark):
    lines = spark.createDataFrame([(x,) for x in ("S1-1\tS2-1,S2-1", "S1-1\t", "no tab", "S1-9\tS1-1,X-1,S3-404")], "value string")
    owners = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    found = {(r.rule, r.offender) for r in evaluate.check_lists(lines, owners, known).collect()}
    assert found == {("malformed", "no tab"), ("duplicate row", "S1-1"), ("missing", "S1-2"), ("extra", "S1-9"), ("repeated id", "S2-1"), ("reference id", "S1-1"), ("unknown prefix", "X-1"), ("unknown id", "S3-404")}


def test_folds_hold_groups_together(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k")).select("k", learn.fold(F.col("k")).alias("f")).distinct()
    assert df.count() == 50
    pops = {r[0]: r[1] for r in spark.range(20000).groupBy(learn.population(F.col("id"))).count().collect()}
    assert abs(pops["ranker"] / 20000 - 0.3) < 0.02 and abs(pops["audit"] / 20000 - 0.1) < 0.02


def test_house_features(spark):
    rows = [("12", ["12", "7"], "12"), ("123", ["13"], ""), ("5", [], "5")]
    df = spark.createDataFrame(rows, "h string, ns array<string>, t string")
    got = df.select(*[v.alias(k) for k, v in sim.house_features(F.col("h"), F.array("h"), F.col("ns"), F.col("t")).items()]).collect()
    assert tuple(got[0])[:2] == (1.0, 1) and got[0].house_first == 1 and got[0].house_diff == 0
    assert (got[1].house_drop, got[1].house_first, got[1].house_eq) == (1, -1, 0)
    assert set(tuple(got[2])) == {-1.0, -1}


@pytest.mark.parametrize("raw,want", [("012 bis, rue de la Paix", "12|paix"), ("7 av. des Lilas", "7|lilas"), ("Main Street 4", None), (None, None)])
def test_street_key(spark, raw, want):
    assert one(spark, raw, tx.street_key) == want


def test_auc_and_log_loss(spark):
    r = np.random.default_rng(3)
    p, y = np.round(r.random(300), 2), r.integers(0, 2, 300)
    got = learn.auc_log_loss(spark.createDataFrame(list(zip(p.tolist(), y.tolist(), strict=True)), "p double, y int")).first()
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    q = np.clip(p, 1e-15, 1 - 1e-15)
    assert abs(got.auc - np.mean(pairs)) < 1e-9
    assert abs(got.log_loss + np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))) < 1e-9


def test_second_stage_context_counts_outsiders(spark):
    p = spark.createDataFrame([(1, 10, 0.9), (2, 10, 0.6), (1, 11, 0.2)], "s1_id long, cand_id long, p double")
    x = spark.createDataFrame([(10, 0.7)], "cand_id long, p double")
    got = {(r.s1_id, r.cand_id): (r.p1_rank_c, r.n_conf_c, r.p1_rank_s1) for r in ranking.second_stage_context(p, x).collect()}
    assert got == {(1, 10): (1, 2, 1), (2, 10): (3, 2, 1), (1, 11): (1, 0, 2)}


def test_checked_write_refuses(spark, tmp_path):
    owners = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    whole = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "s1_id string, ids string")
    assert evaluate.checked_write(whole, str(tmp_path / "a"), owners, known).count() == 2
    with pytest.raises(ValueError, match="missing"):
        evaluate.checked_write(whole.limit(1), str(tmp_path / "b"), owners, known)


def test_admin_vocabulary(spark):
    ours = spark.createDataFrame([("us", ["main st", "texas"])] * 3, "ctry string, comps array<string>")
    theirs = spark.createDataFrame([("us", ["main st", "tx"])] * 4 + [("us", ["main st", "99"])] * 4, "ctry string, comps array<string>")
    got = {tuple(r) for r in blocking.admin_vocabulary(theirs, ours, 3, 4).collect()}
    assert got == {("us", "texas", "state"), ("us", "tx", "noise"), ("us", "tx", "alias")}


def test_rank_average_equals_average_ranks(spark):
    rng = np.random.default_rng(4)
    df = pd.DataFrame({"i": np.arange(3000), "a": rng.integers(0, 40, 3000), "b": np.round(rng.normal(size=3000), 3)})
    df.loc[0, "b"], df.loc[1, "b"] = np.inf, -np.inf
    want = (df.a.rank() + df.b.rank()) / 2
    got = ranking.rank_average(spark.createDataFrame(df), "a", "b", "m").toPandas().set_index("i").m.sort_index()
    assert np.allclose(got, want)
    some = ranking.rank_average(spark.createDataFrame([(1, 2.0), (None, 3.0), (4, None)], "a int, b double"), "a", "b", "m").collect()
    assert [(r.a, r.m) for r in some] == [(1, 1.0)]
    assert ranking.rank_average(spark.createDataFrame([], "a int, b double"), "a", "b", "m").count() == 0


def test_prepared_record(spark):
    rows = [
        ("S1-1", "Avidelta DBA: Jain International Private Limited", "#0406 Udyog Vihar, Near Park, Haryana 122016", "IN"), ("S1-2", None, None, None), ("S1-3", "www.foo-bar.com", "11900 54th Avenue, Seattle", ""),
        ("S1-4", "L.L.C. Le Petit Café SARL", "P O Box 12, n/a, 5 allee des Roses, 31000", "Fr"), ("S1-5", "The", ",,,", "x"), ("S1-6", "a/k/a", "null", "x"),
    ]
    made = {r.entity_id: r for r in prepare.prepare(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")).collect()}
    r = made["S1-1"]
    assert (r.name_n, r.legal, r.name_alt, r.name_acr, r.name_sk) == ("jain international", ["ltd", "pvt"], "avidelta", "ji", "jn intrntnl")
    assert (r.house, r.postal, r.landmark, r.nums, r.ctry) == ("406", ["122016"], "nr park", ["122016", "406"], "in")
    r = made["S1-2"]
    assert (r.ctry, r.name_n, r.addr, r.nums, r.native) == ("unk", "", "", [], 0)
    assert (made["S1-3"].name_n, made["S1-3"].web, made["S1-3"].addr) == ("foo bar", "foo-bar", "11900 54 ave seattle")
    r = made["S1-4"]
    assert (r.name_n, r.legal, r.addr, r.house, r.postal) == ("petit cafe", ["llc", "sarl"], "5 all roses 31000", "5", ["31000"])
    assert made["S1-5"].name_n == "the" and made["S1-5"].addr == "" and made["S1-6"].name_n == "k"


def test_patterns(spark):
    for raw, want in (("https://www.acme-co.in/x", "acme-co"), ("see www.foo.org", "foo"), ("mail.me", ""), ("x.com.y", "x")):
        assert one(spark, raw, tx.site_stem) == want
    for raw, want in (("Foo d / b / a: Bar", ("Bar", "Foo")), ("DBA Bar", ("DBA Bar", "")), ("Old formerly known as New", ("New", "Old")), ("data base", ("data base", "")), ("t/a Bar", ("t/a Bar", ""))):
        df = spark.createDataFrame([(raw,)], "n string")
        assert tuple(df.select(*tx.marker_split(F.col("n"))).first()) == want
    assert one(spark, "N° 15 n ° 3 Batº", tx.drop_number_signs).split() == ["15", "3", "Bat"]
    assert one(spark, "12 main st, post box 9, pmb 3 , boxer 4", tx.components) == ["12 main st", "boxer 4"]
    assert one(spark, "flat no 12b , shop 7 , suiteroom 9 , unit 7", tx.units) == ["12b", "7", "room"]
    assert one(spark, "5 rd en face de gare", tx.landmark) == "en face de gare"


def test_pair_features(spark, tmp_path):
    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    schema = "entity_id string, business_name string, business_address string, country string"
    a = prepare.prepare(spark.createDataFrame([("S1-1", "Agarwal Foods Ltd", "204 MG Road, Pune 411001", "in"), ("S1-2", "Blue Sky", "10 Main Street", "in")], schema))
    a = stored(a, "a")
    b = prepare.prepare(spark.createDataFrame([("S2-1", "Aggarwal Foods", "205 M G Rd, Pune", "in"), ("S3-1", "Sky Blue DBA: Blue Sky Inc", "", "in"), ("S2-9", "दिल्ली", "10 Main", "in")], schema))
    b = stored(b, "b")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9, 0.9), ("S1-2", "S3-1", 0.5, 0.4), ("S1-2", "S2-9", 0.1, 0.2), ("S1-1", "S3-1", 0.1, 0.1)], "s1_id string, cand_id string, v_word double, rk double")
    out = {(r.s1_id, r.cand_id): r for r in features.density(features.pair_features(pairs, a, b), a, b).collect()}
    assert len(out) == 4 and len(next(iter(out.values())).asDict()) >= 71
    r = out["S1-1", "S2-1"]
    assert (r.n_sk_ratio, r.house_close, r.house_eq, r.house_sub1, r.ts_postal, r.src3, r.ts_legal) == (100.0, 0.6, 0, 1, 0, 0, 0)
    assert (r.num_cover, r.num_exact, r.num_extra) == (0.3, 0.0, 0) and r.rk_rank_s1 == 1 and r.rk_gap_s1 == 0 and r.n_cands_s1 == 2
    r = out["S1-2", "S3-1"]
    assert (r.n_tset, r.n_idfj, r.has_alt, r.r_addr_empty, r.num_cover, r.house_first, r.src3, r.r_known_frac) == (100.0, 1.0, 1, 1, -1.0, -1, 1, 1.0)
    assert out["S1-2", "S2-9"].r_native == 1 and out["S1-2", "S2-9"].dn_c_street == 0.0 and out["S1-2", "S3-1"].dn_c_street == -1
    with pytest.raises(Exception, match="unknown id"):
        features.pair_features(spark.createDataFrame([("S1-1", "S2-404", 0.1, 0.1)], pairs.schema), a, b).collect()


def test_file_checks(spark, tmp_path):
    owners, known = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string"), spark.createDataFrame([("S2-1",)], "id string")
    header = ("source1_entity_id", "matched_entity_ids")

    def rules(body: bytes, **kw):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.tsv"
        path.write_bytes(body)
        return sorted((r.rule, r.offender) for r in evaluate.check_file(spark, str(path), header, owners, known, **kw).collect())

    head = b"Source1_entity_id\t matched_entity_ids\n"
    assert rules(head + b"S1-1\tS2-1\nS1-2\t\n\n") == []
    assert [r for r, _ in rules(b"")] == ["empty file"] and [r for r, _ in rules(b"source1_entity_id,matched_entity_ids\n")] == ["comma-separated"]
    assert [r for r, _ in rules(b"a\tb\n")] == ["header"] and [r for r, _ in rules(head + b"S1-1\t\xff\n")] == ["not utf-8"]
    assert rules(head + b"S1-1\tS2-1,S2-1\nS1-1\tS2-7,S1-2,X\nno tab\nS1-9\t\n") == [
        ("duplicate row", "S1-1"), ("extra", "S1-9"), ("malformed", "no tab"), ("missing", "S1-2"), ("reference id", "S1-2"), ("repeated id", "S2-1"), ("unknown id", "S2-7"), ("unknown prefix", "X")]
    listed = spark.createDataFrame([("S1-1", "S2-9")], "s1_id string, id string")
    assert rules(head + b"S1-1\tS2-1\nS1-2\t\n", candidates=listed) == [("not a candidate", "S2-1")]
    lists = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-2", ["S2-1"])], "s1_id string, ids array<string>")
    with pytest.raises(ValueError, match="two owners"):
        evaluate.write_and_check(str(tmp_path / "w"), lists, lists, owners, known)
    report = evaluate.write_and_check(str(tmp_path / "v"), lists.where("s1_id = 'S1-1'"), lists, owners, known).collect()
    assert sorted((r.file, r.n_rows, r.n_ids, r.n_empty) for r in report) == [("candidate_pairs", 2, 2, 0), ("matching_results", 2, 1, 1)]
    assert sorted(r.id for r in sources.first_column_ids(spark, str(tmp_path / "v/matching_results")).collect()) == ["S1-1", "S1-2"]


def test_header_of_many_parts(spark, tmp_path):
    """The header's part is not the largest, so scans don't begin with it."""
    owners = spark.range(4000).select(F.concat(F.lit("S1-"), "id").alias("s1_id"))
    lists = owners.select("s1_id", F.array(F.regexp_replace("s1_id", "S1", "S2")).alias("ids"))
    known = lists.select(F.explode("ids").alias("id"))
    off = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in zip(off, ("false", "1", "20000"), strict=True):
            spark.conf.set(k, v)
        report = evaluate.write_and_check(str(tmp_path / "w"), lists, lists, owners, known).collect()
        assert {(r.n_rows, r.n_ids, r.n_empty) for r in report} == {(4000, 4000, 0)}
        (tmp_path / "odd").mkdir()
        for k, body in enumerate(("", "h\n", "a\nb\nc\n", "d\n")):
            (tmp_path / "odd" / f"part-{k}").write_text(body)
        lines = sources.text_lines(spark, str(tmp_path / "odd")).collect()
        assert [r.value for r in lines if r.line == 0] == ["h"] and sorted(r.value for r in lines if r.line > 0) == ["a", "b", "c", "d"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_denser_frame_and_populations(spark):
    pairs = spark.createDataFrame([(s, c, "x", c >= 500, float((s * 7 + c * 3) % 11) / 11, 0.0, s % 2) for s in range(30) for c in range(s * 20, s * 20 + 25)], "s1_id long, cand_id long, ctry string, decoy boolean, rk double, v_key double, y int")
    out = learn.denser(pairs, spark.createDataFrame([("x", 1.0)], "ctry string, q double"), features.context, 20, 1)
    rows = out.collect()
    assert all(r.base_id == (-r.cand_id - 1 if r.is_clone else r.cand_id) for r in rows) and any(r.is_clone for r in rows)
    size, best = {}, {}
    for r in rows:
        size[r.s1_id] = size.get(r.s1_id, 0) + 1
        best[r.cand_id] = max(best.get(r.cand_id, 0), r.rk)
    assert all(r.n_cands_s1 == size[r.s1_id] and abs(r.rk_gap_c - (best[r.cand_id] - r.rk)) < 1e-12 for r in rows)
    assert learn.denser(pairs, spark.createDataFrame([], "ctry string, q double"), features.context).where("is_clone").count() == 0
    pops = learn.populations(spark.range(100).withColumnRenamed("id", "s1_id"), spark.range(30).withColumnRenamed("id", "s1_id"), 10).groupBy("population").count()
    n = {r[0]: r[1] for r in pops.collect()}
    assert n["ranker"] == 30 and n["audit"] == 10 and sum(n.values()) == 100


def test_stream_matches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "cand_id long, name string").write.parquet(src)
    ref = spark.createDataFrame([(10, "a")], "s1_id long, name string")
    stream = spark.readStream.schema("cand_id long, name string").parquet(src)
    streaming.match_stream(stream, ref, ["name"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((r.s1_id, r.cand_id) for r in spark.read.parquet(out).collect()) == [(10, 1), (10, 3)]


def test_partial_ratio_of_long_strings_is_that_of_all_windows():
    import random
    import time

    rng = random.Random(7)
    pick = lambda n: "".join(rng.choice("abcd ef") for _ in range(n))

    def windows(a, b):
        a, b = sorted((a, b), key=len)
        n = len(a)
        return max(sim.indel(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)) if b[max(0, i) : i + n])

    for _ in range(300):
        a, b = pick(rng.randint(1, 20)), pick(rng.randint(1, 40))
        assert sim.partial(a, b) == windows(a, b)
        c = pick(6) + a[: len(a) // 2] + "z" + a[len(a) // 2 :] + b
        assert sim.partial(a, c) == windows(a, c)
    a, b = pick(4000), pick(4400)
    began = time.process_time()
    sim.partial(a, b)
    # all windows: over ten times as long
    assert time.process_time() - began < 3


def test_written_views_plan_each_step_alone_and_keep_ties(spark):
    names = ["alpha beta gamma", "beta gamma delta", "alpha delta", "gamma alpha beta", "epsilon"]
    rows = [(i, "de", names[i % 5], "") for i in range(200)]
    a = spark.createDataFrame(rows[:60], "s1_id long, ctry string, name string, addr string")
    b = spark.createDataFrame([(1000 + i, *r[1:]) for i, r in enumerate(rows)], "cand_id long, ctry string, name string, addr string")
    tokens = {"words": tx.words, "grams": tx.char_grams}
    joins = []

    def keep(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return spark.createDataFrame(df.collect(), df.schema)

    out = blocking.block(a, b, tokens, keep=keep)
    plain = blocking.block(a, b, tokens)
    key = lambda df: sorted((r.s1_id, r.cand_id) for r in df.collect())
    assert key(out) == key(plain)
    whole = plain._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert max(joins) * 3 < whole and len(joins) == 15


def test_ratios_skip_what_both_share():
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    plain = lambda a, b: 200.0 * sim.lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
    for _ in range(2000):
        a, b = (" ".join(rng.choices(pool, k=rng.randrange(7))) for _ in range(2))
        assert sim.kept(a, b) == sim.lcs(a, b) and sim.indel(a, b) == plain(a, b)
        x, y = set(a.split()), set(b.split())
        if x and y and not (x & y and (x <= y or y <= x)):
            both = " ".join(sorted(x & y))
            left, right = ((both + " " + " ".join(sorted(z))).strip() for z in (x - y, y - x))
            assert sim.set_ratio(a, b) == max(plain(left, right), *((plain(both, left), plain(both, right)) if both else (0.0,)))
