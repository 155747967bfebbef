"""Survivorship, top N, names and matching against brute force and on edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rinkspark.llm import matching as m
from rinkspark.llm import names as n
from rinkspark.llm import queries as q
from rinkspark.llm import survivorship as s
from rinkspark.llm import topn

from ..compare import same

SPEC = s.Survivorship(("k",), "id", "at", ("a", "b"), "trust", "src")
LINES = "id bigint, k string, a int, b double, trust int, src string, at timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute_survivors(rows):
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    out = set()
    for g in groups.values():
        for name, i in (("a", 2), ("b", 3)):
            vals = [None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for r in g]
            have = [r for r, v in zip(g, vals) if v is not None]
            if len(g) > 1 and have and (len(set(vals)) > 1):
                best = max(have, key=lambda r: (r[4] if r[4] is not None else -1, r[6] or dt.datetime.min, -r[0]))
                out.add(("t", min(r[0] for r in g), name, best[0]))
    return out


def test_survivorship_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None] + [f"g{j}" for j in range(60)]), rng.choice([None, 1, 2]), rng.choice([None, math.nan, 0.5, 1.5]), rng.choice([None, 1, 1, 2]), rng.choice(["p", "q", None]), rng.choice([None, day(1), day(1), day(2)])) for i in range(1, 400)]
    df = spark.createDataFrame(rows, LINES).withColumns({"fields": F.lit(1), "group_id": F.lit(2), "sources": F.lit("z")})
    survived = s.survive(df, SPEC)
    got = {tuple(r) for r in s.conflict_cases(survived, SPEC, "t").collect()}
    assert got == brute_survivors(rows)
    golden = s.golden_records(survived, SPEC)
    assert golden.count() == len({r[1] for r in rows} - {None})
    assert s.survive(df.limit(0), SPEC).count() == 0


def test_survivorship_repeated_rows(spark):
    rows = [(1, "x", 1, None, 5, "p", day(1))] * 3 + [(2, "x", 2, None, 5, "p", day(1))]
    got = s.conflict_cases(s.survive(spark.createDataFrame(rows, LINES), SPEC), SPEC, "t").collect()
    assert [tuple(r) for r in got] == [("t", 1, "a", 1)]


def test_clubs(spark):
    aliases = spark.createDataFrame([("L", "ABC", "Ábc Town-66"), ("M", "ABC", "Other")], "league string, code string, team string")
    df = spark.createDataFrame([(1, "L", "abc"), (2, "L", "ABC  TOWN 66 "), (3, "M", "abc"), (4, "N", "abc"), (5, None, None), (6, "L", "--")], "id int, league string, team string")
    got = {r.id: r.club for r in s.with_club(df, aliases).collect()}
    assert got == {1: "abctown66", 2: "abctown66", 3: "other", 4: "abc", 5: None, 6: None}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_queries_equal_their_sql(spark, small, name):
    same(spark, small, q.QUERIES[name], q.SQL[name])


def brute_top(rows, k):
    groups = {}
    for g, v, t in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append((-v, t))
    return sorted((repr(g), i, -v, t) for g, items in groups.items() for i, (v, t) in enumerate(sorted(items)[:k], 1))


def test_top_n_brute_force(spark):
    rng = random.Random(4)
    scores = [None, math.nan, math.inf, -math.inf, 0.0, 1.0, 1.0, 5.5] + [rng.gauss(0, 1) for _ in range(40)]
    rows = [(rng.choice(["a"] * 20 + ["b", "c", None, "same"]), rng.choice(scores), i) for i in range(3000)]
    rows = [(g, 1.0 if g == "same" else v, t) for g, v, t in rows]
    rows += [("outlier", 1e9 if i == 0 else rng.random(), i) for i in range(500)]  # equal widths alone keep all of it
    df = spark.createDataFrame(rows, "g string, v double, t int").withColumn("rank", F.lit("old"))
    for k in (1, 3, 10):
        got = sorted((repr(r.g), r["rank"], r.v, r.t) for r in topn.top_n(df, ["g"], "v", ["t"], k).collect())
        assert got == brute_top(rows, k)
    assert topn.top_n(df.limit(0), ["g"], "v", ["t"], 3).count() == 0


def test_thresholds_of_a_group_with_an_outlier(spark):
    rows = [("a", 1e9 if i == 0 else float(i), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "__g0 string, v double, i int")
    least = {r["__g0"]: r["__least"] for r in topn._thresholds(df, ["__g0"], F.col("v"), 3).collect()}
    assert 3 <= sum(v >= least["a"] for _, v, _ in rows) <= 3 * topn.COARSE + 3


def test_latest_takes_last_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x", day(1)), (2, "x", day(2)), (3, "x", day(2)), (4, "y", None)], "id int, k string, at timestamp")
    assert {(r.k, r.id) for r in topn.latest(df, ["k"], "at", "id").collect()} == {("x", 3), ("y", 4)}


def test_trie_finds_what_brute_force_finds():
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    trie = n.build_trie(words)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(100):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
        for e in (0, 1, 2):
            assert sorted(n.neighbours(trie, w, e)) == sorted(x for x in words if lev(w, x) <= e)


@pytest.mark.parametrize("names, queries", [(20_000, 20_000), (3, 5), (0, 1)])
def test_trie_join_shards(spark, monkeypatch, names, queries):
    monkeypatch.setattr(n, "SHARD_NAMES", names)
    monkeypatch.setattr(n, "SHARD_QUERIES", queries)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 6)))
    left = [("k", word()) for _ in range(60)] + [("z", "abc"), (None, "abc"), ("k", None)]
    right = [("k", word()) for _ in range(90)] + [("y", "abc")]
    got = {(r.q, r.w) for r in n.trie_join(spark.createDataFrame(left, "g string, q string"), spark.createDataFrame(right, "g string, w string"), ["g"], "q", "w").collect()}
    trie = n.build_trie([w for k, w in right if k == "k"])
    assert got == {(w, x) for k, w in left if k == "k" and w for x in n.neighbours(trie, w, 2)}


def test_short_names_and_initials_with_an_error(spark):
    known = spark.createDataFrame([("Anton Kim",), ("Anton Hall",), ("Li Gramatov",), ("Erik Volmasveneau",)], "name string")
    spelled = ["Anton Kin", "Anton Hxll", "Lo Gramatov", "E. Volmasvenneaw", "E. Volmasxenaau"]
    got = {r.spelling: r.last for r in n.link_spellings(spark.createDataFrame([(x,) for x in spelled], "name string"), known).collect()}
    assert got == {"Anton Kin": "kim", "Anton Hxll": "hal", "Lo Gramatov": "gramatov", "E. Volmasvenneaw": n.sound("Volmasveneau")}


def test_readings():
    assert n.sound("Feborinccis") == n.sound("Feborinckis") and n.sound("Vedotiroff") == n.sound("Wedotirov") and n.sound("Väinö") == n.sound("Vaeinö")
    assert ("bradlei", "davarasen") in n.read_spelling("Брадлеы Даварассен")[0]
    assert ("anton", "dogabesek") in n.read_spelling('Dogabesek, Anton "Toha"')[0]
    assert ("artem", "bemiliosalo") in n.read_spelling("ArtyomBemilyossalo")[0] or n.read_spelling("ArtyomBemilyossalo")[0]
    assert n.read_spelling("J. Kolzormelund")[0] == [("i", n.sound("Kolzormelund"))]
    assert n.read_spelling("")[0] == [] and n.read_spelling("12 34")[0] == []
    assert n.osa("abcd", "abdc") == 1 and n.osa("", "abc") == 3


def test_link_spellings(spark):
    known = spark.createDataFrame([("Anton Dogabesek",), ("Erik Metitorzak",), ("Väinö Grabazelis",), ("Erik Volmasveneau",), (None,)], "name string")
    spelled = ["Anton Dogabesek", "DOGABESEK Anton", "Antn Dogabesec", "Erik B. Metitorzkk", "E. Volmasveneau", "Wäinö Grabnzelis", "Zoltan Nobody", None, "", "x" * 50_000, 'Anton "Toha" Dogabesek', "Toha Dogabesek"]
    df = spark.createDataFrame([(x,) for x in spelled + spelled], "name string").withColumns({"first": F.lit(1), "last": F.lit(2)})
    got = {r.spelling: r.last for r in n.link_spellings(df, known).collect()}
    assert set(got) == {"DOGABESEK Anton", "Antn Dogabesec", "Erik B. Metitorzkk", "E. Volmasveneau", "Wäinö Grabnzelis", 'Anton "Toha" Dogabesek', "Toha Dogabesek"}
    assert n.link_spellings(df.limit(0), known).count() == 0
    assert n.link_spellings(df, known.limit(0)).count() == 0


def test_registered_first_name_may_stand_for_a_near_one(spark):
    names = spark.createDataFrame([("Daniel Kolotressen",), ("Danil Berger",), ("Egor Levennedahl",), ("Igor Straub",), ("Danil Kolomensen",)], "name string")
    rows = ["Danil Colotressen", "Igor Levenedahl", "Danil Bergar", "Daniel Berger", "Danil Kolomenson"]
    got = {r.spelling: (r["first"], r["last"]) for r in n.link_spellings(spark.createDataFrame([(r,) for r in rows], "name string"), names).collect()}
    want = {"Danil Colotressen": "Daniel Kolotressen", "Igor Levenedahl": "Egor Levennedahl", "Danil Bergar": "Danil Berger", "Daniel Berger": "Danil Berger", "Danil Kolomenson": "Danil Kolomensen"}
    assert got == {k: n.read_spelling(v)[0][0] for k, v in want.items()}


def bm25_brute(queries, records, weights):
    counts = {}
    for _, ts in records:
        for t in ts:
            counts[t] = counts.get(t, 0) + 1
    average = sum(len(t) for _, t in records) / len(records)
    value = {t: math.log(1 + (len(records) - d + 0.5) / (d + 0.5)) * weights[t.split(":")[0]] for t, d in counts.items()}
    out = {}
    for qid, qt in queries:
        possible = sum(value.get(t, 0) for t in qt)
        shares = sorted(((-sum(value[t] for t in set(qt) & set(rt)) * (m.K1 + 1) / (1 + m.K1 * (1 - m.B + m.B * len(rt) / average)) / possible, rid) for rid, rt in records), key=lambda x: (round(x[0], 9), x[1])) if possible else []
        out |= {(qid, place): (rid, -v) for place, (v, rid) in enumerate(shares[: m.TOP], 1) if -v >= m.FLOOR}
    return out


@pytest.mark.parametrize("shard, block, seeds", [(25_000, 5_000, 16), (17, 9, 2)])
def test_bm25_equals_brute_force(spark, monkeypatch, shard, block, seeds):
    for name, v in (("SHARD_RECORDS", shard), ("BLOCK_QUERIES", block), ("SEEDS", seeds)):
        monkeypatch.setattr(m, name, v)
    rng = random.Random(7)
    tok = lambda: sorted({"name:" + rng.choice("abcdef"), "x:" + rng.choice("pqrs"), "x:" + rng.choice("pqrs"), "hot:1"} - ({"hot:1"} if rng.random() < 0.2 else set()))
    records, queries = [(f"r{i:02}", tok()) for i in range(80)] + [("null", [])], [(f"q{i}", tok()) for i in range(40)] + [("none", []), ("new", ["name:zzz"])]
    kinds = m.Kinds({"n": {"name": 1.0}, "rest": {"x": 0.5, "hot": 0.3}})
    schema = lambda k: f"{k} string, tokens array<string>"
    left, right = spark.createDataFrame(queries + [("no", None)], schema("qid")), spark.createDataFrame(records, schema("rid"))
    rows = m.bm25_top(left, right, kinds).collect()
    want = bm25_brute(queries, records, {"name": 1.0, "x": 0.5, "hot": 0.3})
    assert {(r.qid, r.place) for r in rows} == want.keys()
    assert all(r.rid == want[r.qid, r.place][0] and abs(r.share - want[r.qid, r.place][1]) < 1e-9 for r in rows)
    assert m.bm25_top(left, right.limit(0), kinds).count() == 0 and m.bm25_top(left.limit(0), right, kinds).count() == 0


def shuffled(spark):
    """Bytes written to shuffles by the session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_bm25_shuffles_as_much_for_any_number_of_shards(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"{i}", [f"name:{rng.randrange(400)}", *(f"x:{rng.randrange(90)}" for _ in range(20))]) for i in range(800)]
    left, right = (spark.createDataFrame(rows, f"{k} string, tokens array<string>").repartition(2) for k in ("qid", "rid"))
    kinds, wrote, found = m.Kinds({"n": {"name": 1.0}, "rest": {"x": 0.5}}), [], []
    for size in (1_000, 50):
        monkeypatch.setattr(m, "SHARD_RECORDS", size)
        monkeypatch.setattr(m, "BLOCK_QUERIES", size)
        before = shuffled(spark)
        found.append({(r.qid, r.place, r.rid, round(r.share, 9)) for r in m.bm25_top(left, right, kinds).collect()})
        wrote.append(shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) >= 800
    assert wrote[1] < 1.5 * wrote[0], wrote


def test_confidence_is_calibrated_without_labels(spark):
    rng = random.Random(2)
    person = lambda: [f"a:{rng.randrange(300)}", f"b:{rng.randrange(300)}", f"c:{rng.randrange(40)}", f"d:{rng.randrange(12)}"]
    records = [(f"r{i}", person()) for i in range(600)]
    copies = [(f"q{i}", [t if rng.random() < 0.9 else person()[k] for k, t in enumerate(records[i][1])]) for i in range(300)]
    strangers = [(f"s{i}", person()) for i in range(100)]
    kinds = m.Kinds({k: {k: 1.0} for k in "abcd"})
    schema = lambda k: f"{k} string, tokens array<string>"
    pairs = m.features(m.bm25_top(spark.createDataFrame(copies + strangers, schema("qid")), spark.createDataFrame(records, schema("rid")), kinds)).cache()
    rows = m.with_confidence(m.nearest(pairs), m.calibrate(pairs)).filter("match_score >= 0.5").collect()
    right = sum(r.qid[1:] == r.rid[1:] and r.qid[0] == "q" for r in rows)
    assert right >= 0.9 * len(rows) and right >= 200


def test_matches_have_scores(spark, small):
    rows = q.p6_scores(spark, small).collect()
    assert len({r.source_player_id for r in rows}) == len(rows) and all(0 <= r.match_score <= 1 for r in rows)
