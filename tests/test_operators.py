"""Reference operators on small cases with known results."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkspark.functions import scalars as fn
from rinkspark.operators import aggregates as agg
from rinkspark.operators import audit, linkage, models, ranking, reconcile, scoring
from rinkspark.plans import runtime
from rinkspark.sources import feeds, sinks
from rinkspark.sources.tables import read_csv_table
from rinkspark.streaming import upserts


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("make, value, want", [
    (fn.name_key, "Björn O'Hara-Smith", "björnoharasmith"), (fn.person_key, "Björn O'Hara Jr.", "bjornohara"), (fn.person_alias_key, "Nick de Groot", "nicholasgroot"), (fn.initial_surname_key, "Björn van Dyk", "bdyk"),
    (fn.given_initial_key, "Alex P.", "alexp"), (fn.given_initial_key, "Alex", None), (fn.given_first, "Kane, Patrick", "Patrick Kane"), (fn.transliterate, "Щукин Егор", "shchukin egor"), (fn.slug, " Östhamra  Björnar! ", "osthamra-bjornar"),
    (fn.whole_strict, "3.7", None), (fn.whole_strict, " 12 ", 12), (fn.whole_lenient, "3.7", 3), (fn.whole_lenient, "x", 0), (fn.whole_lenient, "nan", 0), (fn.flag, " Yes ", True), (fn.flag, "0", False), (fn.minutes, "12:30", 12.5), (fn.minutes, "40", 40.0), (fn.minutes, "—", None),
    (fn.money, "$4.5M", 4_500_000), (fn.money, "850K", 850_000), (fn.money, "$1,250,000", 1_250_000), (fn.money, "none", None), (fn.season_label, "2018–19", "2018-19"), (fn.season_label, "2018/2019", "2018-19"), (fn.json_or_jsonp, 'cb({"a": 1});', '{"a": 1}'), (fn.first_sentences, "A b. C d! E f? G h.", "A b. C d! E f?"),
    (fn.typed_date, "Jun 1, 2004", dt.date(2004, 6, 1)), (fn.typed_date, "1.6.2004", dt.date(2004, 6, 1)), (fn.typed_date, "soon", None), (fn.list_cell, " a; ;b ", ["a", "b"]), (fn.cell, "N/A", None),
])
def test_text_scalars(spark, make, value, want):
    assert one(spark, make(F.col("x")), x=value) == want


def test_number_scalars(spark):
    assert one(spark, fn.clamp(F.col("x")), x=1.5) == 1.0 and one(spark, fn.share_of_one(F.col("x")), x=91.5) == 0.915
    assert one(spark, fn.logistic(F.col("x")), x=-1000.0) == 0.0 and abs(one(spark, fn.logistic(F.col("x")), x=2.0) - 0.8807970779778823) < 1e-12
    assert one(spark, fn.age_at(F.col("d"), F.col("b")), d=dt.date(2024, 6, 21), b=dt.date(2006, 6, 21)) == 18.0
    assert one(spark, fn.regular_season_of(F.col("x")), x="SHL Slutspel") is False
    assert one(spark, fn.add_label(F.col("x"), F.col("y")), x="a; b", y="b") == "a; b" and one(spark, fn.add_label(F.col("x"), F.col("y")), x="", y="b") == "b"
    assert one(spark, fn.team_and_league(F.col("x")), x="Kelmar Foxes [NKL]") == ("Kelmar Foxes", "NKL")
    assert one(spark, fn.overlap(fn.word_set(F.col("x"), ("the",)), fn.word_set(F.col("y"))), x="The big cat", y="the cat") == 1
    assert one(spark, scoring.adult_weight(F.col("x")), x=3) == 0.12 and one(spark, scoring.adult_tier(F.col("x")), x=3) == "exposure" and one(spark, scoring.playoff_weight(F.col("x")), x=30) == min(1.0, 0.82 + 15 / 85)


def test_goalie_golden(spark):
    rows = [("g", 47, 2705.0, 1665, 1514, 151, 3, None, None), ("g", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "p string, games int, minutes double, shots_against int, saves int, goals_against int, shutouts int, save_percentage double, goals_against_average double")
    r = agg.goalie_metrics(df, ["p"]).first()
    assert round(r.save_percentage, 6) == 0.909309 and round(r.goals_against_average, 6) == 3.349353
    assert agg.goalie_metrics(df.limit(0), ["p"]).count() == 0


def test_weighted_means(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 3), (None, 9)], "v double, w int")
    r = df.agg(agg.mean_at_least_one(F.col("v"), F.col("w")).alias("a"), agg.mean_positive(F.col("v"), F.col("w"), True).alias("b"), agg.mean_positive(F.col("v"), F.lit(0), True).alias("c"), agg.mean_positive(F.col("v"), F.lit(0), False).alias("d")).first()
    assert tuple(r) == (2.5, 3.0, 2.0, 0.0)


def test_lookup_falls_back(spark):
    dim = spark.createDataFrame([("A", 2.0), ("Unknown", 0.5)], "league string, w double")
    rows = spark.createDataFrame([("A",), ("B",), (None,)], "league string")
    assert {r.league: r.w for r in linkage.lookup(rows, dim, "league", {"w": 9.0}).collect()} == {"A": 2.0, "B": 0.5, None: 0.5}
    assert {r.w for r in linkage.lookup(rows, dim.limit(0), "league", {"w": 9.0}).collect()} == {9.0}


def test_cascade_uses_each_base_row_once(spark):
    src = spark.createDataFrame([(1, "ann lee"), (2, "Ann Lee"), (3, "B Cox"), (4, "Zed")], "s int, name string")
    base = spark.createDataFrame([(10, "Ann Lee"), (20, "Bob Cox"), (30, "Zed"), (40, "Zed")], "b int, name string")
    steps = [("exact", F.col("name"), F.col("name")), ("initial", fn.initial_surname_key(F.col("name")), fn.initial_surname_key(F.col("name")))]
    got = {r.s: (r.b, r.method) for r in linkage.cascade_match(src, base, "s", "b", steps, spark.createDataFrame([(4, 40)], "s int, b int")).collect()}
    assert got == {1: (None, None), 2: (10, "exact"), 3: (20, "initial"), 4: (40, "manual")}


def _ranked(query, people, top=3, least=0.0):
    """Brute force: (id, ratio) of the most similar names, ties by name and id."""
    key = lambda n: "".join(c.lower() for c in n if c.isalnum())
    scored = [(-linkage.ratio(key(query), key(n)), n, i) for i, n in people]
    return [(i, -v) for v, n, i in sorted(scored)[:top] if -v >= least]


def test_closest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linkage, "SHARD_KEYS", 60)
    monkeypatch.setattr(linkage, "SHARD_ASKED", 11)
    rng = np.random.RandomState(3)
    word = lambda: "".join(rng.choice(list("aeiknrstö"), rng.randint(2, 9)))
    people = [(i, f"{word()} {word()}".title()) for i in range(200)]
    people += [(200 + i, "Same Name") for i in range(5)] + [(300, "Kolotres Danil"), (301, "x" * 80 + "y")]
    asked = [(i, "".join(c for c in people[i * 3][1] if rng.rand() > 0.2)) for i in range(50)]
    asked += [(50, "Zame Name"), (51, ""), (52, "Danil Kolotres"), (53, "x" * 79 + "yz"), (54, "Same Name")]
    source, base = spark.createDataFrame(asked, "s int, a string"), spark.createDataFrame(people, "b int, name string")
    for top, least in ((3, 0.0), (1, 0.7)):
        got = {}
        for r in linkage.closest(source, base, "s", "b", fn.name_key(F.col("a")), fn.name_key(F.col("name")), "name", top, least).orderBy("s", "place").collect():
            got.setdefault(r.s, []).append((r.b, r.similarity))
        assert got == {s: want for s, a in asked if (want := _ranked(a, people, top, least))}


def test_closest_shuffles_as_much_for_any_number_of_blocks(spark, monkeypatch):
    from .llm.test_records import shuffled

    rng = np.random.RandomState(5)
    names = [(i, "".join(rng.choice(list("aeiknrst"), 12))) for i in range(1500)]
    base, source = spark.createDataFrame(names, "b int, name string"), spark.createDataFrame(names[:200], "s int, a string")
    wrote, found = [], []
    for size in (1_000, 10):
        monkeypatch.setattr(linkage, "SHARD_ASKED", size)
        before = shuffled(spark)
        found.append(sorted(linkage.closest(source, base, "s", "b", F.col("a"), F.col("name"), "name", 1, 0.9).collect()))
        wrote.append(shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 200
    assert wrote[1] < 1.5 * wrote[0], wrote


def test_unmatched_candidates_equal_brute_force(spark, small):
    from rinkspark.queries import prospects

    people = [tuple(r) for r in spark.read.parquet(f"{small}/players.parquet").select("player_id", "name").collect()]
    asked = spark.read.parquet(f"{small}/open_stats_matches.parquet").filter("source_name <> name").collect()
    got = {(r.match_row, r.place): (r.player_id, r.similarity) for r in prospects.unmatched_candidates(spark, small).collect()}
    want = {(r.match_row, n): (i, round(v, 6)) for r in asked for n, (i, v) in enumerate(_ranked(r.source_name, people), 1)}
    assert got == want and len(got) == 3 * len(asked) > 0


def test_cascade_ends_with_the_fuzzy_step(spark):
    src = spark.createDataFrame([(1, "Ann Leemann"), (2, "Anna Leemann"), (3, "Xavier Coxington"), (4, "Qavier Coxingtom"), (5, "Zed")], "s int, name string")
    base = spark.createDataFrame([(10, "Ann Leemann"), (20, "Xavier Coxingtin"), (30, "Bo Li")], "b int, name string")
    key = fn.name_key(F.col("name"))
    fuzzy = (key, key, "name", 0.9)
    got = {r.s: (r.b, r.method) for r in linkage.cascade_match(src, base, "s", "b", [("exact", key, key)], fuzzy=fuzzy).collect()}
    assert got == {1: (10, "exact"), 2: (None, None), 3: (20, "fuzzy"), 4: (None, None), 5: (None, None)}
    assert linkage.cascade_match(src, base.limit(0), "s", "b", [("exact", key, key)], fuzzy=fuzzy).filter("method is not null").count() == 0


def test_identity_cascade_equals_brute_force(spark, small):
    from rinkspark.functions.text import alnum_key
    from rinkspark.queries import prospects

    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select("player_id", alnum_key(F.col("name")), "name").collect()]
    people, want, used = read("players"), {}, set()
    for r in prospects.identity_pairs(spark, small).collect():
        want[r.source_id] = (r.base_id, r.method)
        used.add(r.base_id)
    keyed = {r.source_id for r in linkage.cascade_match(spark.read.parquet(f"{small}/ep_pdf_profiles.parquet").selectExpr("player_id source_id", "name"), spark.read.parquet(f"{small}/players.parquet").selectExpr("player_id base_id", "name"), "source_id", "base_id", [("initial", fn.initial_surname_key(F.col("name")), fn.initial_surname_key(F.col("name")))]).filter("method is not null").collect()}
    for i, k, _ in sorted(read("ep_pdf_profiles")):
        if want[i][1] is None and i not in keyed:
            v, _, b = min((-linkage.ratio(k or "", p or ""), n, b) for b, p, n in people)
            if -v >= 0.9 and b not in used:
                want[i] = (b, "fuzzy")
                used.add(b)
    assert {r.source_id: (r.base_id, r.method) for r in prospects.identity_cascade(spark, small).collect()} == want
    assert any(m == "fuzzy" for _, m in want.values())


def test_component_scores_keep_every_player(spark, tmp_path):
    from rinkspark.queries import prospects

    rows = [("cm", "D", 190, 90), ("in", "D", 75, 198), ("mm", "D", 1900, 90000), ("none", "D", None, 90), ("no kg", "G", 190, None)]
    spark.createDataFrame([(i, p, "R", 18.0, h, w) for i, p, h, w in rows], "player_id string, position string, handedness string, age_at_draft double, height_cm int, weight_kg int").write.parquet(str(tmp_path / "players.parquet"))
    got = {r.player_id: r for r in prospects.component_scores(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and got["cm"]["size"] == got["mm"]["size"] == round(0.7 * 12 / 18 + 0.3 * 18 / 22, 6)
    assert abs(got["in"]["size"] - round(0.7 * 12.5 / 18 + 0.3 * 17.8 / 22, 6)) < 1e-6
    assert got["none"]["size"] is got["no kg"]["size"] is None and got["none"].hand == 1.0 and got["no kg"].age is not None


def test_upserts_and_scopes(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, t string, n int")
    fresh = spark.createDataFrame([(2, " ", 7), (3, "c", None)], "k int, t string, n int")
    assert {tuple(r) for r in linkage.upsert(base, fresh, "k").collect()} == {(1, "a", None), (2, "b", 7), (3, "c", None)}
    lines = spark.createDataFrame([(1, None, 1), (1, "x", 2), (2, None, 3)], "p int, s string, v int")
    new = spark.createDataFrame([(1, None, 9)], "p int, s string, v int")
    assert {tuple(r) for r in linkage.replace_scope(lines, new, ["p", "s"]).collect()} == {(1, None, 9), (1, "x", 2), (2, None, 3)}


def test_reconcile(spark):
    rows = [(1, "k", "wikipedia; chl", 4, "ab"), (2, "k", "league-feed", 5, "a"), (3, "k", "league-feed", None, "abc")]
    df = spark.createDataFrame(rows, "id int, k string, source string, goals int, t string")
    r = reconcile.prefer_by_priority(df, ["k"], ["goals", "t"], reconcile.source_priority(F.col("source")), "id").first()
    assert (r.row_count, r.goals, r.t) == (3, 5, "abc")
    assert reconcile.conflicts(df, ["k"], ["goals", "source"]).first().conflict_fields == "goals; source"
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, v string")
    assert [r.id for r in reconcile.repeated_rows(dup, "id").orderBy("id").collect()] == [2, 5]


def test_rank_metrics(spark):
    scipy_like = [(1.0, 2.0), (2.0, 1.0), (2.0, 4.0), (5.0, 4.0)]
    got = ranking.spearman(spark.createDataFrame(scipy_like, "a double, b double"), "a", "b").first()[0]

    def mid(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    a, b = map(mid, zip(*scipy_like))
    assert abs(got - np.corrcoef(a, b)[0, 1]) < 1e-12
    assert ranking.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()[0] == 0.0
    df = spark.createDataFrame([(1, True, 0.9), (2, False, 0.9), (3, True, 0.1)], "id int, y boolean, p double")
    assert ranking.precision_at(df, "y", "p", [F.col("id")], 1).first().precision == 1.0
    assert abs(ranking.brier(df, "y", "p").first()[0] - (0.01 + 0.81 + 0.81) / 3) < 1e-12
    assert ranking.top_overlap(df, "id", F.col("p").desc(), F.col("p").asc(), 2).first()[0] == 1


def test_models_fit_and_score(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, "f" if i % 2 else "d", float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, role string, a double, b double, y int")
    scored = models.cross_validated(df, ["role"], ["a", "b"], "y", "id").collect()
    assert len(scored) == 200 and np.mean([(r.score > 0.5) == r.y for r in scored]) > 0.85
    only = df.withColumn("y", F.lit(1))
    assert {r.score for r in models.cross_validated(only, ["role"], ["a"], "y", "id").collect()} == {1.0}
    assert models.cross_validated(df.limit(1), ["role"], ["a"], "y", "id").count() == 1


def test_audits(spark):
    df = spark.createDataFrame([(1, "a"), (1, " "), (2, None)], "k int, t string")
    assert {tuple(r) for r in audit.missing_counts(df).collect()} == {("k", 0), ("t", 2)}
    assert audit.duplicate_total(df, ["k"]).first()[0] == 1 and audit.orphans(df, df.filter("k = 1"), "k").count() == 1
    a, b = audit.fingerprint(df).first(), audit.fingerprint(df.orderBy(F.desc("k")).repartition(3)).first()
    assert a == b and a != audit.fingerprint(df.union(df.limit(1))).first()


def test_checked_join_is_the_same_either_way(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else "x") for i in range(50)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("y", 2)], "k string, v int")
    for how in ("inner", "left"):
        got = [sorted(map(tuple, runtime.join_checked(left, right, "k", how, rows=n).select("i", "k", "v").collect()), key=repr) for n in (0, 100)]
        assert got[0] == got[1]


def test_html_and_scripts(spark):
    page = '<table class="x data"><tr><th>Name</th><th>GP</th></tr><tr><td><a href="/p/1">Al &amp; Bo</a></td><td> 12 <br>b</td></tr></table><table><tr><td>no</td></table><script>var t = {"data": [["a]", 1], ["b", 2]]};</script><div data-page="{&quot;k&quot;:1}"></div>'
    files = spark.createDataFrame([("f", page), ("g", None), ("h", "<table><tr><td>open")], "path string, body string")
    rows = feeds.html_rows(files, css="data")
    assert [tuple(r.cells) for r in rows.orderBy("row_no").collect()] == [("Name", "GP"), ("Al & Bo", "12 b")]
    assert feeds.html_records(rows).first().record == {"name": "Al & Bo", "gp": "12 b"}
    assert feeds.script_rows(files, "array<array<string>>").first().rows == [["a]", "1"], ["b", "2"]]
    assert files.select(feeds.page_attribute(F.col("body")).alias("j")).first().j == '{"k":1}'


def test_wiki_and_text_lines(spark):
    page = "{{Infobox\n| name = [[Al]]\n| name = other\n| pos = C\n}}\n{| class\n|+ cap\n! Season !! GP\n|-\n| 2020–21 || [[A|'''5''']]<ref>x</ref>\n|}"
    files = spark.createDataFrame([("w", page)], "path string, body string")
    assert [r.cells for r in feeds.wiki_table(files).orderBy("row_no").collect()] == [["Season", "GP"], ["2020–21", "5"]]
    assert files.select(feeds.infobox(F.col("body")).alias("m")).first().m == {"name": "[[Al]]", "pos": "C"}
    lines = spark.createDataFrame([("2023-24 NKL Kelmar 20 3 4 7",), ("2023-24 NKL Kelmar 20 2.51 .911",), ("Total 5",)], "line string")
    got = {r.kind: r for r in feeds.text_stat_lines(lines).collect()}
    assert got["skater"].points == 7 and got["goalie"].save_percentage == 0.911 and len(got) == 2


def test_picks(spark):
    body = 'cb({"draftYear": 2024, "picks": [{"round": 1, "overallPick": 3, "teamAbbrev": "X", "firstName": {"default": "Al"}, "lastName": {"default": "Bo"}, "positionCode": "C", "height": 73, "weight": 190}, {"round": 1, "overallPick": 4, "firstName": {"default": "Forfeited"}, "lastName": {"default": "Pick"}, "positionCode": "C"}, {"overallPick": 5, "firstName": {"default": "No"}, "lastName": {"default": "Pos"}}]})'
    schema = "draftYear int, picks array<struct<round:int,overallPick:int,teamAbbrev:string,positionCode:string,countryCode:string,height:int,weight:int,amateurLeague:string,amateurClubName:string,firstName:struct<default:string>,lastName:struct<default:string>>>"
    rows = feeds.draft_picks(feeds.json_payload(spark.createDataFrame([("p", body), ("q", "{")], "path string, body string"), schema)).collect()
    assert [(r.player_id, r.name, r.height_cm, r.weight_kg) for r in rows] == [("2024-003", "Al Bo", 185, 86)]


def test_csv_and_directories(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y', 0.5), (2, None, None)], "a int, b string, c double")
    sinks.write_csv(sinks.fixed_decimals(df), str(tmp_path / "t"), ["a", "b", "c", "missing"])
    back = read_csv_table(spark, str(tmp_path / "t"), ["a", "b", "c", "other"])
    assert {tuple(r) for r in back.collect()} == {("1", 'say "x", y', "0.500000", None), ("2", None, None, None)}
    with pytest.raises(FileNotFoundError):
        read_csv_table(spark, str(tmp_path / "none"), ["a"])
    assert read_csv_table(spark, str(tmp_path / "none"), ["a"], required=False).count() == 0
    recorded = sinks.manifest(spark, str(tmp_path / "t")).filter("path like 'part%'").cache()
    assert recorded.count() > 0
    sinks.write_csv(df, str(tmp_path / "n"), ["a"])
    sinks.replace_directory(spark, str(tmp_path / "n"), str(tmp_path / "t"))
    assert {r.status for r in sinks.changed_files(spark, str(tmp_path / "t"), recorded).filter("path like 'part%'").collect()} == {"added", "removed"}
    with pytest.raises(ValueError):
        sinks.replace_directory(spark, str(tmp_path / "t" / "x"), str(tmp_path / "t"))


def test_streamed_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "p int, s string, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: upserts.upsert_batches(spark, str(tmp_path / "in"), "p int, s string, v int", str(tmp_path / "out"), ["p"], str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([(2, "b", 9)], "p int, s string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "a", 1), (2, "b", 9)}
    dated = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2025, 1, 1)), (3, None)], "i int, d date")
    assert {r.i for r in upserts.not_future(dated, "d", "2024-06-01").collect()} == {1, 3}


def test_similar_equals_brute_force(monkeypatch):
    from rinkspark.operators import similar

    rng = np.random.RandomState(11)
    words = ["".join(rng.choice(list("aeiknrstö"), rng.randint(2, 5))) for _ in range(25)]
    texts = {"".join(rng.choice(words, rng.randint(1, 5))) for _ in range(900)}
    texts |= {"", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 70, "x" * 69 + "y", "𝒶𝓃𝓃", "".join(map(chr, range(0x4E00, 0x4F40))), *(chr(0x4E00 + i) + "nn" for i in range(300))}
    queries = [*(f"{a[3:]}{a[:3]}{b[:2]}" for a, b in zip(sorted(texts)[::25], sorted(texts)[5::25])), "", "a", "zzz", "x" * 68 + "yz", "aaaaaaaaaaaaaa", "nn𝒶", "".join(map(chr, range(0x4E05, 0x4E40))), *(t[1:] + "k" for t in sorted(texts)[::80])]
    queries, texts = sorted(set(queries)), sorted(texts)
    scores = {q: {t: similar.ratio(q, t) for t in texts} for q in queries}
    want = {q: sorted(of.values())[-3:] for q, of in scores.items()}
    for sizes in ({}, {"TREE_TEXTS": 40, "NODE_TEXTS": 2, "MANY": 5, "COUNTED": 100, "PAIRS": 1000}, {"NODE_TEXTS": 300, "TIMES": 1, "PIECES": (1, 2, 9)}):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(similar, name, value)
            for shards in (1, 3):
                best, found = {q: [0.0] * 3 for q in queries}, {q: {} for q in queries}
                for k in range(shards):
                    for q, have in similar.Similar(texts[k::shards]).top(queries, best).items():
                        assert not found[q].keys() & have.keys()
                        found[q] |= have
                for q in queries:
                    assert sorted(best[q]) == want[q]
                    assert {t for t, v in found[q].items() if v >= best[q][0]} == {t for t, v in scores[q].items() if v >= want[q][0]}
            high = {q: [0.8] for q in queries}
            for q, have in similar.Similar(texts).top(queries, high).items():
                assert {t for t, v in have.items() if v >= high[q][0]} == {t for t, v in scores[q].items() if v >= max(0.8, want[q][2])}


def test_similar_looks_at_few_texts(monkeypatch):
    from rinkspark.operators import similar

    rng = np.random.RandomState(12)
    words = ["".join(rng.choice(list(letters), 1)[0] for letters in ("bdfgklmnprstvz", "aeiou", "lmnrst")) for _ in range(60)]
    texts = sorted({"".join(rng.choice(words, 5)) for _ in range(20_000)})
    queries, looked, step = [t[:7] + t[8:] for t in texts[::400]], [], similar.Asked.step
    monkeypatch.setattr(similar.Asked, "step", lambda self, row, q, letter: looked.append(len(row)) or step(self, row, q, letter))
    monkeypatch.setattr(similar.Counted, "__init__", lambda *_: pytest.fail("all texts were looked at"))
    best = {q: [0.0] * 3 for q in queries}
    similar.Similar(texts).top(queries, best)
    assert sum(looked) < 1.5 * len(texts) * len(queries), sum(looked) / len(texts) / len(queries)  # a tenth of 15 letters each
    assert all(best[q] == sorted(similar.ratio(q, t) for t in texts)[-3:] for q in queries[:2])
