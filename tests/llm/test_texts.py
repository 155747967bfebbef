"""Leakage, mixing and truncation against brute force and on edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from rinkspark.llm import leakage as lk
from rinkspark.llm import mixing as mx
from rinkspark.llm import truncation as tr
from rinkspark.llm.words import words

WORDS = [f"w{i}" for i in range(40)]


def test_words_ignore_markup_and_layout():
    assert words("<p>The <b>Größe</b>&nbsp;of​ a me­di-\n  cal <i>fo</i>rm's</p>") == ["the", "grosse", "of", "a", "medical", "forms"]
    assert words(None) == words("") == []


def leaked(text, items):
    have, out = words(text), {}
    for i, item in items:
        w = words(item)
        for a in range(len(w) - lk.WINDOW + 1):
            piece = w[a : a + lk.WINDOW]
            if any(have[b : b + lk.WINDOW] == piece for b in range(len(have) - lk.WINDOW + 1)):
                out[i] = True
    return set(out)


def test_leaks_brute_force(spark):
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    items = [(i, say(rng.randint(5, 40))) for i in range(30)]
    docs = []
    for i in range(150):
        w = rng.choice(items)[1].split()
        a, k = rng.randrange(len(w)), rng.randint(8, 20)
        cut = w[a : a + k]
        if rng.random() < 0.3 and len(cut) > 3:
            cut[rng.randrange(len(cut))] = "other"
        docs.append((i, f"{say(20)} {', '.join(cut).upper()}. {say(20)}"))
    docs += [(200, None), (201, ""), (202, "x " * 30000 + items[3][1]), (7, docs[7][1])]
    items_df = spark.createDataFrame(items + [(90, None), (3, items[3][1])], "item_id bigint, item_text string").withColumn("doc_id", F.lit(1))
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    found = lk.find_leaks(docs_df, items_df).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.errors == 0} == {(d, i) for d, t in docs for i in leaked(t, items)}
    assert all(r.words < lk.WINDOW for r in found if r.errors)
    parsed = [(i, words(t)) for i, t in items]
    near = {(d, i) for d, t in docs for i, w in parsed if len(w) >= lk.WINDOW and lk.window_errors(w, range(len(w) - lk.WINDOW + 1), words(t) or [""]) <= lk.ERRORS}
    assert {(r.doc_id, r.item_id) for r in found} == near and len({(r.doc_id, r.item_id) for r in found if r.errors}) > 5
    assert lk.find_leaks(docs_df.limit(0), items_df).count() == 0 and lk.find_leaks(docs_df, items_df.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lk, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(14))) for i in range(7)], "item_id bigint, item_text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.col("item_text").alias("text"))
    assert {(r.doc_id, r.item_id) for r in lk.find_leaks(docs, items).collect()} == {(i, i) for i in range(7)}


def test_myers_equals_dynamic_programming():
    rng = random.Random(9)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        row = list(range(len(p) + 1))
        want = []
        for c in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
            row = new
            want.append(row[-1])
        assert lk.myers(p, t) == want


def test_mix_reaches_targets(spark):
    rng = random.Random(10)
    docs = [(i, rng.choice(["big"] * 8 + ["small", None, "untargeted"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))) for i in range(2000)] + [(5000, "big", None), (5001, "small", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumns({"tokens": F.lit(1), "hash": F.lit(2), "copies": F.lit(3)})
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    drawn, report = mx.mix(df, targets)
    drawn, report = drawn.cache(), {r.source: r for r in report.collect()}
    assert abs(report["big"].share - 0.5) < 0.01 and report["absent"].drawn_tokens == 0
    rows = drawn.collect()
    assert {r.source for r in rows} == {"big", "small"} and all(1 <= r.copies <= {"big": 1, "small": 3}[r.source] for r in rows)
    largest = max(r.tokens for r in rows)
    for name in ("big", "small"):
        assert abs(report[name].drawn_tokens - report[name].budget_tokens) <= largest
    few, more = ({r.doc_id for r in mx.mix(df, targets, total=t)[0].filter("source = 'big'").collect()} for t in (3000, 9000))
    assert few < more  # nested
    assert mx.mix(df.limit(0), targets)[0].count() == 0
    assert mx.mix(df, targets.limit(0))[0].count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = ["Some nights <|endoftext|> Müller", "", None, "a" * 20000, "x y z"]
    got = {r.i: r.tokens for r in mx.token_counts(spark.createDataFrame(list(enumerate(texts)), "i bigint, text string"), ["i"]).collect()}
    t = Tokenizer.from_file(mx.TOKENIZER)
    t.encode_special_tokens = True
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


BODY = "Some nights a heavy wrist shot takes over and other nights discipline does. The league moved the fixture because of an ice plant failure. "


ENDS = [
    (BODY.strip(), False), (BODY + "The sta", True), (BODY + "The staff…", True), (BODY + "The sta�", True), (BODY + "The sta [...]", True), (BODY + "The sta &am", True), (BODY + "The staff\n", True),
    (BODY + "\n— Kelmar desk", False), (BODY + "#Kelmar #draft2020", False), (BODY + "\nhttps://notes.example/1", False), (BODY + "\nGrade: 5/9", False), (BODY + "\nFinal: Kelmar 2, Mokrous 1", False), (BODY + "\nGP 5 | G 2 | A 1", False), (BODY + "\n[Filed 1 Jan, Kelmar]", False),
    (BODY + "(Second viewing.)", False), (BODY + "Is it enough?", False), ("", False), (None, False), ("   ", False), (BODY * 3000 + "and", True),
    (BODY.replace("fixture", "game") + "The staff (more)", True),
]


def test_ends(spark):
    rows = [(i, t if not t or not t.strip() else f"N{i}. {t}") for i, (t, _) in enumerate(ENDS)]
    df = spark.createDataFrame(rows + rows, "doc_id bigint, text string").withColumns({"tid": F.lit(1), "by": F.lit(2), "keys": F.lit(3)})
    got = sorted((r.doc_id, r.cut) for r in tr.cut_texts(df).collect())
    assert got == sorted([(i, cut) for i, (_, cut) in enumerate(ENDS)] * 2)


def test_near_copy_shows_the_cut(spark):
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(200)) + ". The report on him stays bold and his pace still costs possessions."
    short = long[: long.index("possessions")] + "poss."
    ended = long[: long.index(". The report") + 1]
    docs = spark.createDataFrame([(1, long), (2, short), (3, ended), (4, "Nothing like it at all, whatever one reads.")], "doc_id bigint, text string")
    got = {r.doc_id: (r.cut, r.by) for r in tr.cut_texts(docs).collect()}
    assert got == {1: (False, None), 2: (True, "near_copy"), 3: (False, None), 4: (False, None)}
    assert tr.cut_texts(docs.limit(0)).count() == 0


def test_cut_is_shown_by_a_copy_that_is_not_the_longest(spark):
    rng = random.Random(5)
    body = " ".join(rng.choice(WORDS) + ("." if i % 9 == 8 else "") for i in range(300)) + ". They saw him at the Moritz rink last spring."
    cut = body[: body.index("itz rink")] + "."
    other_end = body[: body.index("They saw")] + "A quite different close of some further words that nobody cut, " + "and on " * 6 + "it goes."
    repeated = body + " And it adds up: " + "the pace of his first step is rated as very high by all of them " * 20 + "again."
    docs = spark.createDataFrame([(1, cut), (2, body), (3, other_end)], "doc_id bigint, text string")
    assert {r.doc_id: r.by for r in tr.cut_texts(docs).collect()} == {1: "near_copy", 2: None, 3: None}
    long_only = spark.createDataFrame([(1, cut), (2, repeated)], "doc_id bigint, text string")
    assert len(repeated) > 1.6 * len(cut) and {r.doc_id: r.by for r in tr.cut_texts(long_only).collect()} == {1: "near_copy", 2: None}


def test_cuts_shown_by_copies_equal_brute_force(spark):
    rng = random.Random(8)
    family = " ".join(rng.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(160)).split(" ")
    texts = [" ".join([*family[:n], *rng.sample(WORDS, k)]) + "." for n in range(140, 160, 2) for k in (0, 0, 3, 6)]
    texts = sorted(set(texts) | {t[: -rng.randint(2, 6)] + "." for t in texts[::3]})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i for i, x in enumerate(texts) if any(y != x and tr.ends_early(x, y) for y in texts)}
    assert {r.doc_id for r in tr.cut_texts(docs).collect() if r.by == "near_copy"} == want and want


def test_cut_at_any_length(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    docs, planted = [], {}
    for i in range(12):
        words = [rng.choice(vocabulary) + ("." if j % 10 == 9 else "") for j in range(300)]
        docs.append((i, " ".join(words)))
        for share in (10, 25, 50, 75, 85, 90, 95):
            n = 3 * share + (3 if share % 10 == 0 else 2)  # not after a sentence's last word
            cut = words[: n - 1] + [words[n - 1].rstrip(".") + "."]
            for at in rng.sample(range(n - 7), n // 80):  # a few other words
                cut[at] = "other"
            planted[100 * (i + 1) + share] = " ".join(cut)
    docs += list(planted.items())
    got = {r.doc_id for r in tr.cut_texts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r.by == "near_copy"}
    brute = {i for i, t in docs if any(tr.ends_early(t, y) for _, y in docs if y != t)}
    assert got <= brute and set(planted) >= brute and len(got) >= 0.98 * len(brute) and len(got) >= 0.95 * len(planted)


def test_texts_of_the_same_sentences_shuffle_little(spark):
    from .test_records import shuffled

    rng = random.Random(6)
    pool = [" ".join(rng.choice(WORDS) for _ in range(9)) + "." for _ in range(6)]
    docs = [(i, " ".join([pool[i % 2], *(rng.choice(pool) for _ in range(9)), f"Then it ends{i}."])) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    before = shuffled(spark)
    assert tr.cut_texts(df).count() == len(docs)
    assert shuffled(spark) - before < sum(len(t) for _, t in docs), (shuffled(spark) - before, sum(len(t) for _, t in docs))


def test_filter_loses_nothing_in_one_scan_or_several(spark, monkeypatch):
    rng = np.random.RandomState(1)
    numbers = rng.randint(-(2**63), 2**63 - 1, 4000)
    sieve = tr.Filter.of(spark.createDataFrame([(int(n),) for n in numbers[:2000]], "n bigint"), 2000, 4)
    has = sieve.has(numbers.astype(np.uint64))
    assert has[:2000].all() and has[2000:].mean() < 0.05
    monkeypatch.setattr(tr, "SOUGHT", 7)
    test_cut_is_shown_by_a_copy_that_is_not_the_longest(spark)


def test_hot_family_of_copies(spark, monkeypatch):
    monkeypatch.setattr(tr, "join_spread", lambda left, right, on: __import__("rinkspark.plans.runtime", fromlist=["x"]).join_spread(left, right, on, 3))
    base = [f"word{i}" + ("." if i % 10 == 9 else "") for i in range(80)]
    docs = [(i, " ".join([f"n{i}", *base])) for i in range(40)] + [(100 + i, " ".join([f"c{i}", *base[:73]]) + ".") for i in range(40)]
    got = {r.doc_id for r in tr.cut_texts(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r.by == "near_copy"}
    assert got == {100 + i for i in range(40)}


def test_ellipsis_after_a_closing_word(spark):
    rows = [(i, f"{BODY}Time will tell...") for i in range(5)] + [(10, BODY + "The staff marked the ti..."), (11, BODY + "The nig...")]
    rows = [(i, f"Number {i}. {t}") for i, t in rows]
    got = {r.doc_id: r.cut for r in tr.cut_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i >= 10 for i, _ in rows}


def test_rates(spark):
    docs = spark.createDataFrame([(i, "cap", "word " * 20 + f"{i % 10}wor"[:4]) for i in range(9)] + [(20, "ok", "Fine."), (21, None, "Bro")], "doc_id bigint, source string, text string")
    docs = docs.unionByName(docs.filter("doc_id = 21").withColumn("source", F.lit("ok")))  # one id twice
    got = {r.source: r for r in tr.truncation_rates(tr.cut_texts(docs, keep=("source",))).collect()}
    assert got["cap"].cut_share == 1.0 and got["cap"].field_limit == 104 and (got["ok"].texts, got["ok"].cut_texts) == (2, 1) and got[None].cut_share == 1.0
