import csv
import io
import random
import re

from pyspark.sql import functions as F

from rinkspark.operators import bad_rows as bad
from rinkspark.operators import packed, units

SEPARATORS = [";", ",", "|", "\t", " / ", " + ", "; ", ", "]


def write_list(values, rng):
    """A packed cell and the values in it, quoted where a value holds a separator."""
    out, sep = [], rng.choice(SEPARATORS)
    for v in values:
        quote = re.search(r"[;,|\t]|(?<=\s)[/+](?=\s)", v) or rng.random() < 0.3
        kind = rng.choice(["'", '"']) if "'" not in v and '"' not in v else '"'
        out.append(kind + v.replace('"', '""') + kind if quote or '"' in v else v)
    return sep.join(out)


def test_packed_round_trip(spark):
    rng = random.Random(1)
    pool = ["Two-Way", "Scout's Pick", "PK | 5v5", "Shot, Heavy", "Size + Reach", "Wing/Center", 'The "Blue" Sheet', "ü né", "a" * 5000]
    cases = []
    for i in range(300):
        values = [rng.choice(pool) for _ in range(rng.randint(1, 5))]
        cases.append((i, write_list(values, rng), values))
    df = spark.createDataFrame([(i, c) for i, c, _ in cases], "i bigint, c string")
    got = {}
    for r in packed.split_packed(df, "i", ["c"]).orderBy("row_id", "item_no").collect():
        got.setdefault(r.row_id, []).append(r.item_text)
        assert not r.item_error
    assert got == {i: v for i, _, v in cases}


def test_packed_edges(spark):
    cells = [None, "", "  ", ";;", "; a ;; b;", '["x", "y \\"z\\""]', '["x", "y', '"open; b', "'it's'; c", "a;a", "[one, two]", "a /b", "x;" * 20000]
    df = spark.createDataFrame(list(enumerate(cells)), "row_id bigint, items string").withColumn("item_no", F.lit(9))
    got = {}
    for r in packed.split_packed(df, "row_id", ["items"]).collect():
        got.setdefault(r.row_id, []).append((r.item_no, r.item_text, r.item_error))
    text = lambda i: [t for _, t, _ in sorted(got.get(i, []))]
    assert all(i not in got for i in (0, 1, 2, 3))
    assert text(4) == ["a", "b"] and text(5) == ["x", 'y "z"'] and text(9) == ["a", "a"] and text(10) == ["one", "two"] and text(11) == ["a /b"]
    assert text(7) == ['"open', "b"] and any(e for _, _, e in got[7])
    assert text(8)[-1] == "c" and len(text(12)) == 20000
    assert packed.split_packed(df.limit(0), "row_id", ["items"]).count() == 0


def reason(line, width):
    """Brute force over the characters of a record."""
    line = re.sub("\r+$", "", line or "")
    state, cells = "start", 1
    for i, c in enumerate(line):
        if state == "quoted":
            if c == '"':
                state = "closing"
        elif state == "closing":
            if c == '"':
                state = "quoted"
            elif c == ",":
                state, cells = "start", cells + 1
            else:
                return "broken_quoting"
        elif c == '"':
            if state != "start":
                return "broken_quoting"
            state = "quoted"
        elif c == ",":
            state, cells = "start", cells + 1
        else:
            state = "bare"
    return "broken_quoting" if state == "quoted" else "column_count" if cells != width else None


def test_structure_brute_force(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choice(['"', ",", "a", " ", '""', '","']) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "a,b\r", '"x,""y""",z\r\r', '"' + "q" * 100000 + '",b']
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, line string")
    got = {r.i: (r.e, r.c) for r in df.select("i", bad.structure_error(bad.record_text(F.col("line")), F.lit(2)).alias("e"), bad.record_cells(bad.record_text(F.col("line"))).alias("c")).collect()}
    for i, line in enumerate(lines):
        assert got[i][0] == reason(line, 2), line
        if got[i][0] is None:
            assert got[i][1] == next(csv.reader(io.StringIO(re.sub("\r+$", "", line)))), line


def test_rejected_rows(spark):
    rules = [bad.Rule("games", bad.WHOLE, "bigint"), bad.Rule("rate", bad.DECIMAL, "double")]
    rows = [(1, " 12 ", "1.5"), (2, "x", "1"), (3, None, "NaN"), (4, "n/a", "-"), (5, "—", " "), (6, "1", "2..3"), (7, "99999999999999999999", None), (7, "99999999999999999999", None)]
    df = spark.createDataFrame(rows, "id bigint, games string, rate string").withColumns({"value": F.lit("v"), "reason": F.lit("r"), "row_id": F.lit(0)})
    good, rejected = bad.load_valid(df, "id", rules)
    assert {(r.row_id, tuple(r.bad_columns)) for r in rejected.collect()} == {(2, ("games",)), (3, ("rate",)), (6, ("rate",)), (7, ("games",))}
    assert {(r.id, r.games, r.rate) for r in good.collect()} == {(1, 12, 1.5), (4, None, None), (5, None, None)}
    assert bad.rejected_rows(df.limit(0), "id", rules).count() == 0


def test_units(spark):
    heights = {"185": ("cm", 1850), "187.0": ("cm", 1870), "1.85": ("m", 1850), "1,85": ("m", 1850), "1m85": ("m", 1850), "1850 mm": ("mm", 1850), "73": ("in", 1854), '6\' 1"': ("ft", 1854), "6′1″": ("ft", 1854), "6-01": ("ft", 1854), "listed at 73 inches": ("in", 1854), "stands 6 ft 1": ("ft", 1854), "185 centimetrs": ("cm", 1850), "73 inchs": ("in", 1854), "tall": (None, None), "": (None, None), None: (None, None), "5": ("ft", 1524), "185 kg": (None, None), "1 2 3": (None, None)}
    df = spark.createDataFrame([(k,) for k in heights], "cell string").withColumns({"unit": F.lit("?"), "nums": F.lit(1)})
    got = {r.cell: (r.unit, r.tenths) for r in units.to_common_unit(df, units.HEIGHT).collect()}
    assert got == heights
    weights = {"187 lb.": ("lb", 848), "13st 2": ("st", 835), "13 st 2 lb": ("st", 835), "83": ("kg", 830), "187": ("lb", 848), "83000 g": ("g", 830), "92,5 kg": ("kg", 925), "88 kilos": ("kg", 880), "180 pouns": ("lb", 816)}
    got = {r.cell: (r.unit, r.tenths) for r in units.to_common_unit(spark.createDataFrame([(k,) for k in weights], "cell string"), units.WEIGHT).collect()}
    assert got == weights
    shares = {"0.939": "fraction", ".939": "fraction", "0,939": "fraction", "93.9%": "%", "SV 93.9%": "%", "93,9": "%", "939": "permille", "939 ‰": "permille", "93.9 pct": "%"}
    got = {r.cell: (r.unit, r.tenths) for r in units.to_common_unit(spark.createDataFrame([(k,) for k in shares], "cell string"), units.SHARE).collect()}
    assert got == {k: (u, 939) for k, u in shares.items()}
    assert units.to_common_unit(df.limit(0), units.HEIGHT).count() == 0


def test_distance_prefers_vowels():
    assert units.weighted_distance("inchs", "inches") < units.weighted_distance("inhes", "inches") <= units.weighted_distance("xnches", "inches") + 1


def test_valid_rows_of_all_three_tables_load(spark, small):
    from rinkspark.queries import cleaning as c

    rejected = {}
    for r in c.p3_found(spark, small).collect():
        rejected.setdefault(r.table_name, set()).add(r.row_id)
    ids = lambda t, k, where="true": {r[0] for r in spark.read.parquet(f"{small}/{t}.parquet").filter(where).select(k).collect()}
    for name, t, key, where in (("p3_loaded_open_stats", "russian_open_stats_2024", "row_no", "true"), ("p3_loaded_matches", "open_stats_matches", "match_row", "true"), ("p3_loaded_raw_open_stats", "open_stats_raw", "line_no", "layout = 'russian_open_stats_2024'"), ("p3_loaded_raw_matches", "open_stats_raw", "line_no", "layout = 'open_stats_matches'")):
        df = c.QUERIES[name](spark, small)
        layout = "russian_open_stats_2024" if "open_stats" in name else "open_stats_matches"
        assert set(c.LAYOUTS[layout]) <= set(df.columns) and all(dict(df.dtypes)[r.column] == r.sql_type for r in c.RULES[layout])
        got = [r[key] for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == ids(t, key, where) - rejected.get(t, set()) and got
