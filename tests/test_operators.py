from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import relational as R
from ledgerloom.operators import search
from ledgerloom.operators import tables as O
from ledgerloom.streaming import windows as S


@pytest.mark.parametrize(
    "written, value",
    [("1,234.50", "1234.50"), ("1.234,50", "1234.50"), ("(12.00)", "-12"), ("$5", "5"), ("7-", "-7"), ("12.00 CR", "-12"), ("abc", None), ("", None), ("3,5", "3.5"), ("1,234", "1234")],
)
def test_amounts(spark, written, value):
    got = spark.createDataFrame([(written,)], "c string").select(T.parse_amount(F.col("c"))).first()[0]
    assert got == (Decimal(value) if value else None)


@pytest.mark.parametrize("written, value", [("2026-04-01", "2026-04-01"), ("4/1/26", "2026-04-01"), ("4/1/75", "1975-04-01"), ("1.4.2026", "2026-04-01"), ("April 1, 2026", "2026-04-01"), ("Wed, 1 Apr 2026", "2026-04-01"), ("soon", None)])
def test_dates(spark, written, value):
    got = spark.createDataFrame([(written,)], "c string").select(T.cell_date(F.col("c")).cast("string")).first()[0]
    assert got == value


def test_identities_of_a_wide_table(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(1, 1000, (200, 36)).astype(float)
    x[:, 5] = x[:, 2] + x[:, 3] - x[:, 4]
    x[:, 20] = x[:, 10:20].sum(axis=1)
    x[:8, 20] += 1
    names = [f"c{i}" for i in range(36)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], [*names])
    found = {t: (f, h) for t, f, h in O.identities(frame, names)}
    assert found["c20"] == (" + ".join(f"c{i}" for i in range(10, 20)), 0.96) and found["c5"] == ("c2 + c3 - c4", 1.0) and len(found) == 2


def test_closure_is_that_of_brute_force(spark, sf):
    from ledgerloom.catalog import QUERIES

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            parent[a] = a = parent[parent[a]]
        return a

    for r in lines:
        a, b = find(("n", r[0])), find(("k", r[1], r[2]))
        parent[b] = a
    least = {}
    for r in lines:
        root = find(("n", r[0]))
        least[root] = min(least.get(root, r[0]), r[0])
    got = {r["l_orderkey"]: r["root"] for r in QUERIES["jn15_conversation_closure"](spark, sf).collect()}
    assert got == {r[0]: least[find(("n", r[0]))] for r in lines}


def test_calendar_rules(spark):
    import datetime as d

    from ledgerloom.operators import calendar as C

    def times(rule, start="20240131T090000", low="2024-01-01", high="2024-12-31", extra=""):
        ics = f"BEGIN:VEVENT\nUID:u\nDTSTART:{start}\nRRULE:{rule}\n{extra}END:VEVENT\n"
        e = C.events(spark.createDataFrame([(1, ics)], "k int, t string"), "k", "t")
        return [r["at"].strftime("%m%d") for r in C.expanded(e, F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")).orderBy("at").collect()]

    assert times("FREQ=MONTHLY;COUNT=4") == ["0131", "0331", "0531", "0731"]
    assert times("FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20240212T000000Z") == ["0131", "0205", "0207"]
    assert times("FREQ=DAILY;INTERVAL=10;COUNT=3", extra="EXDATE:20240210T090000\n") == ["0131", "0220"]
    assert times("FREQ=YEARLY", high="2026-12-31", start="20240229T090000") == ["0229"]
    assert times("FREQ=SECONDLY") == ["0131"] and len(times("FREQ=DAILY", high="2030-01-01")) == 400
    moved = spark.createDataFrame([("u", d.datetime(2024, 1, 31, 9), d.datetime(2024, 2, 1, 9))], "uid string, moved timestamp, starts timestamp")
    at = spark.createDataFrame([("u", d.datetime(2024, 1, 31, 9)), ("u", d.datetime(2024, 2, 2, 9))], "uid string, at timestamp")
    assert sorted(r["at"].day for r in C.overridden(at, moved).collect()) == [1, 2]


def test_forged_ids_and_whom_newcomers_write_to(spark):
    from ledgerloom.operators import links as L

    rows = [
        (1, "a", 0, "m1", None, "own.example", ["vendor.example"]),
        (1, "b", 1, "m2", "m1", "vendor.example", ["own.example"]),
        (1, "c", 2, "m3", "m2", "vend0r.example", ["friend.example"]),
        (1, "d", 3, "m4", "m3", "friend.example", ["own.example"]),
        (1, "e", 4, "m1", "m2", "vend0r.example", []),
        (1, "f", 5, "m5", "m2", "mail.vendor.example", []),
        (2, "g", 0, None, None, "lone.example", []),
    ]
    mail = spark.createDataFrame(rows, "conversation int, id string, arrival int, message_id string, in_reply_to string, party string, to_parties array<string>")
    assert {r["id"] for r in L.newcomers(mail).collect() if r["newcomer"]} == {"c", "d", "e"}


def _walked(rows):
    """Newcomers of one conversation, message by message."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    owner, forged = {}, set()
    for r in rows:
        if r[3] is not None and owner.setdefault(r[3], r)[5] != r[5]:
            forged.add(r[1])
    up = {r[1]: owner.get(r[4]) for r in rows}

    def depth(r):
        steps, seen = 0, {r[1]}
        while up[r[1]] is not None:
            r, steps = up[r[1]], steps + 1
            if r[1] in seen:
                return 0
            seen.add(r[1])
        return steps

    starts = [r for r in rows if r[1] not in forged and up[r[1]] is None] or rows
    answered = lambda r: r[3] is not None and any(o[4] == r[3] and o[5] != r[5] for o in rows)
    root = min(starts, key=lambda r: (r[2], not answered(r), r[1]))
    parties = {root[5], *(root[6] or [])} - {""}
    anyone, new = root[6] is None, set(forged)
    for r in sorted(rows, key=lambda r: (depth(r), r[2], r[1])):
        if r[1] == root[1] or r[1] in forged:
            continue
        near = r[5] in parties or ("@" not in r[5] and any("@" not in p and r[5].endswith("." + p) for p in parties))
        if not r[5] or not (near or anyone):
            new.add(r[1])
        else:
            parties |= {r[5], *(r[6] or [])} - {""}
            anyone = anyone or r[6] is None
    return new


def test_newcomers_by_rounds_are_those_of_a_walk(spark):
    import random

    from ledgerloom.operators import links as L

    rng, rows = random.Random(5), []
    names = ["a.example", "b.example", "mail.a.example", "x.mail.a.example", "xa.example", "c.example", "d.example", "e@free.example", "free.example", ""]
    for c in range(120):
        n = rng.choice([1, 2, 3, 8, 25])
        for i in range(n):
            up = rng.choice([None, f"m{c}-{max(0, i - 1)}", f"m{c}-{max(0, i - 1)}", f"m{c}-{rng.randrange(n)}", "gone"])
            own = rng.choice([f"m{c}-{i}"] * 8 + [f"m{c}-{rng.randrange(n)}", None])
            to = None if rng.random() < 0.02 else rng.sample(names, rng.choice([0, 0, 1, 2]))
            rows.append((c, f"{c}-{i:02}", rng.choice([i, i, i // 2, n - i]), own, up, rng.choice(names), to))
    # a long chain of answers, each of which brings in the next party
    rows += [(500, f"{i:03}", 12 - i, f"k{i}", f"k{i - 1}" if i else None, f"p{i}.example", [f"p{i + 1}.example"]) for i in range(12)]
    rows += [(501, "y", 0, "y", "z", "y.example", ["z.example"]), (501, "z", 0, "z", "y", "z.example", [])]
    mail = spark.createDataFrame([*rows, (None, "alone", 0, None, None, "q.example", [])], "conversation int, id string, arrival int, message_id string, in_reply_to string, party string, to_parties array<string>")
    got = L.newcomers(mail).collect()
    assert len(got) == len(rows) + 1
    want = set().union(*[_walked([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}])
    assert {r["id"] for r in got if r["newcomer"]} == want and 100 < len(want) < len(rows) - 100
    assert L.newcomers(mail.limit(0)).count() == 0


def test_copies_of_invoices_by_side_and_time(spark):
    import datetime as d

    from ledgerloom.operators import links as L

    day = lambda n: d.datetime(2026, 1, n)
    rows = [  # id, number, conversation, sent, held, cautioned, replying, file, sender, reply_to, to
        ("invoice", "7", 1, day(5), False, False, False, True, "a@vendor.example", None, ["ap@own.example"]),
        ("copy", "7", 1, day(6), False, False, True, True, "a@vendor.example", None, []),
        ("earlier copy", "7", 1, day(4), False, False, True, True, "a@vendor.example", None, []),
        ("asked", "7", 1, day(6), False, False, True, False, "clerk@own.example", None, []),
        ("stranger", "7", 1, day(7), False, False, True, False, "a@vend0r.example", None, []),
        ("nobody", "7", 1, day(7), False, False, True, False, None, None, []),
        ("held", "7", 2, day(8), True, False, False, True, "x@y.example", None, []),
        ("cautioned", "7", None, day(8), False, True, False, True, "x@y.example", None, []),
        ("other", "8", 1, day(8), False, False, False, True, "x@y.example", None, []),
        ("service", "9", 3, day(1), False, False, False, True, "bill@service.example", "ar@seller.example", []),
        ("by service", "9", 3, day(2), False, False, True, False, "spam@service.example", None, []),
        ("by seller", "9", 3, day(2), False, False, True, False, "b@seller.example", None, []),
        ("none", None, 3, day(2), False, False, False, True, "b@seller.example", None, []),
    ]
    mail = spark.createDataFrame(rows, "id string, invoice string, conversation int, sent timestamp, held boolean, cautioned boolean, replying boolean, file boolean, sender string, reply_to string, `to` array<string>")
    mail = mail.withColumn("names", L.side_names(F.col("sender"))).withColumn("sides", L.sides(F.col("sender"), F.col("reply_to"), F.col("to")))
    # held mail counts for the doubtful alone; the copy sent later isn't held against the invoice, the earlier one is
    got = {r["id"]: r["others"] for r in L.duplicate_invoices(mail).collect()}
    assert got == {"invoice": 2, "copy": 3, "earlier copy": 3, "stranger": 3, "nobody": 3, "held": 7, "cautioned": 7, "by service": 1}


def test_pairs_by_rare_words_lose_none(spark):
    import random

    from ledgerloom.operators import lookup

    rng = random.Random(3)
    names = {i: {f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 9))} for i in range(150)}
    words = spark.createDataFrame([(i, w) for i, s in names.items() for w in s] + [(None, "w1"), (3, None)], "i int, w string")
    want = {(a, b) for a in names for b in names if a < b and 5 * len(names[a] & names[b]) >= 3 * len(names[a])}
    assert {tuple(r) for r in R.word_overlap(words, "i", "w", 0.6).collect()} == want and len(want) > 100
    months = {i: set(rng.sample(range(6), rng.randrange(1, 7))) for i in names}
    cells = spark.createDataFrame([(i, m, w) for i, s in names.items() for w in s for m in months[i]], "sheet int, month int, value string")
    alike = {(a, b) for a in names for b in names if a < b and len(months[a] & months[b]) >= 3 and 5 * len(names[a] & names[b]) >= 2 * len(names[a] | names[b])}
    assert {(r["a"], r["b"]) for r in lookup.families(cells).collect()} == alike and len(alike) >= 50
    found = lookup.profile(words, ["w"], ["i"]).collect()
    assert {r["column"]: (r["filled"], list(r["samples"])) for r in found} == {"w": (words.filter("w is not null").count(), sorted(set().union(*names.values()))[:3]), "i": (words.filter("i is not null").count(), [])}
    assert [r["samples"] for r in lookup.profile(words.limit(0), ["w"], []).collect()] == [[]]


def test_sinks_can_run_again(spark, tmp_path):
    from ledgerloom.sources import sinks, text_tables

    rows = spark.createDataFrame([(1, "=SUM(A1)", 2.0), (2, "fine", 3.0)], "id int, name string, v double")
    path = str(tmp_path / "t")
    sinks.upsert_table(rows, path, -1, ["id"])
    new = spark.createDataFrame([(2, "changed", 9.0), (3, "more", 1.0)], "id int, name string, v double")
    for _ in range(2):
        assert sorted(map(tuple, spark.read.parquet(sinks.upsert_table(new, path, 0, ["id"], keep=["v"])).collect())) == [(1, "=SUM(A1)", 2.0), (2, "changed", 3.0), (3, "more", 1.0)]
        sinks.export_csv(rows, str(tmp_path / "csv"))
        sinks.export_json(rows, str(tmp_path / "json"))
        sinks.write_digest(rows.withColumn("day", F.lit("2024-01-01")), str(tmp_path / "digest"))
        sinks.write_files(rows, str(tmp_path / "files"), "id", "name")
    assert [r["name"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("id").collect()] == ["'=SUM(A1)", "fine"]
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "digest")).count() == 2
    assert "- v: 2.0" in spark.read.parquet(str(tmp_path / "digest")).filter("id = 1").first()["markdown"]
    (tmp_path / "in.csv").write_text('id;name;v\n1;5" pipe;2.5\n2;"a; b";3\n3;bad;x\n')
    read = text_tables.delimited(spark, str(tmp_path / "in.csv"), "id int, name string, v double")
    good = sinks.quarantine(read, str(tmp_path / "bad"))
    assert sorted(map(tuple, good.collect())) == [(1, "5 pipe", 2.5), (2, "a; b", 3.0)] and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_drop_folder_as_table_and_stream(spark, tmp_path):
    from ledgerloom.sources import text_tables

    for name, size in (("a.pdf", 900), ("a.meta.json", 20), ("b.csv", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = text_tables.drop_folder(spark, str(tmp_path))
    got = {r["batch"]: (r["main"].rpartition("/")[2], len(r["sidecars"])) for r in text_tables.batches(files).collect()}
    assert got == {"a": ("a.pdf", 1), "b": ("b.csv", 0)}
    assert text_tables.drop_folder(spark, str(tmp_path), settled_before="2000-01-01T00:00:00").count() == 0
    out = text_tables.drop_folder(spark, str(tmp_path), stream=True).writeStream.format("memory").queryName("dropped").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.table("dropped").count() == 3


@pytest.mark.parametrize(
    "written, out",
    [("Order_v2 FINAL (1).xlsx", "order"), ("Budget.csv", "budget"), ("Copy of copy of Plan 3.1.2024.doc", "plan"), ("Plan 20240230 12-31-24.txt", "plan"), ("Plan 2024-13-01.txt", "plan 2024 13 01"), ("v2 final.txt", ""), ("Finally new_york.txt", "finally york"), (None, None), ("-" * 50_000 + " " * 50_000 + "x", "x")],
)
def test_file_stems(spark, written, out):
    assert spark.createDataFrame([(written,)], "c string").select(T.file_stem(F.col("c"))).first()[0] == out


@pytest.mark.parametrize("said, day", [("EOD", "2024-12-30"), ("Monday", "2025-01-06"), ("January 5", "2025-01-05"), ("December 28", "2024-12-28"), ("2/29", None), ("May 5, 2025", "2025-05-05"), ("whenever", None)])
def test_due_dates(spark, said, day):
    got = spark.createDataFrame([(said,)], "c string").select(T.due_date(F.col("c"), F.lit("2024-12-30").cast("date")).cast("string")).first()[0]
    assert got == day or said == "2/29"


def test_expressions_other_than_arithmetic_are_refused():
    for bad in ("__import__('os')", "a; b", "f(1)", "a + (select 1)", "zz + 1"):
        with pytest.raises(ValueError):
            T.calculate(bad, {"a", "b"})


def test_a_wrong_subtotal_is_found(spark):
    rows = spark.createDataFrame([(1, 10.0, False), (2, 5.5, False), (3, 15.5, True), (4, 2.0, False), (5, 3.0, True)], "at int, v double, t boolean")
    assert [r["holds"] for r in O.subtotals(rows, "v", F.col("t"), ["at"]).orderBy("at").collect()] == [True, False]


def test_closure_joins_chains(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (9, "z"), (4, "c"), (3, "c")], "n long, k string")
    assert {r["n"]: r["root"] for r in R.closure(pairs, "n", "k").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_stream_goes_on_from_its_checkpoint(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    arrived, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for low, high in ((0, 500), (500, 1000)):
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(arrived)
        S.drain(S.once(S.arrive(spark, arrived, events.schema), ["event_id"], "ts", "60 days"), out, at)
        S.drain(S.once(S.arrive(spark, arrived, events.schema), ["event_id"], "ts", "60 days"), out, at)
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == events.count()


@pytest.mark.parametrize(
    "every, limit, want",
    [
        ([True, False], 2, [(1, 0, 1), (2, 0, 2)]),  # enough hits, one with every term: words only
        ([True, False], 3, [(1, 0, 1), (2, 0, 2), (8, 1, 1)]),  # too few hits: words first
        ([False, False], 4, [(8, 0, 1), (9, 0, 3), (1, 1, 1), (2, 1, 2)]),  # none with every term: meaning first
        ([], 5, [(8, 0, 1), (2, 0, 2), (9, 0, 3)]),
    ],
)
def test_fusion_order(spark, every, limit, want):
    words = spark.createDataFrame([(i + 1, e, i + 1) for i, e in enumerate(every)], "id bigint, every boolean, rank int")
    meaning = spark.createDataFrame([(8, 1), (2, 2), (9, 3)], "id bigint, rank int")
    assert [tuple(r) for r in search.fuse(words, meaning, "id", limit).collect()] == want


def test_hybrid_searches_the_whole_tables(spark, sf):
    from ledgerloom.catalog import QUERIES

    texts = {r["doc_id"]: f"{r['source']} {r['text']}".lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    near = {r["vec_id"] for r in QUERIES["rk03_vector_search"](spark, sf).collect()}
    got = [r["doc_id"] for r in QUERIES["rk04_hybrid"](spark, sf).collect()]
    assert got and len(set(got)) == len(got)
    assert all(i in near or "then" in texts[i] or "on" in texts[i] for i in got)


def test_medians_of_ties_nulls_and_skewed_values(spark):
    import random
    import statistics

    deal = random.Random(5)
    groups = {"a": [1.0], "b": [2.0, 5.0], "c": [7.0] * 50 + [1e9, -3.0], None: [deal.expovariate(1) ** 6 for _ in range(501)], "d": [deal.choice([0.0, 1.0, 4.0]) for _ in range(400)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    got = {r["g"]: r["middle"] for r in R.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins=16).collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()})


def test_nearest_of_other_kinds_with_tied_values(spark):
    import random

    deal = random.Random(6)
    rows = [(i, i % 3, deal.choice("xyz"), float(deal.randrange(12))) for i in range(120)] + [(500, 0, "x", None), (501, 9, "x", 1.0)]
    got = R.nearest_of_other_kinds(spark.createDataFrame(rows, "id long, k long, t string, v double"), "id", "k", "t", ["x", "y", "z"], "v", most=2)
    want = set()
    for i, k, t, v in rows:
        other = [(abs(v - w), j) for j, h, u, w in rows if h == k and u != t and v is not None and w is not None]
        want |= {(i, j) for _, j in sorted(other)[:2]}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 10_000])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, n):
    """In order, and with shuffled numbers, whose least neighbours say little about the way to the end."""
    import random

    at = list(range(n))
    random.Random(n).shuffle(at)
    for number in (lambda i: i, lambda i: at[i]):
        edges = spark.createDataFrame([(number(i), number(max(0, i - 1))) for i in range(n)], "a bigint, b bigint")
        roots, rounds = R.contracted(edges)
        assert roots.select("root").distinct().count() == 1 and roots.count() == n and rounds <= 18


def test_closure_of_stars_rings_and_lone_nodes(spark):
    rows = [(i, 0) for i in range(50)] + [(100 + i, 1000 + (i + d) % 30) for i in range(30) for d in (0, 1)] + [(777, 5), (None, 6), (3, 3000), (101, 3000)]
    got = {r["n"]: r["root"] for r in R.closure(spark.createDataFrame(rows, "n bigint, k bigint").filter("n is not null"), "n", "k").collect()}
    assert got == {**{i: 0 for i in range(50)}, **{100 + i: 0 for i in range(30)}, 777: 777}
