"""Whole jobs on tables and values that a review found to fail."""

import datetime as d

from pyspark.sql import functions as F

from ledgerloom.catalog import ORACLE_SQL, QUERIES
from oracle import connection, same


def put(spark, folder, **tables):
    """A folder of tables, as the queries read them."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def as_sql(spark, folder, name):
    same(spark, connection(folder), folder, QUERIES[name], ORACLE_SQL[name])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_printed_codes_are_counted_before_they_meet_the_book(spark, tmp_path):
    events = spark.range(500).select(F.concat(F.lit('{"k": '), F.col("id") % 7, F.lit("}")).alias("props"))
    part = spark.range(300).select((F.col("id") % 250).alias("p_partkey"), (F.col("id") % 9).cast("int").alias("p_size"))
    folder = put(spark, tmp_path, events=events, part=part)
    as_sql(spark, folder, "jn20_codes_printed_in_text")
    told = plan(QUERIES["jn20_codes_printed_in_text"](spark, folder))
    assert told[told.index("Join") :].count("Aggregate") == 2


def test_sessions_part_at_whole_seconds(spark, tmp_path):
    """Gaps of exactly two hours, and ones a little off whose whole seconds are two hours apart or not."""
    t0 = d.datetime(2024, 1, 1, 0, 0, 0, 900000)
    steps = [("0", 7200), ("1", 7199.2), ("2", 7199.0), ("3", 7199.9), ("4", 7200.05), ("5", 0)]
    rows = [(int(u), t0 + d.timedelta(seconds=i * s), 1.0) for u, s in steps for i in range(4)]
    events = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, value double")
    as_sql(spark, put(spark, tmp_path, events=events), "sm01_sessions")


BALANCES = [-0.0, 0.0, -0.004, -0.3, -0.5, 0.4, -0.05, 1.005, -1.005, 2.675, 0.285, -1234.5, 1234567.125, 8.345, None]


def balances(spark):
    return spark.createDataFrame(list(enumerate(BALANCES)), "c_custkey bigint, c_acctbal double")


def test_money_keeps_the_sign_of_small_figures(spark, tmp_path):
    as_sql(spark, put(spark, tmp_path, customer=balances(spark)), "sc09_money")


def test_cells_below_zero_are_quoted_when_rounding_takes_the_sign(spark, tmp_path):
    as_sql(spark, put(spark, tmp_path, customer=balances(spark)), "sc31_csv_guard")


def reads(told):
    """How often a plan reads texts by a pattern."""
    return told.count("RLIKE") + told.count("regexp_extract")


def test_a_class_reads_text_and_name_once(spark, sf):
    from ledgerloom.operators import scoring

    assert reads(plan(QUERIES["rk07_classes"](spark, sf))) <= 6
    shared = spark.createDataFrame([("New BANK details",), ("first irs-irs",), (None,)], "t string").select(scoring.said(F.col("t"), ["bank details", "irs", "new", "new bank"]).alias("s"))
    assert [sorted(r["s"]) for r in shared.collect()] == [["bank details", "new", "new bank"], ["irs"], []]
    one = lambda name: scoring.classify(F.lit(" Invoice amount DUE remit to bill to net 30"), F.lit(name), F.lit(name != ""))
    got = spark.range(1).select(one("").alias("a"), one("invoice_2.pdf").alias("b"), scoring.classify(F.lit("x"), F.lit(None), F.lit(False)).alias("c")).first()
    assert got["a"] == ("ap_invoice", 0.3 + 88 / 180) and got["b"] == ("ap_invoice", 0.35 + 113 / 180) and got["c"] is None


def test_weights_of_classes_read_text_and_name_once(spark, sf):
    assert reads(plan(QUERIES["rk08_rule_weights"](spark, sf))) <= 6


def test_weights_tell_a_class_once_for_equal_messages(spark, sf, tmp_path):
    """Messages are counted by their words below the place where these are read."""
    told = plan(QUERIES["rk08_rule_weights"](spark, sf))
    assert "Aggregate" in told[told.rindex("regexp_extract") :]
    rows = [(i, i % 11, "F") for i in range(700)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string")
    as_sql(spark, put(spark, tmp_path, orders=orders), "rk08_rule_weights")


def test_a_zone_that_many_files_define_is_expanded_once(spark, monkeypatch):
    from ledgerloom.operators import zones

    zone = lambda off: f"BEGIN:VTIMEZONE\nTZID:Ours\nBEGIN:STANDARD\nDTSTART:20200101T000000\nTZOFFSETFROM:{off}\nTZOFFSETTO:{off}\nEND:STANDARD\nEND:VTIMEZONE\n"
    event = "BEGIN:VEVENT\nUID:x\nDTSTART;TZID=Ours:20240601T120000\nDTEND;TZID=Ours:20240601T130000\nEND:VEVENT\n"
    texts = [(i, zone("+0100" if i % 2 else "-0200") + event) for i in range(40)] + [(99, event), (None, zone("+0300") + event)]
    seen, real = [], zones.transitions
    monkeypatch.setattr(zones, "transitions", lambda parts, *rest: seen.append(parts.count()) or real(parts, *rest))
    out = zones.meetings(spark.createDataFrame(texts, "file bigint, text string"), "file", "text", 2020, 2030)
    got = {r["file"]: (r["starts"] and r["starts"].hour, r["ends"] and r["ends"].hour) for r in out.collect()}
    assert got == {**{i: (11, 12) if i % 2 else (14, 15) for i in range(40)}, 99: (None, None), None: (9, 10)} and seen == [3]


def test_quotes_of_long_texts_in_time_that_grows_with_them(spark):
    """200,000 places of a phrase in one text: their starts were once added up anew for each."""
    from ledgerloom.functions import evidence

    text = "​Is it &amp; <b>оr</b> not? " + "is " * 200_000
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select("t", evidence.normalised(F.col("t")).alias("m"))
    both = df.select(evidence.evidence(F.col("t"), F.col("m"), ["is", "or"]).alias("a"), evidence.quotes(F.col("t"), ["is", "or"]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and [r["a"] and len(r["a"]) for r in both] == [200_002, None, []]
    assert [tuple(x) for x in both[0]["a"][:2]] == [("is", 1, "Is"), ("or", 16, "оr")] and both[0]["a"][-1]["start"] == len(text) - 3


def test_copies_of_a_name_make_no_pairs_and_lose_no_link(spark):
    import random

    from ledgerloom.operators import relational as R

    r = random.Random(4)
    names = {i: frozenset(r.choices("abcdefgh", k=r.randint(1, 4))) for i in range(150)}
    words = spark.createDataFrame([(i, w) for i, ws in names.items() for w in ws] + [(None, "a"), (500, None)], "i bigint, w string")
    rows = [tuple(x) for x in R.class_overlap(words, "i", "w", 0.6).collect()]
    of = {a: b for a, b, kind in rows if kind == "same"}
    near = {(a, b) for a, b, kind in rows if kind == "overlap"}
    assert of == {i: min(j for j in names if names[j] == ws) for i, ws in names.items()} and len(near) == len(rows) - len(names)
    want = {(a, b) for a in names for b in names if a != b and len(names[a] & names[b]) >= 0.6 * len(names[a]) - 1e-9}
    assert {(a, b) for a in names for b in names if a != b and (of[a] == of[b] or (of[a], of[b]) in near)} == want
    copies = spark.range(2_000_000).select("id", F.lit("bolt").alias("w"))
    assert R.class_overlap(copies, "id", "w", 0.6).agg(F.count("*"), F.max("b")).first() == (2_000_000, 0)


def dealt_by(spark, monkeypatch, name, folder="/root/testdata/sf0.01"):
    """How many parts a query deals its table into, a part for each 1,000 rows; nothing but a whole sum is dealt again."""
    import re

    from ledgerloom.operators import relational as R

    monkeypatch.setattr(R, "PART_ROWS", 1000)
    told = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"hashpartitioning\((?!_p)\w+#\w+, (\d+)\), (\w+)", told)
    assert found and {kind for _, kind in found} == {"REPARTITION_BY_NUM"}
    return {int(n) for n, _ in found}


def test_jn26_parts_grow_with_the_table(spark, monkeypatch):
    assert dealt_by(spark, monkeypatch, "jn26_candidates_unlinked") == {45}


def test_src23_parts_grow_with_the_table(spark, monkeypatch):
    assert dealt_by(spark, monkeypatch, "src23_tables_in_text") == {60}


def test_snk01_parts_grow_with_the_table(spark, monkeypatch):
    assert dealt_by(spark, monkeypatch, "snk01_replaced_children") == {60}


def test_ag23_parts_grow_with_the_table(spark, monkeypatch):
    assert dealt_by(spark, monkeypatch, "ag23_totals_by_arithmetic") == {60}


def test_ag22_parts_grow_with_the_table(spark, monkeypatch):
    assert dealt_by(spark, monkeypatch, "ag22_subtotals_hold") == {60} == dealt_by(spark, monkeypatch, "ag22_wrong_subtotals")


def test_precedents_read_the_cells_once(spark, sf):
    told = plan(QUERIES["ud08_precedents"](spark, sf))
    assert told.count("Relation") <= 3 and "l_orderkey" not in told


def test_precedents_of_copies_are_found_once(spark, monkeypatch, tmp_path):
    """Books of equal lines make cells once; lines repeat, have gaps and pass 64 and 1,024, and one book has none like it."""
    from ledgerloom.operators import formulas

    kinds = [[1], [1, 2, 3], [2, 5], [1, 63, 64, 65, 128], [1000, 1024, 3000]]
    rows = [(book, r) for book in range(400) for r in kinds[book % 5] * (1 + book % 2)] + [(777, r) for r in range(1, 300)]
    lineitem = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int").repartition(5)
    seen, real = [], formulas.precedents
    monkeypatch.setattr(formulas, "precedents", lambda cells, *rest: seen.append(cells.count()) or real(cells, *rest))
    as_sql(spark, put(spark, tmp_path, lineitem=lineitem), "ud08_precedents")
    assert seen == [2 * (sum(map(len, kinds)) + 299) + 2 * 6]


def test_sets_of_numbers_are_equal_for_equal_numbers_only(spark):
    import random

    from ledgerloom.operators import relational as R

    r = random.Random(2)
    ends = [-(1 << 31), -65, -64, -1, 0, 1, 62, 63, 64, 127, 128, (1 << 31) - 1]
    held = {k: set(r.choices(ends, k=r.randint(1, 4))) for k in range(300)} | {500: set(ends), 501: set()}
    rows = [(k, n) for k, ns in held.items() for n in [*ns, *ns]] + [(501, None), (500, None)]
    r.shuffle(rows)
    sets = R.number_sets(spark.createDataFrame(rows, "k int, n int").repartition(7), "k", "n")
    got = {x["k"]: x for x in sets.select("k", F.to_json("numbers").alias("set"), R.numbers_of(F.col("numbers")).alias("n")).collect()}
    assert {k: x["n"] for k, x in got.items()} == {k: sorted(ns) for k, ns in held.items()}
    assert len({x["set"] for x in got.values()}) == len(set(map(frozenset, held.values())))


def test_references_are_taken_apart_without_patterns(spark):
    from ledgerloom.operators import formulas

    told = plan(formulas.references(spark.createDataFrame([("S", "=A1")], "sheet string, formula string")))
    assert told.count("regexp_extract(") == 0 and told.count("regexp_extract_all(") == 1 and told.count("regexp_replace(") == 3


def test_references_are_read_apart_from_the_join(spark):
    from ledgerloom.operators import formulas

    cells = spark.createDataFrame([(1, "S", 1, 1, "=A2"), (1, "S", 2, 1, None)], "book int, sheet string, row int, col int, formula string")
    found = formulas.direct_precedents(cells)
    assert "regexp" not in plan(found) and [tuple(r) for r in found.collect()] == [(1, "S", 1, 1, "S", 2, 1)]


def test_figures_of_texts_are_read_once(spark, sf):
    told = plan(QUERIES["ex32_worked_out_figures"](spark, sf))
    assert "l_orderkey" not in told and reads(told) == 0


def test_common_words_meet_as_sets_and_lose_no_score(spark):
    """Each threshold gives what every question held against every row gives."""
    import random

    from ledgerloom.operators import questions as Q

    r = random.Random(8)
    some = ["red", "blue", "x1", "x2", "steel", "all"]
    cells = [(d, t, row, row % 4 == 3, w) for d in (1, 2) for t in (d * 10, d * 10 + 1) for row in range(12) for w in ["all", *r.sample(some[:5], r.randint(0, 3)), f"n{row % 7}"]]
    words = [(q, 1 + q % 2, w) for q in range(30) for w in r.sample([*some, "n1", "n5", "none"], r.randint(1, 5))]
    worth = lambda w: 2.0 if any(c.isdigit() for c in w) else 1.0
    want = {}
    for q, d in {(q, d) for q, d, _ in words}:
        asked = {w for p, _, w in words if p == q}
        for t in (d * 10, d * 10 + 1):
            rows = {}
            for d2, t2, row, total, w in cells:
                if (d2, t2) == (d, t):
                    rows.setdefault((row, total), set()).add(w)
            if hit := asked & set().union(*rows.values()):
                rare = hit - {"all"}
                best = [sum(map(worth, rare & ws)) - total / 2 for (_, total), ws in rows.items() if rare & ws]
                want[q, d, t] = (len(hit), float("all" in hit) + max(best, default=0.0))
    frame = spark.createDataFrame(cells, "doc int, table int, row int, is_total boolean, value string")
    asks = spark.createDataFrame(words, "question int, doc int, word string")
    for often in (0, 1, 3, 6, 10**6):
        got = {(x["question"], x["doc"], x["table"]): (x["named"], x["score"]) for x in Q.named_rows(asks, frame, often).collect()}
        assert got == want, often
    many = spark.range(40_000).select(F.lit(1).alias("doc"), F.lit(5).alias("table"), F.col("id").alias("row"), F.lit(False).alias("is_total"), F.explode(F.array(F.when(F.col("id") > 0, "bolt").otherwise("nut"), F.concat(F.lit("n"), F.col("id")))).alias("value"))
    wide = spark.range(40_000).select(F.col("id").alias("question"), F.lit(1).alias("doc"), F.explode(F.array(F.lit("bolt"), F.concat(F.lit("n"), F.col("id")))).alias("word"))
    assert Q.named_rows(wide, many).groupBy("score").count().orderBy("score").collect() == [(2.0, 1), (3.0, 39_999)]


def test_all_wildcards_of_a_text_are_tested_by_one_worker(spark, sf, tmp_path):
    """Each iterator of arrays is a node, and so a Python process for each task, of its own."""
    told = QUERIES["sc14_wildcards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert told.count("+- ArrowEvalPython") + told.count("*- ArrowEvalPython") == 1
    texts = [None, "", "Été", "ÉÄT 100% a", "BUT", "A%", "Cz\nZEAxTẞ", "a" * 60 + "q12z", "ÀÉßT" * 9]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    as_sql(spark, put(spark, tmp_path, documents=documents), "sc14_wildcards")


def test_a_cell_is_written_out_once_however_often_it_is_looked_at(spark, sf):
    from ledgerloom.functions import text as T

    assert plan(QUERIES["sc08_cell_numbers"](spark, sf)).count("format_number") == 2
    cells = {"(1,234.50)": -1234.5, "1.234,5 cr": -1234.5, "USD 7-": -7, "–": 0, " 6.3\t%": 6.3, "1.234": 1234, "1,5": 1.5, "1,500": 1500, "$ .5": 0.5, "(": None, "CRX 5": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r["n"] for r in df.select("c", T.cell_number(F.col("c")).cast("double").alias("n")).collect()}
    assert got == cells


def test_toxicity_counts_and_learns_every_labelled_text(spark, monkeypatch):
    """Several parts, and pools smaller than a part."""
    from ledgerloom.llm import toxicity

    seen, real = [], toxicity.begin
    monkeypatch.setattr(toxicity, "begin", lambda held, n, rng: seen.append(n) or real(held, n, rng))
    rows = [(i, f"{'vile' if i % 3 == 0 else 'calm'} words of {i % 7}", int(i % 3 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("lang", F.lit("en"))
    net = toxicity.train(frame, frame, part_rows=200, max_words=300)
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", toxicity.score(net, F.col("text"), spark).alias("s")).collect()}
    assert seen[-1] == (400, 200) and sum(seen[0]) < 600 and all((got[i] > 0.5) == bool(y) for i, _, y in rows)


def test_toxicity_shuffles_labelled_texts_only_and_leaves_no_shuffle_files(spark, monkeypatch):
    """Long texts without a label cost no shuffle, a round's shuffle files go when it ends, and parts keep their size."""
    from ledgerloom.llm import toxicity

    stored, real = [], toxicity.fit_parts
    monkeypatch.setattr(toxicity, "fit_parts", lambda texts, *rest: stored.append(len(texts.inputFiles())) or real(texts, *rest))
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def files():
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    labelled = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "vile words").otherwise("calm words").alias("text"))
    others = spark.range(1000, 1200).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256)), " "))
    docs = labelled.union(others).withColumn("lang", F.lit("en"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, there = written(), files()
        net = toxicity.train(docs, labels, part_rows=100)
        moved, left = written() - before, files() - there
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = docs.filter("doc_id < 300").select("doc_id", toxicity.score(net, F.col("text"), spark).alias("s")).collect()
    assert moved < 1_000_000 and not left and stored == [3, 3] and all((r["s"] > 0.5) == (r["doc_id"] % 3 == 0) for r in got)
