import datetime as d
import random

import pytest

from ledgerloom.streaming import arrivals as A
from ledgerloom.streaming import windows as S

DAY = d.datetime(2026, 3, 1)
MAIL = "id bigint, key string, sent timestamp, invoice boolean"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_an_invoice_that_comes_last_files_the_mail_before_it_again(spark, tmp_path):
    at = lambda n: DAY + d.timedelta(days=n)
    batches = [
        [(1, "a", at(2), False), (2, "a", at(9), False), (3, "b", at(1), False), (4, None, at(1), False), (5, "a", None, False)],
        [(6, "a", at(5), True), (7, "a", at(6), False)],  # 2 again, 7 at once; 1 was sent before
        [(8, "a", at(1), True), (9, "c", at(1), True), (10, "a", at(3), None)],  # an earlier invoice: 1 again, 10 at once, the others stay
        [(11, "b", at(2), True), (12, "a", at(0), False)],  # 3 was sent before its invoice
    ]
    filing, folder = A.Refiling(spark, str(tmp_path / "state")), str(tmp_path / "in")
    for rows in batches:
        put(spark, folder, rows, MAIL)
        filing.drain(S.arrive(spark, folder, MAIL), str(tmp_path / "at"))
    got = {(r["id"], r["action"], r["batch"]) for r in filing.filed().collect()}
    assert got == {(2, "filed again", 1), (7, "filed", 1), (1, "filed again", 2), (10, "filed", 2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_the_order_of_arrival_does_not_matter_and_batches_can_run_again(spark, tmp_path, seed):
    deal = random.Random(seed)
    rows = [(i, deal.choice("abcd"), DAY + d.timedelta(hours=deal.randrange(300)), deal.random() < 0.2) for i in range(120)]
    first = {k: min((s for _, x, s, inv in rows if x == k and inv), default=None) for k in "abcd"}
    want = {i for i, k, s, inv in rows if not inv and first[k] and s >= first[k]}
    deal.shuffle(rows)
    filing = A.Refiling(spark, str(tmp_path / "state"))
    for k in range(4):
        part = spark.createDataFrame(rows[30 * k : 30 * k + 30], MAIL)
        filing(part, k)
        if k % 2:
            filing(part, k)  # as after a failure before the batch was committed
    got = [r["id"] for r in filing.filed().collect()]
    assert set(got) == want and len(got) == len(want)


LOOKS = "path string, length bigint, modified timestamp, seen timestamp"


def looks():
    s = lambda n: DAY + d.timedelta(seconds=n)
    return [
        [("grows", 1, s(0), s(0)), ("done", 5, s(-9), s(0)), ("touched", 3, s(0), s(0)), ("once", 1, s(0), s(0)), (None, 1, s(0), s(0)), ("empty", None, None, s(0))],
        [("grows", 2, s(1), s(1)), ("done", 5, s(-9), s(1)), ("touched", 3, s(1), s(1))],
        [("grows", 2, s(1), s(3)), ("done", 5, s(-9), s(2)), ("touched", 3, s(1), s(2)), ("empty", None, None, s(3))],
        [("grows", 2, s(1), s(4)), ("done", 5, s(-9), s(4)), ("touched", 3, s(1), s(4)), ("done", 6, s(4), s(5)), ("done", 6, s(4), s(8))],
    ]


SETTLED = {("done", 2), ("grows", 3), ("touched", 4), ("done", 8), ("empty", 3)}


def seconds(rows):
    return {(r["path"], int((r["seen"] - DAY).total_seconds())) for r in rows}


def test_files_leave_when_they_have_stood_still(spark, tmp_path):
    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for k, rows in enumerate(looks()):
        put(spark, folder, rows, LOOKS)
        S.drain(A.stood_still(S.arrive(spark, folder, LOOKS), 2.0), out, at)
        if k == 0:
            assert spark.read.parquet(out).count() == 0
    rows = spark.read.parquet(out).collect()
    assert seconds(rows) == SETTLED and len(rows) == len(SETTLED)


def test_a_table_of_looks_gives_the_rows_of_the_stream(spark):
    rows = A.stood_still(spark.createDataFrame([r for b in looks() for r in b], LOOKS), 2.0).collect()
    assert seconds(rows) == SETTLED and len(rows) == len(SETTLED)
