"""Calendar shapes over the test tables."""

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import zones
from ..registry import query


@query("sm06_recurrence", "SELECT o_orderkey, unnest(range(CAST(o_orderdate AS DATE)::TIMESTAMP, (CAST(o_orderdate AS DATE) + 28)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS day FROM orders")
def _(t):
    series = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 28).alias("until"))
    return C.occurrences(series, "start", "until", "7 days").select("o_orderkey", "day")


def _file(t):
    day, k = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 4
    rule = F.when(k == 0, "RRULE:FREQ=DAILY;INTERVAL=2;COUNT=3\n").when(k == 1, "RRULE:FREQ=WEEKLY;COUNT=2\n").when(k == 2, "RRULE:FREQ=SECONDLY\n").otherwise("")
    skip = F.when(k == 0, F.concat(F.lit("EXDATE:"), F.date_format(F.date_add("o_orderdate", 2), "yyyyMMdd"), F.lit("T090000Z\n"))).otherwise("")
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u"), "o_orderkey", F.lit("\r\nSEQUENCE:"), F.col("o_orderkey") % 3, F.lit("\nSUMMARY:Call\\, order\n  "), "o_orderkey", F.lit("\nORGANIZER;CN=\"A: B\":mailto:Ann@D"), F.col("o_custkey") % 5, F.lit(".example\nDTSTART;TZID=UTC:"), day, F.lit("T090000Z\nDTEND:"), day, F.lit("T100000Z\n"), rule, skip, F.lit("END:VEVENT\nEND:VCALENDAR\n"))
    return t.orders.select("o_orderkey", text.alias("ics"))


_EVENTS = "SELECT o_orderkey, 'u' || o_orderkey AS uid, (o_orderkey % 3)::INT AS sequence, 'Call, order ' || o_orderkey AS summary, 'ann@d' || (o_custkey % 5) || '.example' AS organizer, date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS starts FROM orders"


@query("src17_calendar_files", _EVENTS)
def _(t):
    return C.events(_file(t), "o_orderkey", "ics").select("o_orderkey", "uid", "sequence", "summary", "organizer", "starts")


@query("sm06_rules", "WITH e AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS s FROM orders) SELECT o_orderkey, s + to_days(i::INT) AS at FROM e, LATERAL (SELECT unnest(CASE o_orderkey % 4 WHEN 0 THEN [0, 4] WHEN 1 THEN [0, 7] ELSE [0] END) AS i)")
def _(t):
    low, high = F.lit("1900-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    series = C.events(_file(t), "o_orderkey", "ics")
    bound = F.least(high, F.col("starts") + F.expr("interval 60 days"))
    return C.expanded(series, low, bound).select("o_orderkey", "at")


@query("ex15_replaced_invitations", "WITH i AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS uid, 'd' || (l_partkey % 3) AS dom, (l_linenumber % 4)::INT AS seq, l_shipdate AS r, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem), f AS (SELECT id * 10 + line AS id, uid, dom, seq, r FROM i WHERE n = 1) SELECT id, (seq, r, id) < max((seq, r, id)) OVER (PARTITION BY uid, dom) AS replaced FROM f")
def _(t):
    w = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(w).alias("x"))
    mail = one.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("x.l_suppkey").alias("uid"), F.concat(F.lit("a@d"), F.col("x.l_partkey") % 3).alias("organizer"), (F.col("l_linenumber") % 4).cast("int").alias("sequence"), F.col("x.l_shipdate").alias("received"))
    return C.standing(mail).select("id", "replaced")


@query("ex16_window_replaced", "WITH s AS (SELECT o_orderkey AS id, o_orderdate AS day, o_orderdate AS seen FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS id, o_orderdate AS day, TIMESTAMP '2000-01-01' AS seen FROM orders WHERE o_orderkey % 3 = 0) SELECT id, day, seen FROM s WHERE NOT day BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' UNION ALL SELECT n.id, n.day, coalesce(s.seen, n.seen) FROM n LEFT JOIN s USING (id) WHERE n.day BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'")
def _(t):
    day = lambda d: F.lit(d).cast("timestamp")
    stored = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderdate").cast("timestamp").alias("seen"))
    new = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("day"), day("2000-01-01").alias("seen"))
    return C.replace_window(stored, new, "day", day("1995-01-01"), day("1996-01-01"), "id", "seen")


@query("ex17_held_invitations", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS summary, o_orderkey % 6 = 0 AS held FROM orders")
def _(t):
    held = F.col("o_orderkey") % 6 == 0
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(~held, F.col("o_orderpriority")).alias("summary"), held.alias("held"))


@query("ex18_meeting_cautions", "WITH i AS (SELECT o_orderkey AS id, o_custkey AS uid, o_orderkey % 20 = 0 AS other FROM orders), p AS (SELECT uid, count(DISTINCT other) > 1 AS several FROM i GROUP BY uid) SELECT id, list_filter([CASE WHEN several THEN 'another sender' END, CASE WHEN id % 15 = 0 THEN 'flagged' END], lambda x: x IS NOT NULL) AS cautions FROM i JOIN p USING (uid)")
def _(t):
    organizer = F.when(F.col("o_orderkey") % 20 == 0, "x@other.example").otherwise("a@own.example")
    mail = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), organizer.alias("organizer"))
    return C.cautions(mail, mail.filter("id % 15 = 0"))


@query("ex21_local_days", "SELECT event_id, (ts - INTERVAL 5 HOUR)::DATE AS day FROM events")
def _(t):
    return t.events.select("event_id", F.to_date(F.from_utc_timestamp("ts", "-05:00")).alias("day"))


@query("ex45_all_over", "SELECT l_orderkey, max(l_shipdate) < TIMESTAMP '1997-01-01' AS over FROM lineitem GROUP BY l_orderkey")
def _(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("ends"))
    return C.all_over(rows, "l_orderkey", F.lit("1997-01-01").cast("timestamp"))


_EAST = """BEGIN:VTIMEZONE
TZID:Customized Time Zone
BEGIN:STANDARD
DTSTART:16011104T020000
RRULE:FREQ=YEARLY;BYDAY=1SU;BYMONTH=11
TZOFFSETFROM:-0400
TZOFFSETTO:-0500
END:STANDARD
BEGIN:DAYLIGHT
DTSTART:16010311T020000
RRULE:FREQ=YEARLY;BYDAY=2SU;BYMONTH=3
TZOFFSETFROM:-0500
TZOFFSETTO:-0400
END:DAYLIGHT
END:VTIMEZONE
"""


@query(
    "ex20_meetings_in_zones",
    "WITH o AS (SELECT o_orderkey AS file, o_custkey % 4 AS k, date_trunc('day', o_orderdate) + INTERVAL 34 YEAR + INTERVAL 10 HOUR + to_minutes(o_orderkey % 60) AS w FROM orders) "
    "SELECT file, CASE k WHEN 0 THEN timezone('UTC', timezone('America/New_York', w)) WHEN 1 THEN timezone('UTC', timezone('Europe/Berlin', w)) WHEN 2 THEN w ELSE w + INTERVAL 330 MINUTE END AS starts, "
    "CASE k WHEN 0 THEN timezone('UTC', timezone('America/New_York', w)) WHEN 1 THEN timezone('UTC', timezone('Europe/Berlin', w)) WHEN 2 THEN w ELSE w + INTERVAL 330 MINUTE END + INTERVAL 90 MINUTE AS ends FROM o",
)
def _(t):
    """A calendar file for each order, in a zone that the file defines, a Windows zone, UTC, or an offset in the zone's name."""
    at = F.timestamp_seconds(F.unix_seconds(F.add_months(F.to_date("o_orderdate"), 34 * 12).cast("timestamp")) + 36000 + F.col("o_orderkey") % 60 * 60)
    k = F.col("o_custkey") % 4
    zone = F.when(k == 0, ";TZID=Customized Time Zone:").when(k == 1, ";TZID=W. Europe Standard Time:").when(k == 2, ":").otherwise(';TZID="(UTC-05:30) Nowhere":')
    starts = F.concat(F.lit("DTSTART"), zone, F.date_format(at, "yyyyMMdd'T'HHmmss"), F.when(k == 2, "Z").otherwise(""))
    text = F.concat(F.lit(f"BEGIN:VCALENDAR\n{_EAST}BEGIN:VEVENT\nUID:x\n"), starts, F.lit("\nDURATION:PT1H30M\nEND:VEVENT\nEND:VCALENDAR"))
    return zones.meetings(t.orders.select(F.col("o_orderkey").alias("file"), text.alias("text")), "file", "text", 2020, 2070).select("file", "starts", "ends")
