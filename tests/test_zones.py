import datetime as d
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import zones as Z

EAST = """BEGIN:VTIMEZONE
TZID:{name}
X-LIC-LOCATION:nowhere
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
BERLIN = """BEGIN:VTIMEZONE
TZID:own
BEGIN:DAYLIGHT
DTSTART:19810329T020000
TZOFFSETFROM:+0100
TZOFFSETTO:+0200
RRULE:FREQ=YEARLY;BYMONTH=3;BYDAY=-1SU
END:DAYLIGHT
BEGIN:STANDARD
DTSTART:19961027T030000
TZOFFSETFROM:+0200
TZOFFSETTO:+0100
RRULE:FREQ=YEARLY;BYMONTH=10;BYDAY=-1SU
END:STANDARD
END:VTIMEZONE
"""


def event(uid, *lines):
    return "\n".join(["BEGIN:VEVENT", f"UID:{uid}", *lines, "END:VEVENT"]) + "\n"


def read(spark, *texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    return {(r["file"], r["uid"]): r for r in Z.meetings(frame, "file", "text", 2020, 2030, **how).collect()}


@pytest.mark.parametrize("block, name, zone", [(EAST.format(name="Customized Time Zone"), "Customized Time Zone", "America/New_York"), (BERLIN, "own", "Europe/Berlin")])
def test_times_on_both_sides_of_every_change(spark, block, name, zone):
    """Every seventh hour of seven years against the zone database, hours that a change skips or repeats included."""
    first = d.datetime(2020, 1, 1)
    times = [first + d.timedelta(hours=7 * i) for i in range(7 * 365 * 24 // 7)]
    times += [d.datetime(y, m, day, h, 30) for y in (2021, 2024, 2026) for m in (3, 10, 11) for day in range(1, 31) for h in (0, 1, 2, 3)]
    known = Z.transitions(Z.zone_parts(spark.createDataFrame([(1, block)], "file int, text string"), "file", "text"), "file", 2020, 2027)
    frame = spark.createDataFrame([(1, t, name) for t in times], "file int, at timestamp, zone string")
    got = {r["at"]: r["utc"] for r in Z.in_utc(frame, known, "file", "at", "zone", "utc").collect()}
    assert got == {t: t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(d.timezone.utc).replace(tzinfo=None) for t in times}


def test_meetings_in_named_defined_and_unknown_zones(spark):
    text = EAST.format(name="(UTC-05:00) Eastern Time (US & Canada)") + "".join([
        event("defined", 'DTSTART;TZID="(UTC-05:00) Eastern Time (US & Canada)":20260701T090000', 'DTEND;TZID="(UTC-05:00) Eastern Time (US & Canada)":20260701T100000'),
        event("iana", "DTSTART;TZID=Europe/Berlin:20260701T090000", "DURATION:PT1H30M"),
        event("windows", "DTSTART;VALUE=DATE-TIME;TZID=Pacific Standard Time:20260115T090000"),
        event("utc", "DTSTART:20260701T090000Z", "DTEND:20260701T093000Z"),
        event("floating", "DTSTART:20260701T090000"),
        event("day", "DTSTART;VALUE=DATE:20260701"),
        event("unknown", "DTSTART;TZID=Nowhere:20260701T090000"),
        event("folded", "DTSTART;TZID=Eur\n ope/Berlin:20260701T09\n 0000"),
    ])
    got = read(spark, text, event("offset", 'DTSTART;TZID="(UTC-03:30) Somewhere":20260701T090000'), "", None)
    at = lambda uid, file=0: (got[file, uid]["starts"], got[file, uid]["ends"])
    t = lambda day, h, m=0: d.datetime(2026, 7, day, h, m)
    assert at("defined") == (t(1, 13), t(1, 14)) and at("iana") == (t(1, 7), t(1, 8, 30)) and at("utc") == (t(1, 9), t(1, 9, 30))
    assert at("windows") == (d.datetime(2026, 1, 15, 17), d.datetime(2026, 1, 15, 17)) and at("floating")[0] == t(1, 9)
    assert at("day") == (t(1, 0), t(2, 0)) and got[0, "day"]["all_day"] and at("unknown") == (None, None)
    assert at("folded")[0] == t(1, 7) and at("offset", 1)[0] == t(1, 12, 30) and len(got) == 9


def test_zones_that_are_no_zones_keep_their_standard_time(spark):
    wild = EAST.format(name="wild").replace("FREQ=YEARLY;BYDAY=2SU;BYMONTH=3", "FREQ=SECONDLY")
    ended = EAST.format(name="ended").replace("BYDAY=2SU;BYMONTH=3", "BYDAY=2SU;BYMONTH=3;UNTIL=20221231T000000Z")
    once = "BEGIN:VTIMEZONE\nTZID:once\nBEGIN:STANDARD\nDTSTART:20240601T000000\nTZOFFSETFROM:+0200\nTZOFFSETTO:+0330\nEND:STANDARD\nEND:VTIMEZONE\n"
    show = lambda zone, day: event(f"{zone}{day}", f"DTSTART;TZID={zone}:{day}T120000")
    got = read(spark, wild + ended + once + wild.replace("-0500", "-0900") + show("wild", "20260701") + show("ended", "20220701") + show("ended", "20230701") + show("once", "20240531") + show("once", "20260101"))
    hour = {u: r["starts"].hour + r["starts"].minute / 60 for (_, u), r in got.items()}
    assert hour == {"wild20260701": 17, "ended20220701": 16, "ended20230701": 17, "once20240531": 10, "once20260101": 8.5}


@pytest.mark.parametrize("rule, day", [("2SU", 8), ("-1SU", 29), ("1MO", 2), ("-2FR", 20), ("5SU", 29), ("+1SU", 1)])
def test_days_of_rules(spark, rule, day):
    got = spark.range(1).select(Z.day_of_rule(F.lit(2026), F.lit(3), F.lit(rule), F.lit(None).cast("int"))).first()[0]
    assert got == d.date(2026, 3, day)
