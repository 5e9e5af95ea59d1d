"""Times of calendar files in the zones they name, or define themselves by VTIMEZONE."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import field, rule_part, stamp, unfolded

#: Common names of zones in Windows, and the IANA zone each stands for.
WINDOWS_ZONES = {
    "AUS Eastern Standard Time": "Australia/Sydney", "Arabian Standard Time": "Asia/Dubai", "Atlantic Standard Time": "America/Halifax", "Central Europe Standard Time": "Europe/Budapest", "Central European Standard Time": "Europe/Warsaw",
    "Central Standard Time": "America/Chicago", "China Standard Time": "Asia/Shanghai", "E. South America Standard Time": "America/Sao_Paulo", "Eastern Standard Time": "America/New_York", "FLE Standard Time": "Europe/Kiev",
    "GMT Standard Time": "Europe/London", "GTB Standard Time": "Europe/Bucharest", "Hawaiian Standard Time": "Pacific/Honolulu", "India Standard Time": "Asia/Calcutta", "Israel Standard Time": "Asia/Jerusalem",
    "Korea Standard Time": "Asia/Seoul", "Mountain Standard Time": "America/Denver", "New Zealand Standard Time": "Pacific/Auckland", "Pacific Standard Time": "America/Los_Angeles", "Romance Standard Time": "Europe/Paris",
    "SE Asia Standard Time": "Asia/Bangkok", "Singapore Standard Time": "Asia/Singapore", "South Africa Standard Time": "Africa/Johannesburg", "Tokyo Standard Time": "Asia/Tokyo", "Turkey Standard Time": "Europe/Istanbul",
    "US Mountain Standard Time": "America/Phoenix", "UTC": "Etc/UTC", "W. Europe Standard Time": "Europe/Berlin",
}
_DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def named_zone(name: Column) -> Column:
    """The IANA zone of an IANA or Windows name, whatever its case; null for other names."""
    known = {z.lower(): z for z in sorted(available_timezones()) if "/" in z or z == "UTC"} | {k.lower(): v for k, v in WINDOWS_ZONES.items()}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(F.trim(name))]


def offset_seconds(written: Column) -> Column:
    """-0500, +05:30 or +013000 as seconds; null for anything else."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(written, r"^([+-])(\d{2}):?(\d{2})(\d{2})?$", i), F.lit("")).cast("long"), F.lit(0))
    sign = F.when(F.startswith(written, F.lit("-")), -1).otherwise(1)
    return F.when(written.rlike(r"^[+-]\d{2}:?\d{2}(\d{2})?$"), sign * (part(2) * 3600 + part(3) * 60 + part(4)))


def _blocks(lines: Column, name: str) -> Column:
    return F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(rf"(?is)BEGIN:{name}\n(.*?)\nEND:{name}\b"), 1)


def zone_texts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tzid, _z): the text of each zone that files define; of a zone defined twice, the first."""
    zones = files.select(key, F.posexplode(_blocks(unfolded(F.col(text)), "VTIMEZONE")).alias("_i", "_z"))
    zones = zones.withColumn("tzid", field(F.split("_z", "\n"), "TZID")).filter("tzid is not null")
    return zones.groupBy(key, "tzid").agg(F.min_by("_z", "_i").alias("_z"))


def zone_parts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tzid, standard, starts, before, after, rule) of the STANDARD and DAYLIGHT parts of the zones that files define; of a zone defined twice, the first."""
    return parts_of(zone_texts(files, key, text), key)


def parts_of(texts: DataFrame, key: str) -> DataFrame:
    """zone_parts() of zones (key, tzid, _z) whose texts are cut out already."""
    part = lambda name: F.transform(_blocks(F.split("_z", "\n"), name), lambda b: F.struct(F.lit(name == "STANDARD").alias("standard"), F.split(b, "\n").alias("x")))
    each = texts.select(key, "tzid", F.explode(F.concat(part("STANDARD"), part("DAYLIGHT"))).alias("p")).select(key, "tzid", "p.*")
    x = F.col("x")
    return each.select(key, "tzid", "standard", stamp(field(x, "DTSTART")).alias("starts"), offset_seconds(field(x, "TZOFFSETFROM")).alias("before"), offset_seconds(field(x, "TZOFFSETTO")).alias("after"), field(x, "RRULE").alias("rule")).filter("after is not null")


def day_of_rule(year: Column, month: Column, by_day: Column, by_month_day: Column) -> Column:
    """The day of a month that BYDAY (2SU, -1SU) or BYMONTHDAY names; with both, the first such weekday from that day on."""
    first = F.make_date(year, month, F.lit(1))
    weekday = F.array_position(F.array(*[F.lit(d) for d in _DAYS]), F.upper(F.substring(by_day, -2, 2))) - 1
    nth = F.nullif(F.regexp_extract(by_day, r"^([+-]?\d+)", 1), F.lit("")).cast("int")
    on = lambda day: F.date_add(day, F.pmod(weekday - F.weekday(day), F.lit(7)).cast("int"))
    last = F.last_day(first)
    back = F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)).cast("int"))
    counted = F.when(nth > 0, F.date_add(on(first), (7 * (nth - 1)).cast("int"))).when(nth < 0, F.date_add(back, (7 * (nth + 1)).cast("int")))
    fixed = F.date_add(first, by_month_day - 1)
    return F.when(by_day.isNotNull() & by_month_day.isNotNull(), on(fixed)).when(by_day.isNotNull(), counted).otherwise(fixed)


def transitions(parts: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """(key, tzid, changes): each defined zone's changes of the clock, from the last before the year ``low`` through ``high``, in order.

    A change has ``at``, the wall time before it, ``before`` and ``after``, seconds
    east of UTC. Yearly rules are expanded for each year from their start to their
    UNTIL; RDATE is not read. A zone with a rule that isn't a plain yearly one
    keeps its standard offset all year.
    """
    rule, by_day = F.col("rule"), rule_part(F.col("rule"), "BYDAY")
    month = F.coalesce(rule_part(rule, "BYMONTH").try_cast("int"), F.month("starts"))
    month_day = F.coalesce(F.regexp_extract(rule_part(rule, "BYMONTHDAY"), r"^(\d{1,2})", 1).try_cast("int"), F.when(by_day.isNull(), F.dayofmonth("starts")))
    plain = rule.isNull() | ((rule_part(rule, "FREQ") == "YEARLY") & F.coalesce(rule_part(rule, "INTERVAL").try_cast("int") == 1, F.lit(True)) & month.between(1, 12) & (by_day.isNull() | by_day.rlike(r"^([+-]?[1-5])?(MO|TU|WE|TH|FR|SA|SU)$")) & (by_day.isNull() | by_day.rlike(r"^[+-]?\d") | month_day.isNotNull()))
    sound = parts.groupBy(key, "tzid").agg(F.bool_and(plain & F.col("starts").isNotNull()).alias("_plain"), F.coalesce(F.min(F.when(F.col("standard"), F.col("after"))), F.min("after")).alias("_standard"))
    at = parts.join(sound, [key, "tzid"]).filter("_plain")
    years = F.when(rule.isNull(), F.array(F.year("starts"))).otherwise(F.filter(F.sequence(F.greatest(F.year("starts"), F.lit(low - 1)), F.greatest(F.year("starts"), F.lit(high))), lambda y: y <= high))
    at = at.withColumn("_y", F.explode(years))
    clock = F.unix_seconds("starts") - F.unix_seconds(F.date_trunc("day", "starts"))
    when = F.when(rule.isNull(), F.col("starts")).otherwise(F.timestamp_seconds(F.unix_seconds(day_of_rule(F.col("_y"), month, by_day, month_day).cast("timestamp")) + clock))
    until = stamp(rule_part(rule, "UNTIL"))
    at = at.withColumn("at", when).filter((F.col("at") >= F.col("starts")) & F.coalesce(F.unix_seconds("at") - F.col("before") <= F.unix_seconds(until), F.lit(True)))
    change = F.struct("at", F.coalesce("before", "after").alias("before"), "after")
    made = at.groupBy(key, "tzid").agg(F.array_sort(F.collect_set(change)).alias("changes"))
    none = F.array().cast("array<struct<at:timestamp,before:bigint,after:bigint>>")
    return sound.join(made, [key, "tzid"], "left").select(key, "tzid", F.coalesce("changes", none).alias("changes"), F.col("_standard").alias("standard"))


def offset_at(local: Column, changes: Column, standard: Column) -> Column:
    """The offset of a wall time: that after the last change before it. A time that a change skips or repeats has the offset before the change."""
    passed = F.filter(changes, lambda c: F.unix_seconds(c["at"]) + F.greatest(F.lit(0), c["after"] - c["before"]) <= F.unix_seconds(local))
    first = F.coalesce(F.get(changes, F.lit(0))["before"], standard)
    return F.when(F.size(passed) > 0, F.element_at(passed, -1)["after"]).otherwise(first)


def in_utc(times: DataFrame, zones: DataFrame, key: str, local: str, zone: str, out: str, default: str = "UTC") -> DataFrame:
    """Times with ``out``: a wall time as UTC, by the zone it names.

    An IANA or Windows name counts first, then a zone that the file of the same
    key defines, then an offset in the name such as "(UTC-05:00)"; an unknown name
    gives null, no name the default zone. ``zones`` is what transitions() gives, one
    row for each zone of a file.
    """
    z = zones.select(F.col(key).alias("_zk"), F.col("tzid").alias("_zn"), "changes", "standard")
    at = times.withColumn("_iana", F.when(F.col(zone).isNull(), default).otherwise(named_zone(F.col(zone)))).join(z, F.col(key).eqNullSafe(F.col("_zk")) & (F.col(zone) == F.col("_zn")), "left")
    written = offset_seconds(F.regexp_extract(F.col(zone), r"\((?:UTC|GMT)\s*([+-]\d{2}:?\d{2})\)", 1))
    shift = F.when(F.col("_zn").isNotNull(), offset_at(F.col(local), F.col("changes"), F.col("standard"))).otherwise(written)
    utc = F.when(F.col("_iana").isNotNull(), F.to_utc_timestamp(F.col(local), F.col("_iana"))).otherwise(F.timestamp_seconds(F.unix_seconds(F.col(local)) - shift))
    return at.withColumn(out, utc).drop("_iana", "_zk", "_zn", "changes", "standard")


def meetings(files: DataFrame, key: str, text: str, low: int, high: int, default: str = "UTC") -> DataFrame:
    """(key, uid, zone, starts, ends, all_day) of every VEVENT, in UTC; times with Z as they are, days from midnight to midnight of the default zone.

    Without DTEND, DURATION (days, hours and minutes) tells the end, else a day counts to its end and a time ends as it starts.
    Programs write the same zone into all their files: each text of a zone is expanded once, and files meet it by its digest.
    """
    lines = unfolded(F.col(text))
    each = files.select(key, F.explode(_blocks(lines, "VEVENT")).alias("_b")).withColumn("_x", F.split("_b", "\n"))
    x = F.col("_x")

    def time(name: str) -> Column:
        line = F.get(F.filter(x, lambda v: v.rlike(rf"(?i)^{name}[:;]")), F.lit(0))
        tzid = F.nullif(F.regexp_replace(F.regexp_extract(line, r'(?i);TZID=("[^"]*"|[^;:]*)', 1), '"', ""), F.lit(""))
        value = field(x, name)
        return F.struct(stamp(value).alias("at"), F.when(F.upper(value).endswith("Z"), "UTC").otherwise(tzid).alias("zone"), value.rlike(r"^\d{8}$").alias("day"))

    span = lambda unit: F.coalesce(F.nullif(F.regexp_extract(field(x, "DURATION"), rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    length = F.when(field(x, "DURATION").isNotNull(), span("W") * 604800 + span("D") * 86400 + span("H") * 3600 + span("M") * 60)
    out = each.select(key, field(x, "UID").alias("uid"), time("DTSTART").alias("_s"), time("DTEND").alias("_e"), length.alias("_length"))
    out = out.select(key, "uid", F.col("_s.zone").alias("zone"), F.col("_s.at").alias("_from"), F.col("_e.at").alias("_to"), F.coalesce("_e.zone", "_s.zone").alias("_to_zone"), F.coalesce("_s.day", F.lit(False)).alias("all_day"), "_length")
    texts = zone_texts(files.filter(F.col(text).rlike("(?i)BEGIN:VTIMEZONE")), key, text).withColumn("_d", F.sha2("_z", 256))
    known = transitions(parts_of(texts.groupBy("_d", "tzid").agg(F.first("_z").alias("_z")), "_d"), "_d", low, high)

    def timed(rows: DataFrame, local: str, zone: str, made: str) -> DataFrame:
        own = texts.select(F.col(key).alias("_tk"), F.col("tzid").alias("_tn"), "_d")
        at = rows.join(own, F.col(key).eqNullSafe(F.col("_tk")) & (F.col(zone) == F.col("_tn")), "left").drop("_tk", "_tn")
        return in_utc(at, known, "_d", local, zone, made, default).drop("_d")

    out = timed(timed(out, "_from", "zone", "starts"), "_to", "_to_zone", "_ends")
    rest = F.coalesce("_length", F.when(F.col("all_day"), 86400).otherwise(0))
    return out.select(key, "uid", "zone", "starts", F.coalesce("_ends", F.timestamp_seconds(F.unix_seconds("starts") + rest)).alias("ends"), "all_day")
