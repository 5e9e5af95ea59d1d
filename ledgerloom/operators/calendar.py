"""Recurring events and invitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(df: DataFrame, start: str, until: str, step: str, most: int = 400, skipped: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A row with ``day`` for each occurrence from start to until (inclusive), up to ``most``; skipped (key, day) are left out."""
    days = F.slice(F.sequence(F.col(start), F.greatest(F.col(start), F.col(until)), F.expr(f"interval {step}")), 1, most)
    out = df.withColumn("day", F.explode(days))
    return out.join(skipped, [key, "day"], "left_anti") if skipped is not None else out


def unfolded(text: Column) -> Column:
    """The lines of a calendar file: a line that begins with a space or a tab continues the one before."""
    return F.split(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n[ \t]", ""), "\n")


def field(lines: Column, name: str) -> Column:
    """The value of the first line of a name, parameters left out; null without one."""
    own = F.filter(lines, lambda x: x.rlike(rf"(?i)^{name}[:;]"))
    return F.get(F.transform(own, lambda x: F.regexp_replace(x, r'^[^:"]*(?:"[^"]*"[^:"]*)*:', "")), F.lit(0))


def stamp(value: Column) -> Column:
    """A time as calendars write it: 20240105T090000Z, or a day."""
    bare = F.regexp_replace(value, "Z$", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(bare, F.lit("yyyyMMdd")))


def events(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, uid, sequence, summary, organizer, starts, ends, rule, skipped, moved) of every VEVENT of calendar files."""
    whole = F.array_join(unfolded(F.col(text)), "\n")
    block = F.explode(F.regexp_extract_all(whole, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), 1))
    at = files.select(key, block.alias("_b")).withColumn("_x", F.split("_b", "\n"))
    x = F.col("_x")
    skipped = F.transform(F.filter(F.split(F.coalesce(field(x, "EXDATE"), F.lit("")), ","), lambda v: v != ""), lambda v: stamp(v))
    return at.select(
        key,
        field(x, "UID").alias("uid"),
        F.coalesce(field(x, "SEQUENCE").try_cast("int"), F.lit(0)).alias("sequence"),
        F.regexp_replace(field(x, "SUMMARY"), r"\\([,;])", "$1").alias("summary"),
        F.lower(F.regexp_replace(field(x, "ORGANIZER"), "(?i)^mailto:", "")).alias("organizer"),
        stamp(field(x, "DTSTART")).alias("starts"),
        stamp(field(x, "DTEND")).alias("ends"),
        field(x, "RRULE").alias("rule"),
        skipped.alias("skipped"),
        stamp(field(x, "RECURRENCE-ID")).alias("moved"),
    )


def rule_part(rule: Column, name: str) -> Column:
    return F.nullif(F.upper(F.regexp_extract(rule, rf"(?i)(?:^|;){name}=([^;]+)", 1)), F.lit(""))


def expanded(series: DataFrame, low: Column, high: Column, most: int = 400) -> DataFrame:
    """One row with ``at`` for each occurrence of (.., starts, rule, skipped) between low and high, ``most`` of a series at most.

    Daily, weekly (with BYDAY), monthly and yearly rules with INTERVAL, COUNT
    and UNTIL are walked by sequences of steps within the window. Rules more
    often than daily are refused: such a series keeps its first time only.
    Months without the day are left out. COUNT counts what EXDATE skips.
    """
    freq, every = rule_part(F.col("rule"), "FREQ"), F.greatest(F.lit(1), F.coalesce(rule_part(F.col("rule"), "INTERVAL").try_cast("int"), F.lit(1)))
    count, until, by_day = rule_part(F.col("rule"), "COUNT").try_cast("int"), stamp(rule_part(F.col("rule"), "UNTIL")), rule_part(F.col("rule"), "BYDAY")
    starts = F.col("starts")
    last = F.least(high, F.coalesce(until, high))
    days = F.greatest(F.lit(0), F.date_diff(last, starts))
    walk = lambda n, f: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n).cast("int")), f)
    names = F.array(*[F.lit(d) for d in ("MO", "TU", "WE", "TH", "FR", "SA", "SU")])
    monday = F.timestamp_seconds(F.unix_seconds(starts) - F.weekday(starts) * 86400)
    plus = lambda t, n: F.timestamp_seconds(F.unix_seconds(t) + n.cast("long") * 86400)
    chosen = F.when(by_day.isNull(), F.array(F.weekday(starts))).otherwise(F.transform(F.filter(F.split(by_day, ","), lambda d: F.array_contains(names, d)), lambda d: (F.array_position(names, d) - 1).cast("int")))
    weeks = F.flatten(walk(F.floor(days / (7 * every)) + 1, lambda i: F.transform(F.array_sort(chosen), lambda d: plus(monday, i * every * 7 + d))))
    clock = F.unix_seconds(starts) - F.unix_seconds(F.date_trunc("day", starts))
    months = lambda step: F.filter(
        walk(F.floor(days / (28 * step)) + 1, lambda i: F.when(F.dayofmonth(F.add_months(starts, (i * step).cast("int"))) == F.dayofmonth(starts), F.timestamp_seconds(F.unix_seconds(F.add_months(starts, (i * step).cast("int")).cast("timestamp")) + clock))),
        lambda t: t.isNotNull(),
    )
    walked = F.when(freq == "DAILY", walk(F.floor(days / every), lambda i: plus(starts, i * every))).when(freq == "WEEKLY", weeks).when(freq == "MONTHLY", months(every)).when(freq == "YEARLY", months(every * 12)).otherwise(F.array(starts))
    times = F.filter(F.coalesce(walked, F.array(starts)), lambda t: (t >= starts) & (t <= F.coalesce(until, t)))
    counted = F.when(count.isNotNull(), F.slice(times, 1, F.greatest(F.lit(1), count))).otherwise(times)
    inside = F.filter(counted, lambda t: (t >= low) & (t <= high) & ~F.coalesce(F.array_contains("skipped", t), F.lit(False)))
    return series.withColumn("at", F.explode(F.slice(inside, 1, most)))


def overridden(times: DataFrame, moved: DataFrame) -> DataFrame:
    """Occurrences (uid, at, ..) with those that a moved one (uid, moved, starts) replaces at their new time."""
    m = moved.select(F.col("uid").alias("_u"), F.col("moved").alias("_m"), F.col("starts").alias("_to"))
    return times.join(m, (F.col("uid") == F.col("_u")) & (F.col("at") == F.col("_m")), "left").withColumn("at", F.coalesce("_to", "at")).drop("_u", "_m", "_to")


def standing(invitations: DataFrame) -> DataFrame:
    """Invitations (uid, organizer, sequence, received, id) with ``replaced``: a later one of the same meeting and organizer's domain has a greater (sequence, received)."""
    domain = F.substring_index("organizer", "@", -1)
    latest = invitations.groupBy(F.col("uid").alias("_u"), domain.alias("_d")).agg(F.max(F.struct("sequence", "received", "id")).alias("_top"))
    at = invitations.join(latest, (F.col("uid") == F.col("_u")) & domain.eqNullSafe(F.col("_d")))
    return at.select(*invitations.columns, (F.struct("sequence", "received", "id") < F.col("_top")).alias("replaced"))


def cautions(invitations: DataFrame, flagged: DataFrame) -> DataFrame:
    """Invitations (id, uid, organizer) with reasons for care: another sender on the same meeting, flagged mail."""
    parties = invitations.groupBy("uid").agg((F.countDistinct("organizer") > 1).alias("_several"))
    at = invitations.join(parties, "uid").join(flagged.select("id", F.lit(True).alias("_flagged")), "id", "left")
    return at.select("id", F.array_compact(F.array(F.when(F.col("_several"), "another sender"), F.when(F.col("_flagged"), "flagged"))).alias("cautions"))


def replace_window(stored: DataFrame, new: DataFrame, at: str, low: Column, high: Column, key: str, first_seen: str) -> DataFrame:
    """What is stored outside the window, and the new rows within it; a row known before keeps when it was first seen."""
    known = stored.groupBy(F.col(key).alias("_k")).agg(F.min(first_seen).alias("_seen"))
    inside = new.filter(F.col(at).between(low, high)).join(known, F.col(key) == F.col("_k"), "left")
    inside = inside.withColumn(first_seen, F.coalesce("_seen", first_seen)).select(*stored.columns)
    return stored.filter(~F.col(at).between(low, high)).unionByName(inside)


def all_over(events_of: DataFrame, message: str, now: Column) -> DataFrame:
    """(message, over): whether everything a message invites to has ended."""
    return events_of.groupBy(message).agg((F.max("ends") < now).alias("over"))


def working_window(day: Column) -> Column:
    """The day before, weekends skipped."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def numbered(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
