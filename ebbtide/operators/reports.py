"""What is shown or exported: calendar, cards, memory checklist, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import dates, money
from ebbtide.functions.text import ics_escape
from ebbtide.operators.portfolio import is_counted
from ebbtide.sources import dictionary

# Recurrence rules; the calendar's head and foot (the maker's name is this library's own).
RULES = {"weekly": "FREQ=WEEKLY", "monthly": "FREQ=MONTHLY", "quarterly": "FREQ=MONTHLY;INTERVAL=3", "yearly": "FREQ=YEARLY"}
HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//ebbtide//FR", "CALSCALE:GREGORIAN", "METHOD:PUBLISH")
FOOT = "END:VCALENDAR"
DOMAIN = "ebbtide"


def fold(line: Column) -> Column:
    """Lines of over 75 octets broken as calendar files want it (74 after the first), no character cut."""

    def broken(text: str) -> str:
        parts, size = [""], 0
        for c in text:
            n = len(c.encode())
            if size + n > (75 if len(parts) == 1 else 74):
                parts.append("")
                size = 0
            parts[-1] += c
            size += n
        return "\r\n ".join(parts)

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield lines.map(lambda x: x if x is None or len(x) <= 18 else broken(x))

    return folded(line)


def calendar_events(items: DataFrame, today: Column, now: Column) -> DataFrame:
    """(id, type_ord, type, lines): the unfolded lines of each event from today on."""
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    priced = F.coalesce(text(" (", money.format_euros(F.col("amount_cents")), ")"), F.lit(""))
    name = F.col("display_name")

    def event(date: Column, kind: str, rule: Column, summary: Column, description: Column, alarm: Column, trigger: str) -> Column:
        lines = F.array(
            F.lit("BEGIN:VEVENT"), text("UID:", F.col("id"), f"-{kind}@{DOMAIN}"), text("DTSTAMP:", dates.stamp(now)), text("DTSTART;VALUE=DATE:", dates.compact_date(date)),
            text("DTEND;VALUE=DATE:", dates.compact_date(F.date_add(date, 1))), text("RRULE:", rule), text("SUMMARY:", ics_escape(summary)), text("DESCRIPTION:", ics_escape(description)),
            F.lit("BEGIN:VALARM"), F.lit("ACTION:DISPLAY"), text("DESCRIPTION:", ics_escape(alarm)), F.lit(f"TRIGGER:{trigger}"), F.lit("END:VALARM"), F.lit("END:VEVENT"),
        )
        return F.when(date >= today, F.filter(lines, lambda x: x.isNotNull()))

    trial = event(
        F.col("trial_ends_at"), "trial", F.lit(None).cast("string"), text("Fin de l'essai gratuit : ", name),
        text("L'essai se termine aujourd'hui", F.when(priced != "", text(", ensuite", priced)).otherwise(""), ". Résilie avant si tu ne veux pas le garder."), text("Fin d'essai dans 2 jours : ", name), "-P2D",
    )
    renewal = event(
        F.col("next_renewal"), "renewal", dictionary.label_of(F.col("period"), RULES), text("Renouvellement : ", name, priced),
        text("Prélèvement attendu ", dictionary.label_of(F.col("period"), dictionary.PERIOD_LABELS), ". Date estimée à partir de tes captures."), text("Demain : ", name, priced), "-P1D",
    )
    shown = items.where((is_counted() | (F.col("status") == "pending")) & (F.col("user_status") != "cancelled") & (F.col("status") != "rejected"))
    both = F.array(*(F.struct(F.lit(i).alias("type_ord"), F.lit(t).alias("type"), e.alias("lines")) for i, (t, e) in enumerate((("trial", trial), ("renewal", renewal)))))
    return shown.select("*", F.inline(both)).where("lines is not null")


def calendar_lines(items: DataFrame, today: Column, now: Column) -> DataFrame:
    """Folded lines, each with its event and place, ready to be written in order."""
    events = calendar_events(items, today, now).select("id", "type_ord", F.posexplode("lines").alias("place", "line"))
    return events.withColumn("line", fold(F.col("line")))


def build_calendar(items: DataFrame, today: Column, now: Column, scope: tuple[str, ...] = (), order: str = "id") -> DataFrame:
    """(scope, content, events): one calendar file for each user (a user's events fit a row)."""
    events = calendar_events(items, today, now)
    lines = events.select(*scope, F.col(order).alias("_o"), "type_ord", F.posexplode("lines").alias("place", "line")).withColumn("line", fold(F.col("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "type_ord", "place", "line"))), lambda x: F.concat(x["line"], F.lit("\r\n"))), "")
    made = lines.groupBy(*scope).agg(body.alias("_body"), F.count_if(F.col("place") == 0).alias("_events"))
    if scope:
        made = items.select(*scope).distinct().join(made, [*scope], "left")
    return made.select(*scope, F.concat(F.lit("\r\n".join(HEAD) + "\r\n"), F.coalesce("_body", F.lit("")), F.lit(FOOT + "\r\n")).alias("content"), F.coalesce("_events", F.lit(0)).cast("long").alias("events"))


def card_amount() -> Column:
    """Amount, period, equivalent by month and whether the period is a guess."""
    words = dictionary.label_of(F.col("period"), dictionary.PERIOD_LABELS)
    month = F.when((F.col("period") != "monthly") & F.col("monthly_equivalent_cents").isNotNull(), F.concat(F.lit(" · "), money.format_euros(F.col("monthly_equivalent_cents")), F.lit("/mois")))
    guess = F.when(F.col("period_is_estimated") & (F.col("period") != "unknown"), F.lit(" (estimé)"))
    told = F.concat(money.format_euros(F.col("amount_cents")), F.lit(" "), words, F.coalesce(month, F.lit("")), F.coalesce(guess, F.lit("")))
    return F.coalesce(told, F.lit("Montant à compléter"))


def card_hint(today: Column) -> Column:
    """Category, then the trial's end or the next payment."""
    trial = F.concat(F.lit(" · essai jusqu'au "), F.regexp_replace(dates.relative_day(F.col("trial_ends_at"), today), "^le ", ""))
    renewal = F.when(F.col("user_status") != "cancelled", F.concat(F.lit(" · prochain "), dates.relative_day(F.col("next_renewal"), today)))
    return F.concat(dictionary.label_of(F.col("category"), dictionary.CATEGORY_LABELS), F.coalesce(trial, renewal, F.lit("")))


def memory_list(items: DataFrame, services: DataFrame, scope: tuple[str, ...] = (), most: int = 8) -> DataFrame:
    """(scope, category, place, name, service_id, has): examples of each checklist category and whether the user has them."""
    spark = items.sparkSession
    named = spark.createDataFrame([(i, c) for i, c in enumerate(dictionary.CHECKLIST) if c != "essai"], "category_ord int, category string")
    first = F.row_number().over(Window.partitionBy("service_category").orderBy("service_ord"))
    branded = services.where(~F.col("intermediary")).withColumn("place", first).where(F.col("place") <= most).select(F.col("service_category").alias("category"), "place", F.col("service_name").alias("name"), "service_id")
    generic = spark.createDataFrame([(c, most + i, n, None) for c, names in dictionary.GENERIC.items() for i, n in enumerate(names, 1)], "category string, place int, name string, service_id string")
    shown = branded.unionByName(generic).join(named, "category")
    owned = items.where("status <> 'rejected'").select(*scope, F.explode(F.array_compact(F.array("service_id", F.lower("display_name")))).alias("_what")).distinct()
    asked = shown.select("*", F.explode(F.array_compact(F.array("service_id", F.lower("name")))).alias("_what"))
    if not scope:
        return asked.join(owned.withColumn("_has", F.lit(True)), "_what", "left").groupBy("category_ord", "category", "place", "name", "service_id").agg(F.coalesce(F.max("_has"), F.lit(False)).alias("has"))
    hits = owned.join(F.broadcast(asked), "_what").select(*scope, "category", "place").distinct().withColumn("has", F.lit(True))
    users = items.select(*scope).distinct().withColumn("_x", F.explode(F.array(*(F.lit(c) for c in dictionary.CHECKLIST if c != "essai"))))
    every = users.join(F.broadcast(shown), F.col("_x") == F.col("category")).drop("_x")
    return every.join(hits, [*scope, "category", "place"], "left").withColumn("has", F.coalesce("has", F.lit(False)))


def toggled(checked: Column, category: Column) -> Column:
    """The checked categories without the category, or with it at the end."""
    return F.when(F.array_contains(checked, category), F.array_remove(checked, category)).otherwise(F.array_append(checked, category))


def follow_ups() -> Column:
    """struct(ask_period, store_links): what a card offers."""
    ask = (F.col("period") == "unknown") & F.col("amount_cents").isNotNull() & (F.col("user_status") != "cancelled")
    links = (F.col("user_status") == "to_cancel") & F.exists("source_transaction_ids", lambda x: x.startswith("screenshot_store"))
    return F.struct(ask.alias("ask_period"), links.alias("store_links"))


def import_summary(rows: DataFrame, captures: DataFrame, found: DataFrame) -> DataFrame:
    """(import_id, screenshots, unreadable, operations, found, other_debits, added): captures has `unreadable`, found has kind and change."""
    pages = captures.groupBy("import_id").agg(F.count("*").alias("screenshots"), F.count_if("unreadable").alias("unreadable"))
    priced = rows.groupBy("import_id").agg(F.count("amount_cents").alias("operations"))
    what = found.groupBy("import_id").agg(F.count_if(F.col("kind") == "subscription").alias("found"), F.count_if(F.col("kind") == "other_debit").alias("other_debits"), F.count_if(F.col("change") == "added").alias("added"))
    return pages.join(priced, "import_id", "left").join(what, "import_id", "left").na.fill(0, ["operations", "found", "other_debits", "added"])


LOW_CONFIDENCE = 60


def unsure_lines(lines: DataFrame) -> DataFrame:
    """Lines read with little confidence."""
    return lines.where(F.col("confidence") < LOW_CONFIDENCE)


def page_confidence(lines: DataFrame) -> DataFrame:
    """(capture_id, confidence): rounded mean over a page's lines; 0 for a page whose confidences are all null."""
    return lines.groupBy("capture_id").agg(F.coalesce(F.floor(F.avg("confidence") + 0.5), F.lit(0)).cast("int").alias("confidence"))


def progress(current: Column, total: Column, fraction: Column) -> Column:
    """Per cent of an import that are done; current counts from 1."""
    return (current - 1 + fraction) / total * 100
