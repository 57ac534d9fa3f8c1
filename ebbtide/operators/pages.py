"""Lines of pages to entries: which page it is, entries of a store's subscription page, entries of a bank's list.

Lines: (capture_id, line_pos, text, words, x0, y0, x1, y1, confidence, reference). Windows and folds run within one capture,
a page of bounded size. Empty pages give no entries and count as card history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions import dates, money
from ebbtide.functions.patterns import let, matches, replaced
from ebbtide.functions.text import has_letters, payment_kind, period_from_text, plain_upper
from ebbtide.operators.lines import clean_text, word_height
from ebbtide.operators.paging import fold_pages

# Words that tell the kind of a page.
STORE_PAGE = r"\b(RENOUVEL\w*|ESSAI GRATUIT|\/ ?MOIS|\/ ?AN\b|PAR MOIS|PROCHAIN PAIEMENT|EXPIRE\w*)\b|^ABONNEMENTS$"
DEBITS_PAGE = r"\b(MANDATS?|CREANCIERS?|PRELEVEMENTS? AUTORISES?)\b|^(MES )?PRELEVEMENTS$"
# Words of a store's page.
RENEWAL = r"\b(RENOUVEL\w*|PROCHAIN\w*|FACTUR\w*|SE RENOUVELLE|DEBITE)\b"
TRIAL = r"\b(ESSAI GRATUIT|GRATUIT JUSQU|PERIODE D ESSAI|ESSAI)\b"
TITLES = r"^(ABONNEMENTS?|ACTIFS?|ACTIVES?|GERER|MODIFIER|COMPTE|PAIEMENTS? ET ABONNEMENTS)$"
ENDED_SECTION = r"^(EXPIRES?|EXPIREES?|INACTIFS?|ANNULES?|ANNULEES?)$"
# Words of a bank's list.
PAYMENT_PHRASE = r"^(PRELEVEMENT( SEPA)?|PRLV( SEPA)?|CARTE( BANCAIRE)?|CB|PAIEMENT( PAR CARTE| CB| CARTE)?|VIREMENT( RECU| EMIS| SEPA| INSTANTANE)?|RETRAIT( DAB)?|DEBIT DIFFERE|ACHAT|AVOIR|MANDAT( ACTIF| SEPA)?)$"
CREDIT_WORDS = r"\b(VIREMENT RECU|VIR RECU|RECU|REMBOURSEMENT|AVOIR|REMISE)\b"
CHROME = r"\b(SOLDE|A VENIR|EN COURS|ENCOURS)\b"
PAGE_TITLE = r"^(MES |VOS )?(OPERATIONS|PRELEVEMENTS|CREANCIERS( AUTORISES)?|MANDATS( SEPA)?|HISTORIQUE|DERNIERES OPERATIONS|COMPTES?|ACTIVITE)$"
TITLE_HEIGHT, SMALL_HEIGHT, LINE_GAP, PHRASE_WORDS = 1.8, 0.8, 0.8, 4


#: What every match of the patterns above holds one of.
STORE_MARKS, DEBITS_MARKS = ("RENOUVEL", "ESSAI GRATUIT", "MOIS", "/ AN", "/AN", "PROCHAIN PAIEMENT", "EXPIRE", "ABONNEMENTS"), ("MANDAT", "CREANCIER", "PRELEVEMENT")
PHRASE_MARKS = ("PRELEVEMENT", "PRLV", "CARTE", "CB", "PAIEMENT", "VIREMENT", "RETRAIT", "DEBIT", "ACHAT", "AVOIR", "MANDAT")
CREDIT_MARKS, CHROME_MARKS = ("RECU", "REMBOURSEMENT", "AVOIR", "REMISE"), ("SOLDE", "VENIR", "COURS")
TITLE_MARKS = ("OPERATIONS", "PRELEVEMENTS", "CREANCIERS", "MANDATS", "HISTORIQUE", "COMPTE", "ACTIVITE")
STORE_KIND, DEBITS_KIND, HISTORY_KIND = "screenshot_store", "screenshot_bank_debits", "screenshot_card_history"


def _read(text: Column) -> Column:
    """What the rules ask of a text, with the text it is of: capitals without accents, amounts and what is left without them."""
    return F.struct(text.alias("of"), plain_upper(text).alias("upper"), money.reading(text).alias("money"))


def _marks(read: Column) -> dict[str, Column]:
    said = F.trim(read["upper"])
    return {
        "lines": said != "", "store": matches(said, STORE_PAGE.replace(r"\w", "[A-Za-z0-9_]"), STORE_MARKS), "debits": matches(said, DEBITS_PAGE, DEBITS_MARKS),
        "priced": (said != "") & (read["money"]["n"] > 0), "signed": (said != "") & read["money"]["signed"],
    }


def _page_kind(n: Callable[[str], Column]) -> Column:
    kind = F.when((n("store") >= 2) & (n("signed") <= 1), STORE_KIND).when((n("debits") >= 1) & (n("priced") <= n("lines") * F.lit(0.2)), DEBITS_KIND)
    return kind.otherwise(HISTORY_KIND)


def classify_pages(lines: DataFrame) -> DataFrame:
    """(capture_id, kind) of every capture that has a line."""
    marks = lines.select("capture_id", _read(F.col("text")).alias("r"))
    marks = marks.select("capture_id", *(c.alias(name) for name, c in _marks(F.col("r")).items()))
    n = marks.groupBy("capture_id").agg(*(F.count_if(name).alias(name) for name in ("store", "debits", "priced", "signed", "lines")))
    return n.select("capture_id", _page_kind(F.col).alias("kind"))


def maybe_store(lines: DataFrame) -> DataFrame:
    """(capture_id) of the captures that have lines enough to be a store's page, found by words alone."""
    said = matches(F.trim(plain_upper(F.col("text"))), STORE_PAGE.replace(r"\w", "[A-Za-z0-9_]"), STORE_MARKS)
    return lines.where(said).groupBy("capture_id").count().where("count >= 2").select("capture_id")


def with_kinds(lines: DataFrame) -> DataFrame:
    """lines, dealt by capture, with `_kind`, the kind of their page, and `_read`, what was read in their text for it."""
    page = Window.partitionBy("capture_id").orderBy("y0", "line_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the order of the layout, which needn't sort again
    read = lines.repartition("capture_id").withColumn("_read", _read(F.col("text"))).withColumns({f"_{name}": c for name, c in _marks(F.col("_read")).items()})
    counted = read.withColumns({f"_n_{name}": F.count_if(f"_{name}").over(page) for name in ("store", "debits", "priced", "signed", "lines")})
    return counted.withColumn("_kind", _page_kind(lambda name: F.col(f"_n_{name}"))).select(*lines.columns, "_kind", "_read")


def parse_store(lines: DataFrame) -> DataFrame:
    """(capture_id, entry, name, raw_text, price_cents, period, renewal_date, trial_ends_at, confidence)."""
    text = replaced(F.col("text"), r"^\s+|\s+$", "")
    upper = F.translate(plain_upper(text), "’'", "  ")
    page = Window.partitionBy("capture_id").orderBy("y0", "line_pos")
    told = lines.select("capture_id", "line_pos", "y0", "confidence", "reference", text.alias("text"), upper.alias("upper")).where("text <> ''")
    told = told.withColumn("_ended", F.max(matches(F.col("upper"), ENDED_SECTION)).over(page)).where("not _ended").where(~matches(F.col("upper"), TITLES))
    told = told.withColumn("cents", money.last_amount(F.col("text"))["cents"]).withColumn("period", period_from_text(F.col("upper")))
    told = told.withColumn("trial", matches(F.col("upper"), TRIAL)).withColumn("renewal", matches(F.col("upper"), RENEWAL.replace(r"\w", "[A-Za-z0-9_]")))
    told = told.withColumn("detail", F.col("cents").isNotNull() | F.col("renewal") | F.col("trial") | (F.col("period") != "unknown"))
    told = told.withColumn("opens", ~F.col("detail") & has_letters(F.col("text"))).where("detail or opens")
    told = told.withColumn("entry", F.sum(F.col("opens").cast("int")).over(page) - 1).where("entry >= 0")
    day = dates.parse_date(F.col("text"), F.col("reference"), "future")["date"]
    told = told.withColumn("day", F.when(F.col("trial") | F.col("renewal"), day)).withColumn("at", F.struct("y0", "line_pos"))
    of = lambda value, when: F.when(when, F.col(value))
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return told.groupBy("capture_id", "entry").agg(
        F.min_by("text", "at").alias("name"), F.array_join(F.transform(ordered, lambda x: x["text"]), " · ").alias("raw_text"),
        F.min_by("cents", F.when(F.col("cents").isNotNull(), F.col("at"))).alias("price_cents"),
        F.coalesce(F.max_by("period", F.when(F.col("detail") & (F.col("period") != "unknown"), F.col("at"))), F.lit("unknown")).alias("period"),
        F.max_by("day", F.when(F.col("detail") & ~F.col("trial") & F.col("renewal") & F.col("day").isNotNull(), F.col("at"))).alias("renewal_date"),
        F.max_by("day", F.when(F.col("detail") & F.col("trial") & F.col("day").isNotNull(), F.col("at"))).alias("trial_ends_at"),
        F.round(F.avg("confidence")).cast("int").alias("confidence"),
    )


def _features(lines: DataFrame, carried: list[str]) -> DataFrame:
    """What the layout fold asks of a line, all computed natively; what was read in its text before (`_read`) isn't read again."""
    rows = lines.select(
        "capture_id", *carried, "line_pos", "y0", "y1", "confidence", "reference", clean_text(F.col("words")).alias("text"), word_height(F.col("words"), F.col("y0"), F.col("y1")).alias("height"),
        *(c for c in lines.columns if c == "_read"),
    )
    read = _read(F.col("text"))
    rows = rows.withColumn("r", F.when(F.col("_read.of") == F.col("text"), F.col("_read")).otherwise(read) if "_read" in rows.columns else read)
    rows = rows.withColumns({"text_date": dates.parse_date(F.col("text"), F.col("reference"), upper=F.col("r.upper")), "upper": F.col("r.upper"), "rest": F.col("r.money.rest"), "amount": F.col("r.money.last")})
    upper = F.col("upper")
    bare = F.trim(F.regexp_replace(replaced(F.regexp_replace(upper, r"[·•|,-]", " "), r"\b\d{1,2}\/\d{1,2}(\/\d{2,4})?\b"), r"\s+", " "))
    phrase = reduce(or_, (upper.contains(m) for m in PHRASE_MARKS)) & matches(bare, PAYMENT_PHRASE)
    few = F.col("amount").isNull() & (F.size(F.split("rest", " ")) <= PHRASE_WORDS)
    kind = (
        F.when(F.col("text") == "", "ignore").when(dates.is_date_header(F.col("text"), F.col("reference"), F.col("text_date")), "header")
        .when(matches(upper, CHROME, CHROME_MARKS) | matches(upper, PAGE_TITLE, TITLE_MARKS), "ignore").when(F.col("amount").isNotNull() & ~has_letters(F.col("rest")), "amount")
        .when(~has_letters(F.col("text")), "ignore").when(few & phrase, "sublabel").when(few, "short").otherwise("label")
    )
    rest_date = F.when(F.col("rest") == F.col("text"), F.col("text_date")).otherwise(dates.parse_date(F.col("rest"), F.col("reference"), upper=plain_upper(F.col("rest"))))
    return rows.withColumn("kind", kind).withColumn("rest_date", F.when(F.col("kind").isin("label", "short", "sublabel"), rest_date))  # others don't open an entry


class _Line(NamedTuple):
    capture: object
    line_pos: int
    y0: float
    y1: float
    height: float
    kind: str
    day: object
    near: bool | None
    rest_day: object
    rest_near: bool | None
    text: str
    rest: str
    confidence: float
    cents: int | None
    direction: str | None
    priced_as: str | None  # null without an amount
    carried: tuple


def _entries(page: list[tuple]) -> list[tuple]:
    """The entries (blocks) of a page: their label, what stands below it, their amount, date and confidence; for each owner of the page."""
    page = [_Line(*x[: len(_Line._fields) - 1], x[len(_Line._fields) - 1 :]) for x in page]
    usual = sorted(x.height for x in page)[len(page) // 2]
    blocks, loose = [], []
    now, label_height = (None, None), None
    found: dict[int, tuple[int, str]] = {}
    for i, x in enumerate(page):
        kind = x.kind
        if kind in ("amount", "sublabel", "short", "label") and x.height > TITLE_HEIGHT * usual:
            kind = "ignore"
        if kind == "short":
            kind = "sublabel" if label_height is not None and x.height < SMALL_HEIGHT * label_height else "label"
        last = blocks[-1] if blocks else None
        gap = x.y0 - last["bottom"] if last else float("inf")
        below = last is not None and gap < last["height"]
        if kind == "sublabel" and not below:
            kind = "label"
        if kind == "header" and not below:
            now, label_height = (x.day, x.near), None
        elif kind in ("header", "sublabel"):
            if x.day is not None:
                last["date"] = (x.day, x.near)
            last["bottom"] = max(last["bottom"], x.y1)
            last["sub"] = True
            found[i] = len(blocks) - 1, "sublabel"
        elif kind == "amount":
            loose.append(i)
        elif kind == "label":
            if last and not last["priced"] and not last["sub"] and gap < LINE_GAP * last["height"]:
                last["bottom"] = max(last["bottom"], x.y1)
            else:
                own = (x.rest_day, x.rest_near) if x.rest_day is not None else now
                blocks.append(last := {"top": x.y0, "bottom": x.y1, "height": x.height, "date": own, "sub": False, "priced": False})
            last["priced"] |= x.priced_as is not None
            found[i] = len(blocks) - 1, "label"
            label_height = x.height
    for i in loose:  # an amount alone belongs to the nearest entry without one
        center = (page[i].y0 + page[i].y1) / 2
        away, near = min(((max(b["top"] - center, center - b["bottom"], 0), k) for k, b in enumerate(blocks) if not b["priced"]), default=(0, None))
        if near is not None and away <= blocks[near]["height"]:
            found[i] = near, "amount"
            blocks[near]["priced"] = True
    members = [[] for _ in blocks]
    for i in sorted(found):
        members[found[i][0]].append((found[i][1], page[i]))
    owners = list(dict.fromkeys(x.carried for x in page))
    out = []
    for entry, (block, held) in enumerate(zip(blocks, members, strict=True)):
        priced = [x for role, x in held if role != "sublabel" and x.cents is not None]
        twice = [x for role, x in held if role == "label" and x.cents is not None]  # the line of the amount counts again
        sure = [x.confidence for x in (*(x for _, x in held), *twice) if x.confidence == x.confidence]
        text = lambda wanted, field, held=held: " ".join(t for role, x in held if role == wanted and (t := getattr(x, field)) is not None)
        amount = (priced[0].cents, priced[0].direction, priced[0].priced_as) if priced else (None, None, None)
        mean = sum(sure) / (len(held) + len(twice)) if sure else None
        out += [(page[0].capture, *owner, entry, text("label", "rest"), text("sublabel", "text"), *amount, *block["date"], mean) for owner in owners]
    return out


def bank_entries(lines: DataFrame, carried: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """parse_bank() with these columns of the page's lines beside capture_id, entries for each of their values. dealt: the lines of a page share a partition."""
    rows = _features(lines, list(carried))
    asked = rows.select(
        "capture_id", "line_pos", "y0", "y1", "height", "kind", F.col("text_date.date").alias("day"), F.col("text_date.approximate").alias("near"), F.col("rest_date.date").alias("rest_day"), F.col("rest_date.approximate").alias("rest_near"),
        "text", "rest", "confidence", F.col("amount.cents").alias("cents"), F.col("amount.direction").alias("direction"), F.col("amount.text").alias("priced_as"), *carried,
    )
    own = "".join(f"{c} {asked.schema[c].dataType.simpleString()}, " for c in ("capture_id", *carried))
    entries = fold_pages(asked, "capture_id", ["y0", "line_pos"], _entries, f"{own}entry int, label string, sub string, cents bigint, direction string, priced_as string, date date, approximate boolean, confidence double", dealt)
    from_label = payment_kind(F.col("label"))
    upper = plain_upper(F.concat_ws(" ", "label", "sub"))
    sign = F.when(F.col("direction") != "unknown", F.col("direction")).when(matches(upper, CREDIT_WORDS, CREDIT_MARKS), "credit").otherwise("unknown")
    shown = F.array_join(F.filter(F.array("label", "sub", "priced_as"), lambda t: t != ""), " · ")
    return entries.select(
        "capture_id", *carried, "entry", "label", shown.alias("raw_text"), "cents", "date", F.when(F.col("date").isNotNull(), F.col("approximate")).alias("approximate"),
        let(from_label, lambda k: F.when(k != "unknown", k).otherwise(payment_kind(F.col("sub")))).alias("kind"), sign.alias("direction"), F.floor(F.col("confidence") + 0.5).cast("int").alias("confidence"),
    )


def parse_bank(lines: DataFrame) -> DataFrame:
    """(capture_id, entry, label, raw_text, cents, date, approximate, kind, direction, confidence)."""
    return bank_entries(lines)
