"""Views of the driver's tables as this library's input: the same projections serve Spark and the DuckDB oracles.

The tables hold no bank or store text, so labels come from TEMPLATES, whose normal form and meaning are known by hand.
An import is ten neighbouring customers, so the size of an import doesn't grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.core import by_distinct, table

#: number | raw label | normal form | payment kind | service | intermediary | other debit | keyword category | merchant key | group of alike merchants | never
TEMPLATES = """
0 | PRLV SEPA CINÉFLUX | CINEFLUX | sepa | | | | | CINEFLUX | 1 |
1 | Prélèvement SEPA Ondéa Musique | ONDEA MUSIQUE | sepa | | | | | ONDEAMUSIQUE | 2 |
2 | PAIEMENT PAR CARTE X1234 NUAGERIE 200 GO 05/09 | NUAGERIE 200 GO | card | | | | | NUAGERIE200GO | 3 |
3 | CB NETFLIX.COM 050926 CARTE 4974XXXXXXXX1234 | NETFLIX.COM | card | netflix | | | | NETFLIXCOM | |
4 | PRLV SEPA CLUB FORME+ RUM: ABC123456789 | CLUB FORME+ | sepa | | | | | CLUBFORMEPLUS | 4 |
5 | CB*SP0TIFY | SPOTIFY | card | spotify | | | | SPOTIFY | |
6 | CB NETFLlX | NETFLIX | card | netflix | | | | NETFLIX | |
7 | APPLE.COM/BILL | APPLE.COM BILL | unknown | apple | apple | | | APPLECOMBILL | 5 |
8 | PAYPAL *DEEZER | PAYPAL DEEZER | unknown | deezer | paypal | | | PAYPALDEEZER | |
9 | VIR SEPA INST REMBOURSEMENT | REMBOURSEMENT | transfer | | | | | REMBOURSEMENT | 6 |
10 | CB BOULANGERIE DU PORT | BOULANGERIE DU PORT | card | | | | | BOULANGERIEDUPORT | 7 |
11 | CINEFLUX SAS | CINEFLUX SAS | unknown | | | | | CINEFLUX | 1 |
12 | PRLV SEPA DGFIP IMPOT | DGFIP IMPOT | sepa | | | Impôts ou taxes | | DGFIPIMPOT | |
13 | PRLV SEPA ECHEANCE PRET AUTO | ECHEANCE PRET AUTO | sepa | | | Crédit ou prêt | | ECHEANCEPRETAUTO | |
14 | MUTUELLE EXEMPLE | MUTUELLE EXEMPLE | unknown | | | | assurance | MUTUELLEEXEMPLE | 8 |
15 | COTISATIONS BANCAIRES | COTISATIONS BANCAIRES | unknown | | | | banque | COTISATIONSBANCAIRES | 9 |
16 | CB SPOTIFV | SPOTIFV | card | spotify | | | | SPOTIFV | |
17 | CB AMAZON PRIRNE | AMAZON PRIRNE | card | prime-video | | | | AMAZONPRIRNE | |
18 | DEBIT DIFFERE N° 1234 | DEBIT DIFFERE N 1234 | unknown | | | | | DEBITDIFFEREN1234 | | never
19 | PRLV SEPA RED BY SFR | RED BY SFR | sepa | red-by-sfr | | | | REDBYSFR | |
20 | CB DISNEY PLUS | DISNEY PLUS | card | disney-plus | | | | DISNEYPLUS | |
21 | ONDEA MUSIQE | ONDEA MUSIQE | unknown | | | | | ONDEAMUSIQE | 2 |
22 | GOOGLE PLAY | GOOGLE PLAY | unknown | google-play | google-play | | | GOOGLEPLAY | 10 |
23 | PRELEVEMENT | PRELEVEMENT | sepa | | | | | PRELEVEMENT | | never
"""
ROWS = [[x.strip() for x in line.split("|")] for line in TEMPLATES.strip().splitlines()]
NAMES = ("n", "raw", "norm", "tkind", "service", "via", "other", "word", "mkey", "alike", "never")


def _literal(value: str, i: int) -> str:
    return value if i == 0 else f"nullif('{value}', '')" if i not in (2,) else f"'{value}'"


#: The templates as a table for DuckDB.
TEMPLATE_SQL = f"(select * from (values {', '.join('(' + ', '.join(_literal(v, i) for i, v in enumerate(r)) + ')' for r in ROWS)}) as v({', '.join(NAMES)}))"

PERIOD = "case o_orderkey % 5 when 0 then 'weekly' when 1 then 'monthly' when 2 then 'quarterly' when 3 then 'yearly' else 'unknown' end"
CENTS = "cast(round(o_totalprice * 100) as bigint)"
DAY = "cast(o_orderdate as date)"
TODAY = "date '2026-10-05'"
#: Projections of orders; `tx` also needs the template o_orderkey % 24.
TX = {
    "import_id": "cast(cast(floor(o_custkey / 10) as bigint) as varchar(20))",
    "pos": "o_orderkey",
    "id": "concat('t', cast(o_orderkey as varchar(20)))",
    "amount_cents": "case when o_orderkey % 11 in (1, 2) and o_orderkey % 5 = 0 then null else 299 + 100 * (o_orderkey % 6) + case when o_orderkey % 13 = 0 then 2000 else 0 end end",
    "currency": "'EUR'",
    "date": "case when o_orderkey % 10 = 7 or o_orderkey % 11 = 0 then null else cast(concat('2025-', case when o_custkey % 12 < 9 then '0' else '' end, cast(o_custkey % 12 + 1 as varchar(4)), '-05') as date) end",
    "date_is_approximate": "false",
    "direction": "case when o_orderkey % 19 = 0 then 'credit' when o_orderstatus = 'P' then 'unknown' else 'debit' end",
    "source": "case when o_orderkey % 11 = 0 then 'screenshot_store' when o_orderkey % 11 < 3 then 'screenshot_bank_debits' else 'screenshot_card_history' end",
    "capture_index": "cast(o_orderkey % 3 as int)",
    "ocr_confidence": "90",
    "period_hint": f"case when o_orderkey % 11 = 0 then {PERIOD} end",
    "renewal_date": f"case when o_orderkey % 22 = 0 then {TODAY} + cast(o_orderkey % 40 as int) end",
    "trial_ends_at": f"case when o_orderkey % 33 = 0 then {TODAY} + cast(o_orderkey % 20 as int) end",
}
SAVED = {
    "user_id": "o_custkey",
    "id": "concat('sub:', cast(o_orderkey as varchar(20)))",
    "service_id": "case when o_orderkey % 3 = 0 then 'netflix' end",
    "display_name": "case when o_orderkey % 4 = 1 then 'Spotify' else concat('Service, ', cast(o_orderkey % 10 as varchar(4))) end",
    "category": "case o_orderkey % 3 when 0 then 'streaming' when 1 then 'sport' else 'autre' end",
    "amount_cents": f"case when o_orderkey % 17 = 0 then null else {CENTS} end",
    "period": PERIOD,
    "period_is_estimated": "o_orderkey % 2 = 0",
    "confidence": "case o_orderkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end",
    "status": "case o_orderkey % 4 when 0 then 'pending' when 3 then 'rejected' else 'confirmed' end",
    "next_renewal": f"case when o_orderkey % 6 = 5 then null else {TODAY} + cast(o_orderkey % 60 - 10 as int) end",
    "trial_ends_at": f"case when o_orderkey % 9 = 0 then {TODAY} + cast(o_orderkey % 40 - 5 as int) end",
    "kind": "case when o_orderkey % 7 = 0 then 'other_debit' else 'subscription' end",
    "user_status": "case o_orderkey % 5 when 1 then 'to_cancel' when 2 then 'cancelled' else 'keep' end",
}


def select_sql(projection: dict[str, str], more: str = "") -> str:
    """The projection over orders, for DuckDB."""
    return f"select {', '.join(f'{v} as {k}' for k, v in projection.items())}{more} from orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(int(r[0]), r[1]) for r in ROWS], "n int, raw string")


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the raw label of their template."""
    return orders(spark, sf_dir).join(F.broadcast(templates(spark)), F.col("o_orderkey") % len(ROWS) == F.col("n"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRANSACTION rows: label and kind are computed from the raw label by this library."""
    from ebbtide.functions.text import normalize_label, payment_kind
    from ebbtide.sources.captures import TRANSACTION

    rows = labelled_orders(spark, sf_dir).selectExpr(*(f"{v} as {k}" for k, v in TX.items()), "raw as raw_text", "raw as label")
    rows = by_distinct(rows, "label", normalized_label=normalize_label(F.col("label")), kind=payment_kind(F.col("label")))
    rows = rows.withColumn("kind", F.when(F.col("source") == "screenshot_store", "store").otherwise(F.col("kind")))
    names = [f.split()[0] for f in TRANSACTION.split(", ")]
    return rows.select(*(F.col(n).cast(kind).alias(n) for n, kind in (f.split() for f in TRANSACTION.split(", ")))).select(*names)


#: tx for DuckDB, with the template's columns.
TX_SQL = f"(select o.*, t.* exclude (n), case when source = 'screenshot_store' then 'store' else tkind end as kind from ({select_sql(TX, ', o_orderkey % 24 as n')}) o join {TEMPLATE_SQL} t on o.n = t.n)"


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STORED rows of each customer, without evidence."""
    from ebbtide.functions.money import monthly_equivalent

    rows = orders(spark, sf_dir).selectExpr(*(f"{v} as {k}" for k, v in SAVED.items()))
    stamp = F.lit("2026-09-01 00:00:00").cast("timestamp")
    return rows.withColumns({
        "monthly_equivalent_cents": monthly_equivalent(F.col("amount_cents"), F.col("period")), "needs_amount": F.col("amount_cents").isNull(), "reasons": F.array(F.lit("seen")), "origin": F.lit("detected"),
        "source_lines": F.array("display_name"), "source_transaction_ids": F.array("id"), "created_at": stamp, "updated_at": stamp,
    })


MONTHLY = "case period when 'weekly' then cast(floor((2 * amount_cents * 52 + 12) / 24.0) as bigint) when 'monthly' then amount_cents when 'quarterly' then cast(floor((2 * amount_cents * 4 + 12) / 24.0) as bigint) when 'yearly' then cast(floor((2 * amount_cents + 12) / 24.0) as bigint) end"
SAVED_SQL = f"(select *, {MONTHLY} as monthly_equivalent_cents from ({select_sql(SAVED)}))"
