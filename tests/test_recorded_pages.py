"""Pages of one import from lines to subscriptions, as a user would send them: made here, expectations written by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide.core import checkpointed
from ebbtide.operators import detect, portfolio
from ebbtide.sources import captures
from ebbtide.sources.store import Portfolio
from test_engine import LINE, page

BANK = [
    ("Mes opérations", 10), ("Mercredi 2 septembre", 100), ("PRLV SEPA CINÉFLUX -11,99 €", 200), ("CB BOULANGERIE DU PORT -4,20 €", 300), ("Lundi 7 septembre", 400), ("PRLV SEPA ONDEA MUSIQUE -10,99 €", 500),
    ("PRLV CLUB FORME+ -24,99 €", 600), ("REMBOURSEMENT 15,00 €", 700), ("VIR SEPA M JEAN DUPONT -50,00 €", 800),
]
DEBITS = [("Mes prélèvements", 10), ("CINEFLUX SAS", 100), ("Mandat actif", 140), ("DGFIP IMPOT", 250), ("Mandat actif", 290), ("CLUB FORME PLUS", 400), ("Mandat actif", 440), ("ONDEA MUSIQUE", 550), ("Mandat actif", 590)]
STORE = [("Abonnements", 10), ("Actifs", 50), ("Cinéflux", 100), ("11,99 € / mois", 140), ("Renouvellement le 12 octobre", 180)]
PLAIN = [("Lundi 7 septembre", 100), ("CB SUPERMARCHE CENTRE -38,74 €", 200), ("CB BOULANGERIE DU PORT -4,20 €", 300), ("VIR SEPA MME ANNE DUPONT 20,00 €", 400)]


CASES = {"list": [BANK], "twice": [BANK, BANK], "debits": [DEBITS], "both": [DEBITS, BANK], "store": [STORE, PLAIN], "plain": [PLAIN]}
THREE = [("Club Forme+", 2499, "medium"), ("Cineflux", 1199, "medium"), ("Ondea Musique", 1099, "medium")]


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """Each case is an import; all are detected and saved together. Frames as lists of rows."""
    rows = [(f"{case}{n}", case, n, *r[3:]) for case, pages in CASES.items() for n, p in enumerate(pages) for r in page(p)]
    read = checkpointed(captures.transactions(spark.createDataFrame(rows, LINE)))
    d = detect.detect(read)
    found = checkpointed(d.subscriptions.unionByName(d.other_debits))
    saved = Portfolio(spark, str(tmp_path_factory.mktemp("saved")), "import_id string")
    saved.save_detections(found, F.lit("2026-10-05 10:00:00").cast("timestamp"))
    frames = {"read": read.orderBy("import_id", "pos"), "found": found.orderBy("import_id", *detect.surest_first()), "stats": d.stats, "saved": saved.read(), "totals": portfolio.portfolio_totals(saved.read(), ("import_id",))}
    return {k: f.collect() for k, f in frames.items()}


def of(told, frame, case, kind=None):
    return [r for r in told[frame] if r.import_id == case and (kind is None or r.kind == kind)]


def subscriptions(told, case):
    return [(r.display_name, r.amount_cents, r.confidence) for r in of(told, "found", case, "subscription")]


def test_bank_list(told):
    assert [(r.label, r.amount_cents, str(r.date), r.kind, r.direction) for r in of(told, "read", "list")] == [
        ("PRLV SEPA CINÉFLUX", 1199, "2026-09-02", "sepa", "debit"), ("CB BOULANGERIE DU PORT", 420, "2026-09-02", "card", "debit"), ("PRLV SEPA ONDEA MUSIQUE", 1099, "2026-09-07", "sepa", "debit"),
        ("PRLV CLUB FORME+", 2499, "2026-09-07", "sepa", "debit"), ("REMBOURSEMENT", 1500, "2026-09-07", "unknown", "credit"), ("", 5000, "2026-09-07", "transfer", "debit"),
    ]
    (stats,) = of(told, "stats", "list")
    assert subscriptions(told, "list") == THREE
    assert (stats.transactions, stats.credits, stats.transfers, stats.ignored, stats.duplicates) == (6, 1, 1, 1, 0)


def test_two_captures_of_one_page(told):
    (stats,) = of(told, "stats", "twice")
    assert subscriptions(told, "twice") == THREE and (stats.transactions, stats.duplicates) == (12, 6)
    assert all(len(r.source_transaction_ids) == 1 for r in of(told, "found", "twice"))


def test_debits_page_with_the_bank_list(told):
    assert [r.label for r in of(told, "read", "debits")] == ["CINEFLUX SAS", "DGFIP IMPOT", "CLUB FORME PLUS", "ONDEA MUSIQUE"]
    assert subscriptions(told, "both") == THREE
    assert [r.display_name for r in of(told, "found", "both", "other_debit")] == ["Dgfip Impot"]
    assert [c for _, c, _ in subscriptions(told, "debits")] == [None] * 3 and of(told, "totals", "debits")[0].incomplete == 3


def test_evidence_in_order(told):
    (row,) = (r for r in of(told, "found", "both") if r.display_name == "Cineflux")
    assert row.source_transaction_ids == ["screenshot_bank_debits:0:0", "screenshot_card_history:1:0"]
    assert row.source_lines == ["CINEFLUX SAS · Mandat actif", "PRLV SEPA CINÉFLUX · -11,99 €"]
    assert row.reasons[0] == "Prélèvement d'un organisme que je ne connais pas : à toi de dire si c'est un abonnement."


def test_store_page_beside_a_bank_list(told):
    (row,) = of(told, "found", "store")
    assert (row.display_name, row.amount_cents, row.period, row.next_renewal, row.confidence) == ("Cinéflux", 1199, "monthly", date(2026, 10, 12), "high")


def test_nothing_to_find(told):
    assert not of(told, "found", "plain") and sum(r.amount_cents is not None for r in of(told, "read", "plain")) == 3


def test_no_personal_name_leaves(told):
    """In no output: transactions, detections, statistics, what is saved."""
    for rows in told.values():
        text = str(rows).upper()
        assert rows and "DUPONT" not in text and "JEAN" not in text and "ANNE D" not in text
