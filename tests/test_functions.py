"""Scalar functions against known values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import dates, fuzzy, money, text, web
from ebbtide.operators import reports
from ebbtide.sources import dictionary

NBSP, NNBSP = "\u00a0", "\u202f"


@pytest.fixture
def values(spark):
    """values(rows of arguments, column function of as many columns) -> results in order."""

    def run(rows, function, ddl=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ddl or ["i", *names])
        return [r[0] for r in df.repartition(2, df.columns[0]).orderBy(df.columns[0]).select(function(*(F.col(c) for c in df.columns[1:])).alias("v")).collect()]

    return run


LABELS = {
    "PRLV SEPA CINÉFLUX": "CINEFLUX",
    "Prélèvement SEPA Ondéa Musique": "ONDEA MUSIQUE",
    "PAIEMENT PAR CARTE X1234 NUAGERIE 200 GO 05/09": "NUAGERIE 200 GO",
    "CB NETFLIX.COM 050926 CARTE 4974XXXXXXXX1234": "NETFLIX.COM",
    "PRLV SEPA CLUB FORME+ RUM: ABC123456789": "CLUB FORME+",
    "CB*SP0TIFY": "SPOTIFY",
    "CB NETFLlX": "NETFLIX",
    "CB*NETFLlX": "NETFLIX",
    "APPLE.COM/BILL": "APPLE.COM BILL",
    "PAYPAL *DEEZER": "PAYPAL DEEZER",
    "VIR SEPA INST REMBOURSEMENT": "REMBOURSEMENT",
    "CB NUAGERIE 200 GO": "NUAGERIE 200 GO",
    "PAIEMENT CB": "PAIEMENT",
    "CB": "CB",
    "": "",
    f"CB{NBSP}NETFLIX{NNBSP}COM": "NETFLIX COM",
    "CB NUMERICABLE": "CB",
}


def test_labels(values):
    assert values(list(LABELS), text.normalize_label) == list(LABELS.values())
    assert values([("x", None)], lambda _, v: text.normalize_label(v), "i int, c0 string, c1 string") == [None]


def test_dictionary_variants_are_in_normal_form(spark):
    rows = dictionary.services(spark).select("service_id", F.explode("variants").alias("v")).select("v", text.normalize_label(F.col("v")).alias("n")).collect()
    assert len(rows) == 83 and all(r.v == r.n for r in rows)


@pytest.mark.parametrize("kind, labels", [
    ("sepa", ["PRLV SEPA CINEFLUX", "Prélèvement SEPA"]), ("card", ["CB BOULANGERIE", "PAIEMENT PAR CARTE X1234"]),
    ("transfer", ["VIR SEPA INST M DUPONT", "Virement reçu", "M DURAND PAUL", "MME MARTIN CLAIRE", "M. DUPONT", "M ET MME DURAND", "MONSIEUR PAUL DURAND"]), ("unknown", ["NETFLIX.COM", "M6 PLUS", "MUTUELLE EXEMPLE", "MAXI ZOO", ""]),
])
def test_payment_kinds(values, kind, labels):
    assert values(labels, text.payment_kind) == [kind] * len(labels)


def test_keywords_and_reasons(values):
    labels = ["BPCE ASSURANCES", "MUTUELLE EXEMPLE", "COTISATIONS BANCAIRES", "FRAIS DE TENUE DE COMPTE", "ABONNEMENT PARKING", "CB BOULANGERIE", "REMBOURSEMENT", "CAISSE D EPARGNE ILE DE FRANCE"]
    assert values(labels, lambda c: text.keyword(c)["category"]) == ["assurance", "assurance", "banque", "banque", "autre", None, None, None]
    assert values(["DEBIT DIFFERE N° 1234", "ENCOURS CARTE A DEBIT DIFFERE", "NETFLIX.COM", "PRELEVEMENT"], text.never_subscription) == [True, True, False, True]
    assert values(["DGFIP IMPOT", "ECHEANCE PRET AUTO", "URSSAF", "LOYER", "NETFLIX"], text.other_debit_reason) == ["Impôts ou taxes", "Crédit ou prêt", "Cotisations sociales", "Loyer", None]


def test_small_text_functions(values):
    assert values(["CLUB FORME+", "BASIC-FIT", "ÉPICERIE DU COIN", ""], text.title_case) == ["Club Forme+", "Basic-Fit", "Épicerie Du Coin", ""]
    keys = values(["CINEFLUX SAS", "CINEFLUX", "CLUB FORME+", "CLUB FORME PLUS"], text.merchant_key)
    assert keys[0] == keys[1] and keys[2] == keys[3]
    assert values(["PAYPAL *DEEZER-A/B", ""], text.tokens) == [["PAYPAL", "DEEZER", "A", "B"], []]
    assert values(["Crème brûlée à Œuvre·ñ", "ÀÉÎÕÜ"], text.strip_accents) == ["Creme brulee a Œuvren", "AEIOU"]
    assert values(["4,99 € / MOIS", "PAR AN", "CHAQUE SEMAINE", "TRIMESTRIEL", "RIEN"], text.period_from_text) == ["monthly", "yearly", "weekly", "quarterly", "unknown"]
    assert values(["a,b;c\\d\ne"], text.ics_escape) == ["a\\,b\\;c\\\\d\\ne"]


AMOUNTS = [
    ("-13,49 €", 1349, "debit"), ("13,49 EUR", 1349, "unknown"), ("− 13,49", 1349, "debit"), ("–13,49 €", 1349, "debit"), ("1 234,56 €", 123456, "unknown"), (f"1{NBSP}234,56{NBSP}€", 123456, "unknown"),
    (f"-1{NNBSP}234,56 €", 123456, "debit"), ("1.234,56 €", 123456, "unknown"), ("13.49 €", 1349, "unknown"), ("+15,00 €", 1500, "credit"), ("9 €", 900, "unknown"), ("-11,99 E", 1199, "debit"),
]


def test_amounts(values):
    found = values([a for a, _, _ in AMOUNTS], money.amounts)
    assert [(x[0].cents, x[0].direction) for x in found] == [(c, d) for _, c, d in AMOUNTS]
    nothing = ["NUAGERIE 200 GO", "05/09", "05/09/2026", "Mardi 2 septembre", "CARTE X1234", "Forfait 5G", ""]
    assert values(nothing, money.amounts) == [[]] * len(nothing)
    assert values(["-1O,99 €", "l3,49 €", "ONDEA MUSIQUE", "Il y a 3"], money.fix_digits) == ["-10,99 €", "13,49 €", "ONDEA MUSIQUE", "Il y a 3"]
    assert values(["PRLV ONDEA -1O,99 €", "CB SUPERMARCHE 12,00 € -38,74 €", "rien"], lambda c: money.last_amount(c)["cents"]) == [1099, 3874, None]
    assert values(["PRLV SEPA CINEFLUX -11,99 €", "12,00 € A 3,00 € B", "rien"], money.without_amounts) == ["PRLV SEPA CINEFLUX", "A B", "rien"]
    (found,) = values(["CB X 12,00 € puis -38,74 €"], money.amounts)
    assert [(x.at, x.size, x.text) for x in found] == [(5, 7, "12,00 €"), (18, 8, "-38,74 €")]


def test_money(values):
    assert values([1349, 123456, 0, -5, 123456789], money.format_euros) == [f"13,49{NBSP}€", f"1{NNBSP}234,56{NBSP}€", f"0,00{NBSP}€", f"-0,05{NBSP}€", f"1{NNBSP}234{NNBSP}567,89{NBSP}€"]
    assert values([-1199, 1500], money.format_signed_euros) == [f"−11,99{NBSP}€", f"+15,00{NBSP}€"]
    typed = ["12,99", "12.99", " 12 € ", "12,9", "1 234,50", "", "douze", "12,999", "-5"]
    assert values(typed, money.parse_euro_input) == [1299, 1299, 1200, 1290, 123450, None, None, None, None]
    assert values([(1299,), (5,)], money.cents_to_input) == ["12,99", "0,05"]
    cases = [(1200, "yearly", 100), (300, "quarterly", 100), (300, "weekly", 1300), (999, "monthly", 999), (999, "unknown", None), (18, "yearly", 2), (100, "quarterly", 33)]
    assert values([(c, p) for c, p, _ in cases], money.monthly_equivalent) == [m for _, _, m in cases]
    assert values([(999, 1049), (999, 1299)], money.is_stable) == [True, False]


DATES = [
    ("05/09", "2026-09-05", True), ("05/09/2026", "2026-09-05", False), ("05/09/25", "2025-09-05", False), ("5 sept.", "2026-09-05", True), ("5 sept", "2026-09-05", True), ("1er octobre", "2026-10-01", True),
    ("12 août 2025", "2025-08-12", False), ("12 aout", "2026-08-12", True), ("Lundi 5 septembre", "2026-09-05", True), ("Aujourd'hui", "2026-10-05", True), ("Aujourd’hui", "2026-10-05", True),
    ("Hier", "2026-10-04", True), ("avant-hier", "2026-10-03", True), ("05.09.2026", "2026-09-05", False), ("5 mars", "2026-03-05", True), ("31/02 puis 3 mai", "2026-05-03", True),
]


def test_dates(values):
    today = F.lit(date(2026, 10, 5))
    found = values([d for d, _, _ in DATES], lambda c: dates.parse_date(c, today))
    assert [(str(x.date), x.approximate) for x in found] == [(i, a) for _, i, a in DATES]
    assert values(["31/02", "13.49 €", "NUAGERIE 200 GO", "29/02"], lambda c: dates.parse_date(c, today)) == [None] * 4
    assert values(["28/12"], lambda c: dates.parse_date(c, F.lit(date(2027, 1, 3)))["date"]) == [date(2026, 12, 28)]
    assert values(["Renouvellement le 2 janvier"], lambda c: dates.parse_date(c, F.lit(date(2026, 12, 20)), "future")["date"]) == [date(2027, 1, 2)]
    heads = ["Lundi 5 septembre", "Mardi 2 septembre 2026", "Aujourd'hui", "Hier", "05/09/2026", "Jeudi 4 sept.", "Lun. 18 mai", "Sam. 16 mai >", "Mar. 5 mai", "Jeu. 30 avr.", "5 mars"]
    assert values(heads, lambda c: dates.is_date_header(c, today)) == [True] * len(heads)
    assert values(["CB NETFLIX 05/09", "Prélèvement du 5 septembre", "PRLV SEPA CINEFLUX", ""], lambda c: dates.is_date_header(c, today)) == [False] * 4


def test_calendar(values):
    cases = [("2026-09-05", "monthly", "2026-10-05"), ("2026-01-31", "monthly", "2026-02-28"), ("2026-09-05", "yearly", "2027-09-05"), ("2026-09-05", "weekly", "2026-09-12"), ("2026-09-05", "unknown", None), ("2024-02-29", "yearly", "2025-02-28")]
    assert values([(date.fromisoformat(d), p) for d, p, _ in cases], dates.next_renewal) == [e and date.fromisoformat(e) for _, _, e in cases]
    words = {"2026-10-05": "aujourd'hui", "2026-10-06": "demain", "2026-10-08": "dans 3 jours", "2026-10-19": "dans 14 jours", "2026-10-20": "le 20 oct.", "2026-10-01": "le 1 oct.", "2027-02-03": "le 3 févr."}
    assert values([date.fromisoformat(d) for d in words], lambda c: dates.relative_day(c, F.lit(date(2026, 10, 5)))) == list(words.values())


def test_similarity(values):
    assert fuzzy.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961, abs=5e-4)
    assert values([("SPOTIFY", "SPOTIFV"), ("DEEZER", "ONDEA"), ("ABC", "ABC"), ("", "ABC")], fuzzy.similarity)[2:] == [1.0, 0.0]
    a, b = values([("SPOTIFY", "SPOTIFV"), ("DEEZER", "ONDEA")], fuzzy.similarity)
    assert a > 0.92 and b < 0.7


def test_folding(values):
    (folded,) = values([f"DESCRIPTION:{'é' * 60}"], reports.fold)
    assert all(len(part.encode()) <= 75 for part in folded.split("\r\n")) and folded.replace("\r\n ", "") == f"DESCRIPTION:{'é' * 60}"


def test_web(values):
    assert values(["/Captures//?x=1", "", "installer/", "/nope#a", "?q"], web.normalize_path) == ["/captures", "/", "/installer", "/nope", "/"]
    assert values(["/Captures//?x=1", "", "/nope"], web.resolve_route) == ["captures", "home", "notFound"]
    phone = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605 Version/17.0 Mobile/15E148 Safari/604.1"
    agents = [(phone, 5, "ios", "safari"), (phone + " Instagram", 5, "ios", "in-app"), ("Macintosh Safari/600", 5, "ios", "in-app"), ("Android 14 Chrome/120 Safari/537", 5, "android", "chrome"), ("Windows Edg/120", 0, "other", "edge")]
    assert values([(a, t) for a, t, _, _ in agents], lambda a, t: F.concat_ws(" ", web.operating_system(a, t), web.browser(a, web.operating_system(a, t)))) == [f"{o} {b}" for _, _, o, b in agents]
    hosts = [("localhost", "http:", "this-computer-only"), ("127.0.0.1", "https:", "this-computer-only"), ("[::1]", "http:", "this-computer-only"), ("192.168.1.4", "http:", "no-https"), ("192.168.1.4", "https:", None), ("example.org", "http:", None)]
    assert values([(h, p) for h, p, _ in hosts], web.local_address_issue) == [e for _, _, e in hosts]
    assert values(["https://a.example//"], web.shareable_url) == ["https://a.example/"]
    policy = F.create_map(F.lit("a"), F.array(F.lit("x"), F.lit("y")), F.lit("b"), F.array(F.lit("z")))
    assert values(["_"], lambda _: web.policy(policy)) == ["a x y; b z"]


def test_marks_lose_no_match(spark, values):
    """What is searched only in texts with its mark is found as by the bare patterns."""
    import random
    import re

    from ebbtide.functions.patterns import java, matches

    words = sorted({w for w in dates.MONTH_WORDS} | {"ma", "juini", "fevrr", "sepbre", "octobr", "janierr"})
    bare = values(words, lambda c: F.coalesce(*(F.when(c.rlike(f"^(?:{p})$"), F.lit(i)) for i, p in enumerate(dates.MONTHS, 1))))
    assert values(words, dates.month_from_word) == bare and None in bare
    dice = random.Random(5)
    parts = ["12", "3", ",50", ".05", " ", " ", "€", "EUR", "E", "l", "O", "-", "+", "/", "mai", "REF", "ID", "CB", "PAR", "MOIS", "ANNUEL", "1O,9l", "X1234", "hier", "a", "Ä", "^", "`", "\u00a0"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 7))) for _ in range(3000)]
    whole = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    pieces = money._pieces(F.col("t"), money.AMOUNT, r"[^\d+\-−–]")
    mended = money._pieces(F.col("t"), money.MISREAD, r"[^+\-−–\dOoIl]")
    part = lambda p, k: F.regexp_extract(p, f"^{money.AMOUNT}$", k)
    wrong = {
        "amounts": F.exists(pieces, money._accepted) & ~F.col("t").rlike(money.PRICED),
        "accents": (F.col("t").rlike("Ä") | (F.translate("t", text._FROM, text._TO) != F.col("t"))) & ~F.col("t").rlike(text.ACCENT_MARK),
        "accepted": F.exists(pieces, lambda p: money._accepted(p) != ((part(p, 2) != "") & ((part(p, 3) != "") | ~part(p, 4).isin("", "E")))),
        "digits": F.exists(mended, lambda p: (F.length(p) > 3) & p.rlike(r"^[+\-−–]?[\dOoIl]+[,.][\dOoIl]{2}$")) & ~F.col("t").rlike(money.MISREAD),
        "noise": F.exists(F.array(*(matches(F.col("t"), p) for p in text.NOISE)), lambda x: x) & ~F.col("t").rlike(text.NOISE_MARK),
        "prefixes": F.col("t").rlike(java(rf"^(?:{'|'.join(text.PREFIXES)})")) & ~F.col("t").rlike(text.PREFIX_MARK),
        "periods": F.exists(F.array(*(matches(F.col("t"), p) for p, _ in text.PERIOD_WORDS)), lambda x: x) & ~F.col("t").rlike(text.PERIOD_MARK),
    }
    assert whole.select(*(F.count_if(w).alias(n) for n, w in wrong.items())).first().asDict() == dict.fromkeys(wrong, 0)
    assert any(re.search(money.PRICED, t) for t in texts) and not all(re.search(money.PRICED, t) for t in texts)
