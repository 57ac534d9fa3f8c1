"""Detection, parsers, portfolio and exports on small hand-made cases."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ebbtide.core import broadcast_up_to
from ebbtide.functions.fuzzy import jaro_winkler
from ebbtide.functions.text import normalize_label
from ebbtide.operators import detect, lines, matching, pages, pixels, portfolio, reports
from ebbtide.operators.dedupe import dedupe
from ebbtide.operators.periodicity import periodicity
from ebbtide.sources import captures, dictionary
from ebbtide.sources.store import Portfolio
from ebbtide.streaming import imports

NOW = TODAY = None  # columns, made once there is a session


@pytest.fixture(autouse=True)
def clock(spark):
    global NOW, TODAY
    NOW, TODAY = F.lit("2026-10-05 10:00:00").cast("timestamp"), F.lit(date(2026, 10, 5))


def day(text):
    return text and date.fromisoformat(text)


@pytest.fixture
def tx(spark):
    def make(*rows):
        """(label, fields) pairs in order, all of one import."""
        out = []
        for i, (label, fields) in enumerate(rows):
            base = dict(import_id="u", pos=i, id=f"t{i}", raw_text=label, label=label, normalized_label=None, amount_cents=None, currency="EUR", date=None, date_is_approximate=None, direction="debit", kind="unknown")
            base |= dict(source="screenshot_card_history", capture_index=0, ocr_confidence=None, period_hint=None, renewal_date=None, trial_ends_at=None) | fields
            for c in ("date", "renewal_date", "trial_ends_at"):
                base[c] = day(base[c])
            out.append(base)
        return spark.createDataFrame(out, captures.TRANSACTION).withColumn("normalized_label", F.coalesce("normalized_label", normalize_label(F.col("label"))))

    return make


def found(rows, *columns):
    d = detect.detect(rows)
    return [tuple(r) for r in d.subscriptions.orderBy(*detect.surest_first()).select(*columns).collect()], d


def test_dedupe_keeps_repeats_of_the_first_capture(tx):
    cafe = dict(amount_cents=250, date="2026-09-05")
    rows = tx(("CB CAFE", cafe), ("CB CAFE", cafe), ("CB CAFE", cafe | {"capture_index": 1}))
    assert sorted(r.id for r in dedupe(rows).collect()) == ["t0", "t1"]


def test_dedupe_and_periodicity_as_loops_would(spark):
    random.seed(3)
    rows = [("u", i, random.choice("ab"), random.choice([None, 1, 2]), random.choice([None, date(2026, 1, random.choice((1, 8, 15)))]), random.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "import_id string, pos long, source string, amount_cents long, date date, capture_index int").selectExpr("*", "source as normalized_label", "source as direction")
    first, kept = {}, []
    for r in rows:
        if first.setdefault(r[2:5], r[5]) == r[5]:
            kept.append(r[1])
    assert sorted(r.pos for r in dedupe(df).collect()) == kept
    gaps = [(g, date.fromordinal(738000 + random.randrange(12) * 7), random.choice([None, 999, 1049, 4500])) for g in range(40) for _ in range(random.randrange(1, 5))]
    told = {r.g: (r.period, r.occurrences) for r in periodicity(spark.createDataFrame(gaps, "g int, date date, amount_cents long"), ["g"]).collect()}
    for g in {x[0] for x in gaps}:
        days = sorted({d for h, d, _ in gaps if h == g})
        cents = [c for h, _, c in gaps if h == g and c]
        steps = {(b - a).days for a, b in zip(days, days[1:], strict=False)}
        stable = len(cents) < 2 or max(cents) - min(cents) <= max(100, min(cents) * 0.1)
        names = {next((n for n, lo, hi in (("weekly", 5, 9), ("monthly", 26, 35), ("quarterly", 84, 98), ("yearly", 350, 380)) if lo <= s <= hi), None) for s in steps}
        expected = (*names, len(days)) if len(names) == 1 and None not in names and stable else (None, None)
        assert told[g] == expected


@pytest.mark.parametrize("days, period", [(["2026-07-05", "2026-08-05", "2026-09-04"], "monthly"), (["2026-09-01", "2026-09-08", "2026-09-15"], "weekly"), (["2026-01-10", "2026-04-11"], "quarterly"), (["2025-09-03", "2026-09-03"], "yearly"), (["2026-09-05"], None), (["2026-09-01", "2026-09-15"], None)])
def test_periods(spark, days, period):
    rows = spark.createDataFrame([("g", day(d), 999) for d in days], "g string, date date, amount_cents long")
    assert periodicity(rows, ["g"]).first().period == period


def test_rules(tx):
    got, d = found(tx(("PRLV SEPA NETFLIX.COM", dict(amount_cents=1000, date="2026-09-05", kind="sepa"))), "service_id", "display_name", "confidence", "period", "period_is_estimated", "monthly_equivalent_cents", "next_renewal", "category", "status")
    assert got == [("netflix", "Netflix", "high", "monthly", True, 1000, date(2026, 10, 5), "streaming", "pending")]
    got, d = found(tx(*((t, dict(amount_cents=c, kind="sepa")) for t, c in (("PRLV SEPA CINEFLUX", 1199), ("PRLV SEPA DGFIP IMPOT", 12000), ("PRLV SEPA ECHEANCE PRET AUTO", 25000)))), "display_name", "confidence")
    assert got == [("Cineflux", "medium")]
    assert [r.reasons[0] for r in d.other_debits.orderBy("group_ord").collect()] == ["Impôts ou taxes : prélèvement, mais pas un abonnement.", "Crédit ou prêt : prélèvement, mais pas un abonnement."]
    assert detect.totals(d.subscriptions.unionByName(d.other_debits)).first().without_amount == 1
    cloud = [("CB NUAGERIE 200 GO", dict(amount_cents=299, date=x, kind="card")) for x in ("2026-07-03", "2026-08-03", "2026-09-03")]
    assert found(tx(*cloud), "confidence", "period", "period_is_estimated", "monthly_equivalent_cents")[0] == [("medium", "monthly", False, 299)]
    assert found(tx(*cloud[:2]), "confidence")[0] == [("low",)]
    got, d = found(tx(("CB BOULANGERIE", dict(amount_cents=420, date="2026-09-03", kind="card")), ("REMBOURSEMENT", dict(amount_cents=1500, direction="credit")), ("", dict(amount_cents=5000, kind="transfer"))), "id")
    stats = d.stats.first()
    assert got == [] and (stats.transactions, stats.credits, stats.transfers, stats.ignored) == (3, 1, 1, 1)


def test_reconciliation_and_clusters(tx):
    bill = dict(kind="card", capture_index=1)
    rows = tx(
        ("Cinéflux", dict(source="screenshot_store", kind="store", amount_cents=499, period_hint="monthly", renewal_date="2026-10-12")), ("CB APPLE.COM/BILL", bill | dict(amount_cents=499, date="2026-09-12")), ("CB APPLE.COM/BILL", bill | dict(amount_cents=999, date="2026-09-20"))
    )
    got, _ = found(rows, "display_name", "amount_cents", F.size("source_transaction_ids"), "confidence", "period", "next_renewal")
    assert got == [("Cinéflux", 499, 2, "high", "monthly", date(2026, 10, 12)), ("Abonnement Apple", 999, 1, "medium", "unknown", None)]
    debit = dict(source="screenshot_bank_debits", kind="sepa")
    rows = tx(("CINEFLUX SAS", debit), ("PRLV SEPA CINEFLUX", dict(amount_cents=1199, date="2026-09-02", kind="sepa", capture_index=1)), ("CLUB FORME PLUS", debit), ("PRLV CLUB FORME+", dict(amount_cents=2499, kind="sepa", capture_index=1)))
    assert found(rows, "display_name", "amount_cents", "needs_amount")[0] == [("Club Forme+", 2499, False), ("Cineflux", 1199, False)]
    got, _ = found(tx(("ONDEA MUSIQUE", debit)), "needs_amount", "confidence", "reasons")
    assert got[0][:2] == (True, "medium") and "Montant absent de la capture : à compléter." in got[0][2]


def test_detection_of_nothing(tx, spark):
    d = detect.detect(tx(("x", {})).where("false"))
    assert d.subscriptions.count() == d.other_debits.count() == d.stats.count() == 0


def test_matches(spark):
    cases = {
        "PRLV SEPA NETFLIX.COM": "netflix", "CB NETFLIXCOM 05/09": "netflix", "CB*SP0TIFY": "spotify", "CB SPOTIFV": "spotify", "PRLV SEPA DEEZER SA": "deezer", "PAYPAL *DEEZER": "deezer", "PRLV SEPA RED BY SFR": "red-by-sfr", "PRLV SEPA SFR": "sfr", "CB AMAZON PRIRNE": "prime-video",
        "APPLE.COM/BILL": "apple", "CB DISNEY PLUS": "disney-plus", "CB BOULANGERIE DU PORT": None, "CB ORANGERIE DU PARC": None, "CB MAXI SUPERMARCHE": None, "PRLV SEPA CINEFLUX": None, "CB FREE PARKING": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("normalized_label", normalize_label(F.col("raw")))
    services = dictionary.services(spark)
    got = {r.raw: r.service_id for r in rows.join(matching.match(rows, services).withColumnRenamed("label", "normalized_label"), "normalized_label", "left").collect()}
    assert got == cases
    one = spark.createDataFrame([("SPOTIFV",)], "normalized_label string")
    assert matching.match(one, services, threshold=0.999).count() == 0


def test_matching_as_nested_loops_would(spark):
    """Every window of every spelling against every variant."""
    services = dictionary.services(spark)
    variants = [(s.service_ord, s.intermediary, i, v, s.service_id) for s in services.collect() for i, v in enumerate(s.variants)]
    random.seed(5)
    labels = set()
    for *_, v, _ in variants:
        for _ in range(4):
            x = list(v)
            x[random.randrange(len(x))] = random.choice("ABRN .X")
            labels.add("".join(x).strip() + random.choice(["", " PARIS", "COM", " SA"]))
    import re

    def split(s):
        return [t for t in re.split(r"[\s.*/-]+", s) if t]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def score(label, variant):
        t, v = split(label), split(variant)
        spelled, compact, best = " ".join(v), "".join(v), 0
        for i in range(len(t) - len(v) + 1):
            w = " ".join(t[i : i + len(v)])
            if w == spelled:
                return 1
            if len(compact) >= 5 and edits(w, spelled) <= max(1, len(spelled) // 4):
                best = max(best, jaro_winkler(w, spelled))
        if len(compact) >= 7 and any(x.startswith(compact) for x in t):
            best = max(best, 0.97)
        return max(best, 0.99) if len(compact) >= 5 and "".join(t) == compact else best

    expected = {}
    for label in labels:
        ranked = []
        for order, hidden, i, v, service in variants:
            s = max(score(label, v), score(label.replace("RN", "M"), v))
            if s >= 0.92:
                ranked.append((hidden, -s, -len(v), order, i, service))
        if ranked:
            expected[label] = min(ranked)[-1]
    rows = spark.createDataFrame([(x,) for x in labels], "normalized_label string")
    assert {r.label: r.service_id for r in matching.match(rows, services).collect()} == expected


@pytest.mark.parametrize("few", [0, matching.FEW])
def test_variants_near_runs_as_all_pairs_would(spark, few):
    """The pieces miss no pair within the edits, at every length up to 40, and bring none beyond; broadcast or not."""
    random.seed(8)
    letters = "AAABBBCCC "
    texts = {"".join(random.choice(letters) for _ in range(random.randrange(1, 41))).strip() for _ in range(400)}
    texts = {" ".join(t.split()) for t in texts} - {""}

    def changed(t, times):
        for _ in range(times):
            at = random.randrange(len(t) + 1)
            t = random.choice([t[:at] + random.choice("ABC") + t[at:], t[:at] + t[at + 1 :], t[:at] + random.choice("ABC") + t[at + 1 :]])
        return " ".join(t.split())

    runs = {changed(t, random.randrange(len(t) // 4 + 3)) for t in texts for _ in range(3)} - {""}
    services = spark.createDataFrame([(i, f"s{i}", False, [t]) for i, t in enumerate(sorted(texts))], "service_ord int, service_id string, intermediary boolean, variants array<string>")
    known = broadcast_up_to(matching.variants(services), few)
    asked = spark.createDataFrame([(r, len(r.split())) for r in runs], "run string, words int")
    got = matching.near(asked, known)
    pairs = asked.crossJoin(known.select(F.col("words").alias("w"), "spelled", "edits")).where("words = w and (run = spelled or edits > 0 and levenshtein(run, spelled) <= edits)")
    expected = {(r.run, r.spelled) for r in pairs.collect()}
    found = got.collect()
    assert len(found) == len(expected) > 500 and {(r.run, r.spelled) for r in found} == expected
    assert all(abs(r.score - jaro_winkler(r.run, r.spelled)) < 1e-12 for r in found)


def test_matching_ties_and_nothing(spark):
    services = spark.createDataFrame([(0, "a", False, ["LONGNAME", "LONGNAME"]), (1, "b", False, ["LONGNAME"]), (2, "c", True, ["LONGNAMES"])], "service_ord int, service_id string, intermediary boolean, variants array<string>")
    labels = spark.createDataFrame([("LONGNAME",), ("LONGNAMF",), (None,), ("",), ("X" * 30_000,), ("LONGNAME" * 5_000,)], "normalized_label string")
    for few in (0, matching.FEW):
        got = {r.label[:9]: (r.service_id, r.via, round(r.score, 2)) for r in matching.match(labels, services, few=few).collect()}
        assert got == {"LONGNAME": ("a", "c", 1.0), "LONGNAMF": ("a", "c", 0.95), "LONGNAMEL": ("a", None, 0.97)}
        assert matching.match(labels.where("false"), services, few=few).count() == matching.match(labels, services.where("false"), few=few).count() == 0


def page(rows, reference=date(2026, 10, 5), capture="p"):
    """(text, y[, height[, confidence]]) lines, one word each."""
    out = []
    for i, (text, y, *more) in enumerate(rows):
        h, c = (*more, 30, 95)[:2] if len(more) < 2 else more
        words = [(w, float(c), 100.0 * k, float(y), 100.0 * k + 90, float(y + h)) for k, w in enumerate(text.split(" "))]
        out.append((capture, "u", 0, i, text, words, 0.0, float(y), 900.0, float(y + h), float(c), reference))
    return out


LINE = "capture_id string, import_id string, capture_index int, line_pos int, text string, words array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>, x0 double, y0 double, x1 double, y1 double, confidence double, reference date"


def test_bank_page(spark):
    rows = page([
        ("Mes opérations", 10), ("Lundi 7 septembre", 100), ("VIR SEPA M JEAN DUPONT -50,00 €", 200), ("PRLV SEPA NETFLIX.COM -10,00 €", 300), ("Hier", 400), ("CB LIBRAIRIE", 500), ("DU QUAI", 535), ("−12,50 €", 520), ("Carte", 580, 20), ("05/09", 660),
        ("REMBOURSEMENT", 700), ("15,00 €", 705), ("Solde 1 234,00 €", 900),
    ])
    told = pages.parse_bank(spark.createDataFrame(rows, LINE)).orderBy("entry").collect()
    assert [(r.label, r.cents, str(r.date), r.kind, r.direction) for r in told] == [
        ("VIR SEPA M JEAN DUPONT", 5000, "2026-09-07", "transfer", "debit"), ("PRLV SEPA NETFLIX.COM", 1000, "2026-09-07", "sepa", "debit"), ("CB LIBRAIRIE DU QUAI", 1250, "2026-10-04", "card", "debit"), ("REMBOURSEMENT", 1500, "2026-09-05", "unknown", "credit"),
    ]
    read = captures.transactions(spark.createDataFrame(rows, LINE))
    hidden = read.where("kind = 'transfer'").first()
    assert (hidden.raw_text, hidden.label, hidden.normalized_label, hidden.amount_cents) == ("", "", "", 5000)
    got, d = found(read, "display_name")
    assert got == [("Netflix",)] and d.stats.first().transfers == 1


def test_store_page(spark):
    rows = page([
        ("Abonnements", 10), ("Actifs", 50), ("Cinéflux", 100), ("4,99 € / mois", 140), ("Renouvellement le 12 octobre", 180), ("Carnet Malin", 250), ("2,99 € par mois", 290), ("Essai gratuit jusqu'au 20 octobre", 330), ("Nuagerie Pro", 400), ("29,99 € par an", 440), ("Se renouvelle le 3 mars", 480),
        ("Expirés", 550), ("Vieux Jeu", 600), ("9,99 € par mois", 640),
    ])
    df = spark.createDataFrame(rows, LINE)
    assert pages.classify_pages(df).first().kind == "screenshot_store"
    got, _ = found(captures.transactions(df), "display_name", "amount_cents", "period", "monthly_equivalent_cents", "next_renewal", "trial_ends_at", "category", "confidence")
    assert got == [
        ("Cinéflux", 499, "monthly", 499, date(2026, 10, 12), None, "autre", "high"), ("Carnet Malin", 299, "monthly", 299, None, date(2026, 10, 20), "essai", "high"), ("Nuagerie Pro", 2999, "yearly", 250, date(2027, 3, 3), None, "autre", "high"),
    ]


def test_words_to_lines(spark):
    words = [
        ("−11,99", 880, 98, 990, 132, 90), ("€", 1000, 100, 1020, 130, 90), ("PRLV", 40, 100, 120, 130, 90), ("SEPA", 132, 100, 210, 130, 90), ("CINÉFLUX", 222, 101, 380, 131, 90), ("02/09", 40, 40, 120, 66, 80), ("CB", 40, 170, 80, 200, 90), ("BOULANGERIE", 92, 170, 300, 200, 90),
        ("−4,20", 900, 171, 990, 199, 90), ("€", 1000, 171, 1020, 199, 90), (" ", 0, 0, 10, 10, 90), ("flat", 0, 5, 9, 5, 90),
    ]
    df = spark.createDataFrame([("p", i, t, float(c), float(a), float(b), float(x), float(y)) for i, (t, a, b, x, y, c) in enumerate(words)], "capture_id string, word_pos int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    told = lines.group_into_lines(df).orderBy("line_pos").collect()
    assert [r.text for r in told] == ["02/09", "PRLV SEPA CINÉFLUX −11,99 €", "CB BOULANGERIE −4,20 €"]
    assert [list(r.segments) for r in told[1:]] == [["PRLV SEPA CINÉFLUX", "−11,99 €"], ["CB BOULANGERIE", "−4,20 €"]]
    assert (told[1].x0, told[1].y0, told[1].x1, told[1].y1) == (40, 98, 1020, 132) and told[0].confidence == 80
    blocks = spark.sql("select 'p' as capture_id, array(struct(array(struct(array(struct(array(struct('A' as text, 95D as confidence, struct(0D as x0, 0D as y0, 5D as x1, 5D as y1) as bbox)) as words)) as lines)) as paragraphs)) as blocks")
    assert [r.text for r in lines.words_of_blocks(blocks).collect()] == ["A"]


STORED = portfolio.STORED


def item(key, **fields):
    base = dict(id=key, service_id=None, display_name=key, category="autre", amount_cents=1000, period="monthly", period_is_estimated=True, monthly_equivalent_cents=1000, confidence="high", reasons=[], source_transaction_ids=[], source_lines=[], status="pending")
    base |= dict(next_renewal=None, trial_ends_at=None, needs_amount=False, kind="subscription", origin="detected", user_status="keep", created_at=None, updated_at=None) | fields
    return base | {c: day(base[c]) for c in ("next_renewal", "trial_ends_at") if isinstance(base[c], str)}


def test_merge_edit_totals_deadlines(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), STORED)
    saved = make(item("a", source_lines=["ligne 1"], next_renewal="2026-11-01"), item("b", status="confirmed", amount_cents=1500))
    new = make(item("a", amount_cents=1100, source_lines=["ligne 2"]), item("b", amount_cents=999), item("c")).drop(*portfolio.BOOKKEEPING)
    got = {r.id: r for r in portfolio.merge_detections(saved, new, NOW).collect()}
    assert {k: r.change for k, r in got.items()} == {"a": "refreshed", "b": None, "c": "added"}
    assert (got["a"].amount_cents, list(got["a"].source_lines), got["a"].next_renewal, got["b"].amount_cents) == (1100, ["ligne 1", "ligne 2"], date(2026, 11, 1), 1500)
    names = [f.split()[0] for f in portfolio.EDITS.split(", ")]
    edit = lambda **f: spark.createDataFrame([tuple({"clear_amount": False, "clear_renewal": False, "clear_trial": False, **f}.get(n) for n in names)], portfolio.EDITS)
    bare = make(item("a", amount_cents=None, monthly_equivalent_cents=None, needs_amount=True, period="unknown"))
    once = portfolio.apply_edits(bare, edit(id="a", amount_cents=2400, period="yearly", display_name="  "), NOW)
    r = once.first()
    assert (r.amount_cents, r.period, r.period_is_estimated, r.monthly_equivalent_cents, r.needs_amount, r.display_name) == (2400, "yearly", False, 200, False, "a")
    r = portfolio.apply_edits(once, edit(id="a", clear_amount=True), NOW).first()
    assert (r.monthly_equivalent_cents, r.needs_amount) == (None, True)
    six = make(item("a"), item("b", monthly_equivalent_cents=500, user_status="to_cancel"), item("c", status="rejected"), item("d", user_status="cancelled"), item("e", kind="other_debit"), item("f", monthly_equivalent_cents=None, amount_cents=None))
    assert tuple(portfolio.portfolio_totals(six).first()) == (3, 1500, 18000, 1, 6000)
    assert tuple(portfolio.portfolio_totals(six.where("false")).first()) == (0, 0, 0, 0, 0)
    trial = portfolio.manual_rows(spark.createDataFrame([("1", " Essai ", date(2026, 10, 6), 499, "monthly")], "entry_id string, display_name string, trial_ends_at date, amount_cents long, period string"), NOW, trial=True)
    t = trial.first()
    assert (t.id, t.category, t.origin, t.monthly_equivalent_cents, t.display_name) == ("trial:1", "essai", "trial", 499, "Essai")
    five = make(item("far", next_renewal="2026-12-01"), item("soon", next_renewal="2026-10-08"), item("gone", next_renewal="2026-10-07", user_status="cancelled"), item("past", next_renewal="2026-10-01")).unionByName(trial)
    assert [(r.display_name, r.type, r.in_days) for r in portfolio.upcoming_deadlines(five, TODAY).orderBy(*portfolio.soonest_first()).collect()] == [("Essai", "trial_end", 1), ("soon", "renewal", 3)]


def test_calendar_file(spark):
    rows = [item("n", display_name="Netflix", status="confirmed", next_renewal="2026-10-12"), item("t", display_name="Appli, photo; pro", status="confirmed", trial_ends_at="2026-10-20", amount_cents=499), item("x", display_name="Résilié", user_status="cancelled", next_renewal="2026-10-12"), item("old", display_name="Passé", next_renewal="2026-09-01")]
    made = reports.build_calendar(spark.createDataFrame(rows, STORED), TODAY, NOW).first()
    text = made.content
    assert made.events == 2 and text.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n") and text.endswith("END:VCALENDAR\r\n") and all("\n" not in x for x in text.split("\r\n"))
    for part in ("DTSTART;VALUE=DATE:20261012", "DTEND;VALUE=DATE:20261013", "RRULE:FREQ=MONTHLY", "TRIGGER:-P1D", "DTSTART;VALUE=DATE:20261020", "TRIGGER:-P2D", "Fin de l'essai gratuit : Appli\\, photo\\; pro", "DTSTAMP:20261005T100000Z"):
        assert part in text
    assert "Résilié" not in text and "Passé" not in text
    empty = reports.build_calendar(spark.createDataFrame([], STORED), TODAY, NOW).first()
    assert empty.events == 0 and empty.content.endswith("METHOD:PUBLISH\r\nEND:VCALENDAR\r\n")


def test_pixels(spark):
    assert [r[0] for r in spark.createDataFrame([(720, 1600), (1170, 2532), (4000, 6000)], "w int, h int").select(pixels.choose_scale(F.col("w"), F.col("h"))).collect()] == [2.0, 1.0, 0.7]
    hist = spark.createDataFrame([("i", 40, 300), ("i", 220, 700)], "image_id string, level int, n long")
    assert 40 <= pixels.otsu(hist).first().threshold < 220 and pixels.percentile_level(hist, 0.3).first().level == 40
    assert pixels.mean_level(hist).first().mean == 166 and pixels.mean_level(pixels.inverted(hist)).first().is_dark
    grey = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255)], "r int, g int, b int").select(pixels.luminance(*map(F.col, "rgb")))
    assert [r[0] for r in grey.collect()] == [76, 149, 29]
    image = lambda n, ground, ink, m: bytes(b for k in range(n) for b in (*([ink] * 3 if k < m else [ground] * 3), 255))
    run = lambda data, **options: pixels.prepare(spark.createDataFrame([(bytearray(data),)], "pixels binary"), **options).first().prepared
    dark = run(image(100, 15, 235, 10))
    assert dark.inverted and dark.pixels[0] < 60 and dark.pixels[99 * 4] > 200
    assert run(image(1000, 255, 170, 100), invert="off").pixels[0] < 40
    cut = run(image(100, 240, 60, 30), binarize=True)
    assert cut.threshold is not None and set(cut.pixels[::4]) == {0, 255}


def test_store_and_stream(spark, tmp_path):
    saved = Portfolio(spark, str(tmp_path / "saved"), "import_id string")
    assert saved.read().count() == 0 and saved.checked_categories().first()[0] == []
    rows = page([("Lundi 7 septembre", 100), ("PRLV SEPA NETFLIX.COM -10,00 €", 200), ("PRLV SEPA CINEFLUX -11,99 €", 300)])
    df = spark.createDataFrame(rows, LINE).withColumns({"segments": F.array("text"), "unreadable": F.lit(False), "of_captures": F.lit(1)}).selectExpr(*[c.split()[0] for c in imports.LINES.replace("struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>", "s").split(", ")])
    for _ in range(2):  # the same captures again change nothing
        df.write.mode("append").parquet(str(tmp_path / "in"))
        imports.merge_stream(imports.line_stream(spark, str(tmp_path / "in")), saved, str(tmp_path / "state"), lambda: NOW).awaitTermination()
        assert sorted(r.display_name for r in saved.read().collect()) == ["Cineflux", "Netflix"]
    saved.delete(saved.read().where("display_name = 'Cineflux'"))
    assert [r.display_name for r in saved.read().collect()] == ["Netflix"]
    saved.set_checked_categories(["sport"])
    assert list(saved.checked_categories().first()[0]) == ["sport"]
    saved.prune(1)
    saved.wipe()
    assert saved.read().count() == 0 and saved.checked_categories().first()[0] == []
