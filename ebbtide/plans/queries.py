"""Queries over the driver's tables, one or more for each operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.core import by_distinct, checkpoint_dir, table
from ebbtide.functions import dates, money, text, web
from ebbtide.operators import dedupe as dedupe_
from ebbtide.operators import detect as detect_
from ebbtide.operators import lines as lines_
from ebbtide.operators import matching, pages, pixels, portfolio, reports
from ebbtide.operators.periodicity import periodicity as periodicity_
from ebbtide.plans.views import CENTS, DAY, MONTHLY, PERIOD, ROWS, SAVED_SQL, TEMPLATE_SQL, TODAY, TX_SQL, labelled_orders, orders, transactions
from ebbtide.plans.views import portfolio as saved_rows
from ebbtide.sources import calendars, captures, dictionary
from ebbtide.sources.store import LiveTotals, Portfolio
from ebbtide.streaming import imports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _day(value: str = "2026-10-05") -> Column:
    return F.lit(value).cast("date")


# ---- detection ----

_MERCHANT = "case when source = 'screenshot_store' then 'store:' else 'label:' end"
_DETECTED = f"""with tx as {TX_SQL},
first_seen as (select *, first_value(capture_index) over (partition by import_id, source, norm, amount_cents, date, direction order by pos) as seen_in, nullif(word, '') as wd from tx),
fates as (select *, case when capture_index <> seen_in then 'duplicate' when direction = 'credit' then 'credit' when kind = 'transfer' then 'transfer' when never is not null then 'ignored' end as fate from first_seen),
going as (select *, service is not null and service not in ('apple', 'google-play', 'paypal') as own, service in ('apple', 'google-play') and source <> 'screenshot_store' and other is null as hidden from fates where fate is null),
leaders as (select import_id as li, source = 'screenshot_store' as ls, alike as la, arg_min(mkey, pos) as leader from going where alike is not null and coalesce(own, false) = false and other is null and not coalesce(hidden, false) group by all),
routed as (select g.*, case when own then 'service:' || service when other is not null then 'other:' || norm when hidden then 'via:' || service || ':' || coalesce(amount_cents::varchar, '?') else {_MERCHANT} || leader end as gk0,
  case when own then via when hidden then service end as via_id, case when coalesce(own, false) = false and other is null and not coalesce(hidden, false) then wd end as keyword
  from (select * replace (coalesce(own, false) as own, coalesce(hidden, false) as hidden) from going) g left join leaders on li = import_id and ls = (source = 'screenshot_store') and la = alike and not own and other is null and not hidden),
born as (select import_id, gk0, min(pos) as b from routed group by all),
target as (select r.import_id, r.amount_cents, arg_min(r.gk0, b) as t from routed r join born using (import_id, gk0) where source = 'screenshot_store' and r.amount_cents is not null group by all),
moves as (select r.import_id, r.gk0, t, min(r.pos) as mv from routed r join target using (import_id, amount_cents) where r.gk0 like 'via:%' group by all),
led as (select r.*, coalesce(m.t, r.gk0) as gk, mv, row_number() over (partition by r.import_id, coalesce(m.t, r.gk0) order by mv is not null, coalesce(mv, 0), pos) as seq from routed r left join moves m using (import_id, gk0)),
gaps as (select import_id, gk, d, d - lag(d) over (partition by import_id, gk order by d) as gap from (select distinct import_id, gk, date as d from led where date is not null)),
bands as (select *, case when gap between 5 and 9 then 'weekly' when gap between 26 and 35 then 'monthly' when gap between 84 and 98 then 'quarterly' when gap between 350 and 380 then 'yearly' end as band from gaps),
regular as (select import_id, gk, count(*) as n, count(gap) = count(band) and min(band) = max(band) and count(*) > 1 as ok, min(band) as band from bands group by all),
stable as (select import_id, gk, coalesce(max(amount_cents) - min(amount_cents) <= greatest(100.0::double, min(amount_cents) * 0.1::double), true) as st from led where date is not null group by all),
g as (select l.import_id, gk, min(pos) filter (mv is null) as group_ord, arg_min(service, seq) filter (own) as sid, first(other order by seq) as reason, first(keyword order by seq) as kw, first(via_id order by seq) as v1, first(via_id order by seq) filter (mv is not null) as v2,
  bool_or(source = 'screenshot_store') as st, first(amount_cents order by seq) filter (source = 'screenshot_store') as s_amount, first(raw order by seq) filter (source = 'screenshot_store') as s_label,
  first(period_hint order by seq) filter (source = 'screenshot_store') as s_hint, first(renewal_date order by seq) filter (source = 'screenshot_store') as s_renewal, first(trial_ends_at order by seq) filter (source = 'screenshot_store') as s_trial,
  bool_or(kind = 'sepa') as sepa, first(date order by date desc nulls last, seq) as l_date, first(amount_cents order by date desc nulls last, seq) as l_amount, first(norm order by date desc nulls last, seq) as l_norm,
  first(amount_cents order by seq) filter (amount_cents is not null) as f_amount, first(norm order by seq) filter (amount_cents is not null) as f_norm, count(*) as n_sources
  from led l group by l.import_id, gk),
j as (select g.*, coalesce(v1, v2) as via_id, case when r.ok and s.st then r.band end as seen, case when r.ok and s.st then r.n end as times, coalesce(s_amount, l_amount, f_amount) as amount_cents, nullif(s_hint, 'unknown') as hint,
  case when sid in ('prime-video') then 'unknown' when sid is not null then 'monthly' end as usual from g left join regular r using (import_id, gk) left join stable s using (import_id, gk)),
p as (select *, coalesce(hint, seen, usual, 'unknown') as period, case when sid is not null or st then 'high' when reason is not null or via_id is not null or kw is not null or sepa then 'medium' when times >= 3 then 'medium' when times is not null then 'low' end as confidence from j)"""

_SUBSCRIPTIONS = f"""{_DETECTED},
names(sid, sname, scat) as (values ('netflix', 'Netflix', 'streaming'), ('spotify', 'Spotify', 'musique'), ('deezer', 'Deezer', 'musique'), ('prime-video', 'Amazon Prime', 'streaming'), ('red-by-sfr', 'RED by SFR', 'telephonie'), ('disney-plus', 'Disney+', 'streaming')),
vias(via_id, vname) as (values ('apple', 'Apple'), ('google-play', 'Google Play'), ('paypal', 'PayPal'))
select import_id, 'sub:' || gk as id, p.sid as service_id, coalesce(sname, case when st then s_label end, case when gk like 'via:%' then 'Abonnement ' || vname end,
  array_to_string(list_transform(string_split(lower(coalesce(f_norm, l_norm)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) as display_name,
coalesce(scat, kw, case when s_trial is not null then 'essai' end, 'autre') as category, amount_cents::bigint as amount_cents, period, (hint is null and seen is null) as period_is_estimated,
{MONTHLY} as monthly_equivalent_cents, confidence, coalesce(s_renewal, case period when 'weekly' then l_date + 7 when 'monthly' then (l_date + interval 1 month)::date when 'quarterly' then (l_date + interval 3 month)::date when 'yearly' then (l_date + interval 12 month)::date end) as next_renewal,
s_trial as trial_ends_at, amount_cents is null as needs_amount, case when reason is not null then 'other_debit' else 'subscription' end as kind, n_sources::int as n_sources, group_ord
from p left join names using (sid) left join vias using (via_id) where confidence is not null"""


@query(_SUBSCRIPTIONS)
def detect_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: everything from raw labels to detected subscriptions and other debits."""
    found = detect_.detect(transactions(spark, sf_dir))
    rows = found.subscriptions.unionByName(found.other_debits)
    return rows.select(
        "import_id", "id", "service_id", "display_name", "category", "amount_cents", "period", "period_is_estimated", "monthly_equivalent_cents", "confidence", "next_renewal", "trial_ends_at", "needs_amount", "kind",
        F.size("source_transaction_ids").alias("n_sources"), "group_ord",
    )


@query(f"""{_DETECTED}, f as (select import_id, count(*) as transactions, count_if(fate = 'duplicate') as duplicates, count_if(fate = 'credit') as credits, count_if(fate = 'transfer') as transfers, count_if(fate = 'ignored') as i from fates group by 1),
x as (select import_id, sum(n_sources) filter (confidence is null) as dropped, count_if(confidence = 'high' and reason is null) as high, count_if(confidence = 'medium' and reason is null) as medium, count_if(confidence = 'low' and reason is null) as low from p group by 1)
select import_id, transactions, duplicates, credits, transfers, (i + coalesce(dropped, 0))::bigint as ignored, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low from f left join x using (import_id)""")  # fmt: skip
def stats_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect_.detect(transactions(spark, sf_dir)).stats
    return told.select("import_id", "transactions", "duplicates", "credits", "transfers", "ignored", *(F.col("by_confidence")[c].alias(c) for c in detect_.CONFIDENCES))


@query(f"select id, capture_index from (select *, first_value(capture_index) over (partition by import_id, source, norm, amount_cents, date, direction order by pos) as f from {TX_SQL}) where capture_index = f")
def dedupe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_.dedupe(transactions(spark, sf_dir)).select("id", "capture_index")


@query(f"""select id, case when service not in ('apple', 'google-play', 'paypal') then 'service:' || service when other is not null then 'other:' || norm when service is not null and source <> 'screenshot_store'
then 'via:' || service || ':' || coalesce(amount_cents::varchar, '?') else {_MERCHANT} || mkey end as route, case when service not in ('apple', 'google-play', 'paypal') then via when other is null and service is not null and source <> 'screenshot_store' then service end as via_id from {TX_SQL}""")  # fmt: skip
def route_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_.routed(transactions(spark, sf_dir), dictionary.services(spark)).select("id", "route", "via_id")


@query(f"""select import_id, {_MERCHANT} || mkey as route, {_MERCHANT} || first_value(mkey) over (partition by import_id, source = 'screenshot_store', grp order by p) as group_key
from (select import_id, any_value(source) as source, mkey, coalesce(alike, mkey) as grp, min(pos) as p from {TX_SQL} where other is null and (service is null or (service in ('apple', 'google-play', 'paypal') and source = 'screenshot_store')) group by import_id, source = 'screenshot_store', mkey, coalesce(alike, mkey))""")  # fmt: skip
def cluster_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the merchants that no service, reason or intermediary claims."""
    routes = detect_.routed(transactions(spark, sf_dir), dictionary.services(spark)).where("unknown_merchant")
    return detect_.clustered(routes).select("import_id", "route", "group_key").distinct()


@query("""with r as (select o_orderkey as k, o_orderkey % 2 = 0 as a, o_orderkey % 3 = 0 as b, o_orderkey % 5 = 0 as c, o_orderkey % 7 = 0 as d, o_orderkey % 11 = 0 as e, o_orderkey % 13 = 0 as f, case when o_orderkey % 4 > 0 then o_orderkey % 4 + 1 end as n from orders)
select k, case when a or b then 'high' when c or d or e or f then 'medium' when n >= 3 then 'medium' when n is not null then 'low' end as confidence from r""")  # fmt: skip
def confidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    flags = [k % m == 0 for m in (2, 3, 5, 7, 11, 13)]
    return orders(spark, sf_dir).select(k.alias("k"), detect_.confidence_rule(*flags, F.when(k % 4 > 0, k % 4 + 1)).alias("confidence"))


@query(f"select user_id, id, row_number() over (partition by user_id order by case confidence when 'high' then 0 when 'medium' then 1 else 2 end, coalesce(monthly_equivalent_cents, 0) desc, coalesce(amount_cents, 0) desc, id) as place from {SAVED_SQL}")
def detection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_rows(spark, sf_dir).select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy(*detect_.surest_first("id"))).alias("place"))


@query("""with e as (select user_id, event_type, floor(value / 2)::bigint as bucket, ts::date as d, round(value * 100)::bigint as c from events),
gaps as (select *, d - lag(d) over (partition by user_id, event_type, bucket order by d) as gap from (select user_id, event_type, bucket, d, min(c) as lo, max(c) as hi from e group by all)),
b as (select *, case when gap between 5 and 9 then 'weekly' when gap between 26 and 35 then 'monthly' when gap between 84 and 98 then 'quarterly' when gap between 350 and 380 then 'yearly' end as band from gaps),
r as (select user_id, event_type, bucket, count(*) as n, count(gap) = count(band) and min(band) = max(band) and count(*) > 1 and max(hi) - min(lo) <= greatest(100.0::double, min(lo) * 0.1::double) as ok, min(band) as band from b group by all)
select user_id, event_type, bucket, case when ok then band end as period, case when ok then n end as occurrences from r""")  # fmt: skip
def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") / 2).alias("bucket"), F.to_date("ts").alias("date"), F.round(F.col("value") * 100).cast("long").alias("amount_cents"))
    return periodicity_(rows, ["user_id", "event_type", "bucket"])


# ---- labels and the dictionary ----


@query(f"""select o_orderkey as k, norm, tkind as kind, mkey, word as category, other, never is not null as never from orders join {TEMPLATE_SQL} on o_orderkey % 24 = n""")
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, n = F.col("raw"), F.col("norm")
    rows = by_distinct(labelled_orders(spark, sf_dir), "raw", norm=text.normalize_label(raw), kind=text.payment_kind(raw)).select(F.col("o_orderkey").alias("k"), "norm", "kind")
    return by_distinct(rows, "norm", mkey=text.merchant_key(n), category=text.keyword(n)["category"], other=text.other_debit_reason(n), never=text.never_subscription(n))


@query(f"select norm, service, via from {TEMPLATE_SQL} where service is not null and n in (select o_orderkey % 24 from orders)")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(transactions(spark, sf_dir), dictionary.services(spark))
    return found.select(F.col("label").alias("norm"), F.col("service_id").alias("service"), "via")


@query("select p_partkey, levenshtein(p_name, p_type)::int as d, levenshtein(p_name, p_type) <= 5 as near from part")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.levenshtein("p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("d"), (F.levenshtein("p_name", "p_type", 5) >= 0).alias("near"))


@query("""select doc_id, strip_accents(regexp_replace(text, '[\\x5E\\x60\\x{A8}\\x{AF}\\x{B4}\\x{B7}\\x{B8}]', '', 'g')) as plain from documents""")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_type || ' x-y'), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda v: upper(v[1]) || v[2:]), '-')), ' ') as title from part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat("p_type", F.lit(" x-y"))).alias("title"))


# ---- amounts and dates in text ----

_DEC = "lpad(cast(cents % 100 as varchar), 2, '0')"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{CENTS} as cents")
    shown = F.regexp_replace(money.format_euros(F.col("cents")), "[  ]", " ")
    sign = F.when(F.col("k") % 3 == 0, "-").when(F.col("k") % 3 == 1, "+").otherwise("")
    return rows.select("k", "cents", sign.alias("sign"), F.concat(F.lit("CB ACHAT "), sign, shown).alias("t"), F.concat(F.lit("X "), sign, F.translate(F.regexp_replace(shown, r" (?=\d)", ""), "01", "Ol")).alias("misread"))


@query(f"select o_orderkey as k, {CENTS} as cents, case o_orderkey % 3 when 0 then 'debit' when 1 then 'credit' else 'unknown' end as direction, 1 as n, 'CB ACHAT' as rest from orders")
def find_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _priced(spark, sf_dir).select("k", money.amounts(F.col("t")).alias("a"), money.without_amounts(F.col("t")).alias("rest"))
    last = F.element_at("a", -1)
    return rows.select("k", last["cents"].alias("cents"), last["direction"].alias("direction"), F.size("a").alias("n"), "rest")


@query(f"""select o_orderkey as k, case when regexp_matches(cents::varchar, '[2-9]') then cents end as cents from (select o_orderkey, {CENTS} as cents from orders)""")
def fix_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts whose 0 and 1 were read as O and l; those whose digits were all misread hold no amount."""
    return _priced(spark, sf_dir).select("k", money.last_amount(F.col("misread"))["cents"].alias("cents"))


@query(f"""select o_orderkey as k, {DAY} as slashed, {DAY} as dotted, {DAY} as worded, cast({DAY} + to_years((2000 + year({DAY}) % 100 - year({DAY}))::int) as date) as short_year, case when month({DAY}) = 2 and day({DAY}) = 29 then null
else make_date((case when month({DAY}) * 100 + day({DAY}) > 1005 then 2025 else 2026 end)::bigint, month({DAY}), day({DAY})) end as guessed from orders""")  # fmt: skip
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("d")
    months = F.array(*(F.lit(m) for m in ("janvier", "févr.", "mars", "avril", "Mai", "juin", "juillet", "août", "SEPT", "octobre", "nov.", "décembre")))
    ref = _day()
    rows = orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{DAY} as d").withColumn("w", F.concat_ws(" ", F.lit("le"), F.dayofmonth(day), F.get(months, F.month(day) - 1), F.year(day)))
    read = lambda t: dates.parse_date(t, ref)["date"]
    return rows.select(
        "k", read(F.date_format(day, "'du' d/M/yyyy")).alias("slashed"), read(F.date_format(day, "dd-MM-yyyy")).alias("dotted"), read(F.col("w")).alias("worded"),
        read(F.date_format(day, "dd/MM/yy")).alias("short_year"), read(F.date_format(day, "dd/MM")).alias("guessed"),
    )


@query(f"""with c as (select o_orderkey as k, {CENTS} as cents from orders), d as (select *, {_DEC} as dd, cents // 100 as w from c)
select k, regexp_replace(case when w >= 1000000 then (w // 1000000)::varchar || chr(8239) || lpad((w // 1000 % 1000)::varchar, 3, '0') || chr(8239) || lpad((w % 1000)::varchar, 3, '0') when w >= 1000 then (w // 1000)::varchar || chr(8239) || lpad((w % 1000)::varchar, 3, '0') else w::varchar end, '$', ',' || dd || chr(160) || '€') as euros,
case when k % 100 = 0 then '+' else chr(8722) end || '0,' || lpad((k % 100)::varchar, 2, '0') || chr(160) || '€' as signed, cents as parsed, w::varchar || ',' || dd as typed, cents * 12 as yearly from d""")  # fmt: skip
def format_euros(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.col("cents")
    rows = orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{CENTS} as cents")
    return rows.select(
        "k", money.format_euros(cents).alias("euros"), money.format_signed_euros(-(F.col("k") % 100)).alias("signed"),
        money.parse_euro_input(money.format_euros(cents)).alias("parsed"), money.cents_to_input(cents).alias("typed"), money.yearly_from_monthly(cents).alias("yearly"),
    )


@query(f"select o_orderkey as k, {PERIOD} as period, m as monthly from (select o_orderkey, {MONTHLY} as m from (select o_orderkey, {CENTS} as amount_cents, {PERIOD} as period from orders))")
def monthly_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{CENTS} as cents", f"{PERIOD} as period")
    return rows.select("k", "period", money.monthly_equivalent(F.col("cents"), F.col("period")).alias("monthly"))


@query(f"select o_orderkey as k, case {PERIOD} when 'weekly' then {DAY} + 7 when 'monthly' then ({DAY} + interval 1 month)::date when 'quarterly' then ({DAY} + interval 3 month)::date when 'yearly' then ({DAY} + interval 12 month)::date end as next from orders")
def next_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{DAY} as d", f"{PERIOD} as period").select("k", dates.next_renewal(F.col("d"), F.col("period")).alias("next"))


_SHORT = "['janv.', 'févr.', 'mars', 'avr.', 'mai', 'juin', 'juil.', 'août', 'sept.', 'oct.', 'nov.', 'déc.']"


@query(f"""select k, case when n = 0 then 'aujourd''hui' when n = 1 then 'demain' when n between 2 and 14 then 'dans ' || n || ' jours' else 'le ' || day(d) || ' ' || ({_SHORT})[month(d)] end as told
from (select o_orderkey as k, {TODAY} + (o_orderkey % 60 - 20)::int as d, o_orderkey % 60 - 20 as n from orders)""")  # fmt: skip
def relative_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).selectExpr("o_orderkey as k", f"{TODAY} + cast(o_orderkey % 60 - 20 as int) as d")
    return rows.select("k", dates.relative_day(F.col("d"), _day()).alias("told"))


# ---- the portfolio ----

_COUNTED = "kind = 'subscription' and status <> 'rejected' and user_status <> 'cancelled'"


@query(f"select user_id, count_if({_COUNTED}) as count, coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED}), 0)::bigint as monthly_cents, (12 * coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED}), 0))::bigint as yearly_cents, count_if({_COUNTED} and monthly_equivalent_cents is null) as incomplete, (12 * coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED} and user_status = 'to_cancel'), 0))::bigint as savings_yearly_cents from {SAVED_SQL} group by user_id")
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.portfolio_totals(saved_rows(spark, sf_dir), ("user_id",))


@query(f"select coalesce(sum(monthly_equivalent_cents) filter (kind = 'subscription' and status <> 'rejected'), 0)::bigint as monthly_cents, (12 * coalesce(sum(monthly_equivalent_cents) filter (kind = 'subscription' and status <> 'rejected'), 0))::bigint as yearly_cents, count_if(kind = 'subscription' and status <> 'rejected' and monthly_equivalent_cents is null) as without_amount from {SAVED_SQL}")
def engine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_.totals(saved_rows(spark, sf_dir))


_DEADLINES = f"select user_id, id, type, deadline, (deadline - {TODAY})::int as in_days, type_ord from (select user_id, id, 'trial_end' as type, trial_ends_at as deadline, 0 as type_ord, status, user_status from {SAVED_SQL} union all select user_id, id, 'renewal', next_renewal, 1, status, user_status from {SAVED_SQL}) where status <> 'rejected' and user_status <> 'cancelled' and deadline - {TODAY} between 0 and 30"


@query(_DEADLINES)
def upcoming_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.upcoming_deadlines(saved_rows(spark, sf_dir), _day()).select("user_id", "id", "type", "deadline", "in_days", "type_ord")


@query(f"{_DEADLINES} order by in_days, id, type_ord limit 5")
def top5_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five soonest: the limit is the report."""
    return upcoming_deadlines(spark, sf_dir).orderBy(*portfolio.soonest_first()).limit(5)


def _number() -> Column:
    return F.replace("id", F.lit("sub:")).cast("long")


def _saved_before(rows: DataFrame) -> DataFrame:
    return rows.where(_number() % 3 < 2)


def _detected_now(rows: DataFrame) -> DataFrame:
    amount = F.when(_number() % 2 == 0, F.col("amount_cents") + 100)
    return rows.where(_number() % 3 > 0).withColumns({"amount_cents": amount, "status": F.lit("pending"), "source_lines": F.array(F.lit("again"))})


_MERGED_SQL = f"""(with s as {SAVED_SQL}, old as (select * from s where replace(id, 'sub:', '')::bigint % 3 < 2), new as (select *, case when replace(id, 'sub:', '')::bigint % 2 = 0 then amount_cents + 100 end as a2 from s where replace(id, 'sub:', '')::bigint % 3 > 0)
select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.id, n.id) as id, case when o.id is null then n.a2 when n.id is not null and o.status = 'pending' then coalesce(n.a2, o.amount_cents) else o.amount_cents end as amount_cents,
case when o.id is null then 'pending' else o.status end as status, case when o.id is null then 'keep' else o.user_status end as user_status,
case when o.id is null then 1 when n.id is not null and o.status = 'pending' then 2 else 1 end as n_lines, case when o.id is null then 'added' when n.id is not null and o.status = 'pending' then 'refreshed' end as change
from old o full join new n on o.user_id = n.user_id and o.id = n.id)"""


@query(f"select * from {_MERGED_SQL}")
def merge_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved_rows(spark, sf_dir)
    merged = portfolio.merge_detections(_saved_before(rows), _detected_now(rows), F.lit("2026-10-05 10:00:00").cast("timestamp"), ("user_id",))
    return merged.select("user_id", "id", "amount_cents", "status", "user_status", F.size("source_lines").alias("n_lines"), "change")


def _edits(rows: DataFrame) -> DataFrame:
    k = _number()
    return rows.where(k % 4 == 0).select(
        "user_id", "id", F.when(k % 12 == 0, " Neuf ").otherwise("  ").alias("display_name"), F.when(k % 8 != 0, 1234).cast("long").alias("amount_cents"), (k % 8 == 0).alias("clear_amount"), F.lit("yearly").alias("period"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("date").alias("next_renewal"), (k % 5 == 0).alias("clear_renewal"), F.lit(None).cast("date").alias("trial_ends_at"), F.lit(False).alias("clear_trial"), F.lit(None).cast("string").alias("user_status"), F.lit(None).cast("string").alias("status"),
    )


@query(f"""with s as {SAVED_SQL}, k as (select *, replace(id, 'sub:', '')::bigint as k from s), e as (select * replace (case when k % 4 = 0 then (case when k % 8 = 0 then null else 1234 end) else amount_cents end as amount_cents, case when k % 4 = 0 then 'yearly' else period end as period,
case when k % 4 = 0 then false else period_is_estimated end as period_is_estimated, case when k % 12 = 0 then 'Neuf' else display_name end as display_name, case when k % 4 = 0 and k % 5 = 0 then null else next_renewal end as next_renewal) from k)
select user_id, id, display_name, amount_cents::bigint as amount_cents, period, period_is_estimated, next_renewal, {MONTHLY} as monthly_equivalent_cents, amount_cents is null as needs_amount from e""")  # fmt: skip
def apply_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved_rows(spark, sf_dir)
    edited = portfolio.apply_edits(rows, _edits(rows), F.lit("2026-10-05 10:00:00").cast("timestamp"), ("user_id",))
    return edited.select("user_id", "id", "display_name", "amount_cents", "period", "period_is_estimated", "next_renewal", "monthly_equivalent_cents", "needs_amount")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


@query(f"""select user_id, id, case when k % 4 > 0 then amount_cents when k % 8 = 0 then null else 1234 end::bigint as amount_cents, status, user_status, n_lines from (select *, replace(id, 'sub:', '')::bigint as k from {_MERGED_SQL}) where k % 10 <> 9""")
def portfolio_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio on disk: rows added (each twice), detections merged, rows edited, rows deleted, and what is there then."""
    saved, rows, now = Portfolio(spark, _new_folder(spark, "portfolio"), "user_id long"), saved_rows(spark, sf_dir), F.lit("2026-10-05 10:00:00").cast("timestamp")
    older = rows.withColumns({"display_name": F.lit("Vieux"), "updated_at": F.lit("2026-08-01 00:00:00").cast("timestamp"), "amount_cents": F.lit(1).cast("long")})
    saved.add(_saved_before(rows.unionByName(older)))
    saved.save_detections(_detected_now(rows), now)
    saved.edit(_edits(rows), now)
    saved.delete(rows.where(_number() % 10 == 9))
    saved.prune()
    return saved.read().select("user_id", "id", "amount_cents", "status", "user_status", F.size("source_lines").alias("n_lines"))


_EDITED_SQL = f"""(with k as (select *, replace(id, 'sub:', '')::bigint as k from {SAVED_SQL}), e as (select * exclude (monthly_equivalent_cents) replace (case when k % 4 = 0 then (case when k % 8 = 0 then null else 1234 end) else amount_cents end as amount_cents, case when k % 4 = 0 then 'yearly' else period end as period) from k)
select *, {MONTHLY} as monthly_equivalent_cents from e where k % 10 <> 9)"""


@query(f"select user_id, count_if({_COUNTED})::bigint as count, coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED}), 0)::bigint as monthly_cents, (12 * coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED}), 0))::bigint as yearly_cents, count_if({_COUNTED} and monthly_equivalent_cents is null)::bigint as incomplete, (12 * coalesce(sum(monthly_equivalent_cents) filter ({_COUNTED} and user_status = 'to_cancel'), 0))::bigint as savings_yearly_cents from {_EDITED_SQL} group by user_id")
def live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals kept up by the changes of four versions (rows added twice, edited, deleted); a full recount gives the same."""
    saved, rows, now = Portfolio(spark, _new_folder(spark, "portfolio"), "user_id long"), saved_rows(spark, sf_dir), F.lit("2026-10-05 10:00:00").cast("timestamp")
    live = LiveTotals(saved)
    for write in (lambda: saved.add(_saved_before(rows)), lambda: saved.add(rows), lambda: saved.edit(_edits(rows), now), lambda: saved.delete(rows.where(_number() % 10 == 9))):
        write()
        live.catch_up()
    return live.read()


@query("select * from (values ('after', '', 0), ('before', '', 0), ('between', 'musique,sport', (select count(*) from orders))) as v(step, checked, n)")
def portfolio_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked categories and saved rows: before anything is saved, once both are, and after all is wiped."""
    saved, seen = Portfolio(spark, _new_folder(spark, "portfolio"), "user_id long"), []

    def look(step: str) -> None:
        rows = saved.read().agg(F.count("*").alias("n"))
        seen.append((step, saved.checked_categories().first()[0], rows.first().n))

    look("before")
    saved.add(saved_rows(spark, sf_dir))
    saved.set_checked_categories(["musique", "sport"])
    look("between")
    saved.wipe()
    look("after")
    return spark.createDataFrame(seen, "step string, checked array<string>, n long").select("step", F.array_join("checked", ",").alias("checked"), "n")


@query(f"""select user_id, id, section, case section when 'mine' then row_number() over (partition by user_id, section order by user_status = 'cancelled', coalesce(monthly_equivalent_cents, 0) desc, id) end as place
from (select *, case when status = 'rejected' then 'rejected' when kind = 'other_debit' then 'other' when status = 'pending' then 'pending' else 'mine' end as section from {SAVED_SQL})""")  # fmt: skip
def dashboard_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved_rows(spark, sf_dir).withColumn("section", portfolio.section())
    place = F.row_number().over(Window.partitionBy("user_id", "section").orderBy(*portfolio.mine_order()))
    return rows.select("user_id", "id", "section", F.when(F.col("section") == "mine", place).alias("place"))


def _checklist() -> str:
    """The checklist's examples as rows for DuckDB: category, name, service."""
    listed = [[x.strip() for x in line.split(" | ")] for line in dictionary.SERVICES.strip().splitlines()]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for category in dictionary.CHECKLIST:
        own = [r for r in listed if r[2] == category and r[0] not in dictionary.INTERMEDIARIES]
        rows += [f"({quoted(category)}, {quoted(r[1])}, {quoted(r[0])})" for r in own[:8]] + [f"({quoted(category)}, {quoted(n)}, null)" for n in dictionary.GENERIC.get(category, ())]
    return ", ".join(rows)


@query(f"""with e as (select service_id, lower(display_name) as n, user_id from {SAVED_SQL} where status <> 'rejected'), u as (select distinct user_id from {SAVED_SQL}),
own as (select distinct user_id, service_id as w from e where service_id is not null union select distinct user_id, n from e), m(category, name, sid) as (values {_checklist()})
select u.user_id, m.category, m.name, (a.w is not null or b.w is not null) as has from u cross join m left join own a on a.user_id = u.user_id and a.w = m.sid left join own b on b.user_id = u.user_id and b.w = lower(m.name)""")  # fmt: skip
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = reports.memory_list(saved_rows(spark, sf_dir), dictionary.services(spark), ("user_id",))
    return shown.select("user_id", "category", "name", "has")


def _euros_sql(cents: str) -> str:
    whole = f"({cents} // 100)"
    groups = f"case when {whole} >= 1000000 then ({whole} // 1000000)::varchar || chr(8239) || lpad(({whole} // 1000 % 1000)::varchar, 3, '0') || chr(8239) || lpad(({whole} % 1000)::varchar, 3, '0') when {whole} >= 1000 then ({whole} // 1000)::varchar || chr(8239) || lpad(({whole} % 1000)::varchar, 3, '0') else {whole}::varchar end"
    return f"({groups} || ',' || lpad(({cents} % 100)::varchar, 2, '0') || chr(160) || '€')"


def _day_sql(day: str) -> str:
    n = f"({day} - {TODAY})"
    return f"case when {n} = 0 then 'aujourd''hui' when {n} = 1 then 'demain' when {n} between 2 and 14 then 'dans ' || {n} || ' jours' else 'le ' || day({day}) || ' ' || ({_SHORT})[month({day})] end"


@query(f"""{_DETECTED},
names(sid, sname) as (values ('netflix', 'Netflix'), ('spotify', 'Spotify'), ('deezer', 'Deezer'), ('prime-video', 'Amazon Prime'), ('red-by-sfr', 'RED by SFR'), ('disney-plus', 'Disney+')),
vias(via_id, vname) as (values ('apple', 'Apple'), ('google-play', 'Google Play'), ('paypal', 'PayPal')),
ids as (select import_id, gk, string_agg(id, ',' order by seq) as transaction_ids from led group by all),
texts as (select import_id, gk, string_agg(raw, ' | ' order by s) as lines from (select import_id, gk, raw, min(seq) as s from led where raw <> '' group by all) group by all)
select import_id, 'sub:' || gk as id, transaction_ids, lines, concat_ws(' ', case when sid is not null then 'Reconnu dans la liste des services : ' || sname || '.' when st then 'Listé sur la page des abonnements du store.'
  when reason is not null then reason || ' : prélèvement, mais pas un abonnement.' when via_id is not null then 'Payé via ' || vname || ', qui ne précise pas le service. Une capture de la page des abonnements du store le retrouverait.'
  when kw is not null then 'Le libellé ressemble à un abonnement (' || case kw when 'banque' then 'cotisation bancaire' else kw end || ').' when sepa then 'Prélèvement d''un organisme que je ne connais pas : à toi de dire si c''est un abonnement.'
  when times is not null then 'Même marchand et montant proche, ' || times || ' fois, ' || case seen when 'weekly' then 'chaque semaine' when 'monthly' then 'chaque mois' when 'quarterly' then 'chaque trimestre' else 'chaque année' end || '.' end,
  case when via_id is not null and sid is not null then 'Payé via ' || vname || '.' end, case when hint is null and seen is null and period <> 'unknown' then 'Fréquence estimée : la fréquence habituelle de ce service.' end,
  case when amount_cents is null then 'Montant absent de la capture : à compléter.' when period = 'unknown' then 'Montant lu : ' || {_euros_sql("amount_cents")} || ', fréquence inconnue.' end) as reasons
from p left join names using (sid) left join vias using (via_id) join ids using (import_id, gk) join texts using (import_id, gk) where confidence is not null""")
def detection_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each detection rests on: transactions and lines in order, and the reasons shown to the user."""
    found = detect_.detect(transactions(spark, sf_dir))
    rows = found.subscriptions.unionByName(found.other_debits)
    return rows.select("import_id", "id", F.array_join("source_transaction_ids", ",").alias("transaction_ids"), F.array_join("source_lines", " | ").alias("lines"), F.array_join("reasons", " ").alias("reasons"))


@query(f"""select id, coalesce({_euros_sql("amount_cents")} || ' ' || case period when 'weekly' then 'par semaine' when 'monthly' then 'par mois' when 'quarterly' then 'par trimestre' when 'yearly' then 'par an' else 'fréquence à préciser' end
|| case when period <> 'monthly' and monthly_equivalent_cents is not null then ' · ' || {_euros_sql("monthly_equivalent_cents")} || '/mois' else '' end || case when period_is_estimated and period <> 'unknown' then ' (estimé)' else '' end, 'Montant à compléter') as amount,
case category when 'streaming' then 'Streaming' when 'sport' then 'Salle de sport' else 'Autres' end || coalesce(' · essai jusqu''au ' || regexp_replace({_day_sql("trial_ends_at")}, '^le ', ''), case when user_status <> 'cancelled' then ' · prochain ' || {_day_sql("next_renewal")} end, '') as hint,
period = 'unknown' and amount_cents is not null and user_status <> 'cancelled' as ask_period from {SAVED_SQL}""")  # fmt: skip
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_rows(spark, sf_dir).select("id", reports.card_amount().alias("amount"), reports.card_hint(_day()).alias("hint"), reports.follow_ups()["ask_period"].alias("ask_period"))


@query(f"""with s as (select *, coalesce(status = 'pending', false) or ({_COUNTED}) as shown from {SAVED_SQL} where user_status <> 'cancelled' and status <> 'rejected')
select id, 'trial' as type, strftime(trial_ends_at, '%Y%m%d') as starts, strftime(trial_ends_at + 1, '%Y%m%d') as ends, 13 as n_lines from s where shown and trial_ends_at >= {TODAY}
union all select id, 'renewal', strftime(next_renewal, '%Y%m%d'), strftime(next_renewal + 1, '%Y%m%d'), case when period = 'unknown' then 13 else 14 end from s where shown and next_renewal >= {TODAY}""")  # fmt: skip
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reports.calendar_events(saved_rows(spark, sf_dir), _day(), F.lit("2026-10-05 10:00:00").cast("timestamp"))
    value = lambda p: F.regexp_extract(F.filter("lines", lambda x: x.startswith(p))[0], r"(\d{8})$", 1)
    return events.select("id", "type", value("DTSTART;").alias("starts"), value("DTEND;").alias("ends"), F.size("lines").alias("n_lines"))


def _fold_sql(rows: str, line: str) -> str:
    """rows with `line` folded: pieces of 75, then 74 octets; four pieces at most, which is more than any line here has."""
    step = lambda inner, n, room: f"select *, len(list_filter(range(1, length({line}) + 1), lambda i: strlen({line}[1:i]) <= {f'strlen({line}[1:c{n - 1}])' if n else '0'} + {room})) as c{n} from ({inner})"
    for n, room in enumerate((75, 74, 74, 74)):
        rows = step(rows, n, room)
    pieces = [f"case when c{n} < length({line}) then chr(13) || chr(10) || ' ' || {line}[c{n} + 1:c{n + 1}] else '' end" for n in range(3)]
    return f"select user_id, id, type_ord, place::int as place, {line}[1:c0] || {' || '.join(pieces)} as line from ({rows})"


_ESCAPED = "replace(replace(replace({t}, chr(92), chr(92) || chr(92)), ',', chr(92) || ','), ';', chr(92) || ';')"
_PRICED = f"coalesce(' (' || {_euros_sql('amount_cents')} || ')', '')"
_TRIAL_TEXTS = ("'Fin de l''essai gratuit : ' || display_name", f"'L''essai se termine aujourd''hui' || case when {_PRICED} <> '' then ', ensuite' || {_PRICED} else '' end || '. Résilie avant si tu ne veux pas le garder.'", "'Fin d''essai dans 2 jours : ' || display_name")
_RENEWAL_TEXTS = (
    f"'Renouvellement : ' || display_name || {_PRICED}", "'Prélèvement attendu ' || case period when 'weekly' then 'par semaine' when 'monthly' then 'par mois' when 'quarterly' then 'par trimestre' when 'yearly' then 'par an' else 'fréquence à préciser' end || '. Date estimée à partir de tes captures.'",
    f"'Demain : ' || display_name || {_PRICED}",
)


def _event_sql(kind: str, day: str, rule: str, texts: tuple[str, str, str], trigger: str) -> str:
    """Events of one kind as lists of unfolded lines."""
    summary, description, alarm = (_ESCAPED.format(t=f"({t})") for t in texts)
    lines = f"""['BEGIN:VEVENT', 'UID:' || id || '-{kind}@ebbtide', 'DTSTAMP:20261005T100000Z', 'DTSTART;VALUE=DATE:' || strftime({day}, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime({day} + 1, '%Y%m%d'), {rule}, 'SUMMARY:' || {summary}, 'DESCRIPTION:' || {description},
    'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:' || {alarm}, 'TRIGGER:{trigger}', 'END:VALARM', 'END:VEVENT']"""
    return f"select user_id, id, {int(kind == 'renewal')} as type_ord, list_filter({lines}, lambda x: x is not null) as lines from shown where {day} >= {TODAY}"


_CALENDAR_LINES = f"""with shown as (select * from {SAVED_SQL} where user_status <> 'cancelled' and status <> 'rejected' and (status = 'pending' or kind = 'subscription')),
events as ({_event_sql("trial", "trial_ends_at", "null", _TRIAL_TEXTS, "-P2D")} union all {_event_sql("renewal", "next_renewal", "'RRULE:' || case period when 'weekly' then 'FREQ=WEEKLY' when 'monthly' then 'FREQ=MONTHLY' when 'quarterly' then 'FREQ=MONTHLY;INTERVAL=3' when 'yearly' then 'FREQ=YEARLY' end", _RENEWAL_TEXTS, "-P1D")}),
plain as (select user_id, id, type_ord, unnest(lines) as plain, generate_subscripts(lines, 1) - 1 as place from events),
folded as ({_fold_sql("select * from plain", "plain")})"""


@query(f"""{_CALENDAR_LINES}, bodies as (select user_id, string_agg(line || chr(13) || chr(10), '' order by id, type_ord, place) as body from folded group by user_id)
select u.user_id::varchar as name, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || 'PRODID:-//ebbtide//FR' || chr(13) || chr(10) || 'CALSCALE:GREGORIAN' || chr(13) || chr(10) || 'METHOD:PUBLISH' || chr(13) || chr(10) || coalesce(body, '') || 'END:VCALENDAR' || chr(13) || chr(10) as content
from (select distinct user_id from {SAVED_SQL}) u left join bodies using (user_id)""")
def calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar files written by the sink and read back, empty ones included."""
    made = reports.build_calendar(saved_rows(spark, sf_dir), _day(), F.lit("2026-10-05 10:00:00").cast("timestamp"), ("user_id",))
    folder = _new_folder(spark, "calendars")
    calendars.write_calendars(made, folder, "user_id")
    return calendars.read_calendars(spark, folder)


@query("select o_custkey as user_id, count_if(s) as count, coalesce(sum(c) filter (s), 0)::bigint as monthly_cents, (12 * coalesce(sum(c) filter (s), 0))::bigint as yearly_cents from (select o_custkey, round(o_totalprice * 100)::bigint as c, o_orderkey % 2 = 0 as s from orders) group by 1")
def preview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).selectExpr("o_custkey as user_id", f"-{CENTS} as c", "o_orderkey % 2 = 0 as is_subscription")
    monthly = F.coalesce(F.sum(F.when(F.col("is_subscription"), F.abs("c"))), F.lit(0))
    return rows.groupBy("user_id").agg(F.count_if("is_subscription").alias("count"), monthly.alias("monthly_cents"), money.yearly_from_monthly(monthly).alias("yearly_cents"))


@query(f"""with t as {TX_SQL}, c as (select import_id, count(*) as screenshots, count_if(capture_index = 2) as unreadable from (select distinct import_id, capture_index from t) group by 1), o as (select import_id, count(amount_cents) as operations, count_if(tkind = 'sepa') as found, count_if(tkind <> 'sepa') as other_debits, count_if(pos % 2 = 0) as added from t group by 1)
select import_id, screenshots, unreadable, operations, found, other_debits, added from c join o using (import_id)""")  # fmt: skip
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir)
    captures = rows.select("import_id", "capture_index").distinct().withColumn("unreadable", F.col("capture_index") == 2)
    found = rows.select("import_id", F.when(text.payment_kind(F.col("label")) == "sepa", "subscription").otherwise("other_debit").alias("kind"), F.when(F.col("pos") % 2 == 0, "added").alias("change"))
    return reports.import_summary(rows, captures, found)


# ---- pages ----


def _page_lines(spark: SparkSession, sf_dir: str, columns: list[Column], shown: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Three lines for each order, on the page of its customer, one below the other. shown: the orders, with more columns to keep."""
    rows = (orders(spark, sf_dir) if shown is None else shown).select(F.col("o_custkey").alias("capture_id"), "o_orderkey", *more, F.posexplode(F.array(*columns)).alias("i", "text"))
    rows = rows.withColumn("line_pos", (F.col("o_orderkey") * 4 + F.col("i")).cast("long")).withColumn("y0", (F.col("line_pos") * 100).cast("double"))
    word = F.struct("text", F.lit(95.0).alias("confidence"), F.lit(0.0).alias("x0"), F.col("y0"), F.lit(900.0).alias("x1"), (F.col("y0") + 40).alias("y1"))
    return rows.select("capture_id", "o_orderkey", F.col("line_pos").cast("int").alias("line_pos"), "text", F.array(word).alias("words"), F.lit(0.0).alias("x0"), "y0", F.lit(900.0).alias("x1"), (F.col("y0") + 40).alias("y1"), F.lit(95.0).alias("confidence"), _day().alias("reference"), *more)


@query(f"""select o_custkey as capture_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry, 'Appli ' || o_orderkey as name, {CENTS} as price_cents, case o_orderkey % 3 when 0 then 'monthly' when 1 then 'yearly' else 'unknown' end as period,
case when o_orderkey % 4 > 0 then date '2027-02-03' end as renewal_date, case when o_orderkey % 4 = 0 then date '2027-02-03' end as trial_ends_at, 95 as confidence from orders""")  # fmt: skip
def parse_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_store(_store_lines(spark, sf_dir)).drop("raw_text")


def _store_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name, a price and a date for each order."""
    k = F.col("o_orderkey")
    period = F.when(k % 3 == 0, " par mois").when(k % 3 == 1, " / an").otherwise("")
    price = F.concat(money.cents_to_input(F.expr(CENTS)), F.lit(" €"), period)
    when = F.concat(F.when(k % 4 == 0, "Essai gratuit jusqu'au ").otherwise("Renouvellement le "), F.lit("3 février"))
    return _page_lines(spark, sf_dir, [F.concat(F.lit("Appli "), k.cast("string")), price, when])


@query(f"""select o_custkey::varchar as import_id, 'screenshot_store:0:' || entry as id, entry as pos, 'Appli ' || o_orderkey as label, {CENTS} as amount_cents, 'debit' as direction, 'store' as kind, 'screenshot_store' as source, 95 as ocr_confidence, null::date as date,
case o_orderkey % 3 when 0 then 'monthly' when 1 then 'yearly' else 'unknown' end as period_hint, case when o_orderkey % 4 > 0 then date '2027-02-03' end as renewal_date, case when o_orderkey % 4 = 0 then date '2027-02-03' end as trial_ends_at
from (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry from orders)""")  # fmt: skip
def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store pages to transactions, those of every second customer mended by a profile first: their lines begin with a mark."""
    own = F.col("capture_id").cast("long") % 2 == 0
    lines = _imported(_store_lines(spark, sf_dir)).withColumn("text", F.when(own, F.concat(F.lit("~"), "text")).otherwise(F.col("text")))
    marked = lambda c: F.transform("words", lambda w: F.struct(c(w["text"]).alias("text"), *(w[x].alias(x) for x in ("confidence", "x0", "y0", "x1", "y1"))))
    lines = lines.withColumn("words", F.when(own, marked(lambda t: F.concat(F.lit("~"), t))).otherwise(F.col("words")))
    profile = (lambda df: df.where(F.col("text").startswith("~")), lambda df: df.withColumns({"text": F.ltrim("text", F.lit("~")), "words": marked(lambda t: F.ltrim(t, F.lit("~")))}))
    rows = captures.store_adapter(captures.apply_profiles(lines, [profile]))
    return rows.select("import_id", "id", "pos", "label", "amount_cents", "direction", "kind", "source", "ocr_confidence", "date", "period_hint", "renewal_date", "trial_ends_at")


@query(f"""select o_custkey as capture_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry, 'PRLV SEPA CREANCIER' as label, {CENTS} as cents, {DAY} as date, 'sepa' as kind, case when o_orderkey % 2 = 0 then 'debit' else 'unknown' end as direction, 95 as confidence from orders""")
def parse_bank_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date header, a label and an amount alone for each order."""
    return pages.parse_bank(_bank_lines(spark, sf_dir, F.lit("PRLV SEPA CREANCIER"))).select("capture_id", "entry", "label", "cents", "date", "kind", "direction", "confidence")


def _bank_lines(spark: SparkSession, sf_dir: str, label: Column, shown: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    amount = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""), money.cents_to_input(F.expr(CENTS)), F.lit(" €"))
    rows = _page_lines(spark, sf_dir, [F.date_format("o_orderdate", "dd/MM/yyyy"), label, amount], shown, more)
    near = rows.withColumn("y0", F.when(F.col("text").contains("€"), F.col("y0") - 50).otherwise(F.col("y0"))).withColumn("y1", F.col("y0") + 40)
    words = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), w["x0"].alias("x0"), F.col("y0").alias("y0"), w["x1"].alias("x1"), F.col("y1").alias("y1")))
    return near.withColumn("words", words)


def _imported(lines: DataFrame) -> DataFrame:
    """Each page as an import of its own."""
    return lines.withColumns({"capture_id": F.col("capture_id").cast("string"), "import_id": F.col("capture_id").cast("string"), "capture_index": F.lit(0)})


_BANK_ROWS = f"""(select o_custkey::varchar as import_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as entry, case o_orderkey % 3 when 0 then '' when 1 then 'CB NETFLIX.COM' else 'PRLV SEPA CREANCIER' end as label,
case o_orderkey % 3 when 0 then 'transfer' when 1 then 'card' else 'sepa' end as kind, {CENTS} as amount_cents, {DAY} as date, case when o_orderkey % 2 = 0 then 'debit' else 'unknown' end as direction from orders)"""


def _mixed_label() -> Column:
    k = F.col("o_orderkey")
    return F.when(k % 3 == 0, "VIR SEPA M JEAN DUPONT").when(k % 3 == 1, "CB NETFLIX.COM").otherwise("PRLV SEPA CREANCIER")


@query(f"""select import_id, 'screenshot_card_history:0:' || entry as id, entry as pos, label, case kind when 'transfer' then '' when 'card' then 'NETFLIX.COM' else 'CREANCIER' end as normalized_label, kind = 'transfer' as text_hidden, amount_cents, date, direction, kind, 'screenshot_card_history' as source, 95 as ocr_confidence from {_BANK_ROWS}""")
def capture_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to transactions by the adapter of their kind; a transfer keeps no text."""
    rows = captures.transactions(_imported(_bank_lines(spark, sf_dir, _mixed_label())))
    return rows.select("import_id", "id", "pos", "label", "normalized_label", (F.col("raw_text") == "").alias("text_hidden"), "amount_cents", "date", "direction", "kind", "source", "ocr_confidence")


_ARRIVALS = f"""shown as (select o_custkey as u, o_orderkey // 3 % 2 as m, o_orderkey % 3 as c, o_orderkey as k from orders union all select o_custkey, o_orderkey // 3 % 2, o_orderkey % 3 + 1, o_orderkey from orders where o_orderkey % 5 = 0 and o_orderkey % 3 < 2)"""


def _arrivals(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """The first or the second import of each customer, in up to three captures that overlap, and for some a file that can't be read; in six files.

    Captures are numbered and dealt as orders are, narrow; lines are made of them where they are written.
    """
    k, u, broken, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") % 7 == 0, F.col("capture_index")
    seen_in = F.when((k % 5 == 0) & (k % 3 < 2), F.array(k % 3, k % 3 + 1)).otherwise(F.array(k % 3))
    of_import = orders(spark, sf_dir).where(F.floor(k / 3) % 2 == int(later)).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", F.explode(seen_in.cast("array<int>")).alias("capture_index"))
    own = Window.partitionBy("o_custkey")

    def told(rows: DataFrame) -> DataFrame:
        many = (F.size(F.collect_set("capture_index").over(own)) + broken.cast("int")).cast("int")
        return rows.withColumns({"of_captures": many, "nth": F.row_number().over(Window.partitionBy("o_custkey", "capture_index").orderBy("o_orderkey")) - 1, "unreadable": F.lit(False)})

    first = F.row_number().over(own.orderBy("capture_index", "o_orderkey")) == 1
    lost = told(of_import.where(broken)).withColumn("first", first).where("first").drop("first").withColumns({"capture_index": F.lit(9), "unreadable": F.lit(True)})
    name = F.concat_ws("/", u, F.lit(int(later)))
    dealt = told(of_import).unionByName(lost).withColumns({"import_id": name, "shown_in": F.concat_ws("/", name, c)}).repartition(6, "shown_in")
    lines = _bank_lines(spark, sf_dir, _mixed_label(), dealt, ("import_id", "shown_in", "capture_index", "of_captures", "nth", "unreadable"))
    i = F.col("line_pos") % 4
    lines = lines.where(~F.col("unreadable") | (i == 0)).withColumns({"capture_id": F.col("shown_in"), "segments": F.array("text"), "line_pos": (3 * F.col("nth") + i).cast("int")})
    names = [f.split()[0] for f in imports.LINES.replace("text:string,confidence:double,x0:double,y0:double,x1:double,y1:double", "").split(", ")]
    own_values = ("import_id", "capture_id", "capture_index", "unreadable", "of_captures")
    return lines.select(*(F.col(n) if n in own_values else F.when(~F.col("unreadable"), F.col(n)).alias(n) for n in names))


def _stream_arrivals(spark: SparkSession, sf_dir: str, name: str, told: imports.Progress | None = None, **options) -> Portfolio:
    """The first imports arrive as files, some in each micro-batch, then the second ones at once; the portfolio that comes of it."""
    folder = _new_folder(spark, name)
    saved = Portfolio(spark, f"{folder}/portfolio", "user_id long")
    for later in (False, True):
        _arrivals(spark, sf_dir, later).write.mode("append").parquet(f"{folder}/lines")
        query = imports.merge_stream(
            imports.line_stream(spark, f"{folder}/lines", files_per_batch=1000 if later else 4), saved, f"{folder}/state", lambda: F.lit("2026-10-05 10:00:00").cast("timestamp"), owner={"user_id": F.split("import_id", "/")[0].cast("long")}, **options
        )
        query.awaitTermination()
        if told is not None:
            told.of(query)
    return saved


@query(f"""with {_ARRIVALS}, x as (select s.*, row_number() over (partition by u, m, c order by k) - 1 as entry, case k % 3 when 0 then '' when 1 then 'sub:service:netflix' else 'sub:label:CREANCIER' end as id, {CENTS} as amount, {DAY} as day, case when k % 2 = 0 then 'debit' else 'unknown' end as dir from shown s join orders on k = o_orderkey),
kept as (select * from (select *, first_value(c) over (partition by u, m, id, amount, day, dir order by c, entry) as f from x where id <> '') where c = f),
found as (select u, m, id, first(amount order by day desc, c, entry) as amount, list(c || ':' || entry) as ids from kept group by all)
select u as user_id, id, case id when 'sub:service:netflix' then 'Netflix' else 'Creancier' end as display_name, case id when 'sub:service:netflix' then 'high' else 'medium' end as confidence, arg_max(amount, m) as amount_cents, 'pending' as status, 'keep' as user_status, len(list_distinct(flatten(list(ids))))::int as n from found group by u, id""")
def import_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports whose captures arrive in several micro-batches are detected once they are whole, and merged; the live query reads the result."""
    saved = _stream_arrivals(spark, sf_dir, "imports")
    shown = imports.live(saved, lambda rows: rows.select("user_id", "id", "display_name", "confidence", "amount_cents", "status", "user_status", F.size("source_transaction_ids").alias("n")))
    return shown()


@query(f"""with {_ARRIVALS}, c as (select distinct u, m, c from shown union all select distinct u, m, 9 from shown where u % 7 = 0)
select count(*)::bigint as read, count_if(c = 9)::bigint as skipped, count(*)::bigint as done from c""")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import streams report about their captures, batch by batch, added up."""
    told = imports.Progress()
    spark.streams.addListener(told)
    try:
        counted = lambda lines: lines.groupBy("import_id").agg(F.lit("all").alias("id"), F.lit("pending").alias("status"))
        _stream_arrivals(spark, sf_dir, "progress", told, analyse=lambda lines: portfolio.as_detected(counted(lines)))
    finally:
        spark.streams.removeListener(told)
    total = {k: sum(run[k] for run in told.counts.values()) for k in ("read", "skipped", "done")}
    return spark.createDataFrame([tuple(total.values())], "read long, skipped long, done long")


@query("""select o_custkey as capture_id, case when o_custkey % 3 = 0 and count(*) >= 2 then 'screenshot_store' when o_custkey % 3 = 1 then 'screenshot_bank_debits' else 'screenshot_card_history' end as kind from orders group by o_custkey""")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    line = F.when(c % 3 == 0, "Renouvellement le 3 mars").when(c % 3 == 1, "Mandat actif").otherwise("CB ACHAT -12,00 €")
    return pages.classify_pages(_page_lines(spark, sf_dir, [F.lit("Une ligne"), line, F.lit("Autre")]))


@query("""select o_custkey as capture_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as line_pos, 'LIGNE ' || o_orderkey || ' ' || o_orderstatus as text, 2 as n_segments, 'LIGNE ' || o_orderkey as first_segment,
10.0::double as x0, 900.0::double as x1, round((80.0 * (5 + length(o_orderkey::varchar)) + 60.0) / (6 + length(o_orderkey::varchar)), 1) as confidence from orders""")  # fmt: skip
def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line for each order, out of order and slightly shifted."""
    k = F.col("o_orderkey")
    y = (k * 100).cast("double")
    word = lambda t, x0, x1, up, sure: F.struct(t.alias("text"), F.lit(sure).alias("confidence"), F.lit(x0).alias("x0"), (y + up).alias("y0"), F.lit(x1).alias("x1"), (y + up + 30).alias("y1"))
    words = F.array(word(F.col("o_orderstatus"), 800.0, 900.0, 4, 60.0), word(F.lit("LIGNE"), 10.0, 60.0, 0, 80.0), word(k.cast("string"), 70.0, 160.0, -3, 80.0))
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("capture_id"), k, F.posexplode(words).alias("i", "w")).select("capture_id", (k * 3 + F.col("i")).alias("word_pos"), "w.*")
    made = lines_.group_into_lines(rows)
    return made.select("capture_id", "line_pos", "text", F.size("segments").alias("n_segments"), F.col("segments")[0].alias("first_segment"), "x0", "x1", "confidence")


# ---- histograms ----

_HIST = "(select l_suppkey as image_id, floor(l_quantity * 5)::int as level, count(*) as n from lineitem group by all)"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.floor(F.col("l_quantity") * 5).cast("int").alias("level"))
    return pixels.histogram(rows)


@query(f"select image_id, level, n from {_HIST}")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


@query(f"select image_id, sum(level * n) / sum(n) as mean, sum(level * n) / sum(n) < 110 as is_dark from {_HIST} group by image_id")
def hist_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.mean_level(_levels(spark, sf_dir))


@query(f"select image_id, min(level) as level from (select *, sum(n) over (partition by image_id order by level) as seen, sum(n) over (partition by image_id) as total from {_HIST}) where seen >= total * 0.99::double group by image_id")
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.percentile_level(_levels(spark, sf_dir), 0.99)


@query(f"""with s as (select image_id, level, (sum(n) over w)::double as b, (sum(n) over (partition by image_id))::double as a, (sum(level * n) over w)::double as m, (sum(level * n) over (partition by image_id))::double as t from {_HIST} window w as (partition by image_id order by level)),
v as (select *, b * (a - b) * ((m / b - (t - m) / (a - b)) * (m / b - (t - m) / (a - b))) as v from s where a > b)
select image_id, coalesce((select level from v where v.image_id = i.image_id order by v desc, level limit 1), 0) as threshold from (select distinct image_id from {_HIST}) i""")  # fmt: skip
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu(_levels(spark, sf_dir))


@query("select p_partkey, case when w * h * s * s <= 12000000 then s else floor(sqrt(12000000.0::double / (w * h)) * 100) / 100 end as scale from (select p_partkey, (p_size * 60)::double as w, (p_size * 120)::double as h, case when p_size * 60 < 1000 then 2.0::double else 1.0::double end as s from part)")
def choose_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", pixels.choose_scale(F.col("p_size") * 60, F.col("p_size") * 120).alias("scale"))


# ---- images ----


def _raw_image(content: bytes) -> tuple[int, int, bytes]:
    """The decoder of the images below: width, height, then RGBA."""
    return content[0], content[1], content[2:]


def _bars(rgba: bytes, width: int, height: int) -> list[tuple]:
    """The recogniser of the images below: in each row, every run of dark pixels is a word that tells its length."""
    out = []
    for y in range(height):
        dark = [x for x in range(width) if rgba[4 * (y * width + x)] < 128]
        starts = [x for x in dark if x - 1 not in dark]
        for x in starts:
            end = next(e for e in range(x, width + 1) if e not in dark)
            out.append((f"W{end - x}", 90, x, y, end, y + 1))
    return out


def _image(width: Column, height: Column, pixel: Callable[[Column, Column], list[Column]]) -> Column:
    """Bytes of an image whose pixels are made from their place: pixel(x, y) gives red, green and blue."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    row = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda x: F.concat(*map(byte, pixel(x, y)), F.lit("FF"))), "")
    return F.unhex(F.concat(byte(width), byte(height), F.array_join(F.transform(F.sequence(F.lit(0), height - 1), row), "")))


_PAINTED = "(select p_partkey as k, 3 + p_partkey % 3 as w, 2 + p_partkey % 2 as h, case when p_partkey % 2 = 0 then 0.6 else 2.0 end as s from part)"


@query(f"""with o as (select *, greatest(1, floor(w * s + 0.5))::bigint as nw, greatest(1, floor(h * s + 0.5))::bigint as nh from {_PAINTED}),
n as (select o.*, i, j, c, x, y, (k * 7 + x * 31 + y * 17 + c * 53 + x * y * k) % 256 as v, least((i + 1) * w, (x + 1) * nw) - greatest(i * w, x * nw) as ox, least((j + 1) * h, (y + 1) * nh) - greatest(j * h, y * nh) as oy
  from o, range(0, 10) a(i), range(0, 6) b(j), range(0, 3) d(c), range(0, 5) e(x), range(0, 3) f(y) where i < nw and j < nh and x < w and y < h),
r as (select k, nw, nh, i, j, c, (2 * sum(v * ox * oy) + w * h) // (2 * w * h) as v from n where ox > 0 and oy > 0 group by k, nw, nh, w, h, i, j, c),
g as (select k, nw, nh, i, j, ((sum(v * case c when 0 then 299 when 1 then 587 else 114 end)) // 1000)::bigint as g from r group by all),
d as (select *, avg(g) over (partition by k) < 110 as dark from g), e as (select * replace (case when dark then 255 - g else g end as g) from d),
t as (select *, min(g) over (partition by k) as lo, max(g) over (partition by k) as hi from e),
u as (select * replace (case when hi - lo >= 10 then floor((g - lo) * (255.0::double / (hi - lo)))::bigint else g end as g) from t),
hist as (select k, g, count(*) as m from u group by all),
q as (select k, g, (sum(m) over w)::double as b, (sum(m) over (partition by k))::double as a, (sum(g * m) over w)::double as bm, (sum(g * m) over (partition by k))::double as am from hist window w as (partition by k order by g)),
z as (select k, g, b * (a - b) * ((bm / b - (am - bm) / (a - b)) * (bm / b - (am - bm) / (a - b))) as between_ from q where a > b),
cut as (select k, first(g order by between_ desc, g) as threshold from z group by k)
select u.k, any_value(nw)::int as width, any_value(nh)::int as height, any_value(dark) as inverted, coalesce(any_value(threshold), 0)::int as threshold,
string_agg(lpad(upper(to_hex(g)), 2, '0'), '' order by j, i) as stretched, string_agg(case when g > coalesce(threshold, 0) then 'FF' else '00' end, '' order by j, i) as cut from u left join cut using (k) group by u.k""")
def prepared_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images of every part, scaled up or down, grey, light, stretched; then black and white."""
    from ebbtide.sources.photos import dealt, prepared_files

    k = F.col("k")
    pixel = lambda x, y: [F.pmod(k * 7 + x * 31 + y * 17 + c * 53 + x * y * k, F.lit(256)) for c in range(3)]
    shown = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("content", _image((3 + k % 3).cast("int"), (2 + k % 2).cast("int"), pixel))
    wanted = F.when(k % 2 == 0, 0.6)
    red = lambda data: F.regexp_replace(F.hex(data), "(..)......", "$1")
    grey = prepared_files(dealt(shown, "k"), _raw_image, wanted=wanted).select("k", "content", F.col("prepared.width").alias("width"), F.col("prepared.height").alias("height"), F.col("prepared.inverted").alias("inverted"), red("prepared.pixels").alias("stretched"))
    both = prepared_files(grey, _raw_image, wanted=wanted, binarize=True)
    return both.select("k", "width", "height", "inverted", F.col("prepared.threshold").alias("threshold"), "stretched", red("prepared.pixels").alias("cut"))


@query("""with p as (select p_partkey as k, 2 + p_partkey % 4 as a, 1 + p_partkey % 3 as b, p_partkey % 7 = 0 as broken from part)
select k, broken as failed, case when not broken then 24 end::int as width, case when not broken then 2.0::double end as scale, case when not broken then 'W' || 2 * a || ' W' || 2 * b end as lines, case when not broken then 2 end::int as n_lines,
case when not broken then 2.0::double end as x0, case when not broken then (2.0 * (3 + a + b))::double end as x1, (select count_if(not broken) from p) as read, (select count_if(broken) from p) as skipped from p""")
def image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with two bars in a row, doubled for their small width, as lines of recognised words; a seventh of the files is cut short."""
    from ebbtide.sources.photos import dealt, read_captures

    k = F.col("capture_id")
    a, b = 2 + k % 4, 1 + k % 3
    light = lambda x, y: F.when((y == 1) & (((x >= 1) & (x < 1 + a)) | ((x >= 3 + a) & (x < 3 + a + b))), 0).otherwise(255)
    content = _image(F.lit(12), F.lit(3), lambda x, y: [light(x, y)] * 3)
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("capture_id")).withColumn("content", F.when(k % 7 == 0, F.substring(content, 1, 40)).otherwise(content))
    got = read_captures(dealt(files, "capture_id"), _raw_image, _bars)  # the table is one file: images are dealt before Python meets them
    seen = got.lines.groupBy("capture_id").agg(F.min_by("text", "line_pos").alias("lines"), F.count("*").cast("int").alias("n_lines"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    told = got.pages.join(seen, "capture_id", "left").join(F.broadcast(got.counts.select("read", "skipped")))
    return told.select(k.alias("k"), F.col("error").isNotNull().alias("failed"), "width", "scale", "lines", "n_lines", "x0", "x1", "read", "skipped")


# ---- addresses ----


@query("""select page_id, case when length(p) > 1 then regexp_replace(p, '/$', '') else '/' end as path from (select page_id, lower(regexp_replace('/' || regexp_replace(coalesce(url, ''), '[?#](.|\\n)*$', ''), '/{2,}', '/', 'g')) as p from pages)""")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.normalize_path(F.col("url")).alias("path"))


@query("""select event_id, case event_id % 4 when 0 then 'ios' when 1 then 'android' else 'other' end as system, case event_id % 4 when 0 then 'safari' when 1 then 'samsung' when 2 then 'edge' else 'firefox' end as browser,
case when event_id % 5 = 0 then 'installed' when event_id % 3 = 0 then 'prompt' else case event_id % 4 when 0 then 'ios-safari' when 1 then 'android-manual' else 'unsupported' end end as guide from events""")  # fmt: skip
def platform_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    agent = F.when(k % 4 == 0, "Mozilla/5.0 (iPhone) Version/17.0 Mobile Safari/604.1").when(k % 4 == 1, "Linux; Android 14 SamsungBrowser/23 Chrome/115 Safari/537").when(k % 4 == 2, "Windows NT 10 Chrome/120 Safari/537 Edg/120").otherwise("X11; Linux Firefox/121")
    rows = table(spark, sf_dir, "events").select(k, web.operating_system(agent, F.lit(0)).alias("system")).withColumn("browser", web.browser(agent, F.col("system")))
    return rows.withColumn("guide", web.install_guide(F.col("system"), F.col("browser"), k % 5 == 0, k % 3 == 0))


@query("""with h as (select event_id as k, case event_id % 6 when 0 then 'localhost' when 1 then '192.168.1.' || event_id % 250 when 2 then 'box.local' when 3 then '127.0.0.1' when 4 then '172.20.0.9' else 'host' || event_id || '.example' end as host, case when event_id % 2 = 0 then 'http:' else 'https:' end as proto from events)
select k, case when host = 'localhost' or host = '127.0.0.1' then 'this-computer-only' when proto = 'http:' and k % 6 in (1, 2, 4) then 'no-https' end as issue, proto || '//' || host || '/' as shared, k % 3 = 0 and k % 2 = 0 as taken from h""")  # fmt: skip
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a phone can't open, the address to share, and clicks that stay in the application."""
    k = F.col("event_id")
    host = F.when(k % 6 == 0, "localhost").when(k % 6 == 1, F.concat(F.lit("192.168.1."), k % 250)).when(k % 6 == 2, "box.local").when(k % 6 == 3, "127.0.0.1").when(k % 6 == 4, "172.20.0.9").otherwise(F.concat(F.lit("host"), k, F.lit(".example")))
    rows = table(spark, sf_dir, "events").select(k.alias("k"), host.alias("host"), F.when(k % 2 == 0, "http:").otherwise("https:").alias("proto"))
    here = F.concat("proto", F.lit("//"), "host")
    link = F.when(F.col("k") % 3 == 0, F.concat(here, F.lit("/memoire"))).otherwise("https://elsewhere.example/")
    no = F.lit(False)
    taken = web.intercepts_click(F.col("k") % 2, no, no, no, F.lit(None).cast("string"), link, here)
    return rows.select("k", web.local_address_issue(F.col("host"), F.col("proto")).alias("issue"), web.shareable_url(F.concat(here, F.lit("//"))).alias("shared"), taken.alias("taken"))


@query("select event_id as k, case when ts::timestamp <= timestamp '2024-06-01' and ts::timestamp > timestamp '2024-06-01' - interval 730 day then ts::date else date '2024-06-01' end as day from events")
def capture_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day a page shows, by a file's time."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), dates.capture_day(ts, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("day"))


@query("select o_orderkey as k, case when o_orderkey % 2 = 0 then ['streaming'] else ['streaming', 'sport', 'musique'] end as checked, ((o_orderkey % 7) + 0.5::double) / 8 * 100 as progress from orders")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toggled categories and the progress of an import."""
    k = F.col("o_orderkey")
    checked = F.when(k % 2 == 0, F.array(F.lit("streaming"), F.lit("musique"))).otherwise(F.array(F.lit("streaming"), F.lit("sport")))
    return orders(spark, sf_dir).select(k.alias("k"), reports.toggled(checked, F.lit("musique")).alias("checked"), reports.progress(k % 7 + 1, F.lit(8), F.lit(0.5)).alias("progress"))


@query("""with recursive s as (select p_partkey, p_name as a, p_type as b, greatest(0, greatest(length(p_name), length(p_type)) // 2 - 1) as reach, 0 as i, '' as mine, []::bigint[] as used from part
union all select p_partkey, a, b, reach, i + 1, case when j is null then mine else mine || a[i + 1] end, case when j is null then used else list_append(used, j) end
  from (select *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: b[j] = a[i + 1] and not list_contains(used, j))[1] as j from s where i < length(a))),
m as (select *, len(used) as m, array_to_string(list_transform(list_sort(used), lambda j: b[j]), '') as theirs from s where i = length(a)),
n as (select *, len(list_filter(range(1, m + 1), lambda p: mine[p] <> theirs[p])) as moved, len(list_filter(range(1, 5), lambda n: n <= least(length(a), length(b)) and a[1:n] = b[1:n])) as same from m),
j as (select *, case when a = b then 1.0::double when m = 0 then 0.0::double else (m / length(a) + m / length(b) + (m - moved / 2) / m) / 3 end as near from n)
select p_partkey, near + same * 0.1::double * (1 - near) as similarity from j""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro-Winkler similarity of part names and types; the SQL pairs their letters one after the other."""
    from ebbtide.functions.fuzzy import similarity

    return table(spark, sf_dir, "part").select("p_partkey", similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query(f"{_CALENDAR_LINES} select id, type_ord, place, line from folded")
def calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded lines of every event."""
    return reports.calendar_lines(saved_rows(spark, sf_dir), _day(), F.lit("2026-10-05 10:00:00").cast("timestamp"))


@query("""select case when o_orderkey % 2 = 0 then 'trial:' else 'manual:' end || o_orderkey as id, case when o_orderkey % 2 = 0 then 'essai' when o_orderkey % 3 = 0 then 'sport' else 'autre' end as category, case when o_orderkey % 5 > 0 then 1200 end::bigint as amount_cents,
case when o_orderkey % 7 = 0 then 'yearly' when o_orderkey % 2 = 1 or o_orderkey % 5 > 0 then 'monthly' else 'unknown' end as period, case when o_orderkey % 5 > 0 then (case when o_orderkey % 7 = 0 then 100 else 1200 end) end::bigint as monthly_equivalent_cents,
case when o_orderkey % 2 = 0 then date '2026-10-12' end as trial_ends_at, o_orderkey % 5 = 0 as needs_amount from orders""")  # fmt: skip
def typed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that users add by hand, trials and others, with the form's defaults."""
    k = F.col("o_orderkey")
    rows = orders(spark, sf_dir).select(
        k.cast("string").alias("entry_id"), F.lit(" Box ").alias("display_name"), F.when(k % 3 == 0, "sport").alias("category"), F.when(k % 5 > 0, 1200).alias("amount_cents"), F.when(k % 7 == 0, "yearly").alias("period"),
        F.lit(None).cast("date").alias("trial_ends_at"), (k % 2 == 0).alias("trial"),
    )
    now = F.lit("2026-10-05 10:00:00").cast("timestamp")
    made = [portfolio.manual_rows(portfolio.with_form_defaults(rows.where(F.col("trial") == t), _day(), t), now, t) for t in (False, True)]
    return made[0].unionByName(made[1]).select("id", "category", "amount_cents", "period", "monthly_equivalent_cents", "trial_ends_at", "needs_amount")


@query("select c_custkey, case when c_custkey in (select o_custkey from orders) then 'dashboard' else 'welcome' end as screen from customer")
def home_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.home_screen(table(spark, sf_dir, "customer").select("c_custkey"), orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("select l_suppkey as capture_id, floor(avg(l_quantity * 2) + 0.5)::int as confidence, count_if(l_quantity * 2 < 60) as unsure from lineitem group by 1")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("capture_id"), (F.col("l_quantity") * 2).alias("confidence"))
    unsure = reports.unsure_lines(lines).groupBy("capture_id").agg(F.count("*").alias("unsure"))
    return reports.page_confidence(lines).join(unsure, "capture_id", "left").na.fill(0, ["unsure"])
