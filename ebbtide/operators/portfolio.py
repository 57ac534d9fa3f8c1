"""A user's saved subscriptions: merge of new detections, edits, manual rows, totals, deadlines, sections.

Frames may hold many users: pass their key as `scope` (part of a row's identity, and of every total and order). `today` and
`now` are parameters, never the clock. Totals over an empty portfolio are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.dates import days_until
from ebbtide.functions.money import monthly_equivalent
from ebbtide.operators.detect import surest_first

DETECTED = (
    "id string, service_id string, display_name string, category string, amount_cents long, period string, period_is_estimated boolean, monthly_equivalent_cents long, confidence string, reasons array<string>, "
    "source_transaction_ids array<string>, source_lines array<string>, status string, next_renewal date, trial_ends_at date, needs_amount boolean, kind string"
)
STORED = f"{DETECTED}, origin string, user_status string, created_at timestamp, updated_at timestamp"
#: Fields that a detection may lack: a refresh then keeps the saved value.
OPTIONAL = ("service_id", "amount_cents", "monthly_equivalent_cents", "next_renewal", "trial_ends_at")
JOINED = ("source_lines", "source_transaction_ids")
BOOKKEEPING = ("origin", "user_status", "created_at", "updated_at")
#: Columns of an edit: a value changes the field; clear_* empties it.
EDITS = "id string, display_name string, amount_cents long, clear_amount boolean, period string, category string, next_renewal date, clear_renewal boolean, trial_ends_at date, clear_trial boolean, user_status string, status string"


def as_detected(rows: DataFrame) -> DataFrame:
    """rows with all of DETECTED's columns, null where they have none; their other columns come first."""
    fields = T.StructType.fromDDL(DETECTED)
    own = [c for c in rows.columns if c not in fields.fieldNames()]
    return rows.select(*own, *((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def from_detection(detected: DataFrame, now: Column) -> DataFrame:
    """Detections as saved rows that the user hasn't touched."""
    return detected.withColumns({"origin": F.lit("detected"), "user_status": F.lit("keep"), "created_at": now, "updated_at": now})


def merge_detections(saved: DataFrame, detected: DataFrame, now: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """The whole portfolio after an import, with `change`: added, refreshed or null.

    New ids are added; a saved row that is still pending takes the detection's fields (its evidence is united); rows the
    user has decided on stay as they are. `detected` has one row for each id.
    """
    keys = (*scope, "id")
    old = saved.select(*(F.col(c).alias(f"o_{c}") for c in saved.columns))
    new = detected.select(*(F.col(c).alias(f"n_{c}") for c in saved.columns if c not in BOOKKEEPING))
    return merged(old.join(new, [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys], "full"), saved.columns, now, scope)


def merged(both: DataFrame, columns: list[str], now: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """merge_detections of rows that have met: o_ before the columns of saved ones, n_ before those of detections."""
    keys = (*scope, "id")
    fields = [c for c in columns if c not in keys and c not in BOOKKEEPING]
    is_new = F.col("o_id").isNull()
    refresh = ~is_new & F.col("n_id").isNotNull() & (F.col("o_status") == "pending")

    def field(c: str) -> Column:
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        fresh = F.coalesce(n, o) if c in OPTIONAL else F.array_distinct(F.concat(o, n)) if c in JOINED else n
        return F.when(is_new, n).when(refresh, fresh).otherwise(o).alias(c)

    kept = {"origin": F.lit("detected"), "user_status": F.lit("keep"), "created_at": now}
    return both.select(
        *(F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys), *map(field, fields), *(F.when(is_new, v).otherwise(F.col(f"o_{c}")).alias(c) for c, v in kept.items()),
        F.when(is_new | refresh, now).otherwise(F.col("o_updated_at")).alias("updated_at"), F.when(is_new, "added").when(refresh, "refreshed").alias("change"),
    ).select(*columns, "change")


def apply_edits(saved: DataFrame, edits: DataFrame, now: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """saved with each row's edit (at most one an id); edits of unknown ids change nothing. Derived fields are recomputed."""
    keys = (*scope, "id")
    edit = edits.select(*(F.col(c).alias(f"e_{c}") for c in edits.columns))
    return edited(saved.join(edit, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys], "left"), saved.columns, now)


def edited(both: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """apply_edits of rows that have met: e_ before the columns of edits."""
    touched = F.col("e_id").isNotNull()
    given = lambda c: F.coalesce(F.col(f"e_{c}"), F.col(c))
    cleared = lambda c, flag: F.when(F.coalesce(F.col(f"e_{flag}"), F.lit(False)), None).otherwise(given(c))
    name = F.trim("e_display_name")
    amount, period = cleared("amount_cents", "clear_amount"), given("period")
    changed = {
        "display_name": F.when(name != "", name).otherwise(F.col("display_name")), "category": given("category"), "user_status": given("user_status"), "status": given("status"), "period": period,
        "period_is_estimated": F.when(F.col("e_period").isNotNull(), False).otherwise(F.col("period_is_estimated")), "amount_cents": amount, "next_renewal": cleared("next_renewal", "clear_renewal"),
        "trial_ends_at": cleared("trial_ends_at", "clear_trial"), "needs_amount": amount.isNull(), "monthly_equivalent_cents": monthly_equivalent(amount, period), "updated_at": now,
    }
    return both.select(*((F.when(touched, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)) for c in columns))


def manual_rows(entries: DataFrame, now: Column, trial: bool = False) -> DataFrame:
    """STORED rows of (entry_id, display_name, category, amount_cents, period, next_renewal or trial_ends_at, service_id) typed by the user.

    A trial has category `essai`; a missing period is unknown. Ids come from entry_id, so a rerun gives the same rows.
    """
    there = lambda c, kind: F.col(c).cast(kind) if c in entries.columns else F.lit(None).cast(kind)
    period, amount, none = F.coalesce(there("period", "string"), F.lit("unknown")), there("amount_cents", "long"), F.array().cast("array<string>")
    return entries.select(
        F.concat_ws(":", F.lit("trial" if trial else "manual"), "entry_id").alias("id"), there("service_id", "string").alias("service_id"), F.trim("display_name").alias("display_name"),
        (F.lit("essai") if trial else F.col("category")).alias("category"), amount.alias("amount_cents"), period.alias("period"), F.lit(False).alias("period_is_estimated"),
        monthly_equivalent(amount, period).alias("monthly_equivalent_cents"), F.lit("high").alias("confidence"), F.array(F.lit("Essai gratuit ajouté par toi." if trial else "Ajouté par toi.")).alias("reasons"),
        none.alias("source_transaction_ids"), none.alias("source_lines"), F.lit("confirmed").alias("status"), (F.lit(None).cast("date") if trial else there("next_renewal", "date")).alias("next_renewal"),
        (there("trial_ends_at", "date") if trial else F.lit(None).cast("date")).alias("trial_ends_at"), amount.isNull().alias("needs_amount"), F.lit("subscription").alias("kind"),
        F.lit("trial" if trial else "manual").alias("origin"), F.lit("keep").alias("user_status"), now.alias("created_at"), now.alias("updated_at"),
    )


def with_form_defaults(entries: DataFrame, today: Column, trial: bool = False) -> DataFrame:
    """Typed entries with what the form fills in: a trial ends in a week and its price is monthly; others are monthly and `autre`."""
    if trial:
        period = F.coalesce("period", F.when(F.col("amount_cents").isNotNull(), "monthly"))
        return entries.withColumns({"trial_ends_at": F.coalesce("trial_ends_at", F.date_add(today, 7)), "period": period})
    return entries.withColumns({"period": F.coalesce("period", F.lit("monthly")), "category": F.coalesce("category", F.lit("autre"))})


def home_screen(users: DataFrame, items: DataFrame, scope: str) -> DataFrame:
    """(scope, screen): the dashboard for users with saved rows, else the welcome page."""
    return users.select(scope).distinct().join(items.select(scope).distinct().withColumn("_has", F.lit(True)), scope, "left").select(scope, F.when(F.col("_has"), "dashboard").otherwise("welcome").alias("screen"))


def is_counted() -> Column:
    """In the totals: a subscription, neither rejected nor cancelled."""
    return (F.col("kind") == "subscription") & (F.col("status") != "rejected") & (F.col("user_status") != "cancelled")


def portfolio_totals(items: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """count, monthly, yearly, incomplete (no monthly amount) and yearly savings of what is to be cancelled."""
    zero = lambda when: F.coalesce(F.sum(F.when(when, F.col("monthly_equivalent_cents"))), F.lit(0))
    return items.groupBy(*scope).agg(
        F.count_if(is_counted()).alias("count"), zero(is_counted()).alias("monthly_cents"), (zero(is_counted()) * 12).alias("yearly_cents"),
        F.count_if(is_counted() & F.col("monthly_equivalent_cents").isNull()).alias("incomplete"), (zero(is_counted() & (F.col("user_status") == "to_cancel")) * 12).alias("savings_yearly_cents"),
    )


#: Sums that can be kept up by additions and subtractions; `items` tells when nothing is left of a scope.
TOTALS = "items long, count long, monthly_cents long, incomplete long, to_save_cents long"


def totals_of_changes(changes: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """TOTALS of rows that come (weight 1) and go (weight -1)."""
    monthly, weight = F.coalesce("monthly_equivalent_cents", F.lit(0)), F.col("weight")
    summed = lambda value, when: F.coalesce(F.sum(F.when(when, weight * value)), F.lit(0))
    return changes.groupBy(*scope).agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("items"), summed(F.lit(1), is_counted()).alias("count"), summed(monthly, is_counted()).alias("monthly_cents"),
        summed(F.lit(1), is_counted() & F.col("monthly_equivalent_cents").isNull()).alias("incomplete"), summed(monthly, is_counted() & (F.col("user_status") == "to_cancel")).alias("to_save_cents"),
    )


def summed_totals(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """TOTALS of several TOTALS rows of a scope; scopes without items are gone."""
    return rows.groupBy(*scope).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (f.split()[0] for f in TOTALS.split(", ")))).where("items <> 0")


def shown_totals(rows: DataFrame) -> DataFrame:
    """TOTALS in the columns of portfolio_totals."""
    scope = [c for c in rows.columns if f"{c} long" not in TOTALS.split(", ")]
    return rows.select(*scope, "count", "monthly_cents", (F.col("monthly_cents") * 12).alias("yearly_cents"), "incomplete", (F.col("to_save_cents") * 12).alias("savings_yearly_cents"))


def upcoming_deadlines(items: DataFrame, today: Column, within: int = 30) -> DataFrame:
    """A row for each trial end and renewal in the coming days, with deadline, type, type_ord and in_days (to sort by)."""
    both = F.array(*(F.struct(F.lit(i).alias("type_ord"), F.lit(t).alias("type"), F.col(c).alias("deadline")) for i, (t, c) in enumerate((("trial_end", "trial_ends_at"), ("renewal", "next_renewal")))))
    open_ = items.where("status <> 'rejected' and user_status <> 'cancelled'")
    return open_.select("*", F.inline(both)).withColumn("in_days", days_until(F.col("deadline"), today)).where(F.col("in_days").between(0, within))


def soonest_first(order: str = "id") -> list[Column]:
    return [F.col("in_days"), F.col(order), F.col("type_ord")]


def section() -> Column:
    """Where the dashboard shows a row; null: nowhere."""
    return (
        F.when(F.col("status") == "rejected", "rejected").when(F.col("kind") == "other_debit", "other").when(F.col("status") == "pending", "pending").when(F.col("status") == "confirmed", "mine")
    )


def pending_order(order: str = "id") -> list[Column]:
    return surest_first(order)


def mine_order(order: str = "id") -> list[Column]:
    """Cancelled ones last, then the most expensive."""
    return [F.col("user_status") == "cancelled", F.coalesce("monthly_equivalent_cents", F.lit(0)).desc(), F.col(order)]
