"""Detection of subscriptions in transactions: routing, merchant groups, reconciliation, rules, statistics.

Everything is keyed by import_id (an import of one user), so imports run in parallel; first-wins rules follow `pos`. Rows
with a null import_id are an import of their own. An empty table gives no subscription and no statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.core import broadcast_up_to, checkpointed
from ebbtide.functions import dates, money
from ebbtide.functions.fuzzy import jaro_winkler
from ebbtide.functions.text import keyword, merchant_key, never_subscription, other_debit_reason, title_case
from ebbtide.operators.dedupe import first_captures
from ebbtide.operators.matching import FEW, THRESHOLD, match
from ebbtide.operators.periodicity import regular_groups
from ebbtide.sources import dictionary

# How alike two merchants' keys must be, and from which length on.
SAME_MERCHANT, LEAST_KEY = 0.93, 5
STORE = "screenshot_store"
# Periods in words.
EVERY = {"weekly": "chaque semaine", "monthly": "chaque mois", "quarterly": "chaque trimestre", "yearly": "chaque année"}
CONFIDENCES = ("high", "medium", "low")


@dataclass
class Detection:
    subscriptions: DataFrame
    other_debits: DataFrame
    stats: DataFrame


def judged(rows: DataFrame) -> DataFrame:
    """rows with `fate`: duplicate, credit, transfer, ignored (an empty or never label) or null for those that go on."""
    label = F.col("normalized_label")
    fate = (
        F.when(~F.col("is_first"), "duplicate").when(F.col("direction") == "credit", "credit").when(F.col("kind") == "transfer", "transfer")
        .when(F.coalesce(label, F.lit("")) == "", "ignored").when(never_subscription(label), "ignored")
    )
    return first_captures(rows).withColumn("fate", fate).drop("is_first")


def routed(rows: DataFrame, services: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows with their first group key (`route`), the service, the intermediary, the reason of another debit, the keyword."""
    known = broadcast_up_to(services.select("service_id", "intermediary", "service_ord"), FEW)
    found = match(rows, services, threshold=threshold).join(known, "service_id", "left")
    label = F.col("normalized_label")
    told = rows.select("normalized_label").distinct().join(found.select(F.col("label").alias("normalized_label"), "service_id", "intermediary", F.col("via").alias("_via")), "normalized_label", "left")
    told = told.select(label.alias("_label"), "service_id", "intermediary", "_via", other_debit_reason(label).alias("_other"), merchant_key(label).alias("_merchant"), keyword(label).alias("_word"))
    told = broadcast_up_to(checkpointed(told), FEW)  # a few labels come to the rows, which needn't be dealt by label then
    asked = rows.join(told, label.eqNullSafe(F.col("_label")), "left")  # what a label says is worked out once for each label
    own = F.col("service_id").isNotNull() & ~F.col("intermediary")
    other, key = F.col("_other"), F.col("_merchant")
    prefix = F.when(F.col("source") == STORE, "store").otherwise("label")
    hidden = F.col("service_id").isNotNull() & F.col("intermediary") & ~F.coalesce(F.col("source") == STORE, F.lit(False))
    route = (
        F.when(own, F.concat(F.lit("service:"), "service_id")).when(other.isNotNull(), F.concat(F.lit("other:"), "normalized_label"))
        .when(hidden, F.concat(F.lit("via:"), "service_id", F.lit(":"), F.coalesce(F.col("amount_cents").cast("string"), F.lit("?"))))
        .otherwise(F.concat(prefix, F.lit(":"), F.when(key != "", key).otherwise(F.col("normalized_label"))))
    )
    unknown = ~own & other.isNull() & ~hidden
    return asked.select(
        *rows.columns, route.alias("route"), F.when(own, F.col("service_id")).alias("service_id"), F.when(own, F.col("_via")).when(other.isNull() & hidden, F.col("service_id")).alias("via_id"),
        F.when(~own, other).alias("other_reason"), F.when(unknown, F.col("_word")).alias("keyword"), unknown.alias("unknown_merchant"),
    )


@lru_cache(1 << 16)
def _alike(leader: str, key: str) -> bool:
    """Whether two keys come near each other; remembered, since imports share merchants."""
    prefix = next((i for i, (x, y) in enumerate(zip(leader[:4], key[:4], strict=False)) if x != y), min(4, len(leader), len(key)))
    jaro = (min(len(leader), len(key)) / max(len(leader), len(key), 1) + 2) / 3  # at most, if the longer one holds all letters of the other
    return jaro + 0.1 * prefix * (1 - jaro) >= SAME_MERCHANT - 1e-9 and jaro_winkler(leader, key) >= SAME_MERCHANT


class _Leaders:
    """Leaders in order. Many of them are kept with what bounds Jaro-Winkler from above: lengths, letter counts, the first four letters.

    Matches are no more than the letters that two keys share, counted with repeats, and no transposition only lowers the
    similarity; so a leader that can't reach the threshold by shared letters, lengths and common prefix isn't compared.
    A few leaders are compared one by one, which costs less than arrays of them.
    """

    MANY = 64

    def __init__(self):
        self.keys: list[str] = []
        self.place: dict[str, int] = {}
        self.told = 0  # leaders that the arrays hold
        self.counts, self.heads, self.lengths = np.zeros((0, 64), np.uint8), np.zeros((0, 4), np.int32), np.zeros(0)

    def joined(self, key: str) -> str:
        """The first leader that is the key or comes near it; without one the key leads from now on."""
        leader = self._first_alike(key)
        if leader is None:
            self.place[key] = len(self.keys)
            self.keys.append(leader := key)
        return leader

    @staticmethod
    def _told(key: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(key.encode("utf-32-le"), np.int32)
        head = np.full(4, -1, np.int32)
        head[: len(codes)] = codes[:4]
        return np.minimum(np.bincount(codes % 64, minlength=64), 255).astype(np.uint8), head

    def _catch_up(self, n: int) -> None:
        if n > len(self.lengths):
            more = 2 * n - len(self.lengths)
            self.counts, self.heads, self.lengths = (np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in (self.counts, self.heads, self.lengths))
        for at in range(self.told, n):
            self.counts[at], self.heads[at] = self._told(self.keys[at])
            self.lengths[at] = len(self.keys[at])
        self.told = n

    def _first_alike(self, key: str) -> str | None:
        same, n = self.place.get(key), len(self.keys)
        if len(key) < LEAST_KEY or not n:
            return None if same is None else key
        if n < self.MANY:
            return next((x for x in self.keys if x == key or _alike(x, key)), None)
        self._catch_up(n)
        counts, head = self._told(key)
        near = np.flatnonzero((self.lengths[:n] >= 0.6 * len(key)) & (0.6 * self.lengths[:n] <= len(key)))  # for others even every letter shared is too little
        shared = np.minimum(self.counts[near], counts).sum(axis=1, dtype=np.int64) if max(len(key), self.lengths[:n].max()) < 256 else np.minimum(self.lengths[near], len(key))
        prefix = np.cumprod(self.heads[near] == head, axis=1).sum(axis=1)
        jaro = (shared / np.maximum(self.lengths[near], 1) + shared / len(key) + 1) / 3
        for at in near[jaro + 0.1 * prefix * (1 - jaro) >= SAME_MERCHANT - 1e-9].tolist():
            if at == same or jaro_winkler(self.keys[at], key) >= SAME_MERCHANT:
                return self.keys[at]
        return None if same is None else key


def _led(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys by import and prefix, in order of appearance, with the `leader` that each joins: the first one alike, or itself.

    Many imports share a batch, and one may go on in the next.
    """
    at, known = None, _Leaders()
    for batch in batches:
        leaders = []
        for *of, key in zip(*(batch.column(c).to_pylist() for c in ("import_id", "prefix", "key")), strict=True):
            if of != at:
                at, known = of, _Leaders()
            leaders.append(known.joined(key))
        yield batch.append_column("leader", pa.array(leaders, pa.string()))


def _leaders(keys: pd.DataFrame) -> pd.DataFrame:
    """Distinct keys of one import and prefix with their leaders, all at once."""
    keys = keys.sort_values("first")
    return pa.Table.from_batches(_led(pa.Table.from_pandas(keys, preserve_index=False).to_batches())).to_pandas()[["import_id", "prefix", "key", "leader"]]


def clustered(rows: DataFrame) -> DataFrame:
    """rows with `group_key`: the route, or for unknown merchants that of the leader.

    The fold is over the distinct merchants of one import, not over rows, since equal keys always share a leader. They are
    dealt over a named number of tasks (their few bytes say little of the work), and only those that join another come back.
    """
    parts, tasks = F.split("route", ":", 2), 4 * rows.sparkSession.sparkContext.defaultParallelism
    keys = rows.where("unknown_merchant").groupBy("import_id", parts[0].alias("prefix"), parts[1].alias("key")).agg(F.min("pos").alias("first"))
    dealt = keys.repartition(tasks, "import_id", "prefix").sortWithinPartitions("import_id", "prefix", "first", "key")
    led = dealt.mapInArrow(_led, T.StructType([*dealt.schema, T.StructField("leader", T.StringType())])).where("leader <> key")
    told = led.select(F.col("import_id").alias("_import"), F.concat_ws(":", "prefix", "key").alias("_route"), F.concat_ws(":", "prefix", "leader").alias("_leader"))
    same = F.col("import_id").eqNullSafe(F.col("_import")) & (F.col("route") == F.col("_route"))
    return rows.join(told, same, "left").withColumn("group_key", F.when(F.col("unknown_merchant"), F.coalesce("_leader", "route")).otherwise(F.col("route"))).select(*rows.columns, "group_key")


def reconciled(rows: DataFrame) -> DataFrame:
    """rows whose `via:` group has the amount of a store's subscription moved to that subscription's group.

    Adds `moved` (null, or the first pos of the group a row comes from): moved rows stand after the group's own.
    """
    first = rows.groupBy("import_id", "group_key").agg(F.min("pos").alias("_born"))
    listed = rows.where(F.col("source") == STORE).where("amount_cents is not null").select("import_id", "group_key", "amount_cents").distinct()
    target = _same_import(listed, first, "group_key").groupBy("import_id", "amount_cents").agg(F.min_by("group_key", "_born").alias("_target"))
    hidden = rows.where("group_key like 'via:%' and amount_cents is not null").groupBy("import_id", "group_key", "amount_cents").agg(F.min("pos").alias("_moved"))
    moves = _same_import(hidden, target, "amount_cents").select("import_id", "group_key", "_target", "_moved")
    is_hidden = F.coalesce(F.col("group_key").like("via:%"), F.lit(False))  # only their rows are dealt anew
    found = _same_import(rows.where(is_hidden), moves, "group_key", "left").unionByName(rows.where(~is_hidden), allowMissingColumns=True)
    return found.select(*(c for c in rows.columns if c != "group_key"), F.coalesce("_target", "group_key").alias("group_key"), F.col("_moved").alias("moved"))


def _same_import(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on import_id (nulls equal) and key."""
    other = right.withColumnRenamed("import_id", "_import_id").withColumnRenamed(key, "_key")
    same = F.col("import_id").eqNullSafe(F.col("_import_id")) & (F.col(key) == F.col("_key"))
    return left.join(other, same, how).drop("_import_id", "_key")


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each group: what its first, its latest and its store transactions say, and its evidence in order."""
    seq = F.struct(F.col("moved").isNotNull().alias("late"), F.coalesce("moved", F.lit(0)).alias("from"), F.col("pos").alias("pos"))
    rows = rows.withColumn("seq", seq)
    store, priced = F.col("source") == STORE, F.col("amount_cents").isNotNull()
    first = lambda c, when=None: F.min_by(c, "seq" if when is None else F.when(when, F.col("seq")))
    tx = F.struct("amount_cents", "label", "period_hint", "renewal_date", "trial_ends_at")
    newest = F.struct(F.coalesce(F.datediff("date", F.lit("0001-01-01").cast("date")), F.lit(-1)).alias("d"), (-F.col("seq.late").cast("int")).alias("l"), (-F.col("seq.from")).alias("f"), (-F.col("seq.pos")).alias("p"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(c).alias("v")))), lambda x: x["v"])
    groups = rows.groupBy("import_id", "group_key").agg(
        F.min(F.when(~F.col("seq.late"), F.col("pos"))).alias("group_ord"), first("service_id").alias("service_id"), first("other_reason").alias("other_reason"), first("keyword").alias("keyword"),
        first("via_id").alias("_own_via"), first("via_id", F.col("seq.late")).alias("_late_via"), first(tx, store).alias("store"), F.coalesce(F.max(F.col("kind") == "sepa"), F.lit(False)).alias("has_sepa"),
        F.max_by(F.struct("date", "amount_cents", "normalized_label"), newest).alias("latest"), first("amount_cents", priced).alias("first_amount"), first("normalized_label", priced).alias("named"),
        F.count("*").alias("n_rows"), ordered("id").alias("source_transaction_ids"), F.array_distinct(F.filter(ordered("raw_text"), lambda t: t != "")).alias("source_lines"),
    )
    return groups.withColumn("via_id", F.coalesce("_own_via", "_late_via")).drop("_own_via", "_late_via")


def confidence_rule(has_service: Column, in_store: Column, other: Column, hidden: Column, named: Column, sepa: Column, occurrences: Column) -> Column:
    """The first rule that holds; null if none does."""
    return F.when(has_service | in_store, "high").when(other | hidden | named | sepa, "medium").when(occurrences >= 3, "medium").when(occurrences.isNotNull(), "low")


def projected(groups: DataFrame, services: DataFrame) -> DataFrame:
    """Groups (with period and occurrences) as detected subscriptions; unexplained ones have a null confidence."""
    services = broadcast_up_to(services.select("service_id", "service_name", "service_category", "usual_period"), FEW)
    via = services.select(F.col("service_id").alias("via_id"), F.col("service_name").alias("via_name"))
    g = groups.withColumnsRenamed({"period": "seen_period"}).join(services, "service_id", "left").join(via, "via_id", "left")
    has = {c: F.col(c).isNotNull() for c in ("service_id", "store", "other_reason", "via_id", "keyword", "occurrences")}
    hint = F.when(F.col("store.period_hint") != "unknown", F.col("store.period_hint"))
    g = g.withColumn("confidence", confidence_rule(has["service_id"], has["store"], has["other_reason"], has["via_id"], has["keyword"], F.col("has_sepa"), F.col("occurrences")))
    g = g.withColumn("amount_cents", F.coalesce("store.amount_cents", "latest.amount_cents", "first_amount")).withColumn("period", F.coalesce(hint, "seen_period", "usual_period", F.lit("unknown")))
    g = g.withColumn("period_is_estimated", hint.isNull() & F.col("seen_period").isNull()).withColumn("monthly_equivalent_cents", money.monthly_equivalent(F.col("amount_cents"), F.col("period")))
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    why = (
        F.when(has["service_id"], said("Reconnu dans la liste des services : ", F.col("service_name"), "."))
        .when(has["store"], said("Listé sur la page des abonnements du store."))
        .when(has["other_reason"], said(F.col("other_reason"), " : prélèvement, mais pas un abonnement."))
        .when(has["via_id"], said("Payé via ", F.col("via_name"), ", qui ne précise pas le service. Une capture de la page des abonnements du store le retrouverait."))
        .when(has["keyword"], said("Le libellé ressemble à un abonnement (", F.col("keyword.word"), ")."))
        .when(F.col("has_sepa"), said("Prélèvement d'un organisme que je ne connais pas : à toi de dire si c'est un abonnement."))
        .when(has["occurrences"], said("Même marchand et montant proche, ", F.col("occurrences").cast("string"), " fois, ", dictionary.label_of(F.col("seen_period"), EVERY), "."))
    )
    no_amount = F.col("amount_cents").isNull()
    reasons = F.filter(
        F.array(
            why,
            F.when(has["via_id"] & has["service_id"], said("Payé via ", F.col("via_name"), ".")),
            F.when(F.col("period_is_estimated") & (F.col("period") != "unknown"), said("Fréquence estimée : la fréquence habituelle de ce service.")),
            F.when(no_amount, said("Montant absent de la capture : à compléter.")).when(F.col("period") == "unknown", said("Montant lu : ", money.format_euros(F.col("amount_cents")), ", fréquence inconnue.")),
        ),
        lambda r: r.isNotNull(),
    )
    hidden = F.col("group_key").startswith("via:") & has["via_id"]
    name = F.coalesce("service_name", F.when(has["store"], F.col("store.label")), F.when(hidden, said("Abonnement ", F.col("via_name"))), title_case(F.coalesce("named", "latest.normalized_label")))
    return g.select(
        "import_id", F.concat(F.lit("sub:"), "group_key").alias("id"), "service_id", name.alias("display_name"),
        F.coalesce("service_category", "keyword.category", F.when(F.col("store.trial_ends_at").isNotNull(), "essai"), F.lit("autre")).alias("category"),
        "amount_cents", "period", "period_is_estimated", "monthly_equivalent_cents", "confidence", reasons.alias("reasons"), "source_transaction_ids", "source_lines", F.lit("pending").alias("status"),
        F.coalesce("store.renewal_date", dates.next_renewal(F.col("latest.date"), F.col("period"))).alias("next_renewal"), F.col("store.trial_ends_at").alias("trial_ends_at"),
        no_amount.alias("needs_amount"), F.when(has["other_reason"], "other_debit").otherwise("subscription").alias("kind"), "group_ord", "n_rows",
    )


def surest_first(order: str = "group_ord") -> list[Column]:
    """Confidence, then the most expensive, then order of appearance."""
    rank = dictionary.label_of(F.col("confidence"), {c: i for i, c in enumerate(CONFIDENCES)})
    return [rank, F.coalesce("monthly_equivalent_cents", F.lit(0)).desc(), F.coalesce("amount_cents", F.lit(0)).desc(), F.col(order)]


def statistics(fates: DataFrame, found: DataFrame) -> DataFrame:
    """Counters of each import: `ignored` also counts the rows of unexplained groups."""
    n = fates.groupBy("import_id").agg(F.count("*").alias("transactions"), *(F.count_if(F.col("fate") == f).alias(c) for f, c in (("duplicate", "duplicates"), ("credit", "credits"), ("transfer", "transfers"), ("ignored", "_ignored"))))
    of = found.groupBy("import_id").agg(
        F.sum(F.when(F.col("confidence").isNull(), F.col("n_rows")).otherwise(0)).alias("_dropped"), *(F.count_if((F.col("confidence") == c) & (F.col("kind") == "subscription")).alias(c) for c in CONFIDENCES)
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    both = n.join(of.withColumnRenamed("import_id", "_i"), F.col("import_id").eqNullSafe(F.col("_i")), "left")
    by = F.map_from_arrays(F.array(*map(F.lit, CONFIDENCES)), F.array(*(zero(F.col(c)) for c in CONFIDENCES)))
    return both.select("import_id", "transactions", "duplicates", "credits", "transfers", (F.col("_ignored") + zero(F.col("_dropped"))).alias("ignored"), by.alias("by_confidence"))


def detect(rows: DataFrame, services: DataFrame | None = None, threshold: float = THRESHOLD) -> Detection:
    """Subscriptions and other debits of TRANSACTION rows, with statistics, import by import.

    Rows are written to the checkpoint folder after each step that later ones read several times.
    """
    services = dictionary.services(rows.sparkSession) if services is None else services
    fates = checkpointed(judged(rows))
    led = checkpointed(clustered(checkpointed(routed(fates.where("fate is null").drop("fate"), services, threshold))))
    ready = checkpointed(reconciled(led))
    groups = grouped(ready)
    regular = regular_groups(ready, ["import_id", "group_key"]).withColumnRenamed("import_id", "_i").withColumnRenamed("group_key", "_k")
    timed = groups.join(regular, F.col("import_id").eqNullSafe(F.col("_i")) & (F.col("group_key") == F.col("_k")), "left").drop("_i", "_k")
    found = projected(timed, services)
    explained = found.where("confidence is not null").drop("n_rows")
    return Detection(explained.where("kind = 'subscription'"), explained.where("kind = 'other_debit'"), statistics(fates, found))


def totals(subscriptions: DataFrame) -> DataFrame:
    """One row: monthly and yearly cents of subscriptions that are not rejected, and how many have no monthly amount."""
    counted = (F.col("kind") == "subscription") & (F.col("status") != "rejected")
    monthly = F.coalesce(F.sum(F.when(counted, F.col("monthly_equivalent_cents"))), F.lit(0))
    return subscriptions.agg(monthly.alias("monthly_cents"), (monthly * 12).alias("yearly_cents"), F.count_if(counted & F.col("monthly_equivalent_cents").isNull()).alias("without_amount"))
