"""Which backups a policy keeps: an age ladder with chain and snapshot integrity, and keep-last/periodic/within rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.operators.closure import reachable
from chunkloom.storage import staged

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds


@dataclass(frozen=True)
class Ladder:
    """Cadences in microseconds by age tier; 0 keeps all."""

    within_week: int = 900_000_000
    after_week: int = DAY
    after_90_days: int = 7 * DAY
    after_year: int = 30 * DAY


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def cadence(age: Column, ladder: Ladder) -> Column:
    return F.when(age < 7 * DAY, ladder.within_week).when(age < 90 * DAY, ladder.after_week).when(age < 365 * DAY, ladder.after_90_days).otherwise(ladder.after_year).cast("long")


def newest_of_source(backups: DataFrame) -> DataFrame:
    """The newest completed backup of each source: latest completion, then latest start, then smallest id."""
    order = F.struct(micros(F.col("completed_at")).alias("c"), micros(F.col("started_at")).alias("s"))
    best = backups.where("status = 'completed'").withColumn("__o", order)
    top = best.groupBy("source").agg(F.max("__o").alias("__o"))
    return best.join(top, ["source", "__o"]).groupBy("source").agg(F.min("backup_id").alias("backup_id"))


def ladder_kept(backups: DataFrame, ladder: Ladder, now: Column) -> DataFrame:
    """backup_id, source, cadence and bucket of the newest completed backup in every (source, cadence, age div cadence); tiers of equal cadence share buckets."""
    b = backups.where("status = 'completed'").withColumn("age", micros(now) - micros(F.col("completed_at")))
    b = b.withColumn("cadence", cadence(F.col("age"), ladder)).withColumn("bucket", F.expr("CASE WHEN cadence > 0 THEN age div cadence END"))
    w = W.partitionBy("source", "cadence", "bucket").orderBy(F.desc("completed_at"), F.desc("started_at"), "backup_id")
    ranked = b.withColumn("__n", F.row_number().over(w)).where("cadence <= 0 OR __n = 1")
    return ranked.select("backup_id", "source", "cadence", "bucket")


def select_ladder(backups: DataFrame, ladder: Ladder, now: Column) -> DataFrame:
    """backup_id, kept and the first reason: active, newest-of-source, ladder, chain-ancestor, snapshot-sibling; null for those that may go.

    Ancestors of kept backups and all members of a kept snapshot stay, to a fixpoint; cycles end, parents that don't exist are ignored.
    """
    direct = backups.where("status <> 'completed'").select("backup_id", F.lit(0).alias("rank"))
    direct = direct.unionByName(newest_of_source(backups).select("backup_id", F.lit(1).alias("rank"))).unionByName(ladder_kept(backups, ladder, now).select("backup_id", F.lit(2).alias("rank")))
    direct = staged(direct.groupBy("backup_id").agg(F.min("rank").alias("rank")), "ladder-direct")
    members = backups.where("coalesce(snapshot_id, '') <> ''").select(F.col("backup_id"), F.col("snapshot_id"))
    # a snapshot is a vertex of its own between its members, so a large one makes no pairs
    up = members.select(F.col("backup_id").alias("from_id"), F.concat(F.lit("snapshot:"), "snapshot_id").alias("to_id"))
    down = members.select(F.concat(F.lit("snapshot:"), "snapshot_id").alias("from_id"), F.col("backup_id").alias("to_id"))
    chain = backups.where("coalesce(parent_id, '') <> ''").select(F.col("backup_id").alias("from_id"), F.col("parent_id").alias("to_id"))
    seen = reachable(direct.select(F.col("backup_id").alias("id")), chain.unionAll(up).unionAll(down))
    kept = seen.join(direct.withColumnRenamed("backup_id", "id"), "id", "left")
    # by what brought it in: a chain edge from something kept, else its snapshot
    parents = chain.join(seen.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().withColumn("ancestor", F.lit(True))
    reason = F.when(F.col("rank") == 0, "active").when(F.col("rank") == 1, "newest-of-source").when(F.col("rank") == 2, "ladder").when(F.col("ancestor"), "chain-ancestor").otherwise("snapshot-sibling")
    kept = kept.join(parents, "id", "left").select(F.col("id").alias("backup_id"), reason.alias("reason"))
    return backups.select("backup_id").join(kept, "backup_id", "left").select("backup_id", F.col("reason").isNotNull().alias("kept"), "reason")


@dataclass(frozen=True)
class KeepPolicy:
    """How many of the most recent backups, hours, days, ISO weeks, months and years; and all within a calendar span."""

    last: int = 0
    hourly: int = 0
    daily: int = 0
    weekly: int = 0
    monthly: int = 0
    yearly: int = 0
    within: tuple[int, int, int, int] = (0, 0, 0, 0)  # years, months, days, hours

    def any(self) -> bool:
        return any((self.last, self.hourly, self.daily, self.weekly, self.monthly, self.yearly, *self.within))


#: A period's key: equal within a period and growing with time.
PERIODS = {
    "hourly": lambda t: F.date_format(t, "yyyyMMddHH").cast("long"),
    "daily": lambda t: F.date_format(t, "yyyyMMdd").cast("long"),
    "weekly": lambda t: F.extract(F.lit("YEAROFWEEK"), t).cast("long") * 100 + F.weekofyear(t),
    "monthly": lambda t: F.date_format(t, "yyyyMM").cast("long"),
    "yearly": lambda t: F.year(t).cast("long"),
}


def cutoff(now: Column, within: tuple[int, int, int, int]) -> Column:
    """now less years, months, days and hours; a day that a month lacks runs over into the next month (31 March less a month is 2 March in a leap year)."""
    years, months, days, hours = within
    month = F.add_months(F.trunc(now, "MM"), -(12 * years + months))
    day = F.date_add(month, F.dayofmonth(now) - 1 - days)
    return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (micros(now) - F.unix_micros(F.to_date(now).cast("timestamp"))) - hours * HOUR)


def keep_reasons(backups: DataFrame, policy: KeepPolicy, now: Column) -> DataFrame:
    """backup_id and reasons (in the order last, hourly, daily, weekly, monthly, yearly, within) of what the policy keeps.

    A periodic rule keeps the newest backup of each of the N most recent periods that have one. Newest: latest timestamp,
    then greatest id. Each rule cuts its few periods out with an aggregate and top N; no window runs over all backups.
    """
    if not policy.any():
        raise ValueError("a policy that keeps nothing is refused")
    b = backups.select("backup_id", "timestamp")
    found = []
    best = F.max(F.struct("timestamp", "backup_id")).alias("x")
    if policy.last:
        found.append(b.orderBy(F.desc("timestamp"), F.desc("backup_id")).limit(policy.last).select("backup_id", F.lit(0).alias("o"), F.lit("last").alias("reason")))
    for i, (name, key) in enumerate(PERIODS.items(), 1):
        if n := getattr(policy, name):
            top = b.groupBy(key(F.col("timestamp")).alias("k")).agg(best).orderBy(F.desc("k")).limit(n)
            found.append(top.select(F.col("x.backup_id").alias("backup_id"), F.lit(i).alias("o"), F.lit(name).alias("reason")))
    if any(policy.within):
        found.append(b.where(micros(F.col("timestamp")) >= micros(cutoff(now, policy.within))).select("backup_id", F.lit(6).alias("o"), F.lit("within").alias("reason")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    ordered = F.array_sort(F.collect_list(F.struct("o", "reason")))
    return out.groupBy("backup_id").agg(F.array_join(F.transform(ordered, lambda x: x["reason"]), ",").alias("reasons"))
