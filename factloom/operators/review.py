"""Pull requests, votes and their close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import latest

#: Roles in their order, most rights first: fixed values.  Compare ranks, never the names.
ROLES = [
    "admin", "owner", "contributor", "curator", "view", "org", "pending", "deactivated", "deleted", "banned", "erased", "blacklist", "builtin",
]


def role_rank(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)


def new_pulls(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Requests (pull, subject, from, to) with both heads and ``error``: no source head, same perspective, same heads."""
    a = heads.select("subject", F.col("perspective").alias("from_p"), F.col("head").alias("from_head"))
    b = heads.select("subject", F.col("perspective").alias("to_p"), F.col("head").alias("to_head"))
    out = requests.join(a, ["subject", "from_p"], "left").join(b, ["subject", "to_p"], "left")
    return out.withColumn(
        "error",
        F.when(F.col("from_p") == F.col("to_p"), "same perspective").when(F.col("from_head").isNull(), "no source head")
        .when(F.col("from_head") == F.col("to_head"), "same head"),
    )


def merge_pulls(pulls: DataFrame, heads: DataFrame, roles: DataFrame) -> DataFrame:
    """Pulls with ``outcome``: merged, or the reason against it.  A missing target head is no reason."""
    now = heads.select("subject", F.col("perspective").alias("from_p"), F.col("head").alias("now_head"))
    role = roles.select("actor", F.col("perspective").alias("to_p"), role_rank(F.col("role")).alias("rank"))
    out = pulls.join(now, ["subject", "from_p"], "left").join(role, ["actor", "to_p"], "left")
    return out.withColumn(
        "outcome",
        F.when(F.col("status") != "pending", "not pending").when(~F.col("now_head").eqNullSafe(F.col("from_head")), "head moved")
        .when(F.coalesce("rank", F.lit(99)) >= ROLES.index("view") + 1, "no role").otherwise("merged"),
    )


def eligibility(votes: DataFrame, committee: DataFrame, reviews: DataFrame) -> DataFrame:
    """Votes (review, reviewer, ts, vote) with ``reason``: not on the committee, voted before, closed; null is fine."""
    from pyspark.sql import Window as W

    member = committee.select("review", "reviewer").distinct().withColumn("on", F.lit(True))
    out = votes.join(member, ["review", "reviewer"], "left").join(reviews.select("review", "close", "allow_change"), "review", "left")
    turn = F.row_number().over(W.partitionBy("review", "reviewer").orderBy("ts", "vote"))
    return out.withColumn("turn", turn).withColumn(
        "reason",
        F.when(F.col("on").isNull(), "not on committee").when(F.col("ts") > F.col("close"), "closed")
        .when((F.col("turn") > 1) & ~F.col("allow_change"), "voted before"),
    )


def quorum(votes: DataFrame, committee: DataFrame, rules: DataFrame) -> DataFrame:
    """(review, present, size, quorum): an exact rule wants so many, a ratio more than that share; ratio 1 means all."""
    size = committee.groupBy("review").agg(F.count_distinct("reviewer").alias("size"))
    here = votes.where("vote <> 'absent'").groupBy("review").agg(F.count_distinct("reviewer").alias("present"))
    out = rules.join(size, "review", "left").join(here, "review", "left").fillna(0, ["size", "present"])
    share = F.when(F.col("quorum_ratio") == 1, F.col("present") >= F.col("size")).otherwise(F.col("present") > F.col("size") * F.col("quorum_ratio"))
    return out.select("review", "present", "size", F.when(F.col("quorum_exact").isNotNull(), F.col("present") >= F.col("quorum_exact")).otherwise(share).alias("quorum"))


def tally(votes: DataFrame, rules: DataFrame) -> DataFrame:
    """(review, approve, deny, total, passed, failed) over each reviewer's newest vote; failing wins."""
    last = latest(votes, ["review", "reviewer"], ["ts", "vote"])
    n = last.groupBy("review").agg(
        F.count_if(F.col("vote") == "approve").alias("approve"), F.count_if(F.col("vote") == "deny").alias("deny"),
        F.count_if(F.col("vote") != "absent").alias("total"),
    )
    out = rules.join(n, "review", "left").fillna(0, ["approve", "deny", "total"])

    def over(count, exact, ratio):
        share = F.when(F.col(ratio) == 1, (F.col(count) >= F.col("total")) & (F.col("total") > 0)).otherwise(F.col(count) > F.col("total") * F.col(ratio))
        return F.coalesce(F.when(F.col(exact).isNotNull(), F.col(count) >= F.col(exact)).otherwise(share), F.lit(False))

    failed = over("deny", "fail_exact", "fail_ratio")
    return out.select("review", "approve", "deny", "total", (over("approve", "pass_exact", "pass_ratio") & ~failed).alias("passed"), failed.alias("failed"))


def close_time(start: Column, days: Column, dow: Column) -> Column:
    """Start and duration, or the end of the given weekday (0 is Sunday) on or after that."""
    after = start + F.make_interval(days=days)
    ahead = F.pmod(dow - (F.dayofweek(after) - 1), F.lit(7))
    return F.when(dow.isNull(), after).otherwise(F.date_trunc("DAY", after) + F.make_interval(days=ahead + 1, secs=F.lit(-1)))


def token_state(created: Column, now: Column, delay_s: int, life_s: int) -> Column:
    age = F.unix_timestamp(now) - F.unix_timestamp(created)
    return F.when(age < delay_s, "early").when(age < delay_s + life_s, "active").otherwise("expired")
