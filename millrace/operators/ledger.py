"""Double-entry postings as whole minor units, and grouped outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balances(postings: DataFrame) -> DataFrame:
    """(account, currency, balance): credits less debits; rows without direction or amount count nothing."""
    signed = F.when(F.col("direction") == "credit", F.col("minor")).when(F.col("direction") == "debit", -F.col("minor"))
    return postings.groupBy("account", "currency").agg(F.coalesce(F.sum(signed), F.lit(0)).alias("balance"))


def net_position(postings: DataFrame) -> DataFrame:
    """(currency, net): 0 where the books balance."""
    return balances(postings).groupBy("currency").agg(F.sum("balance").alias("net"))


def entry_problems(postings: DataFrame) -> DataFrame:
    """(entry, problem) of entries that don't balance, mix currencies or have negative amounts."""
    debit, credit = (F.sum(F.when(F.col("direction") == d, F.col("minor")).otherwise(0)) for d in ("debit", "credit"))
    facts = postings.groupBy("entry").agg(debit.alias("d"), credit.alias("c"), F.count_distinct("currency").alias("k"), F.min("minor").alias("low"))
    problem = F.when(F.col("low") < 0, "negative_amount").when(F.col("k") > 1, "mixed_currencies").when(F.col("d") != F.col("c"), "unbalanced")
    return facts.select("entry", problem.alias("problem")).filter("problem is not null")


def outcomes(offers: DataFrame, results: DataFrame) -> DataFrame:
    """(category, attempts, pending, wins, realized, asked, cost, projected) of offers (id, category, ask, cost) and their results (id, realized); projected is what all offers would leave."""
    done = F.col("realized").isNotNull()
    return offers.join(results, "id", "left").groupBy("category").agg(
        F.count_if(done).alias("attempts"), F.count_if(~done).alias("pending"), F.count_if(F.col("realized") >= F.col("ask")).alias("wins"),
        F.coalesce(F.sum("realized"), F.lit(0)).alias("realized"), F.sum("ask").alias("asked"), F.sum("cost").alias("cost"), F.sum(F.col("ask") - F.col("cost")).alias("projected"),
    )


def demand(listings: DataFrame) -> DataFrame:
    """(term, listings, total, middle): count, sum and exact median of the numbers of each term."""
    return listings.groupBy("term").agg(F.count("*").alias("listings"), F.sum("number").alias("total"), F.round(F.median("number"), 2).alias("middle"))


def postable(postings: DataFrame) -> DataFrame:
    """The postings of entries that balance; one bad leg keeps its whole entry out."""
    return postings.join(entry_problems(postings).select("entry"), "entry", "left_anti")


def reserved(reservations: DataFrame) -> DataFrame:
    """(account, reserved): sum of what is held; settled and released reservations hold nothing."""
    return reservations.groupBy("account").agg(F.coalesce(F.sum(F.when(F.col("state") == "held", F.col("minor"))), F.lit(0)).alias("reserved"))


def snapshot(accounts: DataFrame, postings: DataFrame, reservations: DataFrame) -> DataFrame:
    """(account, currency, balance, reserved, available) of all accounts (account, currency), those without entries too."""
    joined = accounts.select("account", "currency").distinct().join(balances(postings), ["account", "currency"], "left").join(reserved(reservations), "account", "left")
    balance, held = F.coalesce("balance", F.lit(0)), F.coalesce("reserved", F.lit(0))
    return joined.select("account", "currency", balance.alias("balance"), held.alias("reserved"), (balance - held).alias("available"))


def run_costs(events: DataFrame) -> DataFrame:
    """(run, observations, spent, earned) of events (run, direction, minor)."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("minor"))), F.lit(0))
    return events.groupBy("run").agg(F.count("*").alias("observations"), side("debit").alias("spent"), side("credit").alias("earned"))


def last_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The newest event of every key of an append-only log: upserts, transitions and holds are read this way."""
    columns = [c for c in log.columns if c != key]
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*columns))).alias("_r")).select(key, "_r.*")


def entries(postings: DataFrame, seq: str = "seq") -> DataFrame:
    """(entry, legs): the postings of every entry in the order of their number. An entry has a bounded number of legs."""
    return postings.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct(seq, "account", "direction", "minor"))).alias("legs"))


def history(offers: DataFrame, results: DataFrame, order: str, k: int = 50) -> DataFrame:
    """The k newest offers with their results, where there are any."""
    return offers.join(results, "id", "left").orderBy(F.desc(order), F.asc("id")).limit(k)


def summary(rows: DataFrame, category: str, *amounts: str) -> DataFrame:
    """(category, n, amounts) of every category and, as (all), of all rows."""
    out = rows.withColumn(category, F.coalesce(category, F.lit("(null)"))).rollup(category).agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in amounts])
    return out.withColumn(category, F.coalesce(category, F.lit("(all)")))


def top_listing(listings: DataFrame, group: str, score: Column, tie: str) -> DataFrame:
    """(group, tie, score): the row of the highest score of every group; the first of equals."""
    best = listings.groupBy(group).agg(F.min(F.struct((-score).alias("s"), F.col(tie).alias("t"))).alias("b"))
    return best.select(group, F.col("b.t").alias(tie), (-F.col("b.s")).alias("score"))


def merged_listings(listings: DataFrame, key: str, term_order: str, score: str, k: int) -> DataFrame:
    """The k best of the listings found for several terms; one found for more than one counts for the first."""
    columns = [c for c in listings.columns if c != key]
    one = listings.groupBy(key).agg(F.min_by(F.struct(*columns), term_order).alias("_r")).select(key, "_r.*")
    return one.orderBy(F.desc(score), F.asc(key)).limit(k)
