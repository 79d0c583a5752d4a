"""Queries of postings, offers and outcomes, logs, tasks, and amounts, over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions import values as V
from ..operators import graph, ledger
from .common import query, table


def _postings(spark, d) -> DataFrame:
    """Every order credits its customer and debits its status account."""
    o = table(spark, d, "orders").withColumn("minor", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    legs = F.array(F.struct(F.lit(0).alias("seq"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("account"), F.lit("credit").alias("direction")), F.struct(F.lit(1).alias("seq"), F.concat(F.lit("status-"), F.col("o_orderstatus")).alias("account"), F.lit("debit").alias("direction")))
    return o.select(F.col("o_orderkey").alias("entry"), F.lit("USD").alias("currency"), "minor", F.explode(legs).alias("l")).select("entry", "currency", "minor", "l.seq", "l.account", "l.direction")


_MINOR = "round(o_totalprice * 100)::bigint"
_POST = f"(select 'customer-' || o_custkey account, {_MINOR} minor from orders union all select 'status-' || o_orderstatus, -({_MINOR}) from orders)"


@query(f"select account, 'USD' currency, sum(minor)::bigint balance from {_POST} group by 1")
def ledger_balances(spark, d):
    return ledger.balances(_postings(spark, d))


@query(f"select 'USD' currency, sum(minor)::bigint net from {_POST} having count(*) > 0")
def ledger_net_position(spark, d):
    return ledger.net_position(_postings(spark, d))


def _faulty(spark, d) -> DataFrame:
    """Postings with faults made by the order's key: other amounts, other currencies, negative ones."""
    k = F.col("entry")
    return _postings(spark, d).withColumn("currency", F.when((k % 11 == 0) & (F.col("seq") == 1), "EUR").otherwise("USD")).withColumn("minor", F.when(k % 13 == 0, -F.col("minor")).when((k % 7 == 0) & (F.col("seq") == 1), F.col("minor") + 1).otherwise(F.col("minor")))


_FAULT = f"case when o_orderkey % 13 = 0 and {_MINOR} > 0 then 'negative_amount' when o_orderkey % 11 = 0 then 'mixed_currencies' when o_orderkey % 7 = 0 and o_orderkey % 13 <> 0 then 'unbalanced' end"


@query(f"select * from (select o_orderkey entry, {_FAULT} problem from orders) where problem is not null")
def entry_problems(spark, d):
    return ledger.entry_problems(_faulty(spark, d))


@query(f"select account, 'USD' currency, sum(minor)::bigint balance from (select 'customer-' || o_custkey account, {_MINOR} minor from orders where {_FAULT} is null union all select 'status-' || o_orderstatus, -({_MINOR}) from orders where {_FAULT} is null) group by 1")
def posted_balances(spark, d):
    """Balances after entries with faults were kept out."""
    return ledger.balances(ledger.postable(_faulty(spark, d)))


@query(f"""
with a as (select 'customer-' || c_custkey account from customer), b as (select account, sum(minor)::bigint balance from {_POST} group by 1), r as (select 'customer-' || o_custkey account, sum(case when o_orderstatus = 'O' then {_MINOR} end)::bigint held from orders group by 1)
select account, 'USD' currency, coalesce(balance, 0)::bigint balance, coalesce(held, 0)::bigint reserved, (coalesce(balance, 0) - coalesce(held, 0))::bigint available from a left join b using (account) left join r using (account)""")
def ledger_snapshot(spark, d):
    """Balance, what is held by open orders, and what is left, for all customers."""
    accounts = table(spark, d, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("account"), F.lit("USD").alias("currency"))
    held = table(spark, d, "orders").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("account"), F.when(F.col("o_orderstatus") == "O", "held").otherwise("settled").alias("state"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("minor"))
    return ledger.snapshot(accounts, _postings(spark, d), held)


@query("select l_suppkey run, count(*) observations, coalesce(sum(case when l_linestatus = 'O' then round(l_extendedprice * 100)::bigint end), 0)::bigint spent, coalesce(sum(case when l_linestatus <> 'O' then round(l_extendedprice * 100)::bigint end), 0)::bigint earned from lineitem group by 1")
def run_costs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.when(F.col("l_linestatus") == "O", "debit").otherwise("credit").alias("direction"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("minor"))
    return ledger.run_costs(rows)


@query(f"select o_orderkey entry, 2::int legs, 'customer-' || o_custkey first_account, {_MINOR} amount from orders")
def ledger_entries(spark, d):
    """Entries with their postings in order."""
    return ledger.entries(_postings(spark, d)).select("entry", F.size("legs").alias("legs"), F.get("legs", F.lit(0))["account"].alias("first_account"), F.get("legs", F.lit(1))["minor"].alias("amount"))


def _offers(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("ask"), (F.col("o_custkey") % 100).cast("bigint").alias("cost"), F.col("o_orderdate").alias("at"))


def _results(spark, d) -> DataFrame:
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    return table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(net).alias("realized"))


_RESULTS = "(select l_orderkey id, sum(round(l_extendedprice * (1 - l_discount) * 100)::bigint)::bigint realized from lineitem where l_returnflag <> 'R' group by 1)"
_OFFERS = f"(select o_orderkey id, o_orderpriority category, {_MINOR} ask, (o_custkey % 100)::bigint as cost, o_orderdate as \"at\" from orders)"


@query(f"select category, count(realized) attempts, count_if(realized is null) pending, count_if(realized >= ask) wins, coalesce(sum(realized), 0)::bigint realized, sum(ask)::bigint asked, sum(ask - cost)::bigint projected from {_OFFERS} left join {_RESULTS} using (id) group by 1")
def category_outcomes(spark, d):
    return ledger.outcomes(_offers(spark, d), _results(spark, d)).select("category", "attempts", "pending", "wins", "realized", "asked", "projected")


@query(f"select id, category, ask, realized from {_OFFERS} left join {_RESULTS} using (id) order by \"at\" desc, id limit 50")
def offer_history(spark, d):
    return ledger.history(_offers(spark, d), _results(spark, d), "at").select("id", "category", "ask", "realized")


@query(f"select coalesce(category, '(all)') category, count(*) n, sum(ask)::bigint ask, sum(cost)::bigint as cost from {_OFFERS} group by rollup (category)")
def offer_summary(spark, d):
    return ledger.summary(_offers(spark, d), "category", "ask", "cost")


@query("select p_brand term, count(*) listings, sum(l_quantity)::double total, round(median(l_quantity), 2) middle from lineitem join part on l_partkey = p_partkey group by 1")
def demand_medians(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("number")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("term")), "l_partkey")
    return ledger.demand(rows)


@query("select p_brand brand, p_partkey part, (p_size * 10 + p_partkey % 7)::double score from part qualify row_number() over (partition by p_brand order by p_size * 10 + p_partkey % 7 desc, p_partkey) = 1")
def top_listings(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), "p_size")
    return ledger.top_listing(rows, "brand", (F.col("p_size") * 10 + F.col("part") % 7).cast("double"), "part")


@query("""
with t as (select l_partkey part, l_linenumber term, l_quantity::double quantity, l_orderkey o from lineitem), f as (select part, min(term) term from t group by 1), q as (select part, term, max(quantity) quantity from t group by 1, 2)
select part, term, quantity from f join q using (part, term) order by quantity desc, part limit 30""")
def merged_listings(spark, d):
    """The best of what several terms (line numbers) found; what more than one found counts for the first."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("term")).agg(F.max("l_quantity").cast("double").alias("quantity"))
    return ledger.merged_listings(rows, "part", "term", "quantity", 30).select("part", "term", "quantity")


@query("with e as (select user_id, ts, event_type, value from events qualify rank() over (partition by user_id order by ts desc) = 1) select user_id, max(ts) ts, count(*)::bigint ties from e group by 1")
def latest_states(spark, d):
    """The newest event of every user, as the state of a log is read."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_type", "value")
    last = ledger.last_state(rows, "user_id", "ts").select("user_id", "ts")
    ties = rows.join(last, ["user_id", "ts"], "left_semi").groupBy("user_id", "ts").agg(F.count("*").alias("ties"))
    return last.join(ties, ["user_id", "ts"])


@query("select event_type, count(distinct user_id) users, count(*) n from events group by 1")
def state_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query(f"select o_orderkey id, {_MINOR} minor, ({_MINOR} * 20) // 100 as share, -(({_MINOR} * 20) // 100) as negative from orders")
def scaled_amounts(spark, d):
    """Amounts in their smallest unit, and a fifth of them and of their opposites, cut towards zero."""
    minor = V.minor_units(F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), minor.alias("minor"), V.scaled(minor, 20, 100).alias("share"), V.scaled(-minor, 20, 100).alias("negative"))


@query("select l_orderkey id, l_linenumber line, case when l_linenumber % 2 = 0 then (round(l_extendedprice * 100)::bigint + 5) end total from lineitem")
def added_amounts(spark, d):
    """Sums of amounts; none where currencies differ."""
    x = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), V.added(x, F.lit(5).cast("bigint"), F.lit("USD"), F.when(F.col("l_linenumber") % 2 == 0, "USD").otherwise("EUR")).alias("total"))


@query("select l_orderkey id, l_linenumber line, (l_linenumber + 2.0) * 3 - l_quantity::double % 4 as value from lineitem")
def calculated_values(spark, d):
    """Values of expressions as text."""
    x = F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(" + 2) * 3 - "), F.col("l_quantity").cast("int").cast("string"), F.lit(" % 4"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), udfs.calculated(x).alias("value"))


@query("select user_id, (epoch_us(ts) // 1000) / 1000.0 as seconds, count(*) n from events group by all")
def id_times(spark, d):
    """Sortable ids made of events, and the times read from them again."""
    made = table(spark, d, "events").select("user_id", V.sortable_id("run", F.col("ts"), F.col("user_id") % 4096, F.col("user_id")).alias("key"))
    return made.filter(V.is_sortable_id("key")).groupBy("user_id", V.id_seconds("key").alias("seconds")).agg(F.count("*").alias("n"))


@query("select user_id, count(*) filter (where ts + interval '36 hours' <= timestamp '2024-01-15 00:00:00') expired, count(*) n from events group by 1")
def expired_events(spark, d):
    late = V.expired("ts", 36, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(late).alias("expired"), F.count("*").alias("n"))


# Tasks: a supplier waits for those with a half and a third of its number


def tasks(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    needs = F.filter(F.array((k / 2).cast("int"), (k / 3).cast("int")), lambda x: (x >= 0) & (x < k))
    status = F.when(k % 5 == 0, "done").when(k % 5 == 1, "running").otherwise("pending")
    name = lambda x: F.concat(F.lit("t"), x.cast("string"))
    return table(spark, d, "supplier").select(name(k).alias("task_id"), F.transform(needs, name).alias("depends_on"), status.alias("status"), k.cast("long").alias("position"))


_TASKS = "t as (select s_suppkey k, case when s_suppkey % 5 = 0 then 'done' when s_suppkey % 5 = 1 then 'running' else 'pending' end status from supplier), e as (select distinct t.k, n.k needs, n.status from t, unnest([t.k // 2, t.k // 3]) u(x) join t n on n.k = u.x and n.k < t.k)"


@query(f"with {_TASKS} select 't' || k task_id, k::bigint as position from t where status = 'pending' and k not in (select k from e where status <> 'done')")
def ready_tasks(spark, d):
    return graph.ready(tasks(spark, d))


@query(f"with {_TASKS} select 't' || t.k task_id, count(e.k) dependents from t left join e on e.needs = t.k group by 1")
def task_dependents(spark, d):
    return graph.dependents(tasks(spark, d))


@query(f"with {_TASKS} select count(*) tasks, count_if(status = 'done') done, count_if(status = 'pending') pending from t")
def task_progress(spark, d):
    return graph.progress(tasks(spark, d))


@query(f"with recursive {_TASKS}, l(k, level) as (select k, 0 from t where k not in (select k from e) union select e.k, l.level + 1 from l join e on e.needs = l.k) select 't' || k task_id, max(level)::int as level from l group by 1")
def task_levels(spark, d):
    return graph.levels(tasks(spark, d))


@query()
def task_order(spark, d):
    return graph.ordered(tasks(spark, d))
