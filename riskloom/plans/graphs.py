"""Queries of the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .adapters import Tables
from .registry import query


@query("graph_edges", "select distinct user_id as src, dst, rel_type from (select user_id, device_id as dst, 'USES' as rel_type from v_features union all select user_id, email_domain, 'HAS_EMAIL_DOMAIN' from v_features union all select user_id, cast(country_key as string), 'REGISTERED_FROM' from v_features) where dst is not null")
def _(t: Tables) -> DataFrame:
    return G.entity_edges(t("v_features"), "user_id", {"device_id": "USES", "email_domain": "HAS_EMAIL_DOMAIN", "country_key": "REGISTERED_FROM"})


@query("distinct_edges", "select distinct src, dst, rel_type, transaction_id from (select transaction_id, user_id as src, cast(transaction_id as string) as dst, 'MADE' as rel_type from v_txn union all select transaction_id, cast(transaction_id as string), merchant_category, 'AT' from v_txn union all select transaction_id, user_id, device_id, 'USES' from v_txn)")
def _(t: Tables) -> DataFrame:
    return G.transaction_edges(t("v_txn"), {"MADE": ("user_id", "transaction_id"), "AT": ("transaction_id", "merchant_category"), "USES": ("user_id", "device_id")})


@query("phone_email_edges", "select dst, count(*) as accounts, round(max(risk_score), 4) as top_risk from (select distinct concat('A', substr(user_id, 2)) as account_id, email_domain as dst from v_features where email_domain is not null) e join v_accounts using (account_id) group by 1")
def _(t: Tables) -> DataFrame:
    e = G.entity_edges(t("v_features"), "user_id", {"email_domain": "HAS_EMAIL"}).withColumn("account_id", F.concat(F.lit("A"), F.expr("substring(src, 2)")))
    return e.join(t("v_accounts"), "account_id").groupBy("dst").agg(F.count("*").alias("accounts"), F.round(F.max("risk_score"), 4).alias("top_risk"))


@query("edges_merged", "select src, dst, rel_type, min(created_at) as created_at from (select src, dst, rel_type, us as created_at from v_transfers) group by 1, 2, 3")
def _(t: Tables) -> DataFrame:
    e = t("v_transfers").select("src", "dst", "rel_type", F.col("us").alias("created_at"), "transaction_id")
    return G.merge_edges(e.where("transaction_id % 20 = 0").drop("transaction_id"), e.where("transaction_id % 20 <> 0").drop("transaction_id"))


@query("graph_counts", "select rel_type as kind, count(*) as n from (select rel_type from v_entity_edges union all select rel_type from v_ip_edges union all select rel_type from v_transfers) group by 1 union all select 'Account', count(*) from v_accounts")
def _(t: Tables) -> DataFrame:
    kinds = [t(v).select("rel_type") for v in ("v_entity_edges", "v_ip_edges", "v_transfers")]
    edges = kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n"))
    return edges.unionAll(t("v_accounts").select(F.lit("Account").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")))


OTHERS = "select e.src, e.rel_type, count(distinct o.src) as others from ({e}) e left join ({e}) o on e.dst = o.dst and e.src <> o.src group by 1, 2"


@query("shared_entities", OTHERS.format(e="from v_entity_edges"))
def _(t: Tables) -> DataFrame:
    return G.degree_others(t("v_entity_edges"))


@query("entity_other_accounts", OTHERS.format(e="select user_id as src, email_domain as dst, 'M' as rel_type from v_features where email_domain is not null"))
def _(t: Tables) -> DataFrame:
    return G.degree_others(G.entity_edges(t("v_features"), "user_id", {"email_domain": "M"}))


@query("pipeline_graph_score", f"with d as ({OTHERS.format(e='from v_entity_edges')}) select src, round(least(1, 0.4 * others / 10), 6) as score from d")
def _(t: Tables) -> DataFrame:
    return G.degree_others(t("v_entity_edges")).select("src", F.round(G.pipeline_score(F.col("others"), F.lit(0)), 6).alias("score"))


@query("account_history", "select user_id, count(*) as total, sum(is_fraud) as fraud, round(avg(is_fraud), 6) as fraud_rate from v_txn group by 1")
def _(t: Tables) -> DataFrame:
    return G.account_history(t("v_txn")).withColumn("fraud_rate", F.round("fraud_rate", 6))


@query("account_velocity", "select user_id, count(*) as n, round(sum(amount), 4) as amount from v_txn where us > (select max(us) from v_txn) - 172800000000 group by 1")
def _(t: Tables) -> DataFrame:
    rows = t("v_txn")
    return G.account_velocity(rows, rows.agg(F.max("us")).first()[0], 48).withColumn("amount", F.round("amount", 4))


def _entity_sql(view: str) -> str:
    return f"with f as (select account_id as src, (fraud_transaction_count > 0)::int as bad from v_accounts), e as (select src, dst, bad from {view} join f using (src)) select src, dst, count(*) over (partition by dst) - 1 as others, cast(sum(bad) over (partition by dst) - bad as bigint) as fraud_others from e"


@query("device_accounts", _entity_sql("v_entity_edges"))
def _(t: Tables) -> DataFrame:
    return G.others_on_entity(t("v_entity_edges"), t("v_accounts"))


@query("shared_ip", _entity_sql("v_ip_edges"))
def _(t: Tables) -> DataFrame:
    return G.others_on_entity(t("v_ip_edges"), t("v_accounts"))


@query("network_links", "with b as (select src, dst from v_transfers union all select dst, src from v_transfers) select src as account_id, count(*) as links, cast(sum((coalesce(fraud_transaction_count, 0) > 0)::int) as bigint) as fraud_links from b left join v_accounts on dst = account_id group by 1")
def _(t: Tables) -> DataFrame:
    return G.network_links(t("v_transfers"), t("v_accounts"))


@query("mule_depth")
def _(t: Tables) -> DataFrame:
    return G.mule_depth(t("v_transfers"), t("v_accounts")).select("account_id", "depth", "endpoint", "flagged")


#: The report of hops is for the riskiest accounts.
SEEDS_SQL = "select account_id from v_accounts order by risk_score desc, account_id limit 5"


@query(
    "mule_hops",
    f"""with recursive e as (select src, dst, transaction_id, amount from v_transfers), z as ({SEEDS_SQL}), w as (
  select account_id, src as from_account, dst as to_account, amount, [transaction_id] as edges, 1 as hop from e join z on src = account_id
  union all select w.account_id, e.src, e.dst, e.amount, list_append(w.edges, e.transaction_id), w.hop + 1 from w join e on w.to_account = e.src where w.hop < 5 and not list_contains(w.edges, e.transaction_id))
select distinct account_id, from_account, to_account, amount, hop, edges[-1] as transaction_id from w""",
)
def _(t: Tables) -> DataFrame:
    seeds = t("v_accounts").orderBy(F.desc("risk_score"), "account_id").limit(5)
    return G.trail_hops(t("v_transfers"), seeds, 5).select("account_id", "from_account", "to_account", "amount", "hop", "transaction_id")


def _graph_risk(t: Tables) -> DataFrame:
    a = t("v_accounts")
    most = lambda v, x, y: G.others_on_entity(t(v), a).groupBy(F.col("src").alias("account_id")).agg(F.max("others").alias(x), F.max("fraud_others").alias(y))
    rows = a.join(most("v_entity_edges", "devices", "device_fraud"), "account_id", "left").join(most("v_ip_edges", "ips", "ip_fraud"), "account_id", "left")
    rows = rows.join(G.network_links(t("v_transfers"), a), "account_id", "left").join(G.mule_depth(t("v_transfers"), a).select("account_id", "depth"), "account_id", "left")
    rows = rows.join(_rings(t).groupBy("account_id").agg(F.min("ring_id").alias("ring_id")), "account_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    score = G.graph_risk_score(F.col("ring_id").isNotNull(), n("devices"), n("device_fraud"), n("depth"), n("ips"), n("ip_fraud"), n("fraud_links"))
    return rows.select("account_id", n("depth").alias("depth"), n("fraud_links").alias("fraud_links"), F.col("ring_id").isNotNull().alias("in_ring"), score.alias("graph_risk"))


#: A few walks of each account and length show how deep its trails go: no account here runs
#: out of all of them before one that it leaves out would have gone further.
DEPTH_SQL = """e as (select src, dst, transaction_id from v_transfers), w1 as (select src as account_id, dst as pos, [transaction_id] as edges from e qualify row_number() over (partition by src order by transaction_id) <= 200), """ + ", ".join(
    f"w{k} as materialized (select account_id, e.dst as pos, list_append(edges, transaction_id) as edges from w{k - 1} join e on pos = e.src where not list_contains(edges, transaction_id) qualify row_number() over (partition by account_id order by hash(edges, transaction_id)) <= 200)" for k in range(2, 6)
) + ", h as (select account_id, max(depth) as depth from (" + " union all ".join(f"select account_id, {k} as depth from w{k}" for k in range(1, 6)) + ") group by 1)"


@query(
    "graph_risk",
    f"""with f as (select account_id as src, (fraud_transaction_count > 0)::int as bad from v_accounts),
d as (select src, max(others) as devices, max(fb) as device_fraud from (select src, count(*) over (partition by dst) - 1 as others, sum(bad) over (partition by dst) - bad as fb from v_entity_edges join f using (src)) group by 1),
i as (select src, max(others) as ips, max(fb) as ip_fraud from (select src, count(*) over (partition by dst) - 1 as others, sum(bad) over (partition by dst) - bad as fb from v_ip_edges join f using (src)) group by 1),
b as (select src, dst from v_transfers union all select dst, src from v_transfers), n as (select b.src, cast(sum(bad) as bigint) as fraud_links from b join f on f.src = b.dst group by 1), {DEPTH_SQL},
k as (select a.account_id, coalesce(depth, 0) as depth, coalesce(fraud_links, 0) as fraud_links, risk_score >= 0.02 as in_ring, devices, device_fraud, ips, ip_fraud from v_accounts a left join d on d.src = a.account_id left join i on i.src = a.account_id left join n on n.src = a.account_id left join h on h.account_id = a.account_id)
select account_id, depth, fraud_links, in_ring, round(least(1, (case when in_ring then 0.4 else 0 end) + (case when coalesce(device_fraud, 0) > 0 then 0.25 * least(devices / 10, 1) else 0 end) + 0.2 * least(depth / 5, 1) + (case when coalesce(ip_fraud, 0) > 0 then 0.1 * least(ips / 10, 1) else 0 end) + 0.05 * least(fraud_links / 5, 1)), 4) as graph_risk from k""",
)
def _(t: Tables) -> DataFrame:
    return _graph_risk(t)


@query("high_risk_accounts", "select account_id, risk_score from v_accounts where risk_score >= 0.7 order by risk_score desc, account_id limit 100")
def _(t: Tables) -> DataFrame:
    return t("v_accounts").where("risk_score >= 0.7").orderBy(F.desc("risk_score"), "account_id").limit(100).select("account_id", "risk_score")


@query("risk_bands", "select case when risk_score >= 0.7 then 'high' when risk_score >= 0.3 then 'medium' else 'low' end as band, count(*) as n, round(avg(risk_score), 6) as mean_risk from v_accounts group by 1")
def _(t: Tables) -> DataFrame:
    r = F.col("risk_score")
    return t("v_accounts").groupBy(F.when(r >= 0.7, "high").when(r >= 0.3, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean_risk"))


@query("risk_updated", "select account_id, case when total_transactions % 2 = 0 then least(greatest(risk_score * 3 - 0.2, 0), 1) else risk_score end as risk_score from (select account_id, total_transactions, risk_score from v_accounts)")
def _(t: Tables) -> DataFrame:
    a = t("v_accounts")
    return G.update_risk(a, a.where("total_transactions % 2 = 0").select("account_id", (F.col("risk_score") * 3 - 0.2).alias("new_risk"))).select("account_id", "risk_score")


def _rings(t: Tables) -> DataFrame:
    return t("v_accounts").where("risk_score >= 0.02").select("account_id", F.concat(F.lit("R"), F.col("country").cast("string")).alias("ring_id"))


@query("ring_members", "select account_id, min(ring_id) as ring_id from (select account_id, concat('R', cast(country as string)) as ring_id from v_accounts where risk_score >= 0.02) group by 1")
def _(t: Tables) -> DataFrame:
    return _rings(t).groupBy("account_id").agg(F.min("ring_id").alias("ring_id"))


@query("ring_member_counts", "select n_nationkey as country, count(account_id) as members from nation left join (select * from v_accounts where risk_score >= 0.02) on country = n_nationkey group by 1")
def _(t: Tables) -> DataFrame:
    kept = t("v_accounts").where("risk_score >= 0.02")
    return t("nation").join(kept, F.col("n_nationkey") == F.col("country"), "left").groupBy(F.col("n_nationkey").alias("country")).agg(F.count("account_id").alias("members"))


@query("ring_summary", "select count(*) as rings, round(avg(n), 4) as mean_size, max(n) as largest, cast(sum(n) as bigint) as members from (select country, count(*) as n from v_accounts where risk_score >= 0.02 group by 1)")
def _(t: Tables) -> DataFrame:
    n = F.col("n")
    return _rings(t).groupBy("ring_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("rings"), F.round(F.avg(n), 4).alias("mean_size"), F.max(n).alias("largest"), F.sum(n).alias("members"))


GROUPS_SQL = "select grp, count(*) as size, cast(sum((fraud_transaction_count > 0)::int) as bigint) as fraud_members, round(avg(risk_score), 10) as mean_risk from (select distinct dst as grp, src as account_id from {v}) join v_accounts using (account_id) group by 1 having count(*) >= {n}"


@query("device_communities", GROUPS_SQL.format(v="v_entity_edges", n=3))
def _(t: Tables) -> DataFrame:
    return G.group_risk(G.device_groups(t("v_entity_edges")), t("v_accounts"), "group", 3).withColumnRenamed("group", "grp").withColumn("mean_risk", F.round("mean_risk", 10))


@query("ip_groups", GROUPS_SQL.format(v="v_ip_edges", n=2))
def _(t: Tables) -> DataFrame:
    return G.group_risk(G.device_groups(t("v_ip_edges"), 2), t("v_accounts"), "group", 2).withColumnRenamed("group", "grp").withColumn("mean_risk", F.round("mean_risk", 10))


@query("community_scores", f"with g as ({GROUPS_SQL.format(v='v_entity_edges', n=3)}) select grp, size, round(fraud_members / size, 4) as fraud_rate, round(fraud_members / size, 4) >= 0.3 or round(mean_risk, 4) > 0.5 as suspicious, case when round(fraud_members / size, 4) >= 0.3 then 'fraud rate' when round(mean_risk, 4) > 0.5 then 'mean risk' end as reason from g")
def _(t: Tables) -> DataFrame:
    return G.community_scores(G.group_risk(G.device_groups(t("v_entity_edges")), t("v_accounts"), "group", 3)).select(F.col("group").alias("grp"), "size", "fraud_rate", "suspicious", "reason")


COMPONENTS_SQL = """with recursive b as (select src, dst from v_transfers union select dst, src from v_transfers), r(id, top) as (
  select account_id, account_id from v_accounts union select r.id, b.dst from r join b on r.top = b.src), c as (select id as account_id, min(top) as component_id from r group by 1)"""


@query("components", COMPONENTS_SQL + " select account_id, component_id from c")
def _(t: Tables) -> DataFrame:
    return G.components(t("v_transfers"), t("v_accounts"))


@query("in_degree_hubs", "select account_id, count(src) as score from v_accounts left join v_transfers on account_id = dst group by 1 having count(src) >= 1 order by score desc, account_id limit 50")
def _(t: Tables) -> DataFrame:
    return G.hubs(G.in_degree(t("v_transfers"), t("v_accounts")), 50)


def _ranks_sql(rounds: int) -> str:
    steps = ["o as (select src, count(*) as n from v_transfers group by 1)", "r0 as (select account_id, 0.15::double as s from v_accounts)"]
    for k in range(1, rounds + 1):
        steps.append(f"g{k} as materialized (select dst, sum(s / n) as got from v_transfers join r{k - 1} on src = account_id join o using (src) group by 1), r{k} as materialized (select account_id, 0.15 + 0.85 * coalesce(got, 0) as s from v_accounts left join g{k} on dst = account_id)")
    return "with " + ", ".join(steps)


@query("pagerank", _ranks_sql(20) + " select account_id, round(s, 9) as score from r20")
def _(t: Tables) -> DataFrame:
    return G.pagerank(t("v_transfers"), t("v_accounts")).withColumn("score", F.round("score", 9))


SIMILAR_SQL = "with e as (select distinct src as a, dst from v_entity_edges), d as (select a, count(*) as n from e group by 1), p as (select x.a, y.a as b, count(*) as shared from e x join e y using (dst) where x.a < y.a group by 1, 2)"


@query("similar_accounts", SIMILAR_SQL + " select p.a, p.b, round(shared / (d.n + f.n - shared), 3) as similarity from p join d on d.a = p.a join d f on f.a = p.b where round(shared / (d.n + f.n - shared), 3) >= 0.1")
def _(t: Tables) -> DataFrame:
    return G.similar_pairs(t("v_entity_edges"), 0.0995).select("a", "b", F.round("similarity", 3).alias("similarity")).where("similarity >= 0.1")


@query("neighbour_set_sizes", SIMILAR_SQL + " select p.a, p.b, shared, d.n + f.n - shared as either from p join d on d.a = p.a join d f on f.a = p.b")
def _(t: Tables) -> DataFrame:
    return G.similar_accounts(t("v_entity_edges")).select("a", "b", "shared", (F.col("size_a") + F.col("size_b") - F.col("shared")).alias("either"))


ALL_EDGES = "select src, dst, rel_type from v_entity_edges union all select src, dst, rel_type from v_ip_edges union all select src, dst, rel_type from v_transfers"


def _all_edges(t: Tables) -> DataFrame:
    kinds = [t(v).select("src", "dst", "rel_type") for v in ("v_entity_edges", "v_ip_edges", "v_transfers")]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2])


@query(
    "most_similar_accounts",
    """with e as (select distinct src as a, dst from (""" + ALL_EDGES + """)), d as (select a, count(*) as n from e group by 1),
p as (select x.a, y.a as b, count(*) as shared from e x join e y using (dst) where x.a <> y.a group by 1, 2),
s as (select p.a as account_id, p.b as other, shared, shared / (d.n + f.n - shared) as similarity from p join d on d.a = p.a join d f on f.a = p.b)
select account_id, other, shared, round(similarity, 3) as similarity from s where similarity >= 0.05 qualify row_number() over (partition by account_id order by similarity desc, other) <= 10""",
)
def _(t: Tables) -> DataFrame:
    """Over all kinds of edges. The default threshold of 0.5 leaves no pair in these tables."""
    return G.most_similar(_all_edges(t), 0.05)


def _path_sql(edges: str, hops: int = 6) -> str:
    """Breadth first, a table for each level: the smallest path to each node that is new there."""
    steps = [f"v as ({edges})", "b as materialized (select src, dst, min(rel_type) as rel from (select src, dst, rel_type from v where src <> dst union all select dst, src, rel_type from v where src <> dst) group by 1, 2)", "s as (select min(account_id) as a, max(account_id) as z from v_accounts)", "f0 as materialized (select a as pos, a as path, '' as types from s)"]
    for k in range(1, hops + 1):
        seen = " union all ".join(f"select pos from f{j}" for j in range(k))
        steps.append(f"f{k} as materialized (select dst as pos, min(path || '|' || dst) as path, arg_min(types || case when types = '' then '' else '|' end || rel, path || '|' || dst) as types from f{k - 1} join b on pos = src where dst not in ({seen}) and (select z from s) not in ({seen}) group by 1)")
    hits = " union all ".join(f"select {k} as length, path, types from f{k} where pos = (select z from s)" for k in range(1, hops + 1))
    return "with " + ", ".join(steps) + f", h as ({hits}) select a as source, z as target, exists (from h) as connected, coalesce((select length from h), 0) as length, coalesce((select path from h), '') as path, coalesce((select types from h), '') as types from s"


@query("shortest_path", _path_sql("select src, dst, rel_type from v_transfers"))
def _(t: Tables) -> DataFrame:
    a, z = t("v_accounts").agg(F.min("account_id"), F.max("account_id")).first()
    return G.shortest_path(t("v_transfers"), a, z, 6).select("source", "target", "connected", "length", F.array_join("nodes", "|").alias("path"), F.array_join("types", "|").alias("types"))


@query("shortest_path_any", _path_sql(ALL_EDGES))
def _(t: Tables) -> DataFrame:
    a, z = t("v_accounts").agg(F.min("account_id"), F.max("account_id")).first()
    return G.shortest_path(_all_edges(t), a, z, 6).select("source", "target", "connected", "length", F.array_join("nodes", "|").alias("path"), F.array_join("types", "|").alias("types"))


RANKS = _ranks_sql(20)[5:]


@query(
    "ring_sweep",
    f"""{COMPONENTS_SQL}, {RANKS}, k as (select component_id, count(*) as size, sum((fraud_transaction_count > 0)::int) as bad from c join v_accounts using (account_id) group by 1 having count(*) >= 2),
g as ({GROUPS_SQL.format(v='v_entity_edges', n=3)}), x as (select grp, size, round(fraud_members / size, 4) as rate from g where round(fraud_members / size, 4) >= 0.3 or round(mean_risk, 4) > 0.5),
t10 as (from x order by size desc, grp limit 10), hub as (select account_id, s from r20 where s >= 1 order by round(s, 9) desc, account_id limit 50)
select (select count(*) from g) as communities, (select count(*) from x) as suspicious, (select coalesce(string_agg(grp, ',' order by size desc, grp), '') from t10) as top_suspicious, (select count(*) from hub) as hubs,
(select coalesce(string_agg(account_id, ',' order by round(s, 9) desc, account_id), '') from hub) as hub_accounts, (select count(*) from k) as components, (select count(*) from k where bad / size >= 0.3) as risky_components""",
)
def _(t: Tables) -> DataFrame:
    a = t("v_accounts")
    return G.ring_sweep(
        G.community_scores(G.group_risk(G.device_groups(t("v_entity_edges")), a, "group", 3)),
        G.pagerank(t("v_transfers"), a).withColumn("score", F.round("score", 9)),
        G.group_risk(G.components(t("v_transfers"), a), a, "component_id", 2),
    )


FLAGGED_SQL = "select account_id from v_accounts where risk_score >= 0.05"


@query(
    "ring_flagged",
    f"""with f as ({FLAGGED_SQL}), r as (select 'R' || country as ring_id, count(*) as size from v_accounts where risk_score >= 0.02 group by 1)
select ring_id, size, 0.5::double as confidence, 0::bigint as at_full_risk from r where ring_id <> 'R3' union all select 'R3', (select count(*) from f), 0.9, (select count(*) from f join v_accounts using (account_id))""",
)
def _(t: Tables) -> DataFrame:
    """Flag a known ring again: its row is replaced, its members are added, their risk is 1."""
    a, members = t("v_accounts"), _rings(t)
    rings = members.groupBy("ring_id").agg(F.count("*").alias("size")).withColumn("confidence", F.lit(0.5))
    new_rings, new_members, changes = G.flag_ring(rings, members, "R3", a.where("risk_score >= 0.05").select("account_id"), 0.9)
    full = G.update_risk(a, changes).where("risk_score = 1").join(new_members.where("ring_id = 'R3'"), "account_id").groupBy("ring_id").agg(F.count("*").alias("at_full_risk"))
    return new_rings.join(full, "ring_id", "left").select("ring_id", "size", "confidence", F.coalesce("at_full_risk", F.lit(0)).alias("at_full_risk"))


@query("modularity_communities")
def _(t: Tables) -> DataFrame:
    return G.modularity_communities(_all_edges(t), t("v_accounts"))


@query(
    "modularity_of_placements",
    """with e as (select a.country as x, b.country as y, t.src, t.dst from v_transfers t join v_accounts a on a.account_id = t.src join v_accounts b on b.account_id = t.dst),
k as (select c, count(*) as k from (select x as c from e union all select y from e) group by 1), n as (select c, count(*) as k from (select src as c from e union all select dst from e) group by 1)
select round((select avg((x = y)::int) from e) - (select sum(k * k) / pow(sum(k), 2) from k), 9) as by_country, round(-(select sum(k * k) / pow(sum(k), 2) from n), 9) as alone""",
)
def _(t: Tables) -> DataFrame:
    """The modularity of two given placements of the accounts: by country, and each by itself."""
    e, a = t("v_transfers"), t("v_accounts")
    value = lambda c, name: G.modularity(e, a.select("account_id", F.col(c).alias("community"))).select(F.round("modularity", 9).alias(name))
    return value("country", "by_country").crossJoin(F.broadcast(value("account_id", "alone")))  # one row each
