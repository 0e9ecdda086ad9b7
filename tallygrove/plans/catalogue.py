"""Queries over the driver's tables, one or more per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phonetic
from ..functions import records as D
from ..functions import text as T
from ..operators import activity, cards, mentions, places
from ..operators import resolve as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[f"q_{f.__name__}"] = sql
        return f

    return add


GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda k: {0}[k:k+2]))"
SIM = "len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))"
PART = "part as (select p_partkey rid, p_type, p_size, lower(p_name) nm from part)"
PAIRS = f"""firsts as (select p_type, p_size, nm, min(rid) rid, {GRAMS.format("nm")} g from part group by all),
pairs as (select a.rid rid_i, b.rid rid_j, a.nm name_i, b.nm name_j, a.g ga, b.g gb from firsts a join firsts b
 on a.p_type = b.p_type and a.p_size = b.p_size and a.rid < b.rid),
edges as (select rid_i, rid_j, name_i, name_j, round({SIM}, 4) similarity from pairs where {SIM} >= 0.6)"""


def parts(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("rid"), "p_type", "p_size", T.normalize_name("p_name").alias("nm"))


def part_edges(t) -> DataFrame:
    return R.blocked_pairs(parts(t), ["p_type", "p_size"], "nm", "rid", 0.6)


@query(f"with {PART}, {PAIRS} select * from edges")
def block_fuzzy_selfjoin(t):
    return part_edges(t).withColumn("similarity", F.round("similarity", 4))


@query(f"""with {PART}, {PAIRS}, ranked as (select *, row_number() over (partition by least(name_i, name_j), greatest(name_i, name_j) order by similarity desc, rid_i, rid_j) r from edges)
select rid_i, rid_j, name_i, name_j, similarity from ranked where r = 1 and similarity < 0.92""")  # fmt: skip
def review_pairs_dedup(t):
    pairs = part_edges(t).withColumn("similarity", F.round("similarity", 4))
    pairs = pairs.withColumns({"lo": F.least("name_i", "name_j"), "hi": F.greatest("name_i", "name_j")})
    return R.first_k(pairs, ["lo", "hi"], [F.desc("similarity"), "rid_i", "rid_j"], 1).where("similarity < 0.92").drop("lo", "hi")


def part_clusters(t) -> DataFrame:
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    edges = t("part").select(F.col("p_partkey").alias("rid_i"), F.lead("p_partkey").over(w).alias("rid_j")).where("rid_j is not null")
    return R.clusters(t("part"), "p_partkey", edges)


@query("select p_partkey, min(p_partkey) over (partition by p_name) as cluster, count(*) over (partition by p_name) as size, count(*) over (partition by p_name) = 1 as singleton from part")
def clusters(t):
    size = F.count("*").over(Window.partitionBy("cluster"))
    return part_clusters(t).select("p_partkey", "cluster", size.alias("size"), (size == 1).alias("singleton"))


@query("""select min(p_partkey) as cluster, arg_min(p_brand, p_partkey) as brand, string_agg(distinct p_type, ' | ' order by p_type) as types, count(*) as n
from part group by p_name""")  # fmt: skip
def cluster_rollup(t):
    return part_clusters(t).groupBy("cluster").agg(
        F.min_by("p_brand", "p_partkey").alias("brand"), F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("types"), F.count("*").alias("n")
    )


@query(r"select doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s׳'']+', ' ', 'g'), '\s+', ' ', 'g')) as cleaned from documents")
def clean_text(t):
    return t("documents").select("doc_id", T.clean_text("text").alias("cleaned"))


@query(r"""with c as (select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s׳'']+', ' ', 'g'), '\s+', ' ', 'g')) x from part)
select p_partkey, replace(replace(x, '׳', ''), '''', '') as match_key, array_to_string(list_filter(string_split(x, ' '), lambda w: w <> ''), '/') as tokens from c""")  # fmt: skip
def match_key_tokens(t):
    return t("part").select("p_partkey", T.match_key("p_name").alias("match_key"), F.array_join(T.tokens("p_name"), "/").alias("tokens"))


@query()
def normalize_name(t):
    return t("documents").select("doc_id", T.normalize_name("text").alias("folded"), T.normalize_yiddish("text").alias("folded_yi"))


@query("""select s_suppkey, s_name as base, n_name as place from supplier join nation on s_nationkey = n_nationkey""")
def split_name_location(t):
    packed = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("s_name", F.lit(" ("), "n_name", F.lit(")")).alias("x"))
    base, place = T.split_place("x")
    return packed.select("s_suppkey", base.alias("base"), place.alias("place"))


@query("""select p_partkey, lower(p_name) as alias from part
union select p_partkey, regexp_replace(lower(p_name), ' [^ ]+$', '') from part where regexp_extract(lower(p_name), '[^ ]+$') in ('ring', 'bolt', 'gear') and p_name like '% %'""")  # fmt: skip
def aliases(t):
    return t("part").select("p_partkey", F.explode(T.aliases("p_name", articles=("the",), generic=("ring", "bolt", "gear"))).alias("alias"))


@query("""select event_id, case when lower(trim(event_type)) = 'error' then props else event_type end as best from events""")
def best_name(t):
    e = t("events").withColumn("kind", F.when(F.col("event_type") == "error", F.lit(" N/A ")).otherwise(F.col("event_type")))
    return e.select("event_id", T.best_name("kind", "props").alias("best"))


@query("select c_custkey, concat_ws(' · ', n_name, r_name) as place from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def location_summary(t):
    joined = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.withColumn("again", F.col("n_name")).select("c_custkey", T.summary("n_name", "r_name", "again").alias("place"))


@query("select p_partkey from part p where exists (select 1 from part q where q.p_size <= 5 and lower(q.p_name) = lower(p.p_name))")
def db_membership(t):
    known = t("part").where("p_size <= 5").select(T.match_key("p_name").alias("key"))
    return t("part").withColumn("key", T.match_key("p_name")).join(known, "key", "left_semi").select("p_partkey")


@query("select p_partkey from part p where not exists (select 1 from part q where q.p_size <= 5 and q.p_partkey % 3 = 0 and lower(q.p_name) = lower(p.p_name))")
def not_in_db(t):
    known = t("part").where("p_size <= 5 and p_partkey % 3 = 0").select(T.match_key("p_name").alias("key"))
    return t("part").withColumn("key", T.match_key("p_name")).join(known, "key", "left_anti").select("p_partkey")


@query(f"""with a as (select lower(p_name) n, min(p_partkey) id, {GRAMS.format("lower(p_name)")} g from part where p_size <= 10 group by all),
n as (select lower(p_name) n, {GRAMS.format("lower(p_name)")} g from part group by all),
s as (select n.n a, a.id, case when n.n = a.n then 1.0 else (len(list_intersect(n.g, a.g)) / (len(n.g) + len(a.g) - len(list_intersect(n.g, a.g)))) end score from n, a),
r as (select p_partkey, id, score, row_number() over (partition by p_partkey order by score desc, id) k from part join s on lower(p_name) = a where score >= 0.6)
select p_partkey, id as authority, round(score, 4) as score, case when score = 1 then 'exact' else 'fuzzy' end as method from r where k <= 5""")  # fmt: skip
def topk_candidates(t):
    rows = t("part").select("p_partkey", T.normalize_name("p_name").alias("nm"))
    authority = t("part").where("p_size <= 10").select(T.normalize_name("p_name").alias("nm"), "p_partkey").groupBy("nm").agg(F.min("p_partkey").alias("id"))
    got = R.ranked_candidates(rows, authority, "nm", "p_partkey", "nm", "id")
    return got.select(F.col("rid").alias("p_partkey"), F.col("a_id").alias("authority"), F.round("score", 4).alias("score"), F.when(F.col("score") == 1, "exact").otherwise("fuzzy").alias("method"))


@query("""with c as (select user_id, event_type, count(*) n, min(event_id) f from events group by all)
select user_id, event_type as canonical from (select *, row_number() over (partition by user_id order by n desc, f) r from c) where r = 1""")  # fmt: skip
def canonical_mode(t):
    return R.mode_first_seen(t("events"), "user_id", "event_type", "event_id").select("user_id", F.col("event_type").alias("canonical"))


@query("""select o_orderkey, case when o_custkey % 7 = 0 then 'invalid' when c_custkey is null then 'not_found' end as reason, c_name from
(select *, case when o_custkey % 5 = 0 then -o_custkey else o_custkey end k from orders) left join customer on c_custkey = k""")  # fmt: skip
def authority_left_join_reason(t):
    rows = t("orders").withColumn("k", F.when(F.col("o_custkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    reasons = [(F.col("o_custkey") % 7 == 0, "invalid"), (F.col("c_custkey").isNull(), "not_found")]
    return R.keep_unresolved(rows, t("customer"), F.col("c_custkey") == F.col("k"), reasons).select("o_orderkey", "reason", "c_name")


@query("select c_custkey, coalesce(string_agg(distinct o_orderpriority, ' | ' order by o_orderpriority), '') as linked, count(o_orderkey) as mentions from customer left join orders on o_custkey = c_custkey group by c_custkey")
def authority_linked_ids(t):
    linked = t("orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " | ").alias("linked"), F.count("*").alias("mentions"))
    joined = t("customer").join(linked, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("linked", F.lit("")).alias("linked"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("""select s_suppkey, count(*) as mentions, count(distinct o_orderstatus) as n_places, count(distinct o_orderstatus) >= 3 as generic
from supplier join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey group by s_suppkey""")  # fmt: skip
def cards_rollup(t):
    hop = t("lineitem").select("l_suppkey", "l_orderkey").join(t("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    cards = hop.groupBy("l_suppkey").agg(F.count("*").alias("mentions"), F.countDistinct("o_orderstatus").alias("n_places"))
    return cards.select(F.col("l_suppkey").alias("s_suppkey"), "mentions", "n_places", (F.col("n_places") >= 3).alias("generic"))


@query("""select p.p_partkey, coalesce(a.p_brand, b.brand, '') as decision from part p
left join (select p_partkey, p_name, p_brand from part where p_partkey % 3 = 0) a on a.p_partkey = p.p_partkey and a.p_name = p.p_name
left join (select p_name, max_by(p_brand, p_partkey) brand from part where p_partkey % 3 = 0 group by p_name) b on b.p_name = p.p_name""")  # fmt: skip
def preserve_decisions(t):
    old = t("part").where("p_partkey % 3 = 0")
    by_id = old.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("kn"), F.col("p_brand").alias("d1"))
    by_name = old.groupBy(F.col("p_name").alias("n")).agg(F.max_by("p_brand", "p_partkey").alias("d2"))
    p = t("part").join(by_id, (F.col("p_partkey") == F.col("k")) & (F.col("p_name") == F.col("kn")), "left").join(by_name, F.col("p_name") == F.col("n"), "left")
    return p.select("p_partkey", F.coalesce("d1", "d2", F.lit("")).alias("decision"))


@query("select event_id, 'Q' || cast(user_id as varchar) || '|Q' || cast(event_id as varchar) as ids from events where user_id <> event_id union all select event_id, 'Q' || cast(event_id as varchar) from events where user_id = event_id")
def extract_qids(t):
    packed = F.concat(F.lit("q00"), F.col("user_id"), F.lit(" ; Q"), F.col("event_id"), F.lit(", x|Q"), F.col("user_id"))
    return t("events").select("event_id", F.array_join(T.qids(packed), "|").alias("ids"))


@query("""select o_orderkey, 'place' as role, o_orderstatus as qid from orders union all select o_orderkey, 'province', o_orderpriority from orders
union all select o_orderkey, 'country', 'Q' || cast(o_custkey as varchar) from orders""")  # fmt: skip
def explode_places(t):
    roles = {"place": F.col("o_orderstatus"), "province": F.col("o_orderpriority"), "country": F.concat(F.lit("Q"), F.col("o_custkey"))}
    return t("orders").select("o_orderkey", F.inline(F.array(*[F.struct(F.lit(k).alias("role"), c.cast("string").alias("qid")) for k, c in roles.items()])))


@query("""select p_partkey, case when lower(p_type) like '%steel%' then 'settlement' when lower(p_name) like '%ring%' then 'country' else 'other' end as category,
case when lower(p_type) like '%steel%' then p_name else '' end as settlement, case when lower(p_type) not like '%steel%' and lower(p_name) like '%ring%' then p_name else '' end as country from part""")  # fmt: skip
def classify_onehot(t):
    category = R.rules([(F.lower("p_type").contains("steel"), "settlement"), (F.lower("p_name").contains("ring"), "country")], "other")
    hot = lambda k: F.when(F.col("category") == k, F.col("p_name")).otherwise(F.lit("")).alias(k)
    return t("part").withColumn("category", category).select("p_partkey", "category", hot("settlement"), hot("country"))


@query("""with recursive e as (select c_custkey node, c_custkey // 3 parent from customer where c_custkey // 3 > 0),
a as (select node, parent ancestor, 1 d from e union all select a.node, e.parent, d + 1 from a join e on a.ancestor = e.node where d < 6)
select distinct node, ancestor from a""")  # fmt: skip
def bounded_ancestors(t):
    return R.ancestors(t("customer").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("parent")).where("parent > 0"))


@query("""with recursive e as (select c_custkey node, c_custkey // 3 parent from customer where c_custkey // 3 > 0),
a as (select c_custkey node, c_custkey ancestor, 0 d from customer union all select a.node, e.parent, d + 1 from a join e on a.ancestor = e.node where d < 6)
select node, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as countries from a join customer on c_custkey = ancestor group by node""")  # fmt: skip
def country_candidates(t):
    c = t("customer")
    up = R.ancestors(c.select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("parent")).where("parent > 0"))
    every = up.unionByName(c.select(F.col("c_custkey").alias("node"), F.col("c_custkey").alias("ancestor"))).distinct()
    got = every.join(c, F.col("c_custkey") == F.col("ancestor")).groupBy("node")
    return got.agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("countries"))


@query("""with g as (select *, bool_or(l_returnflag = 'R') over w r, bool_or(l_linestatus = 'O') over w o from lineitem window w as (partition by l_orderkey))
select l_orderkey, l_linenumber, concat_ws(';', case when l_quantity > 45 then 'large' end, case when r and o then 'mixed_group' end, case when l_returnflag = 'R' then 'returned' end) as review_flags,
(l_quantity > 45 or (r and o) or l_returnflag = 'R') as needs_review from g""")  # fmt: skip
def group_flags(t):
    w = Window.partitionBy("l_orderkey")
    mixed = F.bool_or(F.col("l_returnflag") == "R").over(w) & F.bool_or(F.col("l_linestatus") == "O").over(w)
    found = t("lineitem").select("l_orderkey", "l_linenumber", R.flags(large=F.col("l_quantity") > 45, returned=F.col("l_returnflag") == "R", mixed_group=mixed).alias("review_flags"))
    return found.withColumn("needs_review", F.col("review_flags") != "")


@query("""select o_orderkey, case when o_orderstatus = '' then o_orderpriority else o_orderstatus end as death, case when o_custkey % 4 = 0 then o_orderstatus else o_orderpriority end as burial,
o_custkey % 4 <> 0 and o_orderstatus <> o_orderpriority as conflict, case when o_custkey % 4 = 0 then 'mirrored' else '' end as stamp from orders""")  # fmt: skip
def mirror_pair(t):
    o = t("orders").withColumn("burial", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")))
    blank = (F.col("burial") == "") != (F.col("o_orderstatus") == "")
    death = F.when(F.col("o_orderstatus") == "", F.col("burial")).otherwise(F.col("o_orderstatus"))
    burial = F.when(F.col("burial") == "", F.col("o_orderstatus")).otherwise(F.col("burial"))
    conflict = ~blank & (F.col("burial") != F.col("o_orderstatus"))
    return o.select("o_orderkey", death.alias("death"), burial.alias("burial"), conflict.alias("conflict"), F.when(blank, "mirrored").otherwise("").alias("stamp"))


@query("""select a.o_orderkey, case when o_custkey % 3 = 0 then coalesce(s, '') else o_orderstatus end as o_orderstatus, o_custkey % 3 <> 0 and s is not null and s <> o_orderstatus as conflict
from orders a left join (select o_orderkey k, o_orderpriority s from orders where o_orderkey % 2 = 0) b on a.o_orderkey = k
union all select -o_orderkey - 1, o_orderpriority, false from orders where o_orderkey % 10 = 0""")  # fmt: skip
def upsert(t):
    old = t("orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    new = t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("o_orderstatus"))
    new = new.unionByName(t("orders").where("o_orderkey % 10 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderpriority").alias("o_orderstatus")))
    return R.upsert(old, new, "o_orderkey", "o_orderstatus")


@query("""select l_orderkey, l_linenumber, case when l_quantity > 48 then 'flagged' else 'context' end as row_type from lineitem
where l_orderkey in (select l_orderkey from lineitem where l_quantity > 48)""")  # fmt: skip
def context_rows(t):
    return R.with_siblings(t("lineitem"), ["l_orderkey"], F.col("l_quantity") > 48).select("l_orderkey", "l_linenumber", "row_type")


@query(r"""select p_partkey, count(*) over (partition by lower(p_name)) > 1 as flag_duplicate_exact, length(p_name) <= 9 as flag_very_short, regexp_matches(p_brand, '[^\p{L}\p{N}_\s-]') as flag_suspicious from part""")
def audit_flags(t):
    twin = F.count("*").over(Window.partitionBy(F.lower(T.squeeze(F.col("p_name"))))) > 1
    return t("part").select("p_partkey", twin.alias("flag_duplicate_exact"), (F.length("p_name") <= 9).alias("flag_very_short"), F.col("p_brand").rlike(r"[^\p{L}\p{N}_\s-]").alias("flag_suspicious"))


@query("select p_partkey, p_name, '' as wikidata_type, false as needs_review from part")
def conform_schema(t):
    return R.conform(t("part"), {"p_partkey": ("bigint", 0), "p_name": ("string", ""), "wikidata_type": ("string", ""), "needs_review": ("boolean", False)})


@query("""with s as (select doc_id, case when quality is null then 'unlabelled' when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end stratum from documents left join labels using (doc_id))
select doc_id, stratum from (select *, row_number() over (partition by stratum order by md5(cast(doc_id as varchar)), doc_id) r from s)
where r <= case stratum when 'toxic' then 12 when 'good' then 18 when 'poor' then 5 else 0 end""")  # fmt: skip
def stratified_sample(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    stratum = R.rules([(F.col("quality").isNull(), "unlabelled"), (F.col("toxic") == 1, "toxic"), (F.col("quality") == 1, "good")], "poor")
    order = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return R.stratified(rows.withColumn("stratum", stratum), "stratum", {"toxic": 12, "good": 18, "poor": 5}, order).select("doc_id", "stratum")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where r <= 4")
def first_k_samples(t):
    return R.first_k(t("events"), ["user_id"], ["ts", "event_id"], 4).select("event_id", "user_id")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r <= 3")
def first_k_by_2keys(t):
    return R.first_k(t("events"), ["user_id", "event_type"], ["ts", "event_id"], 3).select("event_id", "user_id", "event_type")


@query("select p_partkey, p_type from part order by case when p_size = 1 then 0 else 99 end, p_retailprice desc, p_partkey limit 50 offset 50")
def custom_sort_page(t):
    order = [F.when(F.col("p_size") == 1, 0).otherwise(99), F.desc("p_retailprice"), F.col("p_partkey")]
    return t("part").orderBy(*order).offset(50).limit(50).select("p_partkey", "p_type")


@query("select event_type, count(*) as n, count(*) filter (value > 50) as n_large from events group by event_type")
def facets(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"))


@query("""select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as view, count(*) as total from events group by user_id""")
def activity_totals(t):
    kinds = {k: F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view")}
    return t("events").groupBy("user_id").agg(*kinds.values(), F.count("*").alias("total"))


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def activity_by_day(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("select event_id from events order by ts desc, event_id desc limit 50")
def recent_feed(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def decision_latest_wins(t):
    return R.latest(t("events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""select case when c_custkey % 10 = 1 and c_custkey > 1 then c_custkey - 1 else c_custkey end as survivor, count(*) as n, string_agg(distinct c_mktsegment, ' | ' order by c_mktsegment) as segments
from customer group by 1""")  # fmt: skip
def identity_merge(t):
    losers = t("customer").where("c_custkey % 10 = 1 and c_custkey > 1").select(F.col("c_custkey").alias("loser"), (F.col("c_custkey") - 1).alias("survivor"))
    got = R.merge_identities(t("customer"), losers, "c_custkey").groupBy("survivor")
    return got.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " | ").alias("segments"))


@query("select p_partkey, p_brand || ' | ' || p_type as packed, 2 as n from part where p_brand <> p_type")
def pipe_pack_unpack(t):
    parts_ = T.cells(F.concat_ws("|", F.lit(" "), "p_brand", F.concat(F.lit("  "), F.col("p_type"))))
    return t("part").select("p_partkey", F.array_join(parts_, " | ").alias("packed"), F.size(parts_).alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def locations_json(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select p_partkey from part where contains(lower(p_name), 'ring') order by p_partkey limit 20")
def search_contains(t):
    return t("part").where(T.normalize_name("p_name").contains("ring")).orderBy("p_partkey").limit(20).select("p_partkey")


@query("select coalesce(max(o_orderkey) + 1, 464) as next_id from orders")
def next_id(t):
    return t("orders").agg(F.coalesce(F.max("o_orderkey") + 1, F.lit(464)).alias("next_id"))


@query()
def ratio_udf(t):
    names = t("part").select(F.lower("p_name").alias("a"), "p_type", "p_size").distinct()
    pairs = R.ratio_join(names, names.withColumnRenamed("a", "b"), "a", "b", 0.8, ["p_type", "p_size"])
    return pairs.where("a < b").select("a", "b", F.round("ratio", 4).alias("ratio")).distinct()


# Records, classifiers, corrections, cards.


@query("""with f as (select o_orderkey, o_custkey c, min(o_orderkey) over (partition by o_custkey, o_orderstatus) f from orders),
r as (select *, dense_rank() over (partition by c order by f) k from f)
select o_orderkey, case when max(k) over (partition by c) > 1 then c || '_S' || lpad(cast(k as varchar), 2, '0') else cast(c as varchar) end as new_cluster from r""")  # fmt: skip
def location_split(t):
    split = R.location_split(t("orders"), "o_orderkey", "o_custkey", F.lit(False), ["o_orderstatus"])
    return split.select("o_orderkey", "new_cluster")



def part_mentions(t) -> DataFrame:
    """Parts as mentions: names of four kinds, some without a title."""
    return t("part").select(
        "p_partkey", F.lit("factory").alias("org_type"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_brand"))).alias("title"),
        F.when(F.col("p_size") % 4 == 0, F.col("p_type")).otherwise("").alias("clustered"), F.when(F.col("p_size") % 5 == 0, "the theatre").otherwise(F.col("p_type")).alias("descriptive"),
        F.lit("").alias("settlement"), F.when(F.col("p_size") % 2 == 0, "hall").otherwise("").alias("venue"),
    )


LADDER = """with x as (select p_partkey, p_size % 3 = 0 untitled, p_size % 4 = 0 clu, p_size % 5 = 0 the, p_size % 2 = 0 ven, regexp_matches(p_name, '^[a-z]+ [a-z]+') person, lower(p_type) ty from part),
y as (select *, case when untitled then 2 else 0 end + case when untitled and the then 3 else 0 end d,
case when clu and (the or false) then 2 else 0 end + case when not untitled and person then 2 else 0 end + case when ven then 1 else 0 end p from x),
z as (select p_partkey, case when d = 0 and p >= 4 then 'proper_name/high' when p = 0 and d >= 4 then 'descriptive_term/high' when p <= 1 and d >= 2 then 'descriptive_term/medium'
when d <= 1 and p >= 2 then 'proper_name/medium' else 'ambiguous/low' end v from y)"""


def classified(t) -> DataFrame:
    return mentions.classify(part_mentions(t), t("nation").select("n_name"))


@query(LADDER + " select p_partkey, split_part(v, '/', 1) as name_type, split_part(v, '/', 2) as confidence from z")
def classify_ladder(t):
    return classified(t).select("p_partkey", "name_type", "confidence")


@query(LADDER + """ select split_part(v, '/', 1) as name_type, count(*) filter (v like '%/high') as high, count(*) filter (v like '%/medium') as medium, count(*) filter (v like '%/low') as low from z group by 1""")
def classify_crosstab(t):
    return mentions.crosstab(classified(t))


@query("""select o.o_orderkey, case when o.o_orderkey % 4 = 0 then 'missing' when o.o_custkey % 3 = 0 then 'repaired' else 'unchanged' end as drift,
case when o.o_orderkey % 4 = 0 or o.o_custkey % 3 = 0 then '' else 'ALIGN' end as decision from orders o""")  # fmt: skip
def drift_repair(t):
    old = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), F.lit("ALIGN").alias("decision"))
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat("o_orderpriority", F.lit(" x"))).otherwise(F.concat(F.lit("  "), F.upper("o_orderpriority")))
    now = t("orders").where("o_orderkey % 4 <> 0").select("o_orderkey", name.alias("name"))
    return R.drift_repair(old, now, "o_orderkey", ["name"], ["name"], ["decision"]).select("o_orderkey", "drift", "decision")


@query("""with k as (select unnest(['city in Poland', 'urban district', 'concentration camp', 'sovereign state', 'former county', 'mountain', 'Jewish cemetery', 'township']) w, unnest(range(8)) i)
select p_partkey, case i when 0 then 'settlement' when 1 then 'neighborhood' when 2 then 'death_site' when 3 then 'country' when 4 then 'province' when 5 then 'other' when 6 then 'cemetery' else 'settlement' end as category
from part join k on i = p_size % 8""")  # fmt: skip
def classify_substring_rules(t):
    kinds = ["city in Poland", "urban district", "concentration camp", "sovereign state", "former county", "mountain", "Jewish cemetery", "township"]
    label = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_size") % 8).cast("int"))
    return t("part").select("p_partkey", places.category(places.type_text(F.array(label))).alias("category"))


def part_places(t) -> DataFrame:
    """Parts as place rows of three roles, with the columns that corrections need."""
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % len(xs)).cast("int"))
    kind = F.get(F.array(*[F.lit(x) for x in ("province", "country", "settlement", "other")]), (F.col("p_size") % 4).cast("int"))
    hot = [F.when(kind == c, F.col("p_name")).otherwise("").alias(c) for c in places.CATEGORIES]
    return t("part").select(
        "p_partkey", F.concat(F.lit("e"), F.expr("p_partkey div 3")).alias("entry_id"), F.lit("birth").alias("context"), pick("place", "province", "country").alias("source_role"), F.col("p_name").alias("source_value"),
        F.col("p_name").alias("clustered_value"), F.when(F.col("p_size") % 5 == 0, "Q1139315").when(F.col("p_size") % 5 == 1, "Q7835").otherwise(F.concat(F.lit("Q"), F.col("p_partkey"))).alias("qid"),
        F.lit("initial").alias("qid_source"), F.lit("").alias("wikidata_label_en"), kind.alias("resolved_category"), F.when(kind == "other", "peninsula").otherwise("").alias("other_type"),
        F.when(F.col("p_size") % 7 == 0, "state_to_city").otherwise("").alias("correction_applied"), (F.col("p_size") % 2 == 0).alias("needs_review"),
        F.when(F.col("p_size") % 6 == 0, "place_country_mismatch").otherwise("x").alias("review_flags"), *hot,
    )


PLACES = """with b as (select p_partkey id, 'e' || (p_partkey // 3) e, case p_partkey % 3 when 0 then 'place' when 1 then 'province' else 'country' end r, p_name n, p_size,
case when p_size % 5 = 0 then 'Q1139315' when p_size % 5 = 1 then 'Q7835' else 'Q' || p_partkey end q,
case p_size % 4 when 0 then 'province' when 1 then 'country' when 2 then 'settlement' else 'other' end k, p_size % 7 = 0 st from part)"""


@query(PLACES + """ select id as p_partkey, case when not st and r = 'province' and q = 'Q1139315' then 'Q7835' else q end as qid,
case when not st and ((r = 'province' and q = 'Q1139315') or q = 'Q7835') then 'province' else k end as category,
case when st then 'state_to_city' when r = 'province' and q = 'Q1139315' then 'qid_override' when q = 'Q7835' and k <> 'province' then 'category_override' else '' end as stamp from b""")  # fmt: skip
def qid_override(t):
    entities = t("part").sparkSession.createDataFrame([("Q7835", "Crimea", ["peninsula"])], "qid string, label_en string, p31_labels array<string>")
    got = places.override(part_places(t), entities)
    return got.select("p_partkey", "qid", F.col("resolved_category").alias("category"), F.col("correction_applied").alias("stamp"))


@query(PLACES + """, m as (select *, case when st then null when r = 'place' and k = 'province' then 'province' when r in ('place', 'province') and k = 'country' then 'country'
when r = 'country' and k in ('province', 'settlement') then k when r = 'country' and k = 'other' then 'other' end x from b)
select id as p_partkey, coalesce(x, r) as source_role, case when x is not null then 'moved_to_' || x when st then 'state_to_city' else '' end as stamp from m""")  # fmt: skip
def role_reassign(t):
    got = places.reassign_role(part_places(t), F.lit(False))
    return got.select("p_partkey", "source_role", F.col("correction_applied").alias("stamp"))


@query(PLACES + """, a as (select e, min(id) anchor from b where p_size % 6 = 0 group by e)
select id as anchor, 'flagged' as row_type, e as entry_id, n as source_value, 'https://www.wikidata.org/wiki/' || q as wikidata_url from b where p_size % 2 = 0
union all select anchor, 'context', '', n, 'https://www.wikidata.org/wiki/' || q from b s join a using (e)
where not exists (select 1 from b z where z.p_size % 2 = 0 and z.e = s.e and z.r = s.r and z.n = s.n and z.q = s.q)""")  # fmt: skip
def reviewer_rows(t):
    return places.reviewer_rows(part_places(t), "p_partkey").select("anchor", "row_type", "entry_id", "source_value", "wikidata_url")


@query(PLACES + " select id as p_partkey, 'pending' as review_status, k as resolved_category from b where p_size % 2 = 0")
def review_queue(t):
    return part_places(t).where("needs_review").select("p_partkey", F.lit("pending").alias("review_status"), "resolved_category")


def order_cards(t) -> DataFrame:
    parts = cards.by_place(t("orders"), "o_custkey", "o_orderstatus", "o_orderpriority", ["o_orderpriority"])
    parts = parts.withColumnsRenamed({"o_custkey": "db_id", "settlement": "place"})
    return cards.explode(t("customer").select(F.col("c_custkey").alias("db_id"), "c_name", F.lit("").alias("place"), F.lit(0).cast("long").alias("mentions")), parts, "db_id", [F.desc("mentions"), "place"])


CARDS = """with g as (select o_custkey c, case when trim(o_orderstatus) = '' then o_orderpriority else o_orderstatus end place, count(*) n from orders group by all),
k as (select *, row_number() over (partition by c order by n desc, place) - 1 i from g),
x as (select cast(c_custkey as varchar) db_id, c_name, '' place, 0 mentions, '' parent_db_id, c_custkey in (select c from g) is_exploded from customer
union all select c || '_X' || lpad(cast(i as varchar), 2, '0'), c_name, place, n, cast(c as varchar), false from k join customer on c = c_custkey)"""


@query(CARDS + " select * from x")
def explode_card(t):
    return order_cards(t)


@query(CARDS + """ select * replace (is_exploded and not (try_cast(db_id as bigint) is not null and try_cast(db_id as bigint) % 2 = 0) as is_exploded) from x
where parent_db_id = '' or cast(parent_db_id as bigint) % 2 <> 0""")  # fmt: skip
def unexplode(t):
    return cards.unexplode(order_cards(t), t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("db_id")), "db_id")


@query("""select o_custkey, o_orderkey, row_number() over w as position, count(*) over (partition by o_custkey) as total, coalesce(lag(o_orderkey) over w, -1) as previous, coalesce(lead(o_orderkey) over w, -1) as next
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")  # fmt: skip
def navigation(t):
    return cards.neighbours(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").na.fill(-1)


@query("""select l_orderkey * 10 + l_linenumber as pair, l_partkey as cluster, l_suppkey as other from lineitem union all select l_orderkey * 10 + l_linenumber, l_suppkey, l_partkey from lineitem""")
def pair_index(t):
    pairs = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), "l_partkey", "l_suppkey")
    return cards.pair_index(pairs, "l_partkey", "l_suppkey", "pair")


@query("""with a as (select p_partkey id, lower(p_name) x from part union select p_partkey, regexp_replace(lower(p_name), ' [^ ]+$', '') from part where regexp_extract(lower(p_name), '[^ ]+$') in ('ring', 'bolt', 'gear')),
b as (select distinct x from a join part on id = p_partkey where p_size <= 5) select distinct id as p_partkey from a join b using (x)""")  # fmt: skip
def alias_equijoin(t):
    generic = ("ring", "bolt", "gear")
    a = t("part").select("p_partkey", "p_size", F.explode(T.aliases("p_name", articles=("the",), generic=generic)).alias("alias"))
    return a.join(a.where("p_size <= 5").select("alias").distinct(), "alias").select("p_partkey").distinct()


@query("select count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (trim(coalesce(o_orderstatus, '')) = '') as undecided, count(*) as total from orders")
def status_counts(t):
    s = F.col("o_orderstatus")
    return t("orders").agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(F.trim(T.text(s)) == "").alias("undecided"), F.count("*").alias("total"))


@query("""select e.event_id, case when user_id % 2 = 0 then 'https://www.wikidata.org/wiki/Q' || user_id else 'x' end as url, event_type || '/' || user_id as latin, cast(user_id as bigint) as number, 'b-c' as xml_id, 'Main & Elm, ' || event_type as street from events e""")
def record_fields(t):
    e = t("events").withColumn("cell", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" Q"), F.col("user_id"))).otherwise("x"))
    query_, _ = D.street_query(F.lit("Main and Elm"), "event_type")
    latin = F.concat(D.latin_words(F.concat(F.col("event_type"), F.lit(" שלום 12"))), F.lit("/"), F.col("user_id"))
    return e.select("event_id", D.entity_url("cell").alias("url"), latin.alias("latin"), D.authority_number(F.concat(F.col("user_id"), F.lit(" | x"))).alias("number"), D.xml_id(F.lit("a-b-c")).alias("xml_id"), query_.alias("street"))


@query()
def phonetic_codes(t):
    names = t("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return names.select("word", F.array_join(phonetic.codes(F.col("word")), "|").alias("codes"))


@query()
def signal_candidates(t):
    rows = t("part").select("p_partkey", T.normalize_yiddish("p_name").alias("nm"))
    authority = t("part").where("p_size <= 10").select(T.normalize_yiddish("p_name").alias("nm"), "p_partkey").groupBy("nm").agg(F.min("p_partkey").alias("id"))
    return R.signal_candidates(rows, authority, "nm", "p_partkey", "nm", "id", generic=("ring", "bolt", "gear"))


@query()
def fuzzy_membership(t):
    known = t("part").where("p_size <= 5").select(T.match_key("p_name").alias("known")).distinct()
    keys = t("part").select(T.match_key("p_name").alias("key")).distinct()
    return R.ratio_join(known, keys, "known", "key", 0.8).withColumn("ratio", F.round("ratio", 4))


# Decisions of people.

STAMPED = """with f as (select case event_type when 'click' then 'Pairs' else 'Cards' end as source, 'r' || user_id % 4 as reviewer, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, strftime(ts, '%Y-%m-%d') as day,
case when event_type = 'click' then 'c' || event_id when event_id % 2 = 0 then 'd' || event_id else 'p' || event_id end as id, case event_type when 'click' then 'MERGE' else 'name ' || user_id end as label,
case event_type when 'click' then 'MERGE' else '' end as decision from events where event_type in ('click', 'view') and user_id % 4 <> 3)"""


def stamped(t) -> DataFrame:
    e = t("events").withColumns({
        "reviewer": F.when(F.col("user_id") % 4 == 3, "  ").otherwise(F.concat(F.lit(" r"), F.col("user_id") % 4)),
        "reviewed_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    })
    pairs = e.where("event_type = 'click'").select("reviewer", "reviewed_at", F.concat(F.lit("c"), "event_id").alias("cluster_id"), F.lit("MERGE").alias("decision"))
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("d"), "event_id")).otherwise(" ")
    cards_ = e.where("event_type = 'view'").select("reviewer", "reviewed_at", own.alias("db_id"), F.concat(F.lit("p"), "event_id").alias("pair_id"), F.concat(F.lit("name "), "user_id").alias("name"))
    return activity.feed({"Pairs": pairs, "Cards": cards_, "Unstamped": t("part")})


@query(STAMPED + " select * from f")
def activity_feed(t):
    return stamped(t)


@query(STAMPED + " select reviewer, count(*) as total, count(*) filter (source = 'Pairs') as \"Pairs\", count(*) filter (source = 'Cards') as \"Cards\" from f where reviewer in ('r0', 'r1') and day >= '2024-01-10' group by reviewer")
def activity_by_reviewer(t):
    return activity.totals(activity.visible(stamped(t), ["r0", "r1"], ["Pairs", "Cards"], "2024-01-10"), ["Pairs", "Cards"])


@query(STAMPED + " select day, count(*) as total, count(*) filter (reviewer = 'r0') as r0, count(*) filter (reviewer = 'r2') as r2 from f group by day")
def activity_day_pivot(t):
    return activity.by_day(stamped(t), ["r0", "r2"])


@query("""with g as (select unnest(list_filter([case when l_quantity > 45 then 'large' end, case when l_discount > 0.05 then 'cheap' end, case when l_returnflag = 'R' then 'returned' end, l_linestatus], lambda x: x is not null)) as flag from lineitem)
select flag, count(*) as n from g group by flag order by n desc, flag limit 3""")  # fmt: skip
def top_review_flags(t):
    flag = F.concat_ws("; ", F.when(F.col("l_quantity") > 45, "large"), F.when(F.col("l_discount") > 0.05, "cheap"), F.when(F.col("l_returnflag") == "R", "returned"), F.lit(""), "l_linestatus")
    return activity.top_flags(t("lineitem").select(flag.alias("review_flags")), k=3)


@query("select coalesce(max(o_orderkey) filter (o_orderkey % 2 = 0), 0) as highest from orders")
def highest_pair_id(t):
    kinds = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("P"), "o_orderkey")).otherwise(F.concat(F.lit("PAIR-"), "o_orderkey"))
    return activity.highest_pair(t("orders").select(kinds.alias("pair_id")), "pair_id")


@query("select w.id, count(o_custkey) as n from (select unnest(['1', '2', '4', '-7']) as id) w left join orders on cast(o_custkey as varchar) = w.id group by w.id")
def alignment_references(t):
    return activity.references(t("orders"), "o_custkey", ["1", "2", "4", "-7"])
