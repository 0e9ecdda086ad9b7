"""Queries of merges, rewrites, numbers, audits and packed cells over the driver's tables, with their SQL; they join the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import decisions, identity, matching, merge, numbering, packed, places, views
from ..operators import resolve as R
from ..session import shared_dir
from ..sources import versions
from .catalogue import GRAMS, query

# Identity merges: suppliers 1 to 3 of each five go into the next, in chains of up to three, the last into each fifth.

CARDS = """cards as (select s_suppkey k, cast(s_suppkey as varchar) db_id, s_name, s_acctbal, n_name, least(s_suppkey - s_suppkey % 5 + 4, (select max(s_suppkey) from supplier)) as g, s_suppkey % 5 between 1 and 4 as moved
from supplier join nation on s_nationkey = n_nationkey), ended as (select *, case when moved then cast(g as varchar) else db_id end as survivor from cards)"""


def merged(t) -> dict[str, DataFrame]:
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    key, blank = F.col("s_suppkey").cast("string"), F.lit("")
    cards = s.select(
        key.alias("db_id"), F.when(F.col("s_suppkey") % 5 == 0, (F.col("s_suppkey") + 2).cast("string")).otherwise(blank).alias("parent_db_id"),
        F.concat(F.lit("C"), key, F.lit("| N"), "s_nationkey").alias("linked_cluster_ids"), F.lit("").alias("confirmed_locations"),
        F.when(F.col("s_suppkey") % 3 == 0, blank).otherwise(F.col("n_name")).alias("confirmed_settlement"), *[blank.alias(c) for c in identity.COLUMNS[1:]],
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(blank).alias("reviewer_notes"), F.when(F.col("s_acctbal") < 0, "TRUE").otherwise("FALSE").alias("is_generic"),
        blank.alias("is_exploded"), blank.alias("reviewer"), blank.alias("reviewed_at"),
    )
    top = t("supplier").agg(F.max("s_suppkey").alias("top"))
    n = F.col("s_suppkey")
    merges = t("supplier").where(n % 5 % 4 > 0).crossJoin(F.broadcast(top)).where("s_suppkey < top").select(n.cast("string").alias("loser"), (n + 1).cast("string").alias("survivor"), n.alias("n"))
    alignment = t("part").select("p_partkey", (F.col("p_partkey") % 120).cast("string").alias("aligned_db_id"))
    return identity.merge_authorities(cards, alignment, cards.select("db_id", "linked_cluster_ids"), merges, "me", "now")


@query(f"""with {CARDS}, ids as (select survivor, id, max(k) as k, max(nat) as nat from (select survivor, 'C' || db_id id, k, 1 nat from ended union all select survivor, 'N' || s_nationkey, k, 0 from ended join supplier on s_suppkey = k) group by 1, 2),
linked as (select survivor, string_agg(id, '|' order by k desc, nat desc) linked_cluster_ids from ids group by survivor),
notes as (select survivor, string_agg(case when db_id = survivor then s_name else '[merged from db_id ' || db_id || '] ' || s_name end, chr(10) || '---' || chr(10) order by k desc) note from ended where k % 2 = 0 group by survivor),
towns as (select survivor, n_name, max(k) k from ended where k % 3 <> 0 group by 1, 2), located as (select survivor, arg_max(n_name, k) as town, count(*) as n from towns group by survivor),
flagged as (select survivor, bool_or(s_acctbal < 0) f, count(*) > 1 as hit from ended group by survivor)
select e.db_id, linked_cluster_ids, coalesce(note, '') as reviewer_notes, coalesce(town, '') as confirmed_settlement, case when hit then coalesce(n, 0) else 0 end as n_locations, case when f then 'TRUE' else 'FALSE' end as is_generic,
case when hit then 'me' else '' end as reviewer, coalesce(p.survivor, case when e.k % 5 = 0 then cast(e.k + 2 as varchar) else '' end) as parent_db_id
from ended e join linked using (survivor) left join notes using (survivor) left join located using (survivor) join flagged using (survivor) left join ended p on e.k % 5 = 0 and p.k = e.k + 2 where e.db_id = e.survivor""")  # fmt: skip
def identity_merge(t):
    got = merged(t)["cards"]
    n = F.coalesce(F.size(F.from_json("confirmed_locations", identity.LOCATIONS)), F.lit(0))
    ids = F.expr("linked_cluster_ids")
    # a card that took part has its ids trimmed; the others stay as they were written
    return got.select("db_id", F.regexp_replace(ids, r"\| N", "|N").alias("linked_cluster_ids"), "reviewer_notes", "confirmed_settlement", F.greatest(n, F.lit(0)).cast("long").alias("n_locations"), "is_generic", "reviewer", "parent_db_id")


@query(f"with {CARDS} select p_partkey, coalesce(survivor, cast(p_partkey % 120 as varchar)) as aligned_db_id, coalesce(survivor <> db_id, false) as repointed from part left join ended on k = p_partkey % 120")
def identity_repointed(t):
    return merged(t)["alignment"]


@query(f"with {CARDS} select db_id as loser, survivor, false as cyclic from ended where db_id <> survivor")
def identity_chains(t):
    return merged(t)["chains"].select("loser", "survivor", "cyclic")


# Live tables.


@query("""select s_suppkey, 'changed' as change, 's_name' as column, s_name as before, upper(s_name) as after from supplier where s_suppkey % 3 = 0 and upper(s_name) <> s_name
union all select s_suppkey, 'added', c.n, null, case c.n when 's_name' then s_name else cast(s_nationkey as varchar) end from supplier, (values ('s_name'), ('s_nationkey')) c(n) where s_suppkey % 3 = 1
union all select s_suppkey, 'removed', c.n, case c.n when 's_name' then s_name else cast(s_nationkey as varchar) end, null from supplier, (values ('s_name'), ('s_nationkey')) c(n) where s_suppkey % 3 = 2 and s_suppkey % 2 = 0""")  # fmt: skip
def versioned_changelog(t):
    s = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    spark, path = s.sparkSession, f"{shared_dir(s.sparkSession)}/{s.sparkSession.sparkContext.applicationId}/suppliers-{uuid.uuid4().hex}"
    versions.commit(s.where("s_suppkey % 3 <> 1"), path)
    versions.rewrite(spark, path, lambda d: d.where("s_suppkey % 3 = 0 or s_suppkey % 2 = 1").withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.upper("s_name")).otherwise(F.col("s_name"))))
    for _ in range(2):  # the second changes nothing
        versions.append(s.where("s_suppkey % 3 <> 2"), path, "s_suppkey", ["s_name"])
    return versions.changelog(versions.read_version(spark, path, 1), versions.read_version(spark, path), "s_suppkey")


# Numbers and ids.


@query("select p_partkey, printf('ORG-C%05d', dense_rank() over (order by f)) as cluster_id from (select p_partkey, min(p_partkey) over (partition by p_name) f from part)")
def cluster_ids(t):
    return numbering.cluster_ids(t("part"), "p_name", "p_partkey").select("p_partkey", "cluster_id")


@query("select o_orderkey, printf('PAIR-%05d', row_number() over (order by o_totalprice desc, o_custkey, o_orderkey)) as pair_id from orders")
def pair_ids(t):
    return numbering.pair_ids(t("orders"), "o_totalprice", ["o_custkey", "o_orderkey"]).select("o_orderkey", "pair_id")


@query("select s_suppkey, (row_number() over ()) - 1 as ordinal from supplier")
def file_ordinals(t):
    return numbering.with_ordinal(t("supplier")).select("s_suppkey", F.col("_rid").alias("ordinal"))


@query("""with pairs as (select a.c_custkey i, b.c_custkey j, a.c_custkey * 3 as n, case when a.c_custkey % 2 = 0 then 'P' || (a.c_custkey + 1) else 'PAIR-' || a.c_custkey end as pair_id from customer a join customer b on b.c_custkey = a.c_custkey + 1 where a.c_custkey % 3 < 2),
wanted as (select c_custkey + 1 as i, c_custkey as j, c_custkey as n from customer where c_custkey % 4 = 0 union all select c_custkey, c_custkey + 2, c_custkey from customer where c_custkey % 4 = 1),
top as (select max(i + 1) as top from pairs where i % 2 = 0),
new as (select w.*, row_number() over (order by w.n, least(w.i, w.j)) r from wanted w where not exists (select 1 from pairs p where least(p.i, p.j) = least(w.i, w.j) and greatest(p.i, p.j) = greatest(w.i, w.j)))
select pair_id, cast(i as varchar) as cluster_id_i, cast(j as varchar) as cluster_id_j, '0.9' as similarity, case when exists (select 1 from wanted w where least(p.i, p.j) = least(w.i, w.j) and greatest(p.i, p.j) = greatest(w.i, w.j)) then 'MERGE' else '' end as decision from pairs p
union all select 'P' || (top + r), cast(i as varchar), cast(j as varchar), '1.00', 'MERGE' from new, top""")  # fmt: skip
def merge_pairs(t):
    c = F.col("c_custkey")
    text = lambda x: x.cast("string")
    have = t("customer").select((c - 1).alias("c_custkey"))
    pairs = t("customer").where(c % 3 < 2).join(have, "c_custkey", "left_semi").select(
        F.when(c % 2 == 0, F.concat(F.lit("P"), c + 1)).otherwise(F.concat(F.lit("PAIR-"), c)).alias("pair_id"), text(c).alias("cluster_id_i"), text(c + 1).alias("cluster_id_j"),
        F.lit("0.9").alias("similarity"), *[F.lit("").alias(n) for n in ("decision", "reviewer_notes", "reviewer", "reviewed_at")],
    )
    wanted = t("customer").where(c % 4 == 0).select(text(c + 1).alias("cluster_id_i"), text(c).alias("cluster_id_j"), c.alias("n"))
    wanted = wanted.union(t("customer").where(c % 4 == 1).select(text(c), text(c + 2), c))
    return numbering.merge_pairs(pairs, wanted, ["n"], "together", "me", "now").select("pair_id", "cluster_id_i", "cluster_id_j", "similarity", "decision")


# Clusters with a conflict rule. The value that groups first is brand and name of every ninth part; places are the remainders of the key by four, blank for 0.

NAMED = f"""r as (select p_partkey rid, case when p_partkey % 9 = 0 then p_brand || p_name end v, p_type b, lower(p_name) nm, case when p_partkey % 4 = 0 then '' else cast(p_partkey % 4 as varchar) end pl from part),
g as (select *, coalesce(case when v is not null then min(rid) over (partition by v) end, rid) root from r),
f as (select * from g qualify row_number() over (partition by b, root order by rid) = 1),
n as (select nm, {GRAMS.format("nm")} g from (select distinct nm from f)), starts as (select b, min(rid) s from g group by b),
p as (select x.rid ri, y.rid rj, x.nm ni, y.nm nj, x.b, case when x.nm = y.nm then 1.0 else (len(list_intersect(c.g, d.g)) / (len(c.g) + len(d.g) - len(list_intersect(c.g, d.g)))) end sim, x.pl <> '' and y.pl <> '' and x.pl <> y.pl conflict
 from f x join f y on x.b = y.b and x.rid < y.rid join n c on c.nm = x.nm join n d on d.nm = y.nm),
e as (select ri a, rj z from p where sim >= 0.6 and not conflict union select rid, root from g where rid <> root),
q as (select ri, rj, ni, nj, round(sim, 4) sim, conflict from p join starts using (b) where (sim >= 0.4 and sim < 0.6) or (sim >= 0.6 and conflict)
 qualify row_number() over (partition by least(ni, nj), greatest(ni, nj) order by sim desc, s, ri, rj) = 1),
twoways as materialized (select a, z from e union select z, a from e)"""


def two_phase(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("rid"), F.when(k % 9 == 0, F.concat("p_brand", "p_name")).alias("v"), "p_type", F.lower("p_name").alias("nm"), F.when(k % 4 == 0, "").otherwise((k % 4).cast("string")).alias("pl"))
    return matching.two_phase(rows, "rid", "v", ["p_type"], "nm", "pl", 0.6, 0.4)


@query(f"with recursive {NAMED}, walk(rid, c) as (select rid, rid from g union select w.rid, z from walk w join twoways on a = w.c) select rid, min(c) as cluster from walk group by rid")
def conflict_clusters(t):
    return two_phase(t)[0].select("rid", "cluster")


@query(f"with {NAMED} select ri as rid_i, rj as rid_j, ni as name_i, nj as name_j, sim as similarity, conflict from q")
def conflict_pairs(t):
    return two_phase(t)[1].select("rid_i", "rid_j", "name_i", "name_j", F.round("similarity", 4).alias("similarity"), "conflict")


# The audit from rules, and its queue.

PLACE = "case when p_partkey % 10 = 0 then '' when p_partkey % 10 = 1 then ' ' || chr(160) || substr(p_name, 1, 2) || '  ' else replace(substr(p_name, 1, p_size), ' ', chr(9) || ' ') || case when p_partkey % 7 = 0 then '?' else '' end end"
AUDITED = rf"""a as (select p_partkey, trim(regexp_replace({PLACE}, '[\s\x{{a0}}]+', ' ', 'g')) n from part),
b as (select p_partkey, n as place_name_normalized, n = '' as flag_empty_place_name, count(*) over (partition by n) > 1 as flag_duplicate_exact, length(n) <= 2 as flag_very_short,
 regexp_matches(n, '[^\p{{L}}\p{{N}}_\s-]') as flag_suspicious_characters from a)"""
RULES = {"flags": {"suspicious_characters_regex": r"[^\w\s\-]"}, "required_columns": ["place", "p_partkey"]}


def audited(t) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    place = F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("  "), F.substring("p_name", 1, 2), F.lit("  ")))
    place = place.otherwise(F.concat(F.replace(F.substr(name, F.lit(1), F.col("p_size").cast("int")), F.lit(" "), F.lit("\t ")), F.when(k % 7 == 0, "?").otherwise("")))
    return A.audit(t("part").select("p_partkey", place.alias("place")), A.settings(RULES))


@query(f"with {AUDITED} select *, flag_empty_place_name or flag_duplicate_exact or flag_very_short or flag_suspicious_characters as needs_review from b")
def audit(t):
    return audited(t).drop("place", "place_name_original")


@query(f"with {AUDITED} select place_name_normalized, flag_empty_place_name, flag_duplicate_exact, flag_very_short, flag_suspicious_characters, 'pending' as review_status, '' as canonical_name, '' as review_notes, p_partkey, true as needs_review from b where flag_empty_place_name or flag_duplicate_exact or flag_very_short or flag_suspicious_characters")
def audit_queue(t):
    return A.review_queue(audited(t)).drop("place", "place_name_original")


# Packed cells.


@query("""with c as (select p_partkey, [cast(p_size * 3 as varchar), cast(p_size as varchar), 'x' || p_size] ids, case when p_partkey % 2 = 0 then ['0.9', '0.8'] else ['0.7'] end scores, case when p_partkey % 3 = 0 then [] else ['exact'] end methods from part),
e as (select p_partkey, unnest(range(0, 3)) as position, ids, scores, methods from c)
select p_partkey, position, ids[position + 1] as db_id, coalesce(scores[position + 1], '') as score, coalesce(methods[position + 1], '') as method, s_suppkey is not null as known, coalesce(s_name, '(missing)') as name, coalesce(cast(s_nationkey as varchar), '') as place
from e left join supplier on cast(s_suppkey as varchar) = ids[position + 1]""")  # fmt: skip
def candidate_cells(t):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    cells = {
        "ids": F.concat_ws(" | ", (F.col("p_size") * 3).cast("string"), size, F.concat(F.lit("x"), size)), "scores": F.when(k % 2 == 0, "0.9|0.8").otherwise("0.7"),
        "methods": F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise("exact|"),
    }
    rows = t("part").select("p_partkey", *[c.alias(n) for n, c in cells.items()])
    return packed.candidates(rows, "p_partkey", {"db_id": "ids", "score": "scores", "method": "methods"}, t("supplier"), "s_suppkey", {"name": "s_name", "place": "s_nationkey"})


@query("""select c, string_agg(p, ' | ' order by f) as seen from (select o_custkey c, o_orderpriority p, min(row(o_orderdate, o_orderkey)) f from orders group by 1, 2) group by c""")
def ordered_distinct(t):
    got = packed.ordered_distinct(t("orders"), ["o_custkey"], F.col("o_orderpriority"), ["o_orderdate", "o_orderkey"], "seen")
    return got.select(F.col("o_custkey").alias("c"), F.array_join("seen", " | ").alias("seen"))


# Samples and merges by rules for columns.

TARGETS = {"S1": 12, "S2": 18, "S3": None, "S4": 10, "S5": 15}
STRATUM = "case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then 'S1' when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' then 'S2' when o_orderkey % 400 = 7 then 'S3' when o_orderstatus = 'O' and o_custkey % 2 = 0 then 'S4' when o_orderstatus = 'O' then 'S5' end"


@query(f"""with d as (select o_orderkey, {STRATUM} s, md5('42:' || o_orderkey) h from orders),
k as (select o_orderkey, s, row_number() over (partition by s order by h, o_orderkey) r from d where s is not null),
t as (select o_orderkey, s from k where s = 'S3' or r <= case s when 'S1' then 12 when 'S2' then 18 when 'S4' then 10 when 'S5' then 15 end),
x as (select o_orderkey, 'S9' from d where o_orderkey not in (select o_orderkey from t) order by h, o_orderkey limit 15)
select o_orderkey, s as review_stratum from t union all select * from x""")  # fmt: skip
def stratified_with_rest(t):
    return R.sampled(t("orders"), "o_orderkey", F.expr(STRATUM), TARGETS, ("S9", 15)).select("o_orderkey", "review_stratum")


@query("""with o as (select c_custkey k, c_name as a, case when c_custkey % 3 = 0 then '' else c_mktsegment end as b, case when c_custkey % 4 = 0 then null else c_mktsegment end as d, c_mktsegment as e from customer where c_custkey % 5 > 0),
n as (select o_custkey k, arg_min(o_orderstatus, o_orderkey) a, arg_min(o_orderpriority, o_orderkey) filter (o_orderpriority <> '5-LOW') b, arg_min(o_orderstatus, o_orderkey) d, arg_min(o_orderpriority, o_orderkey) e from orders group by 1)
select k, o.a, case when o.b = '' then coalesce(n.b, '') else o.b end as b, coalesce(o.d, n.d) as d, coalesce(n.e, o.e) as e,
 concat_ws(';', case when o.b <> '' and o.b <> n.b then 'b:' || n.b end, case when o.d <> n.d then 'd:' || n.d end) as conflicts from o left join n using (k)
union all select k, a, b, d, e, '' from n where k not in (select k from o)""")  # fmt: skip
def merge_columns(t):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    old = t("customer").where(k % 5 > 0).select(k.alias("k"), F.col("c_name").alias("a"), F.when(k % 3 == 0, "").otherwise(seg).alias("b"), F.when(k % 4 > 0, seg).alias("d"), seg.alias("e"))
    p = F.col("o_orderpriority")
    new = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("a"), F.when(p == "5-LOW", " ").otherwise(p).alias("b"), F.col("o_orderstatus").alias("d"), p.alias("e"), "o_orderkey")
    return merge.merge_columns(old, new, "k", {"a": "keep", "b": "flag", "d": "flag", "e": "take"}, ["o_orderkey"])


PLACED = """pl as (select cast(c_custkey as varchar) entry_id, case when c_custkey % 3 = 0 then 'death' else 'burial' end context, case when c_custkey % 5 = 4 then 'province' else 'place' end source_role, c_name as source_value,
 case when c_custkey % 4 = 0 then 'Q' || c_nationkey else '' end qid, case when c_custkey % 7 = 0 then 'old' else '' end review_flags from customer where c_custkey % 2 = 0),
ce as (select cast(o_custkey as varchar) entry_id, o_orderkey o, 'grave ' || o_orderkey as nm, case when o_orderkey % 5 = 0 then '' else 'Q' || (o_custkey + o_orderkey % 3) % 25 end q, case when o_orderkey % 4 = 0 then 'prov' else '' end pr, case when o_orderkey % 6 = 0 then 'nan' else 'land' end co from orders where o_custkey % 11 = 0),
en as (select 'Q' || n_nationkey q, case when n_nationkey % 2 = 0 then n_name else '' end lab, case n_regionkey when 0 then 'cemetery' when 1 then 'city' else 'thing' end kind from nation where n_nationkey < 20),
fi as (select entry_id, arg_min(q, o) q, arg_min(nm, o) nm from ce where q <> '' group by 1), li as (select entry_id, q, min(o) o from ce where q <> '' group by 1, 2),
hit as (select pl.*, fi.q as fq, fi.nm as fnm, case when qid = '' then fi.q else qid end as held from pl left join fi on fi.entry_id = pl.entry_id and context = 'burial' and source_role = 'place'),
fl as (select h.entry_id, h.source_role, string_agg('ra_qid_conflict:' || l.q, ';' order by l.o) f from hit h join li l on l.entry_id = h.entry_id and l.q <> h.held where h.fq is not null group by 1, 2)"""


def placed(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    rows = t("customer").where(k % 2 == 0).select(
        k.cast("string").alias("entry_id"), F.when(k % 3 == 0, "death").otherwise("burial").alias("context"), F.when(k % 5 == 4, "province").otherwise("place").alias("source_role"),
        F.col("c_name").alias("source_value"), F.when(k % 4 == 0, F.concat(F.lit("Q"), "c_nationkey")).otherwise("").alias("qid"), F.when(k % 7 == 0, "old").otherwise("").alias("review_flags"),
    )
    sheet = t("orders").where("o_custkey % 11 = 0").select(
        F.col("o_custkey").cast("string").alias("unique-id"), F.concat(F.lit("grave "), o).alias("_ - burial_place - name"), F.when(o % 4 == 0, "prov").otherwise("").alias("_ - burial_place - province"),
        F.when(o % 6 == 0, "nan").otherwise("land").alias("_ - burial_place - country"), F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("http://x/entity/Q"), (F.col("o_custkey") + o % 3) % 25)).alias("wikidata"), "o_orderkey",
    )
    cemeteries = merge.cemetery_rows(sheet).join(sheet.select("o_orderkey", F.col("`_ - burial_place - name`").alias("cem_name")), "cem_name")
    n = F.col("n_nationkey")
    kind = F.when(F.col("n_regionkey") == 0, "cemetery").when(F.col("n_regionkey") == 1, "city").otherwise("thing")
    entities = t("nation").where(n < 20).select(F.concat(F.lit("Q"), n).alias("qid"), F.when(n % 2 == 0, F.col("n_name")).otherwise("").alias("label_en"), F.lit("").alias("label_yi"), F.array(kind).alias("p31_labels"))
    return places.unified(rows), cemeteries, entities


@query(f"""with {PLACED}
select h.entry_id, context, h.source_role, source_value, coalesce(held, '') as qid, case when qid = '' and fq is not null then 'ra_cemetery' else '' end as qid_source,
 case when qid = '' and fq is not null then coalesce(case kind when 'cemetery' then 'cemetery' when 'city' then 'settlement' when 'thing' then 'other' end, 'cemetery') else '' end as resolved_category,
 case when qid = '' and fq is not null and coalesce(kind, 'cemetery') = 'cemetery' then coalesce(nullif(lab, ''), fnm) else '' end as cemetery,
 concat_ws(';', nullif(review_flags, ''), f) as review_flags, f is not null as needs_review
from hit h left join fl on fl.entry_id = h.entry_id and fl.source_role = h.source_role left join en on en.q = fq
union all select ce.entry_id, 'burial', 'place', nm, ce.q, case when ce.q = '' then '' else 'ra_cemetery' end, coalesce(case kind when 'cemetery' then 'cemetery' when 'city' then 'settlement' when 'thing' then 'other' end, 'cemetery'),
 case when coalesce(kind, 'cemetery') = 'cemetery' then coalesce(nullif(lab, ''), nm) else '' end, '', false
from ce left join en on en.q = ce.q where not exists (select 1 from pl where pl.entry_id = ce.entry_id and context = 'burial' and source_role = 'place')
union all select entry_id, 'burial', r.r, case r.r when 'province' then pr else co end, '', '', '', '', '', false from ce, (values ('province'), ('country')) r(r)
where case r.r when 'province' then pr else co end not in ('', 'nan') and not exists (select 1 from pl where pl.entry_id = ce.entry_id and context = 'burial' and source_role = 'place')""")  # fmt: skip
def merge_cemeteries(t):
    got = merge.merge_cemeteries(*placed(t), ["o_orderkey"])
    return got.select("entry_id", "context", "source_role", "source_value", F.coalesce("qid", F.lit("")).alias("qid"), "qid_source", "resolved_category", "cemetery", "review_flags", "needs_review")


# What the place operators make, and the tables that older readers expect.


@query("""with o as (select o_orderkey, 'Q' || o_custkey a, case when o_orderkey % 3 = 0 then 'Q' || (o_custkey + 1) else '' end b, 'Q' || (o_orderkey % 7) p, case when o_orderkey % 2 = 0 then null else 'Q' || (o_orderkey % 5) end c from orders)
select o_orderkey, 'place' as source_role, a as qid, 'initial' as qid_source, b <> '' as place_qid_conflict from o where o_orderkey % 4 > 0
union all select o_orderkey, 'place', b, 'dodgy', false from o where o_orderkey % 4 = 0 and b <> ''
union all select o_orderkey, 'province', p, 'province', false from o union all select o_orderkey, 'country', c, 'country', false from o where c is not null""")  # fmt: skip
def places_exploded(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = lambda x: F.concat(F.lit(" q0"), x.cast("string"), F.lit("; "))
    rows = t("orders").select(
        k, F.when(k % 4 > 0, q(c)).otherwise("none").alias("initial"), F.when(k % 3 == 0, q(c + 1)).otherwise("").alias("dodgy"), q(k % 7).alias("province_qid"), F.when(k % 2 > 0, q(k % 5)).alias("country_qid"),
    )
    return places.explode_places(rows, ["o_orderkey"])


# Nations are countries Q0 to Q24 but those that divide by 6; customers are towns in them, each within the customer of a third of its number.
WORLD = """en as (select 'N' || n_nationkey q, [ 'N' || n_nationkey ] p17, []::varchar[] p131, case when n_nationkey % 6 = 0 then 'former thing' else 'sovereign state' end kind, case when n_nationkey % 2 = 0 then n_name else '' end label from nation
union all select 'C' || c_custkey, case when c_custkey % 4 = 0 then [] else [ 'N' || c_nationkey ] end, case when c_custkey < 3 then [] else [ 'C' || (c_custkey // 3) ] end, case c_custkey % 3 when 0 then 'town in the hills' when 1 then 'county' else 'hill' end, c_name from customer where c_custkey % 10 > 0)"""


def world(t) -> DataFrame:
    none, text = F.array().cast("array<string>"), lambda p, c: F.concat(F.lit(p), F.col(c) if isinstance(c, str) else c)
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    lands = t("nation").select(text("N", n).alias("qid"), F.array(text("N", n)).alias("p17"), none.alias("p131"), F.array(F.when(n % 6 == 0, "former thing").otherwise("sovereign state")).alias("p31_labels"), F.when(n % 2 == 0, F.col("n_name")).otherwise("").alias("label_en"))
    kind = F.when(c % 3 == 0, "town in the hills").when(c % 3 == 1, "county").otherwise("hill")
    towns = t("customer").where(c % 10 > 0).select(
        text("C", c).alias("qid"), F.when(c % 4 == 0, none).otherwise(F.array(text("N", "c_nationkey"))).alias("p17"), F.when(c < 3, none).otherwise(F.array(text("C", F.expr("c_custkey div 3")))).alias("p131"), F.array(kind).alias("p31_labels"), F.col("c_name").alias("label_en"),
    )
    return lands.unionByName(towns).withColumn("label_yi", F.lit(""))


STORIES = """st as (select o_custkey % 300 e, o_orderstatus ctx, case o_orderkey % 3 when 0 then 'place' when 1 then 'province' else 'country' end r, case when o_orderkey % 3 = 2 then 'N' || o_orderkey % 25 else 'C' || o_custkey end q, o_orderkey id, o_orderkey % 17 = 0 cf from orders)"""


def stories(t) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    role = F.when(k % 3 == 0, "place").when(k % 3 == 1, "province").otherwise("country")
    qid = F.when(k % 3 == 2, F.concat(F.lit("N"), k % 25)).otherwise(F.concat(F.lit("C"), c))
    return t("orders").select((c % 300).alias("entry_id"), F.col("o_orderstatus").alias("context"), role.alias("source_role"), qid.alias("qid"), k.alias("id"), (k % 17 == 0).alias("place_qid_conflict"), F.col("o_orderpriority").alias("clustered_value"))


KIND = "case when kind like '%town%' then 'settlement' when kind like '%state%' and kind like 'sov%' then 'country' when kind like '%county%' then 'province' when kind is null then 'other' else 'other' end"


@query(f"""with {WORLD}, {STORIES}
select id, coalesce(nullif(label, ''), o_orderpriority) as wikidata_label_en, coalesce(kind, '') as wikidata_type, {KIND} as resolved_category, case when {KIND} = 'other' then coalesce(kind, 'unknown') else '' end as other_type
from st left join en using (q) join orders on o_orderkey = id""")  # fmt: skip
def enrich(t):
    return places.enrich(stories(t), world(t)).select("id", "wikidata_label_en", "wikidata_type", "resolved_category", "other_type")


@query(f"""with recursive {WORLD}, {STORIES}, up(q, a, d) as (select q, unnest(p131), 1 from en union select up.q, unnest(en.p131), d + 1 from up join en on en.q = up.a where d < 6),
land as (select q, unnest(p17) l from en union select up.q, unnest(en.p17) from up join en on en.q = up.a),
k as (select st.*, {KIND} kd, en.q is not null known, bool_or(r = 'country') over w lands, bool_or(r = 'province') over w provs,
 exists (select 1 from land where land.q = st.q) resolved,
 exists (select 1 from land join st s on s.q = land.l where land.q = st.q and s.e = st.e and s.ctx = st.ctx and s.r = 'country') inl,
 exists (select 1 from up join st s on s.q = up.a where up.q = st.q and s.e = st.e and s.ctx = st.ctx and s.r = 'province') inp, kind
 from st left join en using (q) window w as (partition by e, ctx)),
f as (select id, concat_ws(';', case when r = 'country' and not coalesce(kind = 'sovereign state', false) then 'country_role_mismatch' end, case when kd = 'other' then 'needs_manual_type_review' end,
 case when r = 'place' and known and lands and resolved and not inl then 'place_country_mismatch' end, case when r = 'place' and known and lands and not resolved then 'place_country_unresolved' end,
 case when r = 'place' and kd = 'province' then 'place_is_admin_region' end, case when r = 'place' and known and provs and not inp then 'place_province_mismatch' end, case when cf then 'place_qid_conflict' end,
 case when r = 'province' and known and lands and resolved and not inl then 'province_country_mismatch' end, case when r = 'province' and known and lands and not resolved then 'province_country_unresolved' end,
 case when r = 'province' and kd <> 'province' then 'province_role_mismatch' end, case when r in ('place', 'province') and not known then 'qid_lookup_missing' end) as review_flags from k)
select id, review_flags, review_flags <> '' as needs_review from f""")  # fmt: skip
def review_flags(t):
    e = world(t)
    rows = places.enrich(stories(t), e).select("entry_id", "context", "source_role", "qid", "id", "place_qid_conflict", "resolved_category")
    return places.review_flags(rows, e).select("id", "review_flags", "needs_review")


STATES = """s as (select p_partkey id, p_name, p_size % 3 = 0 and p_size % 2 = 0 fits from part), c as (select p_name l, p_partkey i, 'T' || p_partkey q, p_brand ti from part where p_partkey % 5 = 1 or p_partkey % 7 = 2),
best as (select l, arg_min(q, i) q, arg_min(ti, i) ti from c group by l)"""


@query(f"""with {STATES} select id, case when fits and best.q is not null then best.q else 'Q' || id end as qid, case when fits and best.q is not null then ti else '' end as settlement, case when fits and best.q is not null then 'state_to_city' else '' end as stamp from s left join best on l = p_name""")
def state_to_city(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = t("part").select(
        k.alias("id"), F.when(size % 3 == 0, "place").otherwise("province").alias("source_role"), F.when(size % 2 == 0, "province").otherwise("other").alias("resolved_category"), F.concat(F.lit("Q"), k).alias("qid"),
        F.lit("").alias("correction_applied"), F.lit("").alias("wikidata_label_en"), F.col("p_name").alias("clustered_value"), *[F.lit("").alias(c) for c in places.CATEGORIES],
    )
    found = t("part").select(
        F.col("p_name").alias("label"), k.alias("rank"), F.concat(F.lit("T"), k).alias("qid"), F.col("p_brand").alias("title"), F.when(k % 5 == 1, "a Town somewhere").otherwise("hill").alias("description"),
        F.when(k % 7 == 2, "city in the north").alias("types"),
    )
    return places.state_to_city(rows, found).select("id", "qid", "settlement", F.col("correction_applied").alias("stamp"))


SITES = """m as (select p_partkey id, p_size % 4 > 0 pl, case when p_size % 3 = 0 then '' else p_brand end d, case when p_size % 5 = 0 then '  ' when p_size % 5 = 1 then p_brand else p_type end b, case when p_size % 7 = 0 then 'earlier' else '' end s from part)"""


@query(f"""with {SITES} select id, case when pl and d = '' and trim(b) <> '' then b else d end as death_site, case when pl and d <> '' and trim(b) = '' then d else b end as burial_city,
case when pl and s = '' and (d = '') <> (trim(b) = '') then 'death_burial_mirrored' else s end as correction_applied, pl and d <> '' and trim(b) <> '' and d <> b as death_burial_conflict from m""")  # fmt: skip
def mirror(t):
    size = F.col("p_size")
    rows = t("part").select(
        F.col("p_partkey").alias("id"), F.when(size % 4 > 0, "place").otherwise("country").alias("source_role"), F.when(size % 3 > 0, F.col("p_brand")).alias("death_site"),
        F.when(size % 5 == 0, "  ").when(size % 5 == 1, F.col("p_brand")).otherwise(F.col("p_type")).alias("burial_city"), F.when(size % 7 == 0, "earlier").otherwise("").alias("correction_applied"),
    )
    return places.mirror(rows).select("id", T.text("death_site").alias("death_site"), "burial_city", "correction_applied", "death_burial_conflict")


def place_table(t) -> DataFrame:
    size = F.col("p_size")
    return t("part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("source_value"), F.col("p_type").alias("context"), F.when(size % 2 == 0, True).when(size % 3 == 0, False).alias("needs_review"), F.col("p_brand").alias("resolved_category"), F.lit(1).alias("extra"), F.when(size % 7 == 0, "fixed").otherwise("").alias("correction_applied"))


BLANKS = ", ".join(f"'' as {c}" for c in (*places.CATEGORIES, "source_role", "clustered_value", "qid", "qid_source", "wikidata_label_en", "wikidata_label_yi", "wikidata_type", "other_type", "review_flags"))


@query(f"select cast(p_partkey as varchar) as entry_id, p_name as source_value, p_type as context, p_size % 2 = 0 as needs_review, p_brand as resolved_category, false as place_qid_conflict, {BLANKS} from part")
def legacy_resolved(t):
    return places.legacy(place_table(t))[0]


@query(f"select cast(p_partkey as varchar) as entry_id, p_name as source_value, p_type as context, true as needs_review, p_brand as resolved_category, false as place_qid_conflict, case when p_size % 7 = 0 then 'fixed' else '' end as correction_applied, false as death_burial_conflict, {BLANKS} from part where p_size % 2 = 0")
def legacy_queue(t):
    return places.legacy(place_table(t), corrections=True)[1]


@query("""select 'category' as total, p_brand as kind, count(*) as n from part group by p_brand union all select 'correction', 'fixed', count(*) from part where p_size % 7 = 0 having count(*) > 0
union all select 'needs_review', '', count(*) from part where p_size % 2 = 0""")  # fmt: skip
def kind_counts(t):
    return places.kind_counts(place_table(t))


# Decisions, and alignments linked to clusters. Of the mentions of an order's customer some are named as its heading, the others have no name.


@query("""with e as (select o_custkey k, arg_max(case when o_orderkey % 3 = 0 then 'REQUEUE' else o_orderpriority end, row(o_orderdate, o_orderkey)) d, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) a, max(row(o_orderdate, o_orderkey)) t from orders where o_custkey % 2 = 0 group by 1)
select c_custkey, case when d = 'REQUEUE' then '' else coalesce(d, 'old') end as decision, case when d = 'REQUEUE' then '' else coalesce(a, c_mktsegment) end as aligned, case when d is null then '' else 'rev' end as reviewer from customer left join e on k = c_custkey""")  # fmt: skip
def decisions_applied(t):
    o = F.col("o_orderkey")
    log = t("orders").where("o_custkey % 2 = 0").select(
        F.col("o_custkey").alias("c_custkey"), F.when(o % 3 == 0, decisions.BACK).otherwise(F.col("o_orderpriority")).alias("decision"), F.col("o_orderstatus").alias("aligned"), F.col("o_orderdate").alias("at"),
        o.alias("n"), F.lit("rev").alias("reviewer"),
    )
    rows = t("customer").select("c_custkey", F.lit("old").alias("decision"), F.col("c_mktsegment").alias("aligned"))
    return decisions.decided(rows, log, "c_custkey", ["aligned"]).drop("reviewed_at")


LINKED = """a as (select o_orderkey uid, o_orderpriority h, case when o_orderkey % 11 = 0 then 'x' || o_custkey when o_orderkey % 13 = 0 then '' else cast(o_custkey as varchar) end db, o_custkey % 700 x from orders),
m as (select l_orderkey * 10 + l_linenumber as o, l_orderkey % 640 as x, case when l_orderkey % 640 % 9 = 0 then null else 'C' || l_suppkey end c, case l_linenumber when 1 then '5-LOW' when 2 then '1-URGENT' else '' end nm from lineitem where l_orderkey % 5 = 0 and l_linenumber < 4),
s as (select uid, h, db, count(m.x) as met, count(c) as n, arg_min(c, row(case when nm = h then 0 else 1 end, o, c)) filter (c is not null) as best, bool_or(nm = h and c is not null) hit from a left join m using (x) where db <> '' group by 1, 2, 3),
r as (select *, case when db like 'x%' then 'invalid_align_with_db' when met = 0 then 'xml_id_not_found' when n = 0 then 'no_cluster_id' when n > 1 and not hit then 'ambiguous_cluster_match' end as reason from s)"""


def links(t) -> tuple[DataFrame, DataFrame]:
    o, k, line = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_linenumber")
    a = t("orders").select(F.concat(o, F.lit("-"), k % 700).alias("uid"), F.col("o_orderpriority").alias("h"), F.when(o % 11 == 0, F.concat(F.lit("x"), k)).when(o % 13 == 0, "").otherwise(F.concat(k, F.lit(" | 3"))).alias("db"))
    x = F.col("l_orderkey") % 640
    m = t("lineitem").where("l_orderkey % 5 = 0 and l_linenumber < 4").select(
        (F.col("l_orderkey") * 10 + line).alias("o"), x.cast("string").alias("x"), F.when(x % 9 == 0, " ").otherwise(F.concat(F.lit("C"), "l_suppkey")).alias("c"), F.when(line == 1, "5-LOW").when(line == 2, "1-URGENT").otherwise("").alias("nm"),
    )
    return decisions.linked(a, m, "uid", F.col("h"), "db", "x", "c", F.col("nm"), "o")


@query(f"with {LINKED} select uid || '-' || (o_custkey % 700) as uid, coalesce(best, '') as cluster_id, coalesce(reason, '') as reason from (select uid, best, null as reason from r where reason is null union all select uid, null, reason from r where reason is not null) join orders on o_orderkey = uid")
def linked_alignments(t):
    good, bad = links(t)
    return good.select("uid", "cluster_id", F.lit("").alias("reason")).unionByName(bad.select("uid", F.lit("").alias("cluster_id"), "reason"))


# What reviewers look at.


@query("""with g as (select o_custkey c, o_orderstatus f, o_orderpriority e, o_orderkey k from orders where o_orderkey % 5 > 0),
d as (select c, min(k) k from g where f <> 'P' or e not like '%-%M%' group by c, f, case when e = '5-LOW' then '' else e end),
r as (select c, k, row_number() over (partition by c order by k) r from d) select c as o_custkey, k as o_orderkey from r where r <= 4""")  # fmt: skip
def mention_samples(t):
    p, f = F.col("o_orderpriority"), F.col("o_orderstatus")
    rows = t("orders").select("o_custkey", "o_orderkey", f.alias("file"), F.when(p == "5-LOW", " ").otherwise(p).alias("entry"), F.when(F.col("o_orderkey") % 5 > 0, "said").otherwise("").alias("sentence"), F.lit(None).cast("string").alias("heading"))
    rows = rows.where((f != "P") | ~p.rlike("-.*M"))
    return views.samples(rows, ["o_custkey"], "file", "entry", ["sentence", "heading"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query("select c_custkey from customer where c_custkey % 3 = 0 and c_mktsegment in ('BUILDING', 'MACHINERY') and c_mktsegment like '%IN%'")
def visible_rows(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, "ALIGN").otherwise(" ").alias("decision"), F.col("c_mktsegment").alias("org_type"))
    return views.visible(rows, "Undecided", ["building", "Machinery"], "in").select("c_custkey")


CARD_ROWS = """k as (select c_custkey id, c_custkey % 7 = 0 ex, c_custkey % 5 = 0 ge, c_custkey % 4 = 0 sub, c_name nm, c_mktsegment ty, case when c_custkey % 3 = 0 then 'geolocated' when c_custkey % 3 = 1 and c_nationkey % 2 = 0 then 'has_address' when c_nationkey < 10 then 'has_settlement' when c_nationkey < 20 then 'has_country' else 'none' end st from customer)"""


def card_rows(t) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return t("customer").select(
        k.cast("string").alias("db_id"), flag(k % 7 == 0).alias("is_exploded"), flag(k % 5 == 0).alias("is_generic"), F.when(k % 4 == 0, "1").alias("parent_db_id"), F.col("c_name").alias("canonical_yiddish"),
        F.col("c_mktsegment").alias("org_type"), F.when(k % 3 == 0, "1.5").alias("lat"), F.when(k % 3 == 0, "2").alias("lon"), F.when(n % 2 == 0, F.when(k % 3 == 1, "x")).alias("confirmed_address"),
        F.when(n < 10, "y").otherwise(" ").alias("confirmed_settlement"), F.when(n < 20, "z").alias("country"),
    )


@query(f"with {CARD_ROWS} select cast(id as varchar) as db_id, st as geo_status from k where not ex and not ge and not sub and nm like '%7%' and ty = 'BUILDING'")
def filtered_cards(t):
    return views.cards(card_rows(t), ["building"], "7", generic=False, parts=False).select("db_id", "geo_status")


@query(f"""with {CARD_ROWS} select count(*) as showing, count(*) filter (st = 'geolocated') as geolocated, count(*) filter (st = 'has_address') as has_address, count(*) filter (st = 'has_settlement') as has_settlement,
count(*) filter (st = 'has_country') as has_country, count(*) filter (st = 'none') as none, count(*) filter (st <> 'none') / count(*) as reviewed_ratio from k where not ex""")  # fmt: skip
def geo_facets(t):
    return views.facets(views.cards(card_rows(t)))


@query("select p_partkey from part where p_name like '%red%' and (lower(p_brand) || ' ' || lower(p_type)) like '%2 econ%' and p_partkey <> 3 order by p_partkey limit 20")
def search_rows(t):
    rows = t("part").withColumn("nothing", F.lit(None).cast("string"))
    return views.search(rows, "p_partkey", ["p_partkey"], "p_name", ["p_brand", "nothing", "p_type"], "RED", "2 Econ", "3").select("p_partkey")


@query("select distinct cast(o_custkey as varchar) as db_id, o_orderpriority as cluster_id from orders where o_orderstatus = 'F' and o_custkey % 9 > 0")
def linking_decisions(t):
    c = F.col("o_custkey")
    rows = t("orders").select(F.when(F.col("o_orderstatus") == "F", " NEW ").otherwise(F.col("o_orderstatus")).alias("decision"), F.when(c % 9 > 0, F.concat(F.lit(" "), c)).alias("aligned_db_id"), F.col("o_orderpriority").alias("cluster_id"))
    return views.linking(rows)


@query("select distinct cast(o_custkey as varchar) as o_custkey from orders where o_custkey % 4 > 0")
def key_set(t):
    return views.key_set(t("orders").select(F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey")).alias("o_custkey")), "o_custkey")


@query(f"""with d as (select {STRATUM} s, o_totalprice p, o_custkey % 3 = 0 c from orders)
select n.s as stratum, count(d.s) as n, count(*) filter (p > 200000) as dear, count(*) filter (c) as has_context from (values ('S1'), ('S2'), ('S3'), ('S4'), ('S5'), ('S8')) n(s) left join d on d.s = n.s group by 1""")  # fmt: skip
def strata_counts(t):
    rows = t("orders").select("*", F.when(F.col("o_custkey") % 3 == 0, "x").otherwise(" N/A ").alias("x - locations - y"), F.lit(None).cast("string").alias("a relations b"))
    return views.strata(rows, F.expr(STRATUM), ["S1", "S2", "S3", "S4", "S5", "S8"], dear=F.col("o_totalprice") > 200000, has_context=views.has_context(rows))


@query("select p_partkey, p_partkey % 3 > 0 and p_partkey % 4 > 0 as preserved from part")
def preserved_rows(t):
    k = F.col("p_partkey")
    before = t("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("variants"))
    after = t("part").where(k % 3 > 0).select("p_partkey", F.upper("p_name").alias("name"), F.concat(F.lit(" "), F.lower("p_type")).alias("kind"), F.when(k % 4 > 0, F.col("p_brand")).otherwise("other").alias("variants"))
    return views.same_meaning(before, after, "p_partkey", "name", "kind", "variants")
