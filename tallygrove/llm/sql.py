"""What operators 11 to 13 return, in SQL."""

ORACLE_SQL = {}

ORACLE_SQL["op11_phrases"] = r"""
with low as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from low),
g as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from w, (values (1), (2), (3)) as sizes(m)),
f as (select lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') as phrase, count(*) as a from g group by all),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
c as (select *, string_split(phrase, ' ') as p from f where m > 1 and a >= 10),
cuts as (select *, unnest(range(1, m)) as k from c),
scores as (
    select cuts.lang, cuts.phrase, cuts.a, k, fl.a as l, fr.a as r, 1000000::hugeint * cuts.a * cuts.a // (fl.a::hugeint * fr.a) as score
    from cuts
    join f as fl on fl.lang = cuts.lang and fl.phrase = array_to_string(list_slice(p, 1, k), ' ')
    join f as fr on fr.lang = cuts.lang and fr.phrase = array_to_string(list_slice(p, k + 1, cuts.m), ' ')
), least as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
within as (
    select lang, array_to_string(list_slice(p, j, j + 1), ' ') as phrase, max(a) as whole
    from c, (values (1), (2)) as places(j) where m = 3 group by all
), ranked as (
    select least.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from least left join within using (lang, phrase) where whole is null or 100 * whole < 50 * a
)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000"""

#: crc32 of an id's decimal digits: the bits of each byte are taken one by one; the number is the fixed polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1))))"""

ORACLE_SQL["op12_trie"] = f"""
with own as (
    select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as t
    from conversations where conv_id is not null group by conv_id
), h as (select conv_id, t, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from own),
rebuilt as (
    select h.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, h.h), list_slice(h.t, h.h + 1, len(h.t))) as t from h left join own as b on b.conv_id = h.base
), prefixes as (select conv_id, t, unnest(range(0, len(t) + 1)) as depth from rebuilt),
members as (select conv_id, depth, list_slice(t, 1, depth) as p, depth = len(t) as last from prefixes),
nodes as (
    select p, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * if(depth = 0, 0, length(p[depth].text)) as saved,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) as ends_sha256
    from members group by p, depth
), kids as (select list_slice(p, 1, depth - 1) as p, count(*) as n_children from nodes where depth > 0 group by 1),
up as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (p)),
above as (select p, depth, n_children, saved, unnest(range(0, depth + 1)) as d from up),
totals as (select list_slice(p, 1, d) as p, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from above group by 1)
select up.conv_id, up.depth, parent.conv_id as parent_conv_id, up.n_convs, up.n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, up.ends_sha256
from up join totals using (p) left join nodes as parent on up.depth > 0 and parent.p = list_slice(up.p, 1, up.depth - 1)"""

ORACLE_SQL["op13_substring"] = r"""
with d as (
    select row_number() over () as id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), places as (select id, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35),
windows as (select id, s, array_to_string(list_slice(w, s, s + 34), ' ') as said from places),
found as (select id, s from windows where said in (select said from windows group by said having count(*) > 1)),
gone as (select distinct id, s + k as place from found, range(35) as t(k)),
words as (select id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from d),
kept as (select id, string_agg(word, ' ' order by place) as said, count(*) as n from words where not exists (select 1 from gone where gone.id = words.id and gone.place = words.place) group by id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(said, '')) as kept_sha256 from d left join kept using (id)"""
