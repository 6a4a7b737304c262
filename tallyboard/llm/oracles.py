"""SQL of the text queries that SQL can state, for whole tables."""

LINES = """with l as (select doc_id, i, s, trim(s, ' ')<>'' as full_line from (select doc_id, unnest(parts) s,
  generate_subscripts(parts, 1) i from (select doc_id, string_split(text, chr(10)) parts from documents))),
n as (select doc_id, i, s, length(s) chars, row_number() over (partition by doc_id order by i) - 1 pos from l where full_line),
p as (select *, lead(s) over (partition by doc_id order by pos) nxt from n),
q as (select *, row_number() over (partition by s order by doc_id, pos) k1,
  row_number() over (partition by s, nxt order by doc_id, pos) k2 from p),
g as (select doc_id, pos from q where k1>1 and chars>=40 union select doc_id, pos from q where k2>1 and nxt is not null
  union select doc_id, pos+1 from q where k2>1 and nxt is not null),
r as (select doc_id, max(size) longest_run from (select doc_id, count(*) size from
  (select *, pos - row_number() over (partition by doc_id order by pos) run from g) group by doc_id, run) group by doc_id),
k as (select l.doc_id, string_agg(l.s, chr(10) order by l.i) kept from l left join n using (doc_id, i)
  left join g on g.doc_id=l.doc_id and g.pos=n.pos where g.pos is null group by 1)
select d.doc_id, (select count(*) from n where n.doc_id=d.doc_id) n_lines, (select count(*) from g where g.doc_id=d.doc_id) n_removed,
  coalesce(longest_run, 0)::bigint longest_run, sha256(coalesce(kept, '')) text_sha256
from documents d left join r using (doc_id) left join k using (doc_id)"""

WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x<>'')"

LEAKS = f"""with d as (select doc_id, unnest(w) w, generate_subscripts(w, 1) p from
  (select doc_id, {WORDS.format(text="lower(coalesce(text, ''))")} w from documents)),
b as (select item_id, len(w) n, unnest(w) w, generate_subscripts(w, 1) q from
  (select item_id, {WORDS.format(text="lower(coalesce(text, ''))")} w from benchmark) where len(w)>=5),
e as (select doc_id, item_id, p-q as shift, q, n from d join b using (w)),
c as (select doc_id, item_id, shift, n, q, count(*) over (partition by doc_id, item_id, shift order by q
  range between current row and 12 following) same from e),
f as (select doc_id, item_id, shift, max(same) n_equal from c group by doc_id, item_id, shift, n
  having max(same) >= case when n>=13 then 11 else n end)
select doc_id, item_id, max(n_equal)::bigint n_equal, min(shift) filter (where n_equal=best)::bigint as "at" from
  (select *, max(n_equal) over (partition by doc_id, item_id) best from f) group by 1, 2"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""with recursive w as (select doc_id, {WORDS.format(text=LOWER)} w from documents),
s as (select doc_id, case when len(w)>=5 then list_distinct(list_transform(range(1, len(w)-3),
  lambda i: array_to_string(w[i:i+4], ' '))) when len(w)>0 then [array_to_string(w, ' ')] else [] end h from w),
e as (select doc_id, unnest(h) h from s),
o as (select a.doc_id a, b.doc_id b, count(*) o from e a join e b on a.h=b.h and a.doc_id<b.doc_id group by 1, 2),
l as (select a, b from o join s x on x.doc_id=a join s y on y.doc_id=b where 100*o>=75*(len(x.h)+len(y.h)-o)),
u as (select a, b from l union select b, a from l),
t as (select doc_id, doc_id as c from s union select u.b, t.c from t join u on u.a=t.doc_id)
select s.doc_id, len(h)::bigint n_shingles, min(c)::bigint component_id from s join t using (doc_id) group by s.doc_id, h"""

ORACLES = {"op1_line_dedup": LINES, "op5_decontaminate": LEAKS, "op6_jaccard_join": NEAR}

TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""with d as (select row_number() over () k, doc_id, {TERMS.format(text=LOWER)} t from documents),
u as (select k, doc_id, len(t) n from d where len(t)>0),
c as (select count(*)::bigint nn, sum(n)::bigint ll from u),
f as (select k, term, count(*) tf from (select k, unnest(t) term from d) group by 1, 2),
w as (select term, floor(1000*ln((2*nn+2)/(2*count(*)+1)))::bigint w from f, c group by term, nn),
q as (select item, item_id, term, count(*) r from (select row_number() over () item, item_id, unnest(t) term from
  (select distinct item_id, text, {TERMS.format(text=LOWER)} t from benchmark)) group by 1, 2, 3),
s as (select item, item_id, k, doc_id, sum(r*w*((1000000000*tf)//(1000*tf+12*(75+(25*n*nn)//ll))))::bigint score
  from q join w using (term) join f using (term) join u using (k), c group by 1, 2, 3, 4)
select item_id, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank, doc_id, score
from s where score>0 qualify rank<=20"""

ORACLES["op13_ranked_search"] = RANKED

#: crc32 of a short text, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda p, q: case when p & 1 = 1 then xor(p >> 1, 3988292384::bigint) else p >> 1 end)), 4294967295::bigint)"""

TRIE = f"""with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id
  order by turn nulls first, coalesce(role, ''), coalesce(text, '')) i from conversations where conv_id is not null),
o as (select c, list({{'r': r, 'x': x}} order by i) own, {CRC.format(text="c::varchar")} % 9 h from t group by c),
b as (select o.c, list_concat(coalesce(list_slice(z.own, 1, o.h), []), list_slice(o.own, o.h+1, len(o.own))) a
  from o left join o z on z.c = o.c - o.c%5),
p as (select c, d, list_slice(a, 1, d) k, d = len(a) ending from (select c, a, unnest(range(0, len(a)+1)) d from b)),
n as (select d, k, count(*) n, min(c) rep, coalesce(string_agg(c::varchar, ',' order by c) filter (where ending), '') ends,
  case when d=0 then 0 else (count(*)-1)*strlen(k[d].x) end saves from p group by d, k),
q as (select p.c, p.d, n.rep, n.n from p join n on n.d=p.d and n.k=p.k),
m as (select u.rep, u.d, count(*) children from n w join q u on u.c=w.rep and u.d=w.d-1 group by 1, 2),
s as (select u.rep, u.d, sum(w.saves) saved, sum((m.children is null)::int) leaves from n w left join m on m.rep=w.rep and m.d=w.d
  join q u on u.c=w.rep and u.d<=w.d group by 1, 2)
select n.rep conv_id, n.d::bigint as depth, u.rep parent_conv_id, n.n n_convs, coalesce(m.children, 0)::bigint n_children,
  s.leaves::bigint n_leaves, s.saved::bigint saved_tokens, sha256(n.ends) ends_sha256
from n join s on s.rep=n.rep and s.d=n.d left join m on m.rep=n.rep and m.d=n.d left join q u on u.c=n.rep and u.d=n.d-1"""

ORACLES["op12_prefix_trie"] = TRIE
