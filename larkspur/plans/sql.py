"""The SQL that checks the registered queries, from shared fragments."""

from __future__ import annotations

from larkspur.operators import guidance, hybrid, lexical, usage

SUMMARY = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^#{1,6}\s+', '', 'g'), '\s+', ' ', 'g'))"
CORPUS = f"""corpus as (select page_ord, page_id, path, title, text, case when length(s) <= 360 then s else rtrim(left(s, 359)) || '...' end summary, role, tags, source_refs, status, review_state, approved from (
  select d.doc_id page_ord, d.doc_id::varchar page_id, concat_ws('/', source, lang, d.doc_id::varchar || '.md') path, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) title,
    coalesce(text, '') as text, {SUMMARY} s, case d.doc_id when 0 then 'hot' when 1 then 'index' when 2 then 'overview' else 'topic' end as role, lang tags, source source_refs,
    case when toxic = 1 then 'blocked' else '' end status, case when quality = 1 then 'approved' when quality = 0 then 'draft' else 'unknown' end review_state,
    coalesce(toxic, 0) = 0 and coalesce(quality, 1) = 1 approved
  from documents d left join labels l on d.doc_id = l.doc_id))"""
TOKEN = "[A-Za-z0-9][A-Za-z0-9_.-]*(?:[가-힣]+)?|[가-힣]+"


#: The fixed pattern as an engine without lookbehind and possessive repeats reads it.
SENSITIVE = guidance.SENSITIVE.replace("(?iU)", "(?i)").replace("(?<![a-z0-9-])-*+[a-z0-9][a-z0-9-]*+", "(?:^|[^a-z0-9-])-*[a-z0-9][a-z0-9-]*").replace("'", "''")


def tokens(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '{TOKEN}'), lambda x: lower(x))"


FULL = "concat_ws(' ', title, summary, text, tags, source_refs)"
QUERIES = f"""qs as (select item_id query_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:8] toks from (select item_id, {tokens("text")} t from benchmark)),
queries as (select query_id, array_to_string(toks, ' ') query from qs)"""
ROLE_RANK = "case role when 'hot' then 0 when 'index' then 1 when 'overview' then 2 else 3 end"
MULTIPLIER = "case role when 'hot' then 1.15 when 'index' then 1.06 when 'overview' then 1.03 else 1.0 end"
WEIGHT = "case when regexp_full_match(token, '[0-9]+') then 0.2 else 1.0 end"


def bm25(pages: str = "corpus", toks: str = "qs", name: str = "") -> str:
    """CTEs up to whole{name} (query_id, page_id, path, role, whole)."""
    return f"""tk{name} as (select page_id, role, path, {tokens(FULL)} t from {pages}),
st{name} as (select greatest(count(*), 1) n, greatest(avg(len(t)), 1) avgdl from tk{name}),
tf{name} as (select page_id, role, path, len(t) dl, token, count(*) tf from (select *, unnest(t) token from tk{name}) group by all),
df{name} as (select token, count(*) df from tf{name} group by 1),
qt{name} as (select distinct query_id, unnest(toks) token from {toks}),
whole{name} as (select query_id, page_id, path, role, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * greatest(dl, 1) / avgdl)) * {WEIGHT}) * {MULTIPLIER} whole
  from tf{name} join qt{name} using (token) join df{name} using (token), st{name} group by query_id, page_id, path, role)"""


def top(source: str, k: int, digits: int = 4) -> str:
    """Rank of rounded scores."""
    return f"""(select * from (select query_id, page_id, path, role, round(whole, {digits}) score, row_number() over (partition by query_id order by round(whole, {digits}) desc, {ROLE_RANK}, path) rank from {source}) where rank <= {k})"""


COLS = "query_id, page_id, path, role, score, rank"
DOT = "list_dot_product"
COSINE = f"""cv as (select vec_id::varchar page_id, label, embedding::double[] v from embeddings),
vq as (select item_id query_id, embedding::double[] v from benchmark join embeddings on item_id = vec_id),
cos as (select query_id, page_id, label, {DOT}(cv.v, vq.v) / (sqrt({DOT}(cv.v, cv.v)) * sqrt({DOT}(vq.v, vq.v))) score from cv, vq)"""
VECTOR = f"""vtop as (select * from (select query_id, page_id, path, role, score, row_number() over (partition by query_id order by score desc, {ROLE_RANK}, path, page_id) rank from cos join corpus using (page_id)) where rank <= 256)"""
EDGES = """edges as (select distinct source, target, relation from (
 select concat('nation:', n_nationkey) source, concat('region:', n_regionkey) target, 'part_of' relation from nation
 union all select concat('customer:', c_custkey), concat('nation:', c_nationkey), 'located_in' from customer
 union all select concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'located_in' from supplier
 union all select concat('order:', o_orderkey), concat('customer:', o_custkey), 'placed_by' from orders
 union all select concat('order:', l_orderkey), concat('part:', l_partkey), 'contains' from lineitem
 union all select concat('part:', l_partkey), concat('supplier:', l_suppkey), 'supplied_by' from lineitem))"""
SLUG = "coalesce(nullif(trim(regexp_replace(trim({0}), '[^A-Za-z0-9가-힣._-]+', '-', 'g'), '-'), ''), 'item')"
KEY = "regexp_replace(lower(regexp_replace({0}, '\\.md$', '')), '[^a-z0-9가-힣]+', '', 'g')"
KIND = "case when regexp_matches({0}, '^https?://') then 'external_ref' when regexp_full_match({0}, '(#\\d+|[A-Z][A-Z0-9]+-\\d+|GH-\\d+)') then 'external_issue' else 'placeholder' end"
UNRESOLVED = f"case when {KIND} like 'external%' then 'external:' else 'placeholder:' end || {SLUG}"
PROJECTED = f"""lk as (select doc_id::varchar page_id, (doc_id // 10)::varchar link from documents
  union all select page_id::varchar, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) from pages),
keys as (select key, arg_max(page_id, page_ord) target from (select page_ord, page_id, unnest(list_distinct([{KEY.format("page_id")}, {KEY.format("title")}, {KEY.format("path")}, {KEY.format("split_part(path, '/', -1)")}])) key from corpus) group by 1),
rl as (select lk.page_id, page_ord, path, link, target from lk join corpus using (page_id) left join keys on keys.key = {KEY.format("link")}),
gn as (select 0 late, page_ord, 0 step, title as label, role kind, path, 'page:' || page_id id from corpus
  union all select 1, page_ord, 2, source_refs, 'source_ref', path, 'source:' || {SLUG.format("source_refs")} from corpus where source_refs is not null
  union all select 1, page_ord, 3, tags, 'tag', path, 'tag:' || {SLUG.format("lower(tags)")} from corpus where tags is not null
  union all select 1, page_ord, 4, link, {KIND.format("link")}, path, {UNRESOLVED.format("link")} from rl where target is null),
nodes as (select id, label, kind, path from (select *, row_number() over (partition by id order by late, page_ord, step, label, kind, path) r from gn) where r = 1),
pedges as (select distinct source, target, relation from (
  select 'page:' || page_id source, 'source:' || {SLUG.format("source_refs")} target, 'cites' relation from corpus where source_refs is not null
  union all select 'page:' || page_id, 'tag:' || {SLUG.format("lower(tags)")}, 'tagged' from corpus where tags is not null
  union all select 'page:' || page_id, coalesce('page:' || target, {UNRESOLVED.format("link")}), 'links_to' from rl))"""
QRELS = """qrels as (select item_id query_id, doc_id::varchar page_id, case when contains(d.text, b.text) then 2 else 1 end relevance
  from documents d, benchmark b where contains(d.text, substr(b.text, 1, (length(b.text) // 2)::int)))"""
EVAL = f"""run as (select query_id, page_id, rank from {top("whole", 100)}),
jd as (select run.*, coalesce(relevance, 0) rel, (coalesce(relevance, 0) >= 1)::int hit from run left join qrels using (query_id, page_id)),
sf as (select *, sum(hit) over (partition by query_id order by rank) so_far from jd),
need as (select query_id, count(*) filter (where relevance >= 1) n_relevant, sum(case when r <= 10 then (pow(2.0, relevance) - 1) / log2(r + 1) else 0 end) idcg
  from (select *, row_number() over (partition by query_id order by relevance desc, page_id) r from qrels) group by 1),
sm as (select query_id, sum(case when rank <= 10 then (pow(2.0, rel) - 1) / log2(rank + 1) else 0 end) dcg, sum(case when rank <= 10 then hit else 0 end) hits, min(case when hit = 1 then rank end) first_hit,
  sum(case when rank <= 10 and hit = 1 then so_far / rank else 0 end) ap from sf group by 1),
pq as (select query_id, coalesce(dcg, 0) / idcg ndcg, coalesce(hits, 0) / n_relevant recall, (coalesce(hits, 0) > 0)::int hit, coalesce(1.0 / first_hit, 0) mrr, coalesce(hits, 0) / 10.0 "precision",
  coalesce(ap, 0) / n_relevant map_all, coalesce(ap, 0) / least(n_relevant, 10) map_k from need left join sm using (query_id))"""
BASE = f"with recursive {CORPUS}, {QUERIES}, {bm25()}"
RRF = lexical.RRF_K
HITS = f"""h as (select user_id::varchar page_key, epoch(ts)::double t, row_number() over (partition by user_id order by ts) r from events where event_type in ('view', 'click')),
fold(page_key, r, counter, at) as (select page_key, r, 1.0::double, t from h where r = 1
  union all select h.page_key, h.r, least({usage.CAP}, fold.counter * pow(0.5, greatest(0, h.t - fold.at) / {usage.HALF_LIFE}) + 1.0), greatest(fold.at, h.t) from fold join h on h.page_key = fold.page_key and h.r = fold.r + 1),
state as (select page_key, arg_max(counter, r) counter, max(at) last_hit from fold group by 1)""".replace(" at)", " moment)").replace("fold.at", "fold.moment").replace("max(at)", "max(moment)")

RELATION = "regexp_replace(lower(regexp_replace({0}, '\\.md$', '')), '[^a-z0-9가-힣]+', '', 'g')"
NAMES = "[page_id, title, path, split_part(path, '/', -1), regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1')]"
CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
# forms of a label; what a text says in words (links are looked for too: none of these texts holds one)
FORMS = "[b, split_part(b, '/', -1), regexp_replace(split_part(b, '/', -1), '(.)\\.[^.]*$', '\\1')]"
IN_WORDS = "len(list_filter(f, lambda x: len(regexp_extract_all(x, '[0-9A-Za-z]+|[가-힣]+')) > 0 and regexp_matches(' ' || regexp_replace(lower({0}), '[^0-9a-z가-힣]+', ' ', 'g') || ' ', ' ' || array_to_string(list_transform(regexp_extract_all(x, '[0-9A-Za-z]+|[가-힣]+'), lambda y: lower(y)), ' ?') || ' '))) > 0"
SHOWN = f"""su as (select t.*, title, text, list_min(list_filter(list_transform(toks, lambda x: strpos(lower(text), x)), lambda x: x > 0)) p from {top('whole', 8)} t join corpus using (page_id, path, role) join qs using (query_id)),
sv as (select *, {CLEAN.format("case when p is null then text else substr(text, greatest(1, p - 100), 280) end")} c from su),
shown as (select *, case when len(c) <= 280 then c else rtrim(left(c, 279)) || '...' end snippet from sv)"""
SEEDED = f"""with recursive {CORPUS}, {QUERIES}, qx as (select query_id, list_append(toks, 'src' || (query_id % 3)) toks from qs), {bm25('corpus', 'qx', 'x')}, {COSINE}, {VECTOR},
lh as (select * from (select query_id, page_id, path, role, row_number() over (partition by query_id order by round(whole, 4) desc, {ROLE_RANK}, path) rank from wholex where role <> 'topic') where rank <= 24),
vh as (select * from (select query_id, page_id, path, role, row_number() over (partition by query_id order by score desc, {ROLE_RANK}, path, page_id) rank from cos join corpus using (page_id) where role <> 'topic') where rank <= 24),
ea as (select query_id, page_id, text, list_min(list_filter(list_transform(toks, lambda x: strpos(lower(text), x)), lambda x: x > 0)) p from lh join qx using (query_id) join corpus using (page_id)),
la as (select query_id, page_id, {CLEAN.format("case when p is null then text else substr(text, greatest(1, p - 100), 280) end")} a from ea),
lb as (select query_id, page_id, {CLEAN.format("case when text <> '' then text else summary end")} b from vh join corpus using (page_id)),
clip as (select query_id, page_id, case when len(a) <= 280 then a else rtrim(left(a, 279)) || '...' end a, case when len(b) <= 280 then b else rtrim(left(b, 279)) || '...' end b from la full join lb using (query_id, page_id)),
ev as (select query_id, page_id, array_to_string(list_filter([a, b], lambda x: x is not null and x <> ''), ' ') evidence from clip),
j as (select coalesce(lh.query_id, vh.query_id) query_id, coalesce(lh.page_id, vh.page_id) page_id, coalesce(lh.path, vh.path) path, coalesce(lh.role, vh.role) role, lh.rank lexical_rank, vh.rank vector_rank from lh full join vh on lh.query_id = vh.query_id and lh.page_id = vh.page_id),
seeds as (select * from (select j.*, evidence, row_number() over (partition by query_id order by least(coalesce(lexical_rank, 25), coalesce(vector_rank, 25)), coalesce(lexical_rank, 25), coalesce(vector_rank, 25), {ROLE_RANK}, path, page_id) rank from j join ev using (query_id, page_id) where evidence <> '') where rank <= 3),
{PROJECTED.split(',' + chr(10) + 'keys as')[0]},
lab as (select page_id, 'link' kind, link as label from lk join corpus using (page_id) where role <> 'topic' union select page_id, 'source', source_refs from corpus where role <> 'topic' and source_refs is not null union select page_id, 'tag', tags from corpus where role <> 'topic' and tags is not null),
told as (select seeds.query_id, seeds.page_id seed_id, kind, label, evidence, array_to_string(toks, ' ') query, {FORMS} f from (select *, regexp_replace(trim(label), '\\.md$', '') b from lab) lab join seeds using (page_id) join qx using (query_id)),
seen as (select distinct query_id, seed_id, kind, {RELATION.format("label")} k from told where {IN_WORDS.format("evidence")} or {IN_WORDS.format("query")}),
targets as (select 'link' kind, k, arg_min(page_id, page_ord) page_id from (select page_id, page_ord, unnest(list_distinct(list_transform({NAMES}, lambda x: {RELATION.format("x")}))) k from corpus) where k <> '' group by k
  union all select 'source', {RELATION.format("source_refs")}, page_id from corpus where source_refs is not null union all select 'tag', {RELATION.format("tags")}, page_id from corpus where tags is not null),
pool as (select distinct query_id, seed_id, page_id from seen join targets using (kind, k) where page_id <> seed_id),
ps as (select query_id, seed_id, page_id, path, role, score from pool join (select query_id, page_id, score from cos) using (query_id, page_id) join corpus using (page_id)),
p16 as (select distinct query_id, page_id, path, role, score from (select *, row_number() over (partition by query_id, seed_id order by score desc, {ROLE_RANK}, path, page_id) k from ps) where k <= {hybrid.RELATED_PER_SEED}),
rel as (select *, row_number() over (partition by query_id order by score desc, {ROLE_RANK}, path, page_id) rank from p16 qualify rank <= {hybrid.RELATED})"""

ORACLES = {
    "tokenize_terms": f"with {CORPUS} select token, count(*) n, count(distinct page_id) df from (select page_id, unnest({tokens(FULL)}) token from corpus) group by 1",
    "index_stats": f"with {CORPUS}, t as (select page_id, {tokens(FULL)} t from corpus), p as (select page_id, unnest(t) token from t) select (select count(*) from t) n, round((select avg(len(t)) from t), 6) avgdl, (select count(distinct token) from p) n_terms, (select count(*) from (select distinct page_id, token from p)) n_postings",
    "index_build": f"with {CORPUS}, t as (select page_id, unnest({tokens(FULL)}) token from corpus) select 'postings' as name, count(*) n_rows from (select distinct page_id, token from t) union all select 'doc_stats', count(*) from corpus union all select 'term_stats', count(distinct token) from t",
    "doc_lengths": f"with {CORPUS} select page_id, len({tokens(FULL)})::bigint dl from corpus",
    "index_refresh": f"{BASE} select {COLS} from {top('whole', 8)}",
    "index_changes": f"""with {CORPUS} select page_id, case when status = 'blocked' then 'added' else 'changed' end change from corpus
      where status = 'blocked' or review_state = 'draft' and (text <> title or summary <> title) union all select 'item-' || item_id, 'removed' from benchmark""",
    "bm25_topk": f"{BASE} select {COLS} from {top('whole', 8)}",
    "bm25_visible": f"with recursive {CORPUS}, {QUERIES}, seen as (select * from corpus where approved), {bm25('seen')} select {COLS} from {top('whole', 8)}",
    "bm25_min_score": f"{BASE}, m as (select * from whole where whole >= 6.0) select {COLS} from {top('m', 8)}",
    "bm25_excluded": f"{BASE}, m as (select * from whole where page_id not in (select doc_id::varchar from labels where quality = 0)) select {COLS} from {top('m', 8)}",
    "overview_order": f"with {CORPUS}, h as (select role, min(path) path from corpus where role <> 'topic' group by 1), o as (select c.page_id, c.path, c.role, row_number() over (order by case when h.path is not null then {ROLE_RANK.replace('role', 'c.role')} else 3 end, {ROLE_RANK.replace('role', 'c.role')}, c.path) rank from corpus c left join h on h.role = c.role and h.path = c.path) select page_id, path, role, round(1.0 - (rank - 1) * 0.01, 4) score, rank from o where rank <= 30",
    "literal_topk": f"""with recursive {CORPUS}, n as (select item_id query_id, lower(trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g'))) needle from benchmark),
x as (select page_id, path, role, lower(title) t, lower(summary) s, lower(concat_ws(' ', title, path, summary, text, tags, source_refs)) x from corpus),
m as (select query_id, page_id, path, role, (1 + least(3.0, ln(1 + (length(x) - length(replace(x, needle, ''))) // length(needle))) + case when contains(t, needle) then 1.5 else 0 end + case when contains(s, needle) then 0.7 else 0 end) * {MULTIPLIER} whole from x, n where needle <> '' and contains(x, needle))
select {COLS} from {top('m', 8)}""",
    "variants_rrf": f"""{BASE}, q2 as (select query_id, toks[1:4] toks from qs), {bm25('corpus', 'q2', '2')},
ch as (select *, 0 c from {top('whole', 30)} union all select *, 1 from {top('whole2', 30)}),
f as (select query_id, page_id, path, role, sum(1.0 / ({RRF} + rank)) fused, coalesce(min(case when c = 0 then rank end), 1000000) p, min(rank) b from ch group by all),
r as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, p, b, {ROLE_RANK}, path) rank from f) select query_id, page_id, path, role, round(fused, 6) score, rank from r where rank <= 8""",
    "cosine_topk": f"with {CORPUS}, {COSINE}, {VECTOR} select query_id, page_id, path, role, round(score, 6) score, rank from vtop where rank <= 8",
    "best_chunk_per_group": f"with {COSINE}, b as (select query_id, label, page_id, score, row_number() over (partition by query_id, label order by score desc, page_id::bigint) r from cos) select query_id, label::varchar page_id, round(score, 6) score, page_id::bigint ordinal from b where r = 1",
    "hybrid_plain_rrf": f"""{BASE}, {COSINE}, {VECTOR}, ch as (select query_id, page_id, path, role, rank from {top('whole', 256)} union all select query_id, page_id, path, role, rank from vtop),
f as (select query_id, page_id, path, role, sum(1.0 / ({RRF} + rank)) fused from ch group by all), r as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, {ROLE_RANK}, path, page_id) rank from f)
select query_id, page_id, path, role, round(fused, 4) score, rank from r where rank <= 8""",
    "hybrid_seeds": f"{SEEDED} select query_id, page_id, path, role, coalesce(lexical_rank, 0) lexical_rank, coalesce(vector_rank, 0) vector_rank, evidence, rank from seeds",
    "hybrid_related": f"{SEEDED} select query_id, page_id, path, role, round(score, 6) score, rank from rel",
    "hybrid_seeded": f"""{SEEDED}, rich as (select distinct query_id from seeds intersect select distinct query_id from rel),
named as (select query_id, page_id from qx, corpus where role <> 'topic' and list_contains(list_transform({NAMES}, lambda x: {RELATION.format("x")}), {RELATION.format("array_to_string(toks, ' ')")})),
lx as (select query_id, page_id, path, role, row_number() over (partition by query_id order by rank) rank from {top('wholex', 256)} where role = 'topic' or (query_id, page_id) in (select (query_id, page_id) from named)),
vx as (select query_id, page_id, path, role, row_number() over (partition by query_id order by rank) rank from vtop where role = 'topic' or (query_id, page_id) in (select (query_id, page_id) from named)),
sx as (select query_id, page_id, path, role, row_number() over (partition by query_id order by rank) rank from seeds where (query_id, page_id) in (select (query_id, page_id) from named)),
rx as (select rel.query_id, rel.page_id, rel.path, rel.role, row_number() over (partition by rel.query_id order by score desc, coalesce(lx.rank, 1000000), {ROLE_RANK.replace('role', 'rel.role')}, rel.path, rel.page_id) rank from rel left join lx using (query_id, page_id)
  where rel.role = 'topic' or (rel.query_id, rel.page_id) in (select (query_id, page_id) from named)),
ch as (select query_id, page_id, path, role, {hybrid.WEIGHTS['lexical']} / ({RRF} + rank) s from lx where query_id in (from rich) union all select query_id, page_id, path, role, {hybrid.WEIGHTS['related'] + hybrid.WEIGHTS['graph']} / ({RRF} + rank) from rx where query_id in (from rich)
  union all select query_id, page_id, path, role, {hybrid.WEIGHTS['vector']} / ({RRF} + rank) from vx where query_id in (from rich) union all select query_id, page_id, path, role, {hybrid.WEIGHTS['orientation']} / ({RRF} + rank) from sx where query_id in (from rich)
  union all select query_id, page_id, path, role, 1.0 / ({RRF} + rank) from lx where query_id not in (from rich) union all select query_id, page_id, path, role, 1.0 / ({RRF} + rank) from vx where query_id not in (from rich)),
f as (select query_id, page_id, path, role, sum(s) fused from ch group by all), r as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, {ROLE_RANK}, path, page_id) rank from f)
select query_id, page_id, path, role, round(fused, 4) score, rank from r where rank <= 8""",
    "graph_project_nodes": f"with {CORPUS}, {PROJECTED} select id, label, kind, path from nodes",
    "graph_project_edges": f"with {CORPUS}, {PROJECTED} select source, target, relation from pedges",
    "graph_approved_nodes": f"""with {CORPUS}, {PROJECTED}, good as (select 'page:' || page_id id, path from corpus where approved),
keep as (select id from good union select id from nodes where id not like 'page:%' and path in (select path from good)
  union select target from pedges where source in (select id from good) and target not like 'page:%') select id, label, kind, path from nodes where id in (select id from keep)""",
    "graph_by_tag": f"with {CORPUS}, {PROJECTED} select source id from pedges where relation = 'tagged' and target = 'tag:en' group by 1",
    "graph_by_source_ref": f"with {CORPUS}, {PROJECTED} select source id from pedges where relation = 'cites' and target = 'source:src1' group by 1",
    "degree_counts": f"with {CORPUS}, {PROJECTED} select coalesce(a.id, b.id) id, coalesce(i, 0) inbound, coalesce(o, 0) outbound from (select target id, count(*) i from pedges where target like 'page:%' group by 1) a full join (select source id, count(*) o from pedges where source like 'page:%' group by 1) b on a.id = b.id",
    "graph_neighborhood": f"with recursive {EDGES}, mv as (select source a, target b from edges union all select target, source from edges), bfs(id, depth) as (select 'customer:1', 0 union select b, depth + 1 from bfs join mv on a = id where depth < 3) select id, min(depth) depth from bfs group by 1",
    "graph_backlinks": f"with recursive {EDGES}, bfs(id, depth) as (select 'nation:3', 0 union select source, depth + 1 from bfs join edges on target = id where depth < 2) select id, min(depth) depth from bfs group by 1",
    "graph_paths": f"with recursive {EDGES}, p(path, at_) as (select ['order:1'], 'order:1' union all select list_append(path, target), target from p join edges on source = at_ where len(path) <= 4 and at_ <> 'region:1' and not list_contains(path, target)) select path, len(path) - 1 length from p where at_ = 'region:1' order by length, path limit 500",
    "manifest": f"with {CORPUS}, {PROJECTED} select count(*) page_count, count(*) filter (where approved) approved_count, arg_min(path, page_ord) filter (where role = 'hot') hot_path, arg_min(path, page_ord) filter (where role = 'index') index_path, arg_min(path, page_ord) filter (where role = 'overview') overview_path, (select count(*) from nodes) node_count, (select count(*) from pedges) edge_count from corpus",
    "source_refs": f"with {CORPUS} select lower({SLUG.format('source_refs')}) id, source_refs as label, list(path order by page_ord) linked_pages, list(page_id order by page_ord) linked_page_ids, count(*) n_pages from corpus where approved and source_refs is not null group by source_refs",
    "read_page": f"with {CORPUS} select page_id, path, title, role from corpus where page_id = '7' order by page_ord limit 1",
    "sensitive_docs": f"select doc_id, coalesce(replace(lower(trim(text)), '-', '_') in {guidance.SENSITIVE_ALONE} or regexp_matches(text, '{SENSITIVE}'), false) is_sensitive from documents",
    "hit_counters": f"with recursive {HITS} select page_key, round(counter, 4) counter, round(last_hit, 3) last_hit from state",
    "usage_priors": f"with recursive {HITS}, n as (select max(last_hit) now from state), d as (select page_key, least({usage.CAP}, counter * pow(0.5, greatest(0, now - last_hit) / {usage.HALF_LIFE})) c from state, n) select page_key, round(c, 4) counter, round({usage.BOOST} * least(c, {usage.CAP}) / {usage.CAP}, 6) boost from d where c > {usage.FLOOR}",
    "orientation_scores": f"""with {CORPUS}, {PROJECTED}, i as (select target id, count(*) i from pedges where target like 'page:%' group by 1), o as (select source id, count(*) o from pedges where source like 'page:%' group by 1)
select page_id, path, round(2.0 * coalesce(i, 0) + 0.4 * coalesce(o, 0) + 0.5 * (source_refs is not null)::int + 1.0 / len(string_split(path, '/')), 6) score from corpus left join i on i.id = 'page:' || page_id left join o on o.id = 'page:' || page_id""",
    "eval_per_query": f'''{BASE}, {QRELS}, {EVAL} select query_id, round(ndcg, 8) ndcg, round(recall, 8) recall, hit, round(mrr, 8) mrr, round("precision", 8) "precision", round(map_all, 8) map_all, round(map_k, 8) map_k from pq''',
    "eval_by_class": f"{BASE}, {QRELS}, {EVAL}, c as (select *, 'class' || (query_id % 3) as class from pq) select coalesce(class, 'all') as class, count(*) n_queries, round(avg(ndcg), 8) ndcg, round(avg(recall), 8) recall, round(avg(hit), 8) hit, round(avg(mrr), 8) mrr from c group by grouping sets ((class), ())",
    "percentiles": "select event_type, quantile_disc(value, 0.5) disc_50, quantile_cont(value, 0.5) cont_50, quantile_disc(value, 0.95) disc_95, quantile_cont(value, 0.95) cont_95 from events group by 1",
    "validate_refs": "select 'label' kind, doc_id id from labels where doc_id not in (select doc_id from documents) union all select 'embedding', vec_id from embeddings where vec_id not in (select doc_id from documents) union all select 'duplicate', doc_id from documents group by 2 having count(*) > 1",
    "folder_cards": f"""with {CORPUS}, f as (select regexp_extract(path, '^(.*)/', 1) folder, page_ord, page_id, lower(tags) term, tags from corpus), t as (select folder, term, count(*) n from f where term is not null and length(term) >= 2 group by 1, 2),
r as (select *, row_number() over (partition by folder order by n desc, term) k from t) select folder path, (select count(*) from f where f.folder = g.folder) page_count, (select list(term order by k) from r where r.folder = g.folder and k <= 8) terms from (select distinct folder from f) g""",
    "query_dispatch": f"{BASE}, h as (select *, row_number() over (order by {ROLE_RANK}, path) rank from corpus) select {COLS} from {top('whole', 8)} union all select q, page_id, path, role, round(1.0::double - (rank - 1) * 0.01::double, 4), rank from h, (values (-1), (-2)) v(q) where rank <= 8",
    "result_fields": f"{BASE}, {SHOWN} select query_id, rank, page_id, path, title, snippet from shown",
    "context_pack": f"{BASE}, {SHOWN} select query_id, (select count(*) from shown y where y.query_id = x.query_id) n_evidence, (select list(page_id order by {ROLE_RANK}, path) from corpus where role <> 'topic') orientation, rank, page_id, score, title, snippet from shown x",
    "tie_band_rerank": f"""with recursive {CORPUS}, {QUERIES}, {bm25()}, {HITS}, now as (select max(last_hit) now from state),
bo as (select page_key page_id, {usage.BOOST} * least(c, {usage.CAP}) / {usage.CAP} boost from (select page_key, least({usage.CAP}, counter * pow(0.5, greatest(0, now - last_hit) / {usage.HALF_LIFE})) c from state, now) where c > {usage.FLOOR}),
rr as (select t.*, least(greatest(coalesce(boost, 0), 0), 0.05) b from {top('whole', 30)} t left join bo using (page_id)),
bands(query_id, rank, top, band) as (select query_id, rank, score, 0 from rr where rank = 1 union all select rr.query_id, rr.rank, case when top - score > 0.05 then score else top end, case when top - score > 0.05 then band + 1 else band end from bands join rr on rr.query_id = bands.query_id and rr.rank = bands.rank + 1)
select rr.query_id, page_id, path, role, score, row_number() over (partition by rr.query_id order by band, score + b desc, score desc, {ROLE_RANK}, path) rank from rr join bands on bands.query_id = rr.query_id and bands.rank = rr.rank""",
    "content_signature": f"with {CORPUS}, e as (select path, path || chr(9) || sha256(text) l from corpus), p as (select left(sha256(path), 4) b, sha256(array_to_string(list(l order by l), chr(10))) d from e group by 1) select sha256(array_to_string(list(b || chr(9) || d order by b || chr(9) || d), chr(10))) signature from p",
    "quality_gates": f"""{BASE}, {QRELS}, {EVAL}, r5 as (select query_id, coalesce(sum(hit) filter (where rank <= 5), 0) h from need left join sf using (query_id) group by 1),
m as (select count(*) n, avg(h / n_relevant) r5, avg(mrr) mrr, avg(ndcg) ndcg from pq join r5 using (query_id) join need using (query_id)),
g as (select 'bm25' run_id, unnest([{{'gate': 'recall_at_5', 'value': r5, 'threshold': 0.9::double, 'passed': r5 >= 0.9}}, {{'gate': 'mrr', 'value': mrr, 'threshold': 0.75::double, 'passed': mrr >= 0.75}}, {{'gate': 'ndcg_at_10', 'value': ndcg, 'threshold': 0.85::double, 'passed': ndcg >= 0.85}},
  {{'gate': 'citation_precision', 'value': null, 'threshold': 0.95::double, 'passed': false}}, {{'gate': 'citation_recall', 'value': null, 'threshold': 0.85::double, 'passed': false}}, {{'gate': 'negative_false_positive_rate', 'value': null, 'threshold': 0.05::double, 'passed': false}}]) x from m
  union all select run_id, unnest([{{'gate': 'query_count', 'value': n::double, 'threshold': 50.0::double, 'passed': n >= 50}}, {{'gate': 'judged_query_count', 'value': n::double, 'threshold': 50.0::double, 'passed': n >= 50}}]) from m, (values ('bm25'), ('telemetry')) v(run_id))
select run_id, x.gate, round(x.value, 8) "value", x.threshold, x.passed from g""",
    "context_whole": f"""with recursive {CORPUS}, {QUERIES}, {PROJECTED}, seen as (select * from corpus where approved),
asked as (select query_id, query, toks from qs join queries using (query_id) union all select -1, 'zzzzqqq', ['zzzzqqq']), {bm25('seen', 'asked')},
h as (select role, min(path) path from seen where role <> 'topic' group by 1),
o as (select c.page_id, row_number() over (order by case when h.path is not null then {ROLE_RANK.replace('role', 'c.role')} else 3 end, {ROLE_RANK.replace('role', 'c.role')}, c.path) rank from seen c left join h on h.role = c.role and h.path = c.path),
good as (select 'page:' || page_id id, path from corpus where approved),
keep as (select id from good union select id from nodes where id not like 'page:%' and path in (select path from good)
  union select target from pedges where source in (select id from good) and target not like 'page:%'),
num as (select (select count(*) from corpus) page_count, (select count(*) from seen) approved_page_count, (select list(page_id order by rank) from o where rank <= 3) orientation, (select least(count(*), 120) from nodes where id in (select id from keep)) n_graph_nodes),
e as (select query_id, count(*) k from {top('whole', 8)} group by 1)
select query_id, query, page_count, approved_page_count, coalesce(k, 0) > 0 answerable, coalesce(k, 0)::bigint n_evidence, orientation,
  concat_ws('|', case when k is null then 'No matching approved page was found.' end, case when page_count > approved_page_count then (page_count - approved_page_count)::varchar || ' draft or unapproved page(s) were withheld.' end) limitations, n_graph_nodes
from asked left join e using (query_id), num""",
    "graph_around": f"""with {EDGES}, seeds as (select 'customer:1' id, 0 place union all select 'nation:3', 1),
m as (select *, row_number() over (order by place, side, source, target, relation) k from (
  select place, 0 side, source, target, relation, target other from edges join seeds on source = id union all select place, 1, source, target, relation, source from edges join seeds on target = id)),
n as (select k, count(*) filter (where new) over (order by k) + 2 met from (select k, other not in (select id from seeds) and k = min(k) over (partition by other) new from m)),
seen as (select m.* from m where k <= coalesce((select min(k) from n where met >= 40), 1000000000)),
each as (select source, target, relation, min(k) k from seen group by all)
select * from (select row_number() over (order by k) place, source, target, relation from each) where place <= 40""",
    "graph_neighbors": f"with {EDGES}, m as (select target id, source, target, relation, 0 side from edges where source = 'nation:3' union all select source, source, target, relation, 1 from edges where target = 'nation:3'), f as (select id, min((source, target, relation, side)) k from m where id <> 'nation:3' group by 1) select 'nation:3' id, 0 depth, 0 place union all select id, 1, place from (select id, row_number() over (order by k) place from f) where place < 500",
    "managed_orientation": f"""with {CORPUS}, {PROJECTED}, i as (select target id, count(*) i from pedges where target like 'page:%' group by 1), o as (select source id, count(*) o from pedges where source like 'page:%' group by 1),
l as (select page_id, path, {CLEAN.format('text')} t, row_number() over (order by 2.0::double * coalesce(i, 0) + 0.4::double * coalesce(o, 0) + 0.5::double * (source_refs is not null)::int + 1.0::double / len(string_split(path, '/')) desc, path) rank from corpus left join i on i.id = 'page:' || page_id left join o on o.id = 'page:' || page_id where role = 'topic')
select page_id, path, round(1.0::double - (rank - 1) * 0.01::double, 4) score, case when len(t) <= 160 then t else rtrim(left(t, 159)) || '...' end snippet, rank from l where rank <= 3""",
    "corpus_bundle": f"with {CORPUS} select page_id || '-' || left(sha256(path), 10) corpus_id, title, path source_path, sha256(text) sha256 from corpus where approved",
    "page_summaries": f"with {CORPUS} select page_id, summary, regexp_extract_all(text, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1)[1:40] headings from corpus",
}
