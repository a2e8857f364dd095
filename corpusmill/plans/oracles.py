"""DuckDB SQL for the registered queries, written from the semantics, not from the Spark plans."""

from __future__ import annotations

PUNCT = r"'[!-/:-@\[-`{-~]'"


def _norm(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), {PUNCT}, '', 'g'), '\\s+'), lambda t: t not in ('a', 'an', 'the', '')), ' ')"


def _loose(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(lower(regexp_replace(coalesce({x}, ''), {PUNCT}, ' ', 'g')), '\\s+'), lambda t: t <> ''), ' ')"


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda t: t <> '')"


def _often(a: str, x: str) -> str:
    return f"len(list_filter({a}, lambda y: y = {x}))"


def _common(p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({p}, {g})), lambda x: least({_often(p, 'x')}, {_often(g, 'x')}))), 0)"


VECTORS = "v as (select vec_id, label, cast(embedding as double[]) e from embeddings)"
HITS = f"""{VECTORS},
scored as (select q.vec_id query_id, d.vec_id doc_id, d.label, list_cosine_similarity(q.e, d.e) s from v q, v d where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) rank from scored),
hits as (select query_id, doc_id, s similarity_score, rank, case when label % 2 = 0 then 'ontology_summary' else 'original_document' end doc_type from ranked where rank <= 15)"""
NEAR = f"{VECTORS}, near as (select a.vec_id i, b.vec_id j from v a, v b where a.vec_id < b.vec_id and list_cosine_similarity(a.e, b.e) > 0.3)"

ANSWERS = r"""said as (select conv_id, turn, text from conversations where role = 'assistant'),
pairs as (select a.conv_id, a.turn, replace(replace(a.text, '|', ' '), chr(10), ' ') output, replace(b.text, '|', ' ') answer, a.text output_raw, b.text answer_raw from said a join said b on a.conv_id = b.conv_id and b.turn = a.turn + 2)"""


def _scores(pairs: str = "pairs", keys: str = "conv_id, turn") -> str:
    return f"""normed as (select {keys}, answer raw, {_norm("output")} p, {_norm("answer")} g from {pairs}),
cut as (select *, list_filter(string_split(p, ' '), lambda t: t <> '') pt, list_filter(string_split(g, ' '), lambda t: t <> '') gt,
  list_distinct(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]{{3,}}')) pw, list_distinct(regexp_extract_all(g, '[\\p{{L}}\\p{{N}}_]{{3,}}')) gw from normed),
counted as (select *, case when p <> g and (p in ('yes', 'no', 'noanswer') or g in ('yes', 'no', 'noanswer')) then 0 else {_common("pt", "gt")} end same from cut),
scores as (select {keys}, same, case when same > 0 then same / len(pt) else 0 end::double as prec, case when same > 0 then same / len(gt) else 0 end::double as rec, (p = g)::int em,
  case when p = g or contains(p, g) or contains(g, p)
    or (contains(raw, '-') and len(string_split(raw, '-')) <= 3 and len(list_filter(list_transform(string_split(raw, '-'), lambda x: {_norm("x")}), lambda y: y <> '' and not contains(p, y))) = 0)
    or (list_has_any(pw, gw) and (len(pw) <= 3 or len(gw) <= 3))
    or list_has_any(regexp_extract_all(p, '\\p{{Nd}}+'), regexp_extract_all(g, '\\p{{Nd}}+')) then 1 else 0 end accuracy from counted),
final as (select *, case when same > 0 then 2 * prec * rec / (prec + rec) else 0 end f1 from scores)"""


RESPONSES = """nations as (select n_nationkey k, n_name, r_name, case when n_nationkey % 5 = 0 then 'is related to' else 'located in' end verb from nation join region on n_regionkey = r_regionkey),
raws as (
  select k::bigint cluster_id, case when n_nationkey_bad then 'a relationship is malformed' end error, n_name as name, 'A nation' description, n_name || ' -> ' || verb || ' -> ' || r_name relation, 'OTHER' as type, n_name s, verb p, r_name o
  from (select *, verb = 'is related to' n_nationkey_bad from nations)
  union all
  select p_partkey + 1000, case when p_partkey % 13 = 0 then 'not a JSON object' when p_partkey % 11 = 0 then 'a name or description is missing' when p_name = p_type then 'a relationship is malformed' end,
    p_name, 'A part', p_name || ' -> is type of -> ' || p_type, 'TYPE', p_name, 'is type of', p_type from part),
good as (select * from raws where error is null)"""


def _pascal(x: str) -> str:
    return f"list_reduce(list_prepend('', list_transform(list_filter(string_split_regex(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s\\-]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:]))), lambda a, b: a || b)"


EDGES = f"edges as (select {_pascal('s')} subject, case when type = 'TYPE' then 'subClassOf' else 'locatedIn' end predicate, {_pascal('o')} object, type rel_type from good)"
CLASSES = f"""classes as (select {_pascal('name')} as name, 'A' || description[2:] as description, name original, cluster_id from good),
defined as (select name, arg_max(description, struct_pack(l := length(description), o := -cluster_id)) description, arg_min(original, cluster_id) original_name, count(*)::bigint document_count, min(cluster_id)::int cluster_id from classes group by name)"""
TURTLE_CLASS = """'mill:' || name || ' rdf:type owl:Class ;' || chr(10) || '    rdfs:label "' || original_name || '" ;' || chr(10) || '    rdfs:comment "' || description || '" ;' || chr(10) || '    mill:documentCount ' || document_count || ' ;' || chr(10) || '    mill:clusterId ' || cluster_id || ' .'"""
INFERRED = "inferred as (select distinct name from (select subject as name from edges union all select object from edges) where name not in (select name from defined))"

GRAM = lambda a, n: f"case when len({a}) >= {n} then list_transform(range(1, len({a}) - {n} + 2), lambda i: array_to_string({a}[i:i + {n - 1}], ' ')) else []::varchar[] end"


def _dataset(by_report: bool) -> str:
    names = ["musique", "quality", "hotpot", "nq", "triviaqa"] + ([] if by_report else ["test"])
    listed = ", ".join(f"'{n}'" for n in names)
    first = "" if by_report else "when starts_with(stem, 'test') then 'test' "
    return f"case {first}when parent in ({listed}) then parent {' '.join(f'''when contains(stem, '{n}') then '{n}' ''' for n in names)} else {'''string_split(stem, '_')[1]''' if by_report else '''\'unknown\''''} end"


#: Fixed lines of a Turtle file: public prefixes, and the properties that every class has.
TURTLE_FIXED = "values " + ", ".join(
    f"({section}, '{line}')"
    for section, line in [
        *((0, f"@prefix {p}: <{u}> .") for p, u in [("mill", "http://example.org/concepts#"), ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"), ("owl", "http://www.w3.org/2002/07/owl#"), ("xsd", "http://www.w3.org/2001/XMLSchema#")]),
        (0, ""),
        (0, "<http://example.org/concepts> rdf:type owl:Ontology ."),
        *((2, f'mill:{n} rdf:type owl:DatatypeProperty ;\n    rdfs:label "{label}" ;\n    rdfs:range xsd:{kind} .') for n, label, kind in [("documentCount", "document count", "integer"), ("clusterId", "cluster id", "integer"), ("generatedFrom", "generated from", "string"), ("clusterCount", "cluster count", "integer"), ("ontologyCount", "ontology count", "integer")]),
    ]
)


def _side(name: str, side: str, end: str) -> str:
    return f"""case when len({side}) = 1 then '    rdfs:{name} mill:' || {side}[1] || ' {end}' else '    rdfs:{name} [ rdf:type owl:Class ; owl:unionOf ( ' || array_to_string(list_transform({side}, lambda x: 'mill:' || x), ' ') || ' ) ] {end}' end"""


ORACLE_SQL = {
    "knn_topk": f"with {HITS} select query_id, doc_id, round(similarity_score, 6) similarity_score, rank from hits",
    "retrieval_summary": f"""with {HITS} select query_id, count(*) total_retrieved, count(*) filter (doc_type = 'ontology_summary') ontology_count, count(*) filter (doc_type <> 'ontology_summary') original_count,
        round(avg(similarity_score), 6) avg_similarity, round(min(similarity_score), 6) min_similarity, round(max(similarity_score), 6) max_similarity from hits group by query_id""",
    "retrieval_stats": f"""with {HITS}, t as (select count(distinct query_id) q, count(*) n, count(*) filter (doc_type = 'ontology_summary') s from hits)
        select q total_queries, n total_retrieved, round(n / q, 6) avg_per_query, s total_ontology, n - s total_original, case when n = s then 'infinity'::double else round(s / (n - s), 6) end ontology_ratio from t""",
    "prompt_context": f"""with {HITS} select query_id, string_agg('[' || upper(doc_type) || '] Document ' || h.doc_id || chr(10) || text || chr(10) || '(Relevance: ' || printf('%.3f', round(similarity_score, 6)) || ')', chr(10) || chr(10) order by rank) context
        from hits h join documents d on d.doc_id = h.doc_id group by query_id""",
    "sim_self_join": f"with {NEAR}, ends as (select i vec_id from near union all select j from near), n as (select vec_id, count(*) c from ends group by vec_id) select v.vec_id, coalesce(c, 0) n_links from v left join n on n.vec_id = v.vec_id",
    "leader_dedup": f"""with recursive {NEAR}, before as (select j, list(i) nb from near group by j),
        ids as (select v.vec_id, coalesce(nb, []::bigint[]) nb, row_number() over (order by v.vec_id) rn from v left join before on j = v.vec_id),
        walk(rn, lead) as (select 0::bigint, []::bigint[] union all select ids.rn, case when list_has_any(ids.nb, walk.lead) then walk.lead else list_append(walk.lead, ids.vec_id) end from walk join ids on ids.rn = walk.rn + 1),
        done as (select arg_max(lead, rn) lead from walk)
        select vec_id, coalesce(list_min(list_intersect(nb, lead)), vec_id) leader from ids, done""",
    "name_dedup": "select md5(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) name_key, min(doc_id) first_id, count(*) members from documents group by 1",
    "nearest_centroid": f"""with {VECTORS}, d as (select label, i, avg(e[i]) x from v, range(1, 65) r(i) group by label, i), c as (select label, list(x order by i) c from d group by label),
        s as (select vec_id, c.label cluster_id, list_distance(v.e, c.c) far from v, c), r as (select *, row_number() over (partition by vec_id order by round(far, 9), cluster_id) k from s)
        select vec_id, cluster_id::bigint cluster_id, round(far, 6) distance from r where k = 1""",
    "cluster_stats": "with n as (select label, count(*) n from embeddings group by label) select sum(n)::bigint total_documents, count(*) num_clusters, min(n) min_size, max(n) max_size, round(avg(n), 6) avg_size from n",
    "cluster_hist_zero_fill": "select r.i cluster_id, count(label) n from (select unnest(range(greatest(16, (select max(label) + 1 from embeddings)))) i) r left join embeddings on label = r.i group by r.i",
    "cluster_report": "select source cluster_id, doc_id, length(text) context_length, md5(case when length(text) > 200 then left(text, 200) || '...' else text end) context_preview from documents",
    "normalize_answer": f"select doc_id, md5({_norm('text')}) normalized_md5 from documents",
    "normalize_loose": f"select doc_id, md5({_loose('text')}) normalized_md5 from documents",
    "token_count": f"select doc_id, len({_tokens('text')}) n_tokens from documents",
    "sentence_chunks": rf"""with s as (select doc_id, text, len({_tokens('text')}) n, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') pieces from documents),
        sized as (select doc_id, list_transform(pieces, lambda x: struct_pack(done := []::varchar[][], cur := []::varchar[], n := 0::bigint, s := x, k := len({_tokens('x')})::bigint)) sized from s where n > 150),
        packed as (select doc_id, list_reduce(list_prepend(struct_pack(done := []::varchar[][], cur := []::varchar[], n := 0::bigint, s := '', k := 0::bigint), sized), lambda a, x:
          struct_pack(done := case when a.n + x.k > 500 and a.n >= 300 then list_append(a.done, a.cur) else a.done end, cur := case when a.n + x.k > 500 and a.n >= 300 then [x.s] else list_append(a.cur, x.s) end,
            n := case when a.n + x.k > 500 and a.n >= 300 then x.k else a.n + x.k end, s := '', k := 0::bigint)) st from sized),
        made as (select doc_id, case when len(st.cur) > 0 then list_append(st.done, st.cur) else st.done end chunks from packed),
        every as (select doc_id, true whole, 1 parts, 0 part, text context from s where n <= 150 union all select doc_id, false, len(chunks), i - 1, array_to_string(chunks[i], ' ') from made, lateral (select unnest(range(1, len(chunks) + 1)) i))
        select doc_id, part::int part, parts::int parts, 'Document ' || doc_id || case when whole then '' else ' - Part ' || (part + 1) end title, md5(context) context_md5, part = 0 is_supporting from every""",
    "written_relations": "select p_partkey, case when p_partkey % 4 = 0 then null else p_name || ' -> is type of -> ' || p_type end relation, case when p_partkey % 4 = 0 then null else 'TYPE' end as type from part",
    "qa_accuracy": f"with {ANSWERS}, {_scores()} select conv_id, turn, accuracy from final",
    "qa_f1": f"with {ANSWERS}, {_scores()} select conv_id, turn, round(f1, 6) f1, round(prec, 6) as precision, round(rec, 6) recall from final",
    "qa_em": f"with {ANSWERS}, {_scores()} select conv_id, turn, em from final",
    "qa_metric_means": f"with {ANSWERS}, {_scores()} select count(*) n, round(100 * avg(accuracy), 6) accuracy, round(100 * avg(f1), 6) f1, round(100 * avg(prec), 6) as precision, round(100 * avg(rec), 6) recall, round(100 * avg(em), 6) em, sum(accuracy)::bigint correct_answers from final",
    "qa_fallback": rf"""with {ANSWERS}, t as (select {_loose('output_raw')} p, {_loose('answer_raw')} g, answer_raw raw, output_raw o from pairs),
        r as (select case when raw = '' or o = '' then false else contains(p, g) or contains(g, p)
          or (contains(raw, '-') and len(string_split(raw, '-')) <= 3 and len(list_filter(list_transform(list_filter(string_split(raw, '-'), lambda y: trim(y) <> ''), lambda y: {_loose('y')}), lambda y: not contains(p, y))) = 0)
          or ((contains(raw, ' - ') or contains(raw, '–')) and len(string_split_regex(raw, '\s*[-–]\s*')) = 2 and len(list_filter(list_transform(string_split_regex(raw, '\s*[-–]\s*'), lambda y: {_loose('y')}), lambda y: contains(p, y))) > 0) end ok from t)
        select count(*) n, round(100 * avg(ok::int), 6) accuracy from r""",
    "bleu": f"""with {ANSWERS}, t as (select conv_id, turn, {_tokens('output_raw')}p, {_tokens('answer_raw')}g from pairs),
        n as (select *, {", ".join(f"{GRAM('p', k)} p{k}, {GRAM('g', k)} g{k}" for k in (1, 2, 3, 4))} from t),
        c as (select *, {", ".join(f"{_common(f'p{k}', f'g{k}')}::double c{k}, greatest(len(p{k}), 1) n{k}" for k in (1, 2, 3, 4))} from n),
        b as (select *, case when len(p) > len(g) then 0 else 1 - len(g) / len(p) end brevity from c)
        select conv_id, turn, case when c1 > 0 then round(exp(brevity + ln(c1 / n1)), 6) else 0 end bleu_1, case when c1 > 0 and c4 > 0 then round(exp(brevity + ln(c4 / n4)), 6) else 0 end bleu_4,
          case when c1 > 0 and c2 > 0 and c3 > 0 and c4 > 0 then round(exp(brevity + (ln(c1 / n1) + ln(c2 / n2) + ln(c3 / n3) + ln(c4 / n4)) / 4), 6) else 0 end bleu,
          case when c1 > 0 then round(exp(brevity + ({" + ".join(f"ln(case when c{k} > 0 then c{k} else 0.1 end / n{k})" for k in (1, 2, 3, 4))}) / 4), 6) else 0 end bleu_smoothed from b""",
    "multi_answer_best": f"""with pairs as (select p_partkey, unnest(string_split(p_name, ' ')) answer, string_split(p_name, ' ')[1] || ' ' || lower(p_type) output from part), {_scores(keys="p_partkey")}
        select p_partkey, max(accuracy) accuracy, round(max(f1), 6) f1, max(em) em from final group by p_partkey""",
    "exact_presence": "select item_id, count(d.doc_id) n_docs from benchmark b left join documents d on contains(d.text, b.text) group by item_id",
    "index_union": """select 'original_document' doc_type, md5(text) content_md5, source title, doc_id::varchar doc_id, null::bigint cluster_id from documents
        union all select 'ontology_summary', md5('rows: ' || count(*)), 'Cluster ' || label || ' Summary', 'summary_' || label, label::bigint from embeddings group by label""",
    "token_intersect_all": f"""with t as (select doc_id, unnest(list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '')) token from documents), c as (select doc_id, token, count(*) n from t group by all)
        select a.doc_id, sum(least(a.n, b.n))::bigint common from c a join c b on b.doc_id = a.doc_id + 1 and a.token = b.token group by a.doc_id""",
    "keyword_intersect": f"""with t as (select distinct doc_id, unnest(regexp_extract_all({_norm('text')}, '[\\p{{L}}\\p{{N}}_]{{3,}}')) token from documents)
        select a.doc_id, count(*) common from t a join t b on b.doc_id = a.doc_id + 1 and a.token = b.token group by a.doc_id""",
    "ontology_validate": f"with {RESPONSES} select cluster_id, error from raws",
    "ontology_concepts": f"with {RESPONSES} select cluster_id source_cluster, name, description, relation, type from good",
    "ontology_merge": f"""with {RESPONSES} select lower(trim(name)) as key, arg_min(name, cluster_id) as name, md5(string_agg(description, chr(10) order by cluster_id)) description_md5, count(*)::int n_relationships, count(distinct cluster_id)::int n_clusters, count(*)::int merged_from_count from good group by 1""",
    "ontology_stats": f"with {RESPONSES}, m as (select lower(trim(name)) k, count(*) n from good group by 1) select count(*) total_ontologies, sum(n)::bigint total_relationships, round(avg(n), 6) avg_relationships from m",
    "owl_triples": f"with {RESPONSES}, {EDGES} select subject, predicate, object, rel_type, count(*) n from edges group by all",
    "owl_properties": f"with {RESPONSES}, {EDGES} select predicate, array_to_string(list_sort(list_distinct(list(subject))), ',') domains, array_to_string(list_sort(list_distinct(list(object))), ',') ranges from edges where rel_type <> 'TYPE' group by predicate",
    "owl_classes": f"with {RESPONSES}, {CLASSES} select name, description, original_name, document_count, cluster_id from defined",
    "owl_inferred": f"with {RESPONSES}, {EDGES}, {CLASSES}, {INFERRED} select name, -999 cluster_id, 0::bigint document_count from inferred",
    "turtle_lines": f"""with {RESPONSES}, {EDGES}, {CLASSES}, {INFERRED}
        select 1 section, {TURTLE_CLASS} line from (select * from defined union all select name, name || ' (inferred from a relation)', name, 0, -999 from inferred)
        union all select distinct case when rel_type = 'TYPE' then 4 else 5 end, 'mill:' || subject || case when rel_type = 'TYPE' then ' rdfs:subClassOf' else ' mill:' || predicate end || ' mill:' || object || ' .' from edges
        union all select section, line from ({TURTLE_FIXED}) f(section, line)
        union all select 3, 'mill:' || predicate || ' rdf:type owl:ObjectProperty ;' || chr(10) || '    rdfs:label "' || predicate || '" ;' || chr(10) || {_side("domain", "domains", ";")} || chr(10) || {_side("range", "ranges", ".")}
          from (select predicate, list_sort(list_distinct(list(subject))) domains, list_sort(list_distinct(list(object))) ranges from edges where rel_type <> 'TYPE' group by predicate)""",
    "vector_length": "with v as (select vec_id, cast(embedding as double[]) e from embeddings) select vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) as first, round(sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(e, e)), 6) as length from v",
    "center_similarity": "with v as (select vec_id, label, cast(embedding as double[]) e from embeddings), x as (select label, generate_subscripts(e, 1) i, unnest(e) x from v), m as (select label, i, avg(x) x from x group by label, i), c as (select label, list(x order by i) c from m group by label) select vec_id, v.label cluster_id, round(list_cosine_similarity(e, c), 6) similarity from v join c using (label)",
    "required_keys": f"with {RESPONSES} select cluster_id, true as plain, coalesce(error = 'not a JSON object', false) as full from raws",
    "merge_answers": "select p_partkey, case when p_partkey % 5 = 0 then p_name else 'One ' || p_type end description, case when p_partkey % 5 <> 0 then p_name || ' -> is type of -> ' || p_type end relation from part",
    "strip_punctuation": f"select doc_id, md5(regexp_replace(array_to_string({_tokens('text')}[1:100], ' '), {PUNCT[:-1]}+$', '')) md5 from documents",
    "string_em": f"""with t as (select p_partkey, {_norm("string_split(p_name, ' ')[1] || ' ' || p_type")} n, list_transform(string_split(p_name, ' '), lambda w: {_norm('w')}) a from part),
        h as (select p_partkey, list_transform(a, lambda x: contains(n, x)::int) h from t) select p_partkey, round(list_avg(h), 6) str_em, list_min(h) str_hit from h""",
    "option_match": "select p_partkey, (regexp_extract_all(p_brand, '[0-9]')[1] = regexp_extract_all(p_brand, '[0-9]')[-1])::int em from part",
    "virtual_ids": f"""with {RESPONSES}, m as (select lower(trim(name)) k, arg_min(name, cluster_id) as name, string_agg(description, chr(10) order by cluster_id) d, string_agg('- ' || relation, chr(10) order by cluster_id) r from good group by 1)
        select (-row_number() over (order by k))::int cluster_id, name as ontology_name, md5(name || '：' || d || chr(10) || '关系：' || chr(10) || r) summary_md5 from m""",
    "corpus_signature": "with s as (select doc_id // 20 cluster_id, left(md5('cluster_' || (doc_id // 20) || ':' || string_agg(source || text, '|' order by source || text)), 12) signature from documents group by 1) select md5(string_agg(signature, '||' order by cluster_id)) signature, count(*) clusters from s",
    "xml_escape": """select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) escaped_md5 from pages""",
    "content_signature": "select doc_id // 20 cluster_id, left(md5('cluster_' || (doc_id // 20) || ':' || string_agg(source || text, '|' order by source || text)), 12) signature from documents group by 1",
    "keep_newest": "select event_id, event_type from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r from events) where r > 5",
    "age_filter": "select event_id from events where ts < timestamp '2024-01-20 00:00:00' - interval 7 day",
    "metric_stats": """select count(*) total, count(*) filter (event_type <> 'error') succeeded, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 6) success_rate, round(count(*) / sum(value), 6) per_second,
        round(avg(value) filter (event_type <> 'error'), 6) avg_duration, round(max(value) filter (event_type <> 'error'), 6) max_duration, round(min(value) filter (event_type <> 'error'), 6) min_duration from events""",
    "dataset_name": f"""with n as (select page_id, lower(regexp_extract(url, '([^/]*)$', 1)) name, lower(regexp_extract(url, '([^/]*)/[^/]*$', 1)) parent from pages), s as (select *, regexp_replace(name, '\\.[^.]*$', '') stem from n)
        select page_id, {_dataset(False)} by_index, {_dataset(True)} by_report from s""",
    "class_names": f"""with w as (select p_partkey, {_pascal("p_name || ' - ' || p_brand")} class_id, {_pascal("p_name || ' ' || p_type")} camel from part) select p_partkey, class_id, lower(string_split((select any_value(p_name) from part q where q.p_partkey = w.p_partkey), ' ')[1]) || camel[length(string_split((select any_value(p_name) from part q where q.p_partkey = w.p_partkey), ' ')[1]) + 1:] property_id from w""",
    "source_concepts": "with d as (select doc_id, coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint), -1) c from documents) select r.i cluster_id, count(d.doc_id) n from (select unnest(range(-1, (select max(c) + 1 from d))) i) r left join d on d.c = r.i group by r.i",
    "rebalance_labels": f"""with recursive {VECTORS}, size as (select list(n order by label) sizes, sum(n)::bigint total, count(*)::bigint k from (select label, count(*)::bigint n from v group by label)),
        walk(i, sizes, gone, src, first, last, target) as (
          select 0::bigint, sizes, list_transform(sizes, lambda x: 0::bigint), 0::bigint, 0::bigint, 0::bigint, 0::bigint from size
          union all
          select i + 1, list_transform(range(1, k + 1), lambda j: sizes_now[j] - case when j = c then n else 0 end + case when j = t then n else 0 end), list_transform(range(1, k + 1), lambda j: gone[j] + case when j = c then n else 0 end),
            c, gone[c] + 1, gone[c] + n, t
          from (select *, case when t is null or sizes_now[c] <= low + 1 then 0 else least(sizes_now[c] - low - 1, low - sizes_now[t]) end::bigint n
                from (select w.i, w.gone, w.sizes sizes_now, s.k, greatest(1, s.total // 10) low, (w.i % s.k) + 1 c, list_filter(range(1, s.k + 1), lambda j: w.sizes[j] < greatest(1, s.total // 10))[1] t from walk w, size s where w.i < 10 * s.k))),
        moves as (select src - 1 src, first, last, target - 1 target from walk where i > 0 and last >= first),
        d as (select label, x, avg(e[x]) m from v, range(1, 65) r(x) group by label, x), c as (select label, list(m order by x) c from d group by label),
        ranked as (select vec_id, v.label, row_number() over (partition by v.label order by round(list_distance(v.e, c.c), 9) desc, vec_id) r from v join c on c.label = v.label)
        select vec_id, coalesce(target, label)::bigint cluster_id, target is not null moved from ranked left join moves on src = label and r between first and last""",
}
ORACLE_SQL["running_ids"] = f"select doc_id, part, row_number() over (order by doc_id, part) - 1 idx from ({ORACLE_SQL['sentence_chunks']})"
ORACLE_SQL["retrieval_details"] = f"""with {HITS} select query_id, rank, h.doc_id, round(similarity_score, 6) similarity_score, doc_type = 'ontology_summary' is_ontology_text, source title,
    md5(case when length(text) > 100 then left(text, 100) || '...' else text end) preview_md5 from hits h join documents d on d.doc_id = h.doc_id"""
