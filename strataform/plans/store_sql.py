"""SQL counterparts (DuckDB) of the queries in store.py."""

from __future__ import annotations

#: Fixed value: the white space of the ends of keys, as in functions.clean.
_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8195)||chr(8201)||chr(8239)||chr(12288)"


def key(c: str) -> str:
    return f"nullif(lower(trim({c}, {_WS})), '')"


_SNAPS = f"""snaps as (
  select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, min(created_at) as created_at
  from snapshot_meta group by 1, 2)"""

_CLAIMS = f"""claims as (
  select * from (
    select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, {key('claim_id')} as claim_id,
      nullif(upper(trim(status, {_WS})), '') as status, cast(floor(confidence * 100 + 0.5) as int) as confidence,
      evidence_ids, superseded_by, contradiction_ids,
      row_number() over (partition by {key('snapshot_id')}, {key('claim_id')} order by loaded_at desc) as rn
    from brain_claims)
  where rn = 1 and claim_id is not null)"""


def _held(table: str, column: str) -> str:
    return f"""select s.project_id, s.snapshot_id, s.created_at, {key('t.' + column)} as id from {table} t
      join snaps s on s.project_id = {key('t.project_id')} and s.snapshot_id = {key('t.snapshot_id')}"""


P1_FOUND = f"""with {_SNAPS}, {_CLAIMS}, refs as (
  select distinct s.*, c.claim_id, c.ref_field, {key('c.ref_id')} as ref_id from (
    select project_id, snapshot_id, claim_id, 'evidence_ids' as ref_field, unnest(evidence_ids) as ref_id from claims
    union all select project_id, snapshot_id, claim_id, 'superseded_by', superseded_by from claims
    union all select project_id, snapshot_id, claim_id, 'contradiction_ids', unnest(contradiction_ids) from claims) c
  join snaps s using (project_id, snapshot_id)),
held as (
  select distinct 'evidence_ids' as ref_field, * from ({_held('brain_evidence', 'evidence_id')})
  union all select distinct 'superseded_by', * from ({_held('brain_claims', 'claim_id')})
  union all select distinct 'contradiction_ids', * from ({_held('brain_contradictions', 'contradiction_id')}))
select r.ref_field, r.snapshot_id, r.claim_id, r.ref_id,
  case when bool_or(h.created_at < r.created_at) then 'deleted' when bool_or(h.created_at > r.created_at) then 'late' else 'missing' end as reason,
  strftime(any_value(r.created_at), '%Y-%m') as period
from refs r left join held h on h.project_id = r.project_id and h.ref_field = r.ref_field and h.id = r.ref_id
where r.ref_id is not null
group by 1, 2, 3, 4 having not coalesce(bool_or(h.snapshot_id = r.snapshot_id), false)"""

P1_REPORT = f"select ref_field, period, reason, count(*) as n_refs, count(distinct ref_id) as n_keys from ({P1_FOUND}) group by 1, 2, 3"


def _edges(table: str, column: str) -> str:
    return f"""select '{table}' as edge_table, {key(column)} as key_name, edge_id, max(confidence) as confidence, max(discovered_at) as discovered_at
      from {table} where {key(column)} is not null and edge_id is not null group by 1, 2, 3"""


_EDGES = f"{_edges('dependency_matches', 'dep_to')} union all {_edges('relationship_matches', 'rel_target')}"

P2_FOUND = f"""select edge_table, key_name, edge_id from ({_EDGES})
qualify row_number() over (partition by edge_table, key_name order by confidence desc nulls last, discovered_at desc nulls last, edge_id) <= 3"""

# The join itself, row by row, is what the query avoids.
P2_PAIRS = f"""with d as ({_edges('dependency_matches', 'dep_to')}), r as ({_edges('relationship_matches', 'rel_target')})
select key_name, count(distinct d.edge_id) as n_dependencies, count(distinct r.edge_id) as n_relationships, count(*) as pairs,
  count(d.confidence * r.confidence) as measured_pairs,
  cast(floor(sum(cast(d.confidence as decimal(12,8)) * cast(r.confidence as decimal(12,8))) * 100 + cast('0.5' as decimal(2,1))) as double) / 100 as confidence_product
from d join r using (key_name) group by 1"""

_CHAIN = f"""chain as (
  select s.*, row_number() over (partition by project_id order by created_at) as seq
  from snaps s where exists (select 1 from claims c where c.project_id = s.project_id and c.snapshot_id = s.snapshot_id)),
rows_ as (select c.project_id, h.snapshot_id, h.seq, c.claim_id, c.status, c.confidence from claims c join chain h using (project_id, snapshot_id))"""

P4_FOUND = f"""with {_SNAPS}, {_CLAIMS}, {_CHAIN}
select n.snapshot_id, n.claim_id, case when o.claim_id is null then 'added' else 'changed' end as change_kind
from rows_ n left join rows_ o on o.project_id = n.project_id and o.claim_id = n.claim_id and o.seq = n.seq - 1
where n.seq > 1 and (o.claim_id is null or o.status is distinct from n.status or o.confidence is distinct from n.confidence)
union all
select h.snapshot_id, o.claim_id, 'removed' from rows_ o join chain h on h.project_id = o.project_id and h.seq = o.seq + 1
where not exists (select 1 from rows_ n where n.project_id = o.project_id and n.claim_id = o.claim_id and n.seq = o.seq + 1)"""

P4_STALE_HASHES = f"""with {_SNAPS}, {_CLAIMS}, {_CHAIN},
hashes as (select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, max({key('content_hash')}) as h from snapshot_meta group by 1, 2),
stale as (select snapshot_id from (select c.snapshot_id, h.h, lag(h.h) over (partition by c.project_id order by c.seq) as before
  from chain c join hashes h using (project_id, snapshot_id)) where h = before)
select snapshot_id, count(*) filter (change_kind = 'added') as n_added, count(*) filter (change_kind = 'removed') as n_removed,
  count(*) filter (change_kind = 'changed') as n_changed
from ({P4_FOUND}) f join stale using (snapshot_id) group by 1"""

_EVENTS = f"""ev as (
  select * from (
    select *, row_number() over (partition by project_id, claim_id, eff order by loaded_at desc nulls last, update_id desc) as rn
    from (
      select {key('project_id')} as project_id, {key('claim_id')} as claim_id, coalesce({key('op')} = 'purge', false) as purge,
        nullif(upper(trim(status, {_WS})), '') as status, {key('superseded_by')} as superseded_by, loaded_at, update_id,
        coalesce(case when coalesce({key('op')}, '') <> 'purge' and upper(trim(status, {_WS})) in ('INVALIDATED', 'SUPERSEDED') then invalidated_at end,
          updated_at, created_at) as eff
      from claim_updates)
    where eff is not null and project_id is not null and claim_id is not null)
  where rn = 1)"""


def _spans(attributes: str, columns: str) -> str:
    return f"""select *, lead(eff) over (partition by project_id, claim_id order by eff) as until from (
      select *, row({attributes}) is distinct from lag(row({attributes})) over w or purge is distinct from lag(purge) over w as moves
      from (select project_id, claim_id, eff, purge, {columns} from ev) window w as (partition by project_id, claim_id order by eff))
    where moves"""


_STAMP = "coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"

P5_FOUND = f"""with {_EVENTS}
select project_id, claim_id, status, {_STAMP.format(c='eff')} as valid_from, {_STAMP.format(c='until')} as valid_to
from ({_spans('status, superseded_by', 'case when not purge then status end as status, case when not purge then superseded_by end as superseded_by')}) where not purge"""

P5_INTERVALS = f"""with {_EVENTS} """ + " union all ".join(
    f"""select project_id, claim_id, '{a}' as attribute, {a} as value, {_STAMP.format(c='eff')} as valid_from, {_STAMP.format(c='until')} as valid_to
from ({_spans(a, f'case when not purge then {a} end as {a}')}) where not purge"""
    for a in ("status", "superseded_by")
)

P3_CLAIMS = """with v as (
  select export_id, case when json_type(payload, '$.brain') = 'OBJECT' then json_extract(payload, '$.brain') else cast(payload as json) end as b
  from brain_exports where json_valid(payload)),
c as (select export_id, json_extract(b, '$.claims') as c from v),
e as (select export_id, unnest(range(cast(json_array_length(c) as bigint))) as pos, c from c where json_type(c) = 'ARRAY'
  union all select export_id, 0, json_array(c) from c where json_type(c) not in ('ARRAY', 'NULL')),
r as (select export_id, pos, json_extract(c, '$[' || pos || ']') as r from e)
select export_id, pos, json_extract_string(r, '$.id') as id, json_extract_string(r, '$.subject') as subject, json_extract_string(r, '$.predicate') as predicate,
  json_extract_string(r, '$.object') as claim_object, json_extract_string(r, '$.status') as status,
  coalesce(json_extract_string(r, '$.createdAt'), json_extract_string(r, '$.created_at')) as created_at
from r where json_type(r) <> 'NULL'"""


#: The brain and the model of every export that holds one.
DOCS = """raw as (
  select export_id, case when json_type(payload, '$.brain') = 'OBJECT' then json_extract(payload, '$.brain') else cast(payload as json) end as b
  from brain_exports where json_valid(payload)),
docs as (select export_id, b, case json_type(b, '$.model') when 'VARCHAR' then try_cast(json_extract_string(b, '$.model') as json) else json_extract(b, '$.model') end as m
  from raw where json_type(b) = 'OBJECT')"""
_MANY = "case when json_type({v}) = 'ARRAY' then cast({v} as json[]) when json_type({v}) is null or json_type({v}) = 'NULL' then [] else [{v}] end"


def records(source: str, camel: str) -> str:
    """export_id, i, r: the elements of a collection with their places, null ones too."""
    return f"""select export_id, unnest(generate_series(0, len(l) - 1)) as i, unnest(l) as r
      from (select export_id, {_MANY.format(v=f"json_extract({source}, '$.{camel}')")} as l from docs)"""


def flat(source: str, camel: str, fields: dict[str, str]) -> str:
    """A flat table of a collection; fields as in nested.flat_table."""
    one = lambda c: f"try_cast(json_extract_string(r, '$.{c.removesuffix(':double')}') as double)" if c.endswith(":double") else f"json_extract_string(r, '$.{c}')"
    return f"select export_id, cast(i as bigint) as pos, {', '.join(f'{one(c)} as {n}' for n, c in fields.items())} from ({records(source, camel)}) where json_type(r) <> 'NULL'"


def _walk(entity: str, source: str, camel: str, children: dict[str, tuple[str, ...]]) -> str:
    """Rows of one collection and of the strings below it."""
    many, elements = _MANY, records(source, camel)
    out = [f"select export_id, '{entity}' as entity, -1 as parent_pos, i as pos, coalesce(json_extract_string(r, '$.id'), '') as item from ({elements}) where json_type(r) <> 'NULL'"]
    for child, names in children.items():
        value = "coalesce(" + ", ".join(f"nullif(json_extract(r, '$.{n}'), 'null')" for n in names) + ")"
        below = f"select export_id, i, unnest(generate_series(0, len(l) - 1)) as j, unnest(l) as x from (select export_id, i, {many.format(v='x')} as l from (select export_id, i, {value} as x from ({elements})))"
        out.append(f"select export_id, '{child}', i, j, json_extract_string(x, '$') from ({below}) where json_type(x) <> 'NULL'")
    return " union all ".join(out)


P3_FOUND = (
    f"with {DOCS} "
    + " union all ".join(
        [
            _walk("domain", "m", "domains", {"domain_path": ("paths",)}),
            _walk("entrypoint", "m", "entrypoints", {}),
            _walk("dependency", "m", "dependencies", {"dependency_evidence": ("evidence",)}),
            _walk("relationship", "m", "relationships", {}),
            _walk("architecture", "m", "architectures", {"architecture_rule": ("matchedRules", "matched_rules")}),
            _walk("component", "b", "components", {"component_dependency": ("dependencyIds", "dependency_ids"), "component_evidence": ("evidenceIds", "evidence_ids")}),
            _walk("claim", "b", "claims", {"claim_evidence": ("evidenceIds", "evidence_ids"), "claim_contradiction": ("contradictionIds", "contradiction_ids")}),
            _walk("evidence", "b", "evidence", {}),
        ]
    )
)

P3_DOMAINS = f"with {DOCS} {flat('m', 'domains', {'id': 'id', 'name': 'name', 'confidence': 'confidence:double'})}"
P3_ENTRYPOINTS = f"with {DOCS} {flat('m', 'entrypoints', {'id': 'id', 'framework': 'framework', 'file': 'file', 'confidence': 'confidence:double'})}"
P3_DEPENDENCIES = f"with {DOCS} {flat('m', 'dependencies', {'id': 'id', 'source': 'from', 'target': 'to', 'type': 'type', 'confidence': 'confidence:double'})}"
P3_RELATIONSHIPS = f"with {DOCS} {flat('m', 'relationships', {'id': 'id', 'source': 'source', 'target': 'target', 'relationship': 'relationship', 'strength': 'strength', 'confidence': 'confidence:double'})}"
P3_ARCHITECTURES = f"with {DOCS} {flat('m', 'architectures', {'id': 'id', 'pattern': 'pattern', 'confidence': 'confidence:double'})}"
P3_COMPONENTS = f"with {DOCS} {flat('b', 'components', {'id': 'id', 'type': 'type', 'name': 'name', 'path': 'path', 'owner': 'owner'})}"
P3_EVIDENCE = f"with {DOCS} {flat('b', 'evidence', {'id': 'id', 'kind': 'kind', 'locator': 'locator', 'epistemics': 'epistemics'})}"
