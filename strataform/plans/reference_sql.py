"""SQL counterparts (DuckDB) of the queries in reference.py."""

from __future__ import annotations

from strataform.plans import values_sql as V
from strataform.plans.store_sql import _CHAIN, _CLAIMS, _SNAPS, _WS, DOCS, P3_FOUND, flat, key

_ROUND = "floor({x} * 100 + 0.5) / 100"
_MEAN = "coalesce(floor(cast(sum(cast({c} as decimal(12,8))) as double) / nullif(count({c}), 0) * 100 + 0.5) / 100, 0.0)"


def conf(x: str, high: float = 1.0, digits: int = 2) -> str:
    p = 10**digits
    return f"floor(least(greatest({x}, 0.0), cast({high} as double)) * {p}.0 + 0.5) / {p}.0"


def upper(c: str) -> str:
    return f"nullif(upper(trim({c}, {_WS})), '')"


def _last(table: str, columns: dict[str, str]) -> str:
    """An edge table once per edge_id, in the order of the struct that the queries compare."""
    names = ", ".join(f"{x} as {n}" for n, x in columns.items())
    order = ", ".join(f"{n} desc nulls last" for n in ("loaded_at", *columns))
    return f"""(select edge_id, {', '.join(columns)} from (select *, row_number() over (partition by edge_id order by {order}) as rn
      from (select edge_id, loaded_at, {names} from {table} where edge_id is not null)) where rn = 1 and project_id is not null and source is not null and target is not null)"""


D = "deps as " + _last("dependency_matches", {"project_id": key("project_id"), "source": key("dep_from"), "target": key("dep_to"), "type": key("dep_type"), "confidence": "confidence", "evidence": "evidence"})
R = "rels as " + _last(
    "relationship_matches",
    {"project_id": key("project_id"), "source": key("rel_source"), "target": key("rel_target"), "kind": upper("relationship"), "strength": key("strength"), "bidirectional": "bidirectional", "confidence": "confidence", "evidence": "evidence", "target_name": f"trim(rel_target, {_WS})"},
)
L = f"files as (select distinct {key('project_id')} as project_id, locator as path from brain_evidence where locator is not null and locator <> '' and {key('project_id')} is not null)"

FINDINGS = """f as (
  select user_id as repo, event_id as finding_id, event_type as rule_id,
    case when event_type in ('error', 'login') then 'security' when event_type = 'purchase' then 'mcp' else 'context' end as category,
    case event_type when 'error' then 'critical' when 'purchase' then 'warning' else 'info' end as severity,
    concat_ws(':', cast(user_id as varchar), event_type, cast(k as varchar)) as path, list_slice(['claude-code', 'codex', 'cursor'], 1, k % 4) as agents, ts
  from (select *, coalesce(cast(json_extract_string(props, '$.k') as int), 0) as k from events))"""


def _score(severe: str = "count(*) filter (severity = 'critical' and category = 'security')") -> str:
    n = lambda s: f"count(*) filter (severity = '{s}')"
    decay = lambda c: f"case {c} when 0 then 0 when 1 then 100 when 2 then 170 else 220 + ({c} - 3) * 35 end"
    loss = " + ".join(f"({decay(n(s))}) * {p}" for s, p in (("critical", 35), ("warning", 10), ("info", 2)))
    return f"cast(greatest(least(floor((10000 - ({loss}) + 50) / 100.0), case when {severe} >= 2 then 49 when {severe} = 1 then 69 else 100 end), 0) as int)"


_COUNTS = "count(*) filter (severity = 'critical') as n_critical, count(*) filter (severity = 'warning') as n_warning, count(*) filter (severity = 'info') as n_info, count(*) as n_total"
_AGENTS = "(select repo, severity, category, unnest(agents) as agent from f)"
_EVIDENCE = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(evidence, []))))), '|'), '')"
_RANK = "case strength when 'strong' then 3 when 'medium' then 2 when 'weak' then 1 else 0 end"

DEPENDENCY_MERGE = f"select project_id, source, target, type, max(confidence) as confidence, {_EVIDENCE} as evidence from deps where source <> target or type in ('service', 'repository', 'module') group by all"
RELATIONSHIP_MERGE = f"""select project_id, source, target, kind, max(confidence) as confidence, arg_max(strength, {_RANK}) as strength, coalesce(bool_or(bidirectional), false) as bidirectional, {_EVIDENCE} as evidence
  from rels where source <> target group by project_id, source, target, kind"""
FAN_IN = f"""select project_id, target, count(*) as n, case when count(*) >= 6 then 'high' else 'medium' end as severity, {conf('least(0.92, cast(0.5 as double) + count(*) * cast(0.08 as double))')} as confidence
  from deps group by 1, 2 having count(*) >= 3"""
COUPLING = f"""select project_id, target, count(*) as n, case when count(*) >= 8 then 'high' else 'medium' end as severity, {conf('least(0.9, cast(0.48 as double) + count(*) * cast(0.07 as double))')} as confidence
  from (select project_id, unnest([source, target]) as target from rels) group by 1, 2 having count(*) >= 4"""
_CROSS = "('USES', 'CALLS', 'DEPENDS_ON', 'PROVIDES', 'CONSUMES')"


def _matching(kinds=None, source=None, target=None, evidence=None, kind="kind") -> str:
    some = lambda x, needles: "(" + " or ".join(f"contains(lower({x}), '{n.lower()}')" for n in needles) + ")"
    parts = ["true"]
    if kinds:
        parts.append(f"coalesce({kind} in ({', '.join(repr(k) for k in kinds)}), false)")
    if source:
        parts.append(some("source", source))
    if target:
        parts.append(some("target", target))
    if evidence:
        parts.append(some("concat_ws(' ', source, target, array_to_string(evidence, ' '))", evidence))
    return " and ".join(parts)


def _case(pairs, otherwise: str) -> str:
    return "case " + " ".join(f"when {c} then '{v}'" for c, v in pairs) + f" else {otherwise} end"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''").replace(r"\A", "^").replace(r"\z", "$")


_TOKENS = """list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(replace(path, '\\', '/'), '\\.[A-Za-z0-9]+$', ''), '([a-z0-9])([A-Z])', '\\1/\\2', 'g'), '[/_.-]+'), lambda w: lower(w)),
    lambda w: length(w) >= 2 and not list_contains([{stop}], w) and not regexp_matches(w, '^[0-9]+$'))""".replace("{stop}", ", ".join(f"'{w}'" for w in V.STOP_SEGMENTS))
_LEXICON = ", ".join(f"('{w}', '{d}')" for w, d in sorted({w: d for d, ws in reversed(V.DOMAIN_LEXICON.items()) for w in ws}.items()))
_words_of = lambda x: f"list_filter(regexp_split_to_array({x}, '[._\\-/]+'), lambda w: w <> '')"
_pascal = lambda x: f"array_to_string(list_transform({_words_of(x)}, lambda w: upper(w[1:1]) || lower(w[2:])), '')"
_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_SAMPLE = f"""len(list_filter(case when contains(string_split(path, '/')[-1], '.') then string_split(path, '/')[:-2] else string_split(path, '/') end, lambda s:
    list_contains({_list(V.SAMPLE_DIRECTORIES)}, lower(s))
    or (starts_with(s, '_') and list_contains({_list(V.SAMPLE_DIRECTORIES)}, regexp_replace(lower(s), '^_+', '')))
    or (len(list_filter(regexp_split_to_array(lower(s), '[-_]+'), lambda w: w <> '')) >= 2 and list_has_any(regexp_split_to_array(lower(s), '[-_]+'), {_list(V.TEST_WORDS)}))
    or (regexp_matches(s, '[A-Z]') and list_has_any(string_split(lower(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1/\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1/\\2', 'g')), '/'), {_list(V.TEST_WORDS)})))) > 0"""
_ROLE = _case([(f"regexp_matches(lower(path), '{_re(p)}')", r) for r, p in V.ROLES], "'none'")
_hash31 = lambda x: f"lpad(printf('%x', cast(list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split({x}, ''), lambda c: cast(ord(c) as hugeint))), lambda h, c: (h * 31 + c) % 4294967296) as bigint)), 8, '0')"

_ENDS = "[\\s\\pZ\\x{FEFF}\\x{0B}]+"
_FORM = f"""lower(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '^---(?s:.*?)\\n---', ''), chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
    '\\A{_ENDS}|{_ENDS}\\z', '', 'g'))"""



def strip(c: str) -> str:
    return f"trim({c}, {_WS})"


def _glob(p: str) -> str:
    escaped = f"regexp_replace({p}, '[.+^${{}}()|\\[\\]\\\\]', '\\\\\\0', 'g')"
    return f"replace(replace(replace(replace({escaped}, '**', chr(1)), '*', '[^/]*'), '?', '[^/]'), chr(1), '.*')"


_INNER = _glob("regexp_replace(regexp_replace(pattern, '^/', ''), '/$', '')")
_OWNED = f"""line as (select {key('project_id')} as project_id, unnest(regexp_extract_all(text, '(?m)^(/\\S+)[ \\t]+(@\\S+)[ \\t]*\\r?$', 1)) as pattern, unnest(regexp_extract_all(text, '(?m)^(/\\S+)[ \\t]+(@\\S+)[ \\t]*\\r?$', 2)) as owner from documents where text is not null),
told as (select {key('project_id')} as project_id, {strip('subject')} as pattern, {strip('claim_object')} as owner from brain_claims where {key('predicate')} = 'owned-by'),
rules as (select distinct project_id, pattern, owner, source from (select *, 'codeowners' as source from line union all select *, 'package' from told) where pattern <> '' and owner <> '' and project_id is not null),
ready as (select *, case when pattern = '*' then '.*' else case when starts_with(pattern, '/') then '^' else '(^|/)' end || {_INNER} || case when ends_with(pattern, '/') then '(/.*)?$' else '$' end end as regex from rules),
best as (select f.project_id, f.path, r.owner, r.source as owner_source from files f join ready r on r.project_id = f.project_id and regexp_matches(f.path, r.regex)
  qualify row_number() over (partition by f.project_id, f.path order by case r.source when 'codeowners' then 2 else 1 end desc, case r.source when 'package' then length(r.pattern) else 0 end desc, r.pattern desc, r.owner desc) = 1)"""

#: The shape of every ignore pattern is known, so each is matched by what it means.
_EXPOSED = f"""loc as (select distinct {key('project_id')} as project_id, locator as o, strlen(locator) as n from brain_evidence where {key('kind')} = 'pattern-match' and locator <> '' and {key('project_id')} is not null),
pat as (select project_id, o, ['claude-code', 'codex', 'cursor'][n % 3 + 1] as agent, (n // 3) % 5 as shape, regexp_replace(o, '/[^/]*$', '') as dir, string_split(o, '/')[-1] as name, '.' || lower(regexp_extract(o, '\\.([A-Za-z0-9]+)$', 1)) as ext from loc),
own as (select distinct project_id, agent from pat),
pairs as (select f.project_id, f.path, o.agent from files f join own o using (project_id)),
hit as (select q.project_id, q.path, q.agent, arg_max(p.shape = 4, p.o) as keep from pairs q join pat p on p.project_id = q.project_id and p.agent = q.agent and case p.shape
    when 0 then q.path = p.dir or starts_with(q.path, p.dir || '/') when 1 then ends_with(q.path, p.ext) when 2 then q.path = p.o when 3 then list_contains(string_split(q.path, '/'), p.name)
    else q.path = p.o or starts_with(q.path, p.o || '/') or ends_with(q.path, '/' || p.o) end group by 1, 2, 3),
seen as (select q.* from pairs q left join hit h using (project_id, path, agent) where coalesce(h.keep, true))"""

_STORED = f"""stored as (select project_id, snapshot_id, claim_id, r.subject, r.predicate, r.claim_object, r.status, r.superseded_by, r.confidence,
    list_distinct(list_filter(list_transform(r.evidence_ids, lambda e: {key('e')}), lambda e: e is not null)) as evidence_ids
  from (select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, {key('claim_id')} as claim_id,
      arg_max({{'subject': subject, 'predicate': predicate, 'claim_object': claim_object, 'status': {upper('status')}, 'superseded_by': {key('superseded_by')}, 'confidence': confidence, 'evidence_ids': evidence_ids}}, loaded_at) as r
    from brain_claims group by 1, 2, 3)
  where project_id is not null and snapshot_id is not null and claim_id is not null)"""
_EV = f"ev as (select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, {key('evidence_id')} as evidence_id, min(locator) as locator from brain_evidence group by 1, 2, 3)"


def _reach(root: str, step: str) -> str:
    """The least number of steps to every node from one root per project; a node is walked from once, however deep it lies."""
    return f"""with recursive {D}, steps as (select distinct project_id, a, b from ({step})),
  walk(project_id, node, depth) using key (project_id, node) as (select distinct project_id, '{root}', 0 from deps
    union select w.project_id, s.b, min(w.depth) + 1 from walk w join steps s on s.project_id = w.project_id and s.a = w.node
      left join recurring.walk r on r.project_id = w.project_id and r.node = s.b where r.node is null group by 1, 2)
  select project_id, node, depth from walk"""


_BACK = "select project_id, target as a, source as b from deps"
_TRIES = ", ".join(f"({i}, '{e}')" for i, e in enumerate(V.TRIED))


_CANDIDATE = f"""regexp_replace({strip('c')}, '(?s)#.*$', '')"""
_GO = "archive bufio bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io log maps math mime net os path plugin reflect regexp runtime slices structs sync syscall testing text time unicode unique unsafe weak"


def refs_of(texts: str) -> str:
    """The references of texts (project_id, path, text) that may be paths of their tree."""
    return f"""cand as (select distinct project_id, path, {_CANDIDATE} as ref from (
    select project_id, path, unnest(list_concat(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1), regexp_extract_all(text, '`([^`]+)`', 1))) as c from ({texts}))),
  parts as (select *, regexp_replace(ref, '/+$', '') as plain, string_split(regexp_replace(ref, '/+$', ''), '/') as ps from cand),
  refs as (select project_id, path, ref from parts where ref <> '' and length(ref) <= 200
    and not regexp_matches(ref, '(?i)^(https?:|mailto:|file:)|^#|^--|://|[\\n ]|[;&|$]|^/|^[A-Za-z]:[\\\\/]|^\\.[A-Za-z_][\\w-]*$|^@[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|[*?\\[\\]{{}}]')
    and not regexp_matches(ref, '(?i)^(try/finally|if/else|for/of|for/in|async/await|do/while)$') and regexp_replace(regexp_replace(ref, '^\\./', ''), '/+$', '') not in ('dist', 'build', 'out', 'target', '.next', 'coverage')
    and case when contains(ref, '/') then not list_contains(ps, '') and not regexp_matches(ps[1], '(?i)^(?:[a-z0-9-]+\\.)+(?:com|org|net|io|dev|ai|app|cloud|co|edu|gov|info|me|tv|xyz|in|to|cc)$')
        and not (len(ps) between 2 and 4 and list_contains(string_split('{_GO}', ' '), ps[1]) and len(list_filter(ps, lambda x: not regexp_matches(x, '^[a-z][a-z0-9]*$'))) = 0)
      else regexp_matches(ref, '(?i)\\.(mdc?|txt|tsx?|jsx?|mjs|cjs|json|ya?ml|toml|php|py|rb|go|rs|java|kt|css|scss|html|vue|svelte|sh|bash|zsh|sql|xml|svg|png|jpe?g|gif|webp|wasm|lock)$') and not starts_with(ref, '.') end
    and not regexp_matches(ref, '^(origin|upstream|HEAD)/[A-Za-z0-9._/-]+$') and not (regexp_matches(ref, '^(feature|fix|chore|hotfix|release)/[A-Za-z0-9._/-]+$') and not regexp_matches(ref, '\\.[A-Za-z0-9]{{1,16}}$'))
    and not regexp_matches(ref, '<[^<>\\s]+>|(^|/)\\.\\.\\.(/|$)|^~(/|$)|^(asset|javascript|css|json|wasm|webassembly|runtime)/[A-Za-z0-9_-]+$')),
  based as (select *, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') || '/' else '' end as base from refs)"""


_REFS = refs_of(f"select {key('project_id')} as project_id, coalesce(path, '') as path, text from documents where text is not null and {key('project_id')} is not null")

_EXP = f"exp as (select export_id, {key('project_id')} as project_id from brain_exports where {key('project_id')} is not null)"


def _needle(text: str) -> str:
    low = text.lower()
    return f"""with {D}, {R}, {DOCS}, {_EXP}, h as (select project_id from deps where len(list_filter(evidence, lambda e: contains(lower(e), '{low}'))) > 0 union all select project_id from rels where len(list_filter(evidence, lambda e: contains(lower(e), '{low}'))) > 0
        union all select e.project_id from (select distinct export_id, entity, parent_pos from ({P3_FOUND}) where entity in ('domain_path', 'architecture_rule') and contains(lower(item), '{low}')) f join exp e using (export_id)
        union all select e.project_id from ({flat('m', 'entrypoints', {'file': 'file'})}) f join exp e using (export_id) where contains(lower(f.file), '{low}'))
      select project_id, count(*) as n, {_ROUND.format(x='least(0.99, cast(0.5 as double) + least(count(*), 10) * cast(0.04 as double))')} as confidence from h group by 1"""


_FIND_DOMAIN = f"""with {D}, {R}, {DOCS}, {_EXP}, items as ({P3_FOUND}),
  named as (select e.project_id, d.export_id, d.pos from ({flat('m', 'domains', {'name': 'name'})}) d join exp e using (export_id) where lower(d.name) = 'inventory'),
  scope as (select n.project_id, coalesce(list(distinct lower(i.item)) filter (i.item is not null), []) as paths from named n left join items i on i.export_id = n.export_id and i.parent_pos = n.pos and i.entity = 'domain_path' and i.item <> '' group by 1),
  arch as (select e.project_id, a.export_id, a.pos, a.pattern from ({flat('m', 'architectures', {'pattern': 'pattern'})}) a join exp e using (export_id)),
  naming as (select distinct a.project_id, a.pattern from arch a join items i on i.export_id = a.export_id and i.parent_pos = a.pos and i.entity = 'architecture_rule' and contains(lower(i.item), 'inventory') where a.pattern is not null),
  firsts as (select distinct project_id, pattern from arch where pos < 3 and pattern is not null and project_id not in (select project_id from naming))
  select project_id, 'domain' as slice, 'Inventory' as item from scope
  union select s.project_id, 'entrypoint', f.file from ({flat('m', 'entrypoints', {'file': 'file'})}) f join exp e using (export_id) join scope s using (project_id) where f.file is not null and len(list_filter(s.paths, lambda p: contains(p, lower(f.file)) or contains(lower(f.file), p))) > 0
  union select s.project_id, 'relationship', cast(r.edge_id as varchar) from rels r join scope s using (project_id) where 'inventory' in (r.source, r.target) or len(list_filter(coalesce(r.evidence, []), lambda x: contains(lower(x), 'inventory'))) > 0
    or len(list_filter(s.paths, lambda p: contains(r.source, p) or contains(r.target, p) or contains(lower(array_to_string(coalesce(r.evidence, []), chr(10))), p))) > 0
  union select s.project_id, 'dependency', cast(d.edge_id as varchar) from deps d join scope s using (project_id) where 'inventory' in (d.source, d.target) or len(list_filter(coalesce(d.evidence, []), lambda x: contains(lower(x), 'inventory'))) > 0
  union select s.project_id, 'architecture', a.pattern from (select * from naming union select * from firsts) a join scope s using (project_id)"""

_h = lambda *names: "(" + " and ".join(f"{n} > 0" for n in names) + ")"
_CHAINED = _h("controller_service", "service_repository", "repository_database")
_LAYERS = "((layer_1 > 0)::int + (layer_2 > 0)::int + (layer_3 > 0)::int)"
#: What supports each pattern and what speaks against it, with the weights.
_PATTERNS = {
    "MVC": ([(_h("route_controller"), "1.2"), (_h("controller_service"), "1.4")], [(_h("widget_bloc"), "1.1")]),
    "MVVM": ([(_h("viewmodel"), "1.5"), (_h("view_model_edge", "viewmodel"), "1.0")], [("(controller_uses_service > 0 and viewmodel = 0)", "0.8")]),
    "Clean Architecture": (
        [(_CHAINED, "2.2"), (f"(not {_CHAINED} and controller_service > 0)", "0.7"), (f"(not {_CHAINED} and service_repository > 0)", "0.8"), (f"(not {_CHAINED} and repository_database > 0)", "0.8"), (_h("implements"), "1.3")],
        [(_h("controller_repository"), "least(controller_repository, 3) * 1.2")],
    ),
    "Layered Architecture": ([(_h(f"layer_{i}"), f"case when {_LAYERS} >= 2 then 0.9 else 0.0 end") for i in (1, 2, 3)], []),
    "Hexagonal": ([(_h("implements"), "1.4"), (_h("module_provides"), "1.0"), (_h("configures"), "0.8")], [(_h("controller_database"), "1.0")]),
    "Onion": ([("(n_domains > 0 and (provides_named_domain > 0 or contains > 0))", "1.2"), (_h("service_repository"), "1.0")], []),
    "DDD": ([(_h("n_domains"), "least(n_domains, 3) * 0.7"), (_h("provides_domain"), "1.1"), (_h("repository_database"), "0.9")], []),
    "Repository Pattern": ([(_h("service_repository"), "1.4"), (_h("repository_database"), "1.2")], [(_h("controller_database"), "1.0")]),
    "Service Layer": ([(_h("app_service"), "1.5"), (_h("api_service"), "1.1")], []),
    "Feature-first": ([("(contains >= 2)", "1.3"), (_h("consumes"), "1.2"), (_h("owns"), "0.8")], []),
    "BLoC": ([(_h("widget_bloc"), "1.6"), (_h("bloc_repository"), "1.3"), (_h("n_flutter"), "0.7")], [(_h("controller_service"), "0.4")]),
    "Riverpod": ([(_h("riverpod"), "1.5")], [("(riverpod > 0 and n_flutter = 0)", "0.6")]),
    "Redux": ([(_h("redux"), "1.5")], []),
    "Microservice": ([("(n_frameworks >= 2)", "n_frameworks * 0.7"), ("(package >= 2)", "0.8")], [("(n_frameworks >= 2 and configures > 0 and package <= 1)", "0.7")]),
    "Modular Monolith": ([(_h("module_wires"), "1.4"), ("(n_nest > 0 or (n_frameworks = 1 and module_wires > 0))", "1.0"), (_h("package", "module_wires"), "0.8")], [("(n_frameworks >= 3)", "0.9")]),
    "Plugin Architecture": ([(_h("dynamic"), "1.5"), (_h("dynamic", "module_provides"), "0.9")], []),
    "Monorepo Workspace": ([(_h("package"), "least(package, 4) * 0.55"), (_h("declared"), "0.8"), (_h("owns"), "0.7")], []),
}


def _cells() -> str:
    """A row per project and pattern."""
    total = lambda rs: " + ".join(["cast(0 as double)", *(f"case when {c} then cast(({w}) as double) else cast(0 as double) end" for c, w in rs)])
    count = lambda rs: " + ".join(["0", *(f"{c}::int" for c, _ in rs)])
    rows = []
    for p, (support, against) in _PATTERNS.items():
        told = "least(widget_bloc_told, 3)" if p == "MVC" else count(against)
        rows.append(f"select project_id, '{p}' as pattern, {count(support)} as n_rules, {_ROUND.format(x=f'({total(support)})')} as support, {_ROUND.format(x=f'({total(against)})')} as conflict, {told} as n_against from sig")
    return " union all ".join(rows)


_NAMES = [*V.RELATIONSHIP_SIGNALS, *V.DEPENDENCY_SIGNALS]
_MORE = ["widget_bloc_told", "n_frameworks", "n_nest", "n_flutter", "n_domains", "provides_named_domain"]
_ARCH = f"""ra as (select project_id, {', '.join(f'count(*) filter ({_matching(**x)}) as {n}' for n, x in V.RELATIONSHIP_SIGNALS.items())}, count(*) filter ({_matching(**V.RELATIONSHIP_SIGNALS['widget_bloc'])} and len(evidence) > 0) as widget_bloc_told from rels group by 1),
  da as (select project_id, {', '.join(f'count(*) filter ({_matching(**x, kind="type")}) as {n}' for n, x in V.DEPENDENCY_SIGNALS.items())} from deps group by 1),
  fa as (select e.project_id, count(distinct f.framework) as n_frameworks, count(*) filter (f.framework = 'NestJS') as n_nest, count(*) filter (f.framework = 'Flutter') as n_flutter from ({flat('m', 'entrypoints', {'framework': 'framework'})}) f join exp e using (export_id) group by 1),
  dn as (select distinct e.project_id, lower(f.name) as name from ({flat('m', 'domains', {'name': 'name'})}) f join exp e using (export_id) where f.name is not null), dc as (select project_id, count(*) as n_domains from dn group by 1),
  pw as (select project_id, source, target, unnest(regexp_split_to_array(lower(regexp_replace(target_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) as name from rels where kind = 'PROVIDES'),
  pn as (select project_id, count(*) as provides_named_domain from (select distinct project_id, source, target from pw join dn using (project_id, name)) group by 1),
  ids as (select project_id from ra union select project_id from da union select project_id from fa union select project_id from dc),
  sig as (select project_id, {', '.join(f'coalesce({n}, 0) as {n}' for n in [*_NAMES, *_MORE])} from ids left join ra using (project_id) left join da using (project_id) left join fa using (project_id) left join dc using (project_id) left join pn using (project_id)),
  cells as ({_cells()}),
  inferred as (select project_id, pattern, cast(n_rules as bigint) as n_rules, support, conflict, confidence, n_against from (select *, case when n_rules <= 0 or support <= 0 then cast(0 as double)
    else {conf('support / (support + conflict * cast(1.25 as double) + cast(0.35 as double)) + least(n_rules, 4) * cast(0.03 as double)', 0.95)} end as confidence from cells) where confidence > 0 and confidence >= 0.55)"""

_RISKS = f"""{D}, {R}, {DOCS}, {_EXP}, {L}, {_OWNED}, {_ARCH},
  ent as (select e.project_id, f.file as target, max(coalesce(f.confidence, 0)) as sure from ({flat('m', 'entrypoints', {'file': 'file', 'confidence': 'confidence:double'})}) f join exp e using (export_id) where f.file <> '' group by 1, 2),
  dp as (select e.project_id, i.item as target from ({P3_FOUND}) i join exp e using (export_id) where i.entity = 'domain_path' and i.pos < 3 and i.item <> ''),
  asked as (select distinct project_id, replace(target, chr(92), '/') as target from (select project_id, target from ent union all select * from dp)),
  covered as (select distinct a.project_id, a.target from asked a join ready r on r.project_id = a.project_id and regexp_matches(ltrim(a.target, '/'), r.regex)),
  all_risks as (select * from (select project_id, 'critical-entrypoint' as kind, target, 'high' as severity, {conf('least(cast(0.9 as double), cast(0.55 as double) + sure * cast(0.35 as double))')} as confidence from ent
    union all select project_id, 'dependency-centrality', target, severity, confidence from ({FAN_IN}) union all select project_id, 'high-coupling', target, severity, confidence from ({COUPLING})
    union all select project_id, 'architecture-conflict', pattern, 'medium', {conf('least(cast(0.85 as double), cast(0.4 as double) + n_against * cast(0.1 as double))')} from inferred where n_against > 0
    union all select project_id, 'unclear-ownership', target, 'medium', cast(0.7 as double) from asked anti join covered using (project_id, target)) where confidence >= 0.5)"""

SQL = {
    "finding_summary": f"with {FINDINGS} select repo, {_COUNTS} from f group by 1",
    "finding_dedupe": f"""with {FINDINGS} select repo, rule_id, path, min(finding_id) as finding_id, any_value(severity) as severity,
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(agents)))), '|'), '') as agents, count(*) as n from f group by 1, 2, 3""",
    "readiness_scores": f"with {FINDINGS} select repo, strftime(ts, '%Y-%m-%d') as day, {_score()} as score from f group by 1, 2",
    "readiness_scopes": f"""with {FINDINGS} select repo, 'overall' as scope, '' as name, {_score()} as score from f group by 1
      union all select repo, 'category', category, {_score('0')} from f group by 1, 3 union all select repo, 'agent', agent, {_score('0')} from {_AGENTS} group by 1, 3""",
    "policy_gates": f"""with {FINDINGS}, s as (select repo, {_score()} as score, count(*) filter (severity = 'critical') as n_critical, count(*) filter (rule_id in ('login', 'purchase')) as n_ruled, max(len(agents)) = 0 as limited from f group by 1),
      b as (select distinct repo, path from f where ts < timestamp '2024-01-16'), a as (select distinct repo, path from f where ts >= timestamp '2024-01-16'), n as (select repo, count(*) as n_new from a anti join b using (repo, path) group by 1)
      select repo, 'minimum-score' as gate, cast(score as bigint) as value from s where score < 30 or limited union all select repo, 'fail-on-severity', n_critical from s where n_critical > 0
      union all select repo, 'fail-on-rule', n_ruled from s where n_ruled > 0 union all select repo, 'fail-on-new', n_new from n""",
    "finding_diff": f"""with {FINDINGS}, b as (select distinct path from f where ts < timestamp '2024-01-16'), a as (select distinct path from f where ts >= timestamp '2024-01-16')
      select coalesce(a.path, b.path) as path, case when b.path is null then 'new' when a.path is null then 'resolved' else 'remaining' end as status from a full join b on a.path = b.path""",
    "dependency_merge": f"with {D} {DEPENDENCY_MERGE}",
    "relationship_merge": f"with {R} {RELATIONSHIP_MERGE}",
    "fan_in_risk": f"with {D} {FAN_IN}",
    "coupling_risk": f"with {R} {COUPLING}",
    "risk_ranking": f"""with {D}, {R}, risks as (select *, 'dependency-centrality' as kind from ({FAN_IN}) union all select *, 'high-coupling' from ({COUPLING}))
      select project_id, cast(place as int) as place, kind, target, severity, confidence from (select *, row_number() over (partition by project_id order by case severity when 'high' then 2 else 1 end desc, confidence desc, kind, target) as place from risks) where place <= 5""",
    "bidirectional_edges": f"""with {R}, m as (select distinct project_id, source, target, kind from rels where source <> target),
      looks as (select a.*, b.kind as back, exists (select 1 from m s where s.project_id = a.project_id and s.source = a.target and s.target = a.source and s.kind = a.kind) as same
        from m a join m b on b.project_id = a.project_id and b.source = a.target and b.target = a.source),
      pairs as (select * from looks where same and back = kind or not same and back in {_CROSS}),
      marked as (select project_id, source, target, kind from pairs union select project_id, target, source, back from pairs)
      select m.*, x.kind is not null as bidirectional from m left join marked x using (project_id, source, target, kind)""",
    "edge_search": f"""with {D}, {R} select 'relationship' as collection, project_id, edge_id from rels where {_matching(['USES', 'CALLS'], ['Controller'], ['Service', 'Repository'])}
      union all select 'dependency', project_id, edge_id from deps where {_matching(['import', 'require'], evidence=['injects'], kind='type')}""",
    "statistics": f"""with {D}, {R}, r as (select project_id, confidence, coalesce(len(evidence), 0) as e, 0 as k from deps union all select project_id, confidence, coalesce(len(evidence), 0), 1 from rels)
      select project_id, count(*) filter (k = 0) as n_dependencies, count(*) filter (k = 1) as n_relationships, cast(sum(e) as bigint) as n_evidence, {_MEAN.format(c='confidence')} as confidence from r group by 1""",
    "list_dependencies": f"""with {D}, counts as (select project_id, count(*) as n, {_MEAN.format(c='confidence')} as confidence from deps group by 1),
      told as (select project_id, array_to_string(list_slice(flatten(list(evidence order by edge_id)), 1, 20), '|') as evidence from deps where len(evidence) > 0 group by 1)
      select project_id, n, confidence, coalesce(evidence, '') as evidence from counts left join told using (project_id)""",
    "find_component": f"""with {D}, {R} select project_id, 'relationship-source' as slice, edge_id from rels where source = 'coreregistry'
      union all select project_id, 'relationship-target', edge_id from rels where target = 'coreregistry' union all select project_id, 'dependency-endpoint', edge_id from deps where 'coreregistry' in (source, target)""",
    "find_dependency": f"""with {D} select project_id, edge_id, source, target, type, confidence from deps where target = 'eventspine' and type = 'import'
      qualify row_number() over (partition by project_id order by confidence desc nulls last, source, target, edge_id) = 1""",
    "find_relationship": f"""with {R} select project_id, edge_id, source, target, kind, confidence from rels where target = 'storagehub' and kind = 'CONTAINS'
      qualify row_number() over (partition by project_id order by confidence desc nulls last, source, target, edge_id) = 1""",
    "evidence_search": _needle("injects"),
    "path_search": _needle("harbor"),
    "find_domain": _FIND_DOMAIN,
    "impact": f"""with {D} select project_id, count(*) filter (contains(target, 'kernel')) as n_inbound, count(*) filter (contains(source, 'kernel')) as n_outbound, count(*) as n_edges
      from deps where contains(source, 'kernel') or contains(target, 'kernel') group by 1""",
    "architecture_signals": f"""with {D}, {R}, p as (select distinct project_id from deps union select distinct project_id from rels),
      a as (select project_id, {', '.join(f'count(*) filter ({_matching(**x)}) as {n}' for n, x in V.RELATIONSHIP_SIGNALS.items())} from rels group by 1),
      b as (select project_id, {', '.join(f'count(*) filter ({_matching(**x, kind="type")}) as {n}' for n, x in V.DEPENDENCY_SIGNALS.items())} from deps group by 1)
      select project_id, {', '.join(f'coalesce({n}, 0) as {n}' for n in [*V.RELATIONSHIP_SIGNALS, *V.DEPENDENCY_SIGNALS])} from p left join a using (project_id) left join b using (project_id)""",
    "confidence_distribution": f"""with {D} select type, count(*) as n, min(confidence) as least, max(confidence) as greatest, {_MEAN.format(c='confidence')} as mean, {_ROUND.format(x='quantile_cont(confidence, 0.5)')} as median
      from deps where confidence is not null group by 1""",
    "latency_percentiles": "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as greatest, count(*) as n from events where value is not null group by 1",
    "set_metrics": f"""with {_SNAPS}, t as (select distinct project_id, snapshot_id from snaps where created_at is not null),
      a as (select distinct {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id from brain_claims),
      c as (select coalesce(t.project_id, a.project_id) as project_id, count(*) filter (t.snapshot_id is not null and a.snapshot_id is not null) as tp, count(*) filter (t.snapshot_id is null) as fp, count(*) filter (a.snapshot_id is null) as fn
        from t full join a on t.project_id = a.project_id and t.snapshot_id = a.snapshot_id group by 1)
      select *, floor(coalesce(tp / nullif(tp + fp, 0), 1.0) * 10000 + 0.5) / 10000 as precision, floor(coalesce(tp / nullif(tp + fn, 0), 1.0) * 10000 + 0.5) / 10000 as recall,
        floor(case when tp = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end * 10000 + 0.5) / 10000 as f1 from c""",
    "token_domains": f"""with {L}, lexicon(word, domain) as (values {_LEXICON}), words as (select project_id, path, unnest({_TOKENS}) as word from files),
      c as (select project_id, domain, count(distinct path) as n_files, count(*) as n_hits from words join lexicon using (word) group by 1, 2)
      select * from (select *, {conf('0.45 + least(n_files, 8) * cast(0.06 as double) + least(n_hits / n_files, 3.0) * cast(0.05 as double)')} as confidence from c) where confidence >= 0.5""",
    "path_classes": f"""with {L} select project_id, {_ROLE} as role, count(*) as n_files, count(*) filter ({_SAMPLE}) as n_samples,
      count(*) filter (list_contains({_list(V.SOURCE_EXTENSIONS)}, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)))) as n_sources from files group by 1, 2""",
    "path_names": f"""with {L}, p as (select distinct path, string_split(path, '/') as parts from files)
      select path, {_pascal("regexp_replace(parts[-1], '\\.[A-Za-z0-9]+$', '')")} as name,
        coalesce({_pascal(f"list_filter(parts[:-2], lambda d: not list_contains({_list(V.NO_FEATURE)}, lower(d)) and regexp_matches(d, '^[a-zA-Z][A-Za-z0-9_-]+$'))[1]")}, '') as feature,
        case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as directory, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as extension from p""",
    "model_ids": f"with {L} select distinct path, 'entrypoint_' || substr(sha256('entrypoint-discovery' || chr(0) || 'entrypoint' || chr(0) || path), 1, 16) as id from files",
    "claim_ids": f"""select distinct subject, predicate, claim_object, 'claim_' || {_hash31("subject || chr(0) || predicate || chr(0) || claim_object")} as id
      from brain_claims where subject is not null and predicate is not null and claim_object is not null""",
    "redacted_evidence": f"""select distinct locator, symbol, case when not (regexp_matches(regexp_extract(locator, '[^/\\\\]*$'), '{_re(V.SENSITIVE_NAME)}') or regexp_matches(locator, '{_re(V.SECRETISH)}')) then locator
        when not regexp_matches(locator, '[/\\\\]') then '[REDACTED_PATH]' else regexp_replace(regexp_replace(locator, '[^/\\\\]*$', ''), '[/\\\\]', '/', 'g') || '[REDACTED_NAME]' end as safe_locator,
      case when regexp_matches(symbol, '{_re(V.SECRETISH)}') then '[REDACTED]' else symbol end as safe_symbol from brain_evidence""",
    "duplicate_documents": f"""with n as (select distinct doc_id, {_FORM} as form from documents where doc_id is not null and text is not null),
      c as (select form, min(doc_id) as class_id, count(*) as n_copies from n where length(form) >= 80 group by 1 having count(*) > 1) select doc_id, class_id, n_copies from n join c using (form)""",
    "large_documents": "select doc_id, n_bytes, case when n_bytes >= 8192 then 'warning' else 'info' end as severity from (select doc_id, cast(strlen(text) as bigint) as n_bytes from documents) where n_bytes >= 4096",
    "ownership_resolution": f"with {L}, {_OWNED} select f.project_id, f.path, b.owner, b.owner_source from files f left join best b using (project_id, path)",
    "unclear_ownership": f"with {L}, {_OWNED} select f.project_id, f.path from files f anti join best b using (project_id, path)",
    "exposure": f"with {L}, {_EXPOSED} select f.project_id, f.path, coalesce(string_agg(s.agent, '|' order by s.agent), '') as agents from files f left join seen s using (project_id, path) group by 1, 2",
    "missing_references": f"""with {L}, {_REFS},
      held as (select distinct project_id, array_to_string(parts[:i], '/') as t from (select project_id, string_split(path, '/') as parts, unnest(generate_series(1, len(string_split(path, '/')))) as i from files)),
      tries as (select project_id, path, ref, base || ref as t from based union all select project_id, path, ref, ref from based where not regexp_matches(ref, '^\\.\\.?/')),
      plain as (select project_id, path, ref, array_to_string(list_filter(string_split(t, '/'), lambda p: p not in ('', '.')), '/') as t from tries)
      select project_id, path, ref from plain p left join held h using (project_id, t) group by 1, 2, 3 having count(h.project_id) = 0""",
    "contradictions": f"""with {_STORED}, live as (select * from stored where status in ('ACTIVE', 'CONTRADICTED') and claim_object is not null),
      g as (select project_id, snapshot_id, subject, predicate, array_to_string(list_sort(list(distinct claim_object)), '|') as object_values, count(distinct claim_object) as n,
        array_to_string(list_sort(list(distinct claim_id)), '|') as claim_ids, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(evidence_ids, []))))), '|'), '') as evidence_ids, min(confidence) as confidence
        from live group by 1, 2, 3, 4)
      select project_id, snapshot_id, 'contra_' || {_hash31("concat_ws(chr(0), subject, predicate, object_values)")} as contradiction_id, subject, predicate, object_values, claim_ids, evidence_ids, confidence from g where n >= 2""",
    "claim_lifecycle": f"""with {_SNAPS}, {_CLAIMS}, {_CHAIN}, {_STORED},
      links as (select h.*, lead(snapshot_id) over (partition by project_id order by seq) as following from chain h),
      now as (select s.* from stored s join links h using (project_id, snapshot_id) where s.status = 'ACTIVE' and h.seq > 1),
      prior as (select s.project_id, h.following as snapshot_id, s.claim_id, s.subject, s.predicate, s.claim_object, s.status, s.superseded_by, s.confidence from stored s join links h using (project_id, snapshot_id) where h.following is not null),
      rivals as (select project_id, snapshot_id, subject, predicate, min(claim_id) as rival from now group by all),
      past as (select p.project_id, p.snapshot_id, p.claim_id, case when p.status = 'INVALIDATED' then p.status when r.rival is not null then 'SUPERSEDED' else 'INVALIDATED' end as status,
          case when p.status = 'INVALIDATED' then p.superseded_by else r.rival end as superseded_by, p.confidence
        from prior p left join rivals r on r.project_id = p.project_id and r.snapshot_id = p.snapshot_id and r.subject is not distinct from p.subject and r.predicate is not distinct from p.predicate
        where not exists (select 1 from now n where n.project_id = p.project_id and n.snapshot_id = p.snapshot_id and n.subject is not distinct from p.subject and n.predicate is not distinct from p.predicate and n.claim_object is not distinct from p.claim_object)),
      both_ as (select project_id, snapshot_id, claim_id, 'ACTIVE' as status, null as superseded_by, confidence, 0 as source from now union all select *, 1 from past)
      select project_id, snapshot_id, claim_id, status, superseded_by from both_ qualify row_number() over (partition by project_id, snapshot_id, claim_id
        order by case status when 'ACTIVE' then 4 when 'CONTRADICTED' then 3 when 'SUPERSEDED' then 2 else 1 end desc, source desc, confidence desc nulls last, superseded_by desc nulls last) = 1""",
    "claim_evidence": f"""with {_STORED}, {_EV}, asked as (select project_id, snapshot_id, claim_id, unnest(evidence_ids) as evidence_id from stored)
      select a.project_id, a.snapshot_id, a.claim_id, count(*) as n_asked, count(e.evidence_id) as n_found, coalesce(array_to_string(list_sort(list(distinct e.locator) filter (e.locator is not null)), '|'), '') as locators
      from asked a left join ev e on e.project_id = a.project_id and e.snapshot_id = a.snapshot_id and e.evidence_id = a.evidence_id group by 1, 2, 3""",
    "evidence_links": f"""with {_STORED} select project_id, snapshot_id, evidence_id, count(distinct claim_id) as n_claims, min(claim_id) as first_claim
      from (select project_id, snapshot_id, claim_id, unnest(evidence_ids) as evidence_id from stored) group by 1, 2, 3""",
    "brain_summary": f"with {_STORED} select project_id, snapshot_id, count(*) filter (status = 'ACTIVE') as n_active, count(*) as n_claims, {_MEAN.format(c='confidence')} as confidence from stored group by 1, 2",
    "list_claims": f"with {_STORED} select project_id, snapshot_id, claim_id, status, confidence from stored where status in ('ACTIVE', 'CONTRADICTED')",
    "invalidations": f"with {_STORED} select project_id, snapshot_id, claim_id from stored where status = 'INVALIDATED'",
    "contradiction_delta": f"""with {_SNAPS}, {_CLAIMS}, {_CHAIN}, t as (select h.project_id, h.seq, h.snapshot_id, {key('c.contradiction_id')} as contradiction_id, max(c.confidence) as confidence
        from brain_contradictions c join chain h on h.project_id = {key('c.project_id')} and h.snapshot_id = {key('c.snapshot_id')} where {key('c.contradiction_id')} is not null group by 1, 2, 3, 4),
      b as (select h.project_id, h.snapshot_id, t.contradiction_id, t.confidence from t join chain h on h.project_id = t.project_id and h.seq = t.seq + 1), a as (select * from t where seq > 1)
      select coalesce(a.project_id, b.project_id) as project_id, coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id, coalesce(a.contradiction_id, b.contradiction_id) as contradiction_id,
        case when b.contradiction_id is null then 'added' when a.contradiction_id is null then 'removed' when a.confidence is not distinct from b.confidence then 'unchanged' else 'changed' end as change
      from a full join b on a.project_id = b.project_id and a.snapshot_id = b.snapshot_id and a.contradiction_id = b.contradiction_id""",
    "contract_violations": f"""select rule, n from (select 'absent field' as rule, count(*) as n from brain_claims where subject is null or predicate is null or claim_object is null or {upper('status')} is null
      union all select 'unknown status', count(*) from brain_claims where {upper('status')} not in ('ACTIVE', 'CONTRADICTED', 'SUPERSEDED', 'INVALIDATED')
      union all select 'confidence', count(*) from brain_claims where confidence is null or confidence < 0 or confidence > 1) where n > 0
      union all select 'id used twice', count(*) from (select 1 from brain_claims group by {key('project_id')}, {key('snapshot_id')}, {key('claim_id')} having count(*) > 1)""",
    "snapshot_registry": f"""with o as (select {key('project_id')} as project_id, {key('snapshot_id')} as snapshot_id, min(created_at) as created_at, max({key('content_hash')}) as h from snapshot_meta where created_at is not null group by 1, 2)
      select project_id, snapshot_id, cast(row_number() over w as int) as place, coalesce(h = lag(h) over w, false) as same_hash from o where project_id is not null and snapshot_id is not null window w as (partition by project_id order by created_at, snapshot_id)""",
    "trace_dependents": _reach("eventspine", _BACK),
    "blast_radius": _reach("sharedkernel", f"{_BACK} union all select project_id, source, target from deps"),
    "trace_dependencies": f"""with recursive {D}, walk(project_id, root, node, depth) using key (project_id, node) as (select project_id, min(source), min(source), 0 from deps group by 1
      union select w.project_id, any_value(w.root), s.target, min(w.depth) + 1 from walk w join deps s on s.project_id = w.project_id and s.source = w.node left join recurring.walk r on r.project_id = w.project_id and r.node = s.target where r.node is null group by 1, 3)
      select * from walk""",
    "trace_confidence": f"""with nodes as ({_reach("eventspine", _BACK)}), e as (with {D} select project_id, source, target, type, max(confidence) as confidence from deps group by all),
      w as (select e.project_id, count(*) as n_edges, {_MEAN.format(c='confidence')} as confidence from e join nodes n on n.project_id = e.project_id and n.node = e.target group by 1),
      c as (select project_id, count(*) as n_nodes from nodes group by 1) select c.project_id, n_nodes, coalesce(n_edges, 0) as n_edges, coalesce(confidence, 0) as confidence from c left join w using (project_id)""",
    "entrypoint_downstream": f"""with {DOCS}, {_EXP}, ent as (select e.project_id, f.file as item, max(f.confidence) as confidence from ({flat('m', 'entrypoints', {'file': 'file', 'confidence': 'confidence:double'})}) f join exp e using (export_id) where f.file <> '' and contains('/' || lower(f.file) || '/', '/harbor/') group by 1, 2)
      select project_id, 'entrypoint' as kind, item, confidence from ent""",
    "domain_modules": f"""with {DOCS}, {_EXP}, paths as (select export_id, parent_pos as pos, item from ({P3_FOUND}) where entity = 'domain_path' and contains(item, '/')),
      own as (select distinct e.project_id, d.name as domain, regexp_replace(p.item, '/[^/]*$', '') as dir from ({flat('m', 'domains', {'name': 'name'})}) d join paths p using (export_id, pos) join exp e using (export_id)),
      comp as (select distinct e.project_id, c.name as component, c.path from ({flat('b', 'components', {'name': 'name', 'path': 'path'})}) c join exp e using (export_id))
      select distinct o.project_id, o.domain, c.component from own o join comp c on c.project_id = o.project_id and starts_with(c.path, o.dir || '/') where o.domain is not null and c.component is not null""",
    "architecture_scores": f"with {D}, {R}, {DOCS}, {_EXP}, {_ARCH} select project_id, pattern, n_rules, support, conflict, confidence from inferred",
    "risks": f"with {_RISKS} select * from all_risks",
    "top_risks": f"with {_RISKS} select project_id, cast(place as int) as place, kind, target, severity, confidence from (select *, row_number() over (partition by project_id order by case severity when 'high' then 3 when 'medium' then 2 else 1 end desc, confidence desc, kind, target) as place from all_risks) where place <= 5",
    "built_claims": f"""with {_RISKS}, facts as (
        select e.project_id, 'domain-discovery' as source_pass, f.name as subject, 'is-domain' as predicate, 'true' as claim_object, f.confidence from ({flat('m', 'domains', {'name': 'name', 'confidence': 'confidence:double'})}) f join exp e using (export_id)
        union all select e.project_id, 'entrypoint-discovery', f.file, 'is-entrypoint', f.framework, f.confidence from ({flat('m', 'entrypoints', {'file': 'file', 'framework': 'framework', 'confidence': 'confidence:double'})}) f join exp e using (export_id)
        union all select e.project_id, 'architecture-inference', e.project_id, 'architecture', f.pattern, f.confidence from ({flat('m', 'architectures', {'pattern': 'pattern', 'confidence': 'confidence:double'})}) f join exp e using (export_id)
        union all select project_id, 'dependency-discovery', source, 'depends-on', target || coalesce(':' || type, ''), confidence from deps where source <> target or type in ('service', 'repository', 'module')
        union all select project_id, 'relationship-discovery', source, kind, target, confidence from rels where source <> target
        union all select project_id, 'ownership-discovery', pattern, 'owned-by', owner, cast(case source when 'codeowners' then 0.95 else 0.75 end as double) from rules
        union all select project_id, 'risk-discovery', target, 'has-risk', kind, confidence from all_risks)
      select project_id, 'claim_' || {_hash31("subject || chr(0) || predicate || chr(0) || claim_object")} as claim_id, subject, predicate, claim_object, min(source_pass) as source_pass, {conf('coalesce(max(confidence), cast(0.0 as double))')} as confidence
      from facts where project_id is not null and subject is not null and predicate is not null and claim_object is not null group by project_id, subject, predicate, claim_object""",
    "resolved_imports": f"""with {L}, refs as (select distinct specifier from (select unnest(list_concat(
          regexp_extract_all(text, '(?m)\\b(?:import|export)\\b[^''"\\n;()]*?[''"]([^''"\\n]+)[''"]', 1), regexp_extract_all(text, '\\brequire\\(\\s*[''"]([^''"\\n]+)[''"]\\s*\\)', 1),
          regexp_extract_all(text, '\\bimport\\(\\s*[''"]([^''"\\n]+)[''"]\\s*\\)', 1))) as specifier from documents where text is not null)
        where not starts_with(specifier, 'node:') and specifier not in ('.', './', '../')),
      keys as (select key, arg_min(path, (rank, path)) as target from (select path, 0 as rank, path as key from files
          union all select path, 1, regexp_replace(path, '\\.[A-Za-z0-9]+$', '') from files
          union all select path, 2, regexp_replace(path, '/[^/]*$', '') from files where regexp_matches(path, '/(index\\.(ts|js)|__init__\\.py|mod\\.rs)$')) where key <> '' group by 1),
      plain as (select specifier, case when starts_with(specifier, '.') then array_to_string(list_filter(string_split(specifier, '/'), lambda p: p not in ('', '.', '..')), '/') else specifier end as c from refs),
      cands as (select specifier, 0 as i, c from plain union all select specifier, 1, regexp_replace(c, '\\.(?:jsx?|mjs|cjs)$', '') from plain),
      best as (select c.specifier, arg_min(k.target, c.i * 100 + t.n) as target from cands c, (values {_TRIES}) t(n, e), keys k where k.key = c.c || t.e group by 1)
      select r.specifier, coalesce(b.target, '') as target from refs r left join best b on b.specifier = r.specifier""",
    "mutual_dependencies": f"""with {D}, {R}, e as (select project_id, source, target from deps union select project_id, source, target from rels)
      select a.project_id, a.source as first, a.target as second from e a join e b on a.project_id = b.project_id and a.source = b.target and a.target = b.source where a.source < a.target""",
}
