"""SQL counterparts (DuckDB) of the queries in trees.py: what they must find, read off the tables themselves, without any file or text between."""

from __future__ import annotations

from strataform.plans import values_sql as V
from strataform.plans.reference_sql import _CROSS, _FORM, _OWNED, _SAMPLE, L, _pascal, conf, refs_of, strip, upper
from strataform.plans.store_sql import key

_in = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


def _path(name: str) -> str:
    dotted = f"lower(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1.\\2', 'g'))"
    return f"'src/' || regexp_replace({dotted}, '^([^.]+)\\.', '\\1/') || '.ts'"


def _evidence(kind: str) -> str:
    return f"select distinct {key('project_id')} as repo, locator, strlen(locator) as n, case when contains(locator, '/') then regexp_replace(locator, '/[^/]*$', '') || '/' else '' end as dir from brain_evidence where {key('kind')} = '{kind}' and locator <> '' and {key('project_id')} is not null"


def _notes(source: str) -> str:
    return f"select {key('project_id')} as repo, doc_id, max(coalesce(text, '')) as t from documents where {key('source')} = '{source}' and {key('project_id')} is not null and doc_id is not null group by 1, 2"


_E = f"""edges as (select distinct {key('project_id')} as repo, {strip('dep_from')} as source, {strip('dep_to')} as target, {key('dep_type')} as type from dependency_matches
    where {strip('dep_from')} <> '' and {strip('dep_to')} <> '' and {key('project_id')} is not null and {key('dep_type')} is not null),
  impl as (select distinct {key('project_id')} as repo, {strip('rel_source')} as source, {strip('rel_target')} as target from relationship_matches where {upper('relationship')} = 'IMPLEMENTS' and {strip('rel_source')} <> '' and {strip('rel_target')} <> '' and {key('project_id')} is not null),
  names as (select distinct repo, name, {_path('name')} as path from (select repo, unnest([source, target]) as name from edges where type <> 'package' union all select repo, unnest([source, target]) from impl)),
  pkgs as (select distinct repo, unnest([lower(source), lower(target)]) as name from edges where type = 'package')"""
_SECRETS = "['.env', '.env.local', '.env_backup', '.env.example', 'id_rsa', 'server.pem', 'public-cert.pem', 'credentials.json', 'app.key', 'settings.json']"
_PRUNED = "['dist', 'build', 'coverage', '.next', 'node_modules', 'vendor', 'target', 'out']"
_FILES = f"""{L.replace('files as', 'locs as')}, {_E}, keys as (select distinct repo, dir || {_SECRETS}[n % 10 + 1] as path, {_SECRETS}[n % 10 + 1] as name from ({_evidence('config-key')})),
  dirs as (select distinct repo, dir || {_PRUNED}[n % 8 + 1] as path, {_PRUNED}[n % 8 + 1] as name from ({_evidence('ownership-rule')})),
  ruled as ({_notes('agent_rules')}), logs as ({_notes('scan_log')}),
  pat as (select repo, locator as o, ['claude-code', 'codex', 'cursor'][n % 3 + 1] as agent, (n // 3) % 5 as shape, rtrim(dir, '/') as dir, string_split(locator, '/')[-1] as name, '.' || lower(regexp_extract(locator, '\\.([A-Za-z0-9]+)$', 1)) as ext from ({_evidence('pattern-match')})),
  serv as (select distinct {key('project_id')} as repo, {strip('claim_object')} as name, {strip('subject')} as file, strlen({strip('subject')}) % 4 as n from brain_claims where {key('predicate')} = 'is-entrypoint' and {strip('claim_object')} <> '' and {strip('subject')} <> '' and {key('project_id')} is not null),
  scopes as (select distinct repo, name, ['~/', '../', '/elsewhere/', './'][n + 1] || file as scope, n from serv),
  {_OWNED.split('ready as')[0].rstrip().rstrip(',')},
  files as (select repo, path from names union select repo, 'packages/' || name || '/package.json' from pkgs union select repo, path from keys union select repo, '.claude/rules/note-' || doc_id || '.md' from ruled
    union select repo, 'logs/note-' || doc_id || '.log' from logs union select distinct project_id, 'CODEOWNERS' from rules where source = 'codeowners' union select distinct repo, '.cursor/mcp.json' from serv
    union select distinct repo, case agent when 'cursor' then '.cursorignore' when 'codex' then '.gitignore' else '.claude/settings.json' end from pat union select project_id, path from locs),
  present as (select distinct repo, 'claude-code' as agent from files where starts_with(path, '.claude/') union select distinct repo, 'cursor' from files where starts_with(path, '.cursor/')),
  crew as (select repo, string_agg(agent, '|' order by agent) as agents from present group by 1)"""


def _ignored(source: str, agent: str) -> str:
    """repo, path of a list's paths that the patterns of an agent's ignore file leave out: the last that matches decides, by shape."""
    return f"""select repo, path from (select q.repo, q.path, arg_max(p.shape = 4, p.o) as keep from {source} q join pat p on p.repo = q.repo and p.agent = '{agent}' and case p.shape
      when 0 then p.dir <> '' and (q.path = p.dir or starts_with(q.path, p.dir || '/')) or p.dir = '' and list_contains(string_split(q.path, '/'), p.name) when 1 then ends_with(q.path, p.ext) when 2 then q.path = p.o
      when 3 then list_contains(string_split(q.path, '/'), p.name) else q.path = p.o or starts_with(q.path, p.o || '/') or ends_with(q.path, '/' || p.o) end group by 1, 2) where not keep"""


_SEEN = "select x.repo, x.path, string_agg(x.agent, '|' order by x.agent) as agents from {pairs} x where not (x.agent = 'cursor' and exists (select 1 from {out} o where o.repo = x.repo and o.path = x.path)) group by 1, 2"
_LANGS = """ext as (select repo, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as e from files),
  counted as (select repo, count(*) filter (e in ('ts', 'tsx', 'mts', 'cts')) as typescript, count(*) filter (e in ('js', 'jsx', 'mjs', 'cjs')) + max(case when repo in (select repo from pkgs) then 10 else 0 end) as js,
    count(*) filter (e = 'py') as python, count(*) filter (e = 'dart') as dart, count(*) filter (e = 'php') as php, count(*) filter (e = 'go') as go, count(*) filter (e = 'rs') as rust, count(*) filter (e = 'java') as java, count(*) filter (e in ('kt', 'kts')) as kotlin from ext group by 1),
  scored as (select repo, unnest(['typescript', 'javascript', 'python', 'dart', 'php', 'go', 'rust', 'java', 'kotlin']) as language, unnest([typescript, case when typescript >= 10 and js > 0 then least(js, 5) else js end, python, dart, php, go, rust, java, kotlin]) as score,
    unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) as place from counted)"""

# Relations between modules: an edge's type as its text says it, told apart by the paths of both ends.
_TITLE = lambda x: f"upper({x}[1:1]) || lower({x}[2:])"
_DIRS = "list_filter(string_split({p}, '/')[:-2], lambda d: not list_contains([{stop}], lower(d)) and not contains(d, '.') and regexp_matches(d, '^[a-zA-Z][A-Za-z0-9_-]*$'))".replace("{stop}", ", ".join(f"'{w}'" for w in V.NO_LABEL))


def _label(p: str) -> str:
    raw = f"coalesce({_DIRS.format(p=p)}[-1], regexp_replace(string_split({p}, '/')[-1], '\\.[A-Za-z0-9]+$', ''))"
    parts = f"list_filter(regexp_split_to_array(regexp_replace({raw}, '[^a-zA-Z0-9_-]', '', 'g'), '[-_]+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1:1]) || lower(w[2:])), '')"


_DEPS = f"""stems as (select repo, regexp_replace(path, '\\.[A-Za-z0-9]+$', '') as stem, min(path) as target from files group by 1, 2),
  imports as (select distinct e.repo, {_path('e.source')} as path, s.target, case when e.type in ('require', 'export', 'dynamic-import') then e.type else 'import' end as base
    from edges e join stems s on s.repo = e.repo and s.stem = regexp_replace({_path('e.target')}, '\\.ts$', '') where e.type <> 'package'),
  typed as (select *, case when base <> 'import' then base when regexp_matches(path, '(^|/)(routes?|pages?)/') then 'route' when contains(path, 'controller') and contains(target, 'service') then 'service'
    when contains(target, 'repositor') then 'repository' when contains(target, 'service') and regexp_matches(path, 'controller|handler|route') then 'service' else 'import' end as type from imports),
  mods as (select distinct repo, {_label('path')} as source, {_label('target')} as target, type, path || ' ' || case type when 'require' then 'requires' when 'dynamic-import' then 'dynamically imports' when 'export' then 're-exports' when 'route' then 'routes to' else 'imports' end || ' ' || target as evidence from typed
    union select distinct repo, {_TITLE('lower(source)')}, {_TITLE('lower(target)')}, 'package', 'packages/' || lower(source) || '/package.json declares dependency on ' || lower(target) from edges where type = 'package'),
  deps as (select repo, source, target, type, cast(case type when 'import' then 0.97 when 'export' then 0.96 when 'require' then 0.95 when 'package' then 0.9 when 'service' then 0.88 when 'repository' then 0.88 when 'route' then 0.8 else 0.75 end as double) as confidence,
    count(distinct evidence) as n_evidence, min(evidence) as first_evidence from mods where source <> target or type in ('service', 'repository', 'module') group by 1, 2, 3, 4)"""

_ROLE = "case " + " ".join(f"when regexp_matches(lower(path), '{p}') then '{r}'" for r, p in V.ROLES) + " end"
_FEATURE = f"{_pascal('''list_filter(string_split(path, '/')[:-2], lambda d: not list_contains([{stop}], lower(d)) and regexp_matches(d, '^[a-zA-Z][A-Za-z0-9_-]+$'))[1]'''.replace('{stop}', ', '.join(f''' '{w}' '''.strip() for w in V.NO_FEATURE)))}"
_STEM = "regexp_replace(string_split(path, '/')[-1], '\\.[A-Za-z0-9]+$', '')"
_RULES = [
    ("Controller", "Service", "USES", 0.96, "strong"), ("Service", "Repository", "USES", 0.95, "strong"), ("Repository", "Database", "USES", 0.94, "strong"), ("Route", "Controller", "EXPOSES", 0.93, "strong"),
    ("Widget", "Bloc", "USES", 0.92, "strong"), ("Bloc", "Repository", "USES", 0.91, "strong"), ("API", "Service", "CALLS", 0.9, "medium"), ("Module", "Configuration", "CONFIGURES", 0.9, "medium"),
    ("Module", "Controller", "PROVIDES", 0.88, "medium"), ("Module", "Service", "PROVIDES", 0.88, "medium"), ("Service", "Service", "CALLS", 0.8, "weak"), ("Controller", "Repository", "USES", 0.84, "weak"),
]
_LEX = ", ".join(f"('{w}', '{d}')" for w, d in sorted({w: d for d, ws in reversed(V.DOMAIN_LEXICON.items()) for w in ws}.items()))
_WORDS = """list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), '([a-z0-9])([A-Z])', '\\1/\\2', 'g'), '[/_.-]+'), lambda w: lower(w)),
    lambda w: length(w) >= 2 and not list_contains([{stop}], w) and not regexp_matches(w, '^[0-9]+$'))""".replace("{stop}", ", ".join(f"'{w}'" for w in V.STOP_SEGMENTS))


def _sure(base: str, strength: str, n: str) -> str:
    return conf(f"cast({base} as double) + case {strength} when 'strong' then cast(0.03 as double) when 'weak' then cast(-0.05 as double) else cast(0.0 as double) end + cast(0.0 as double) + least(greatest({n} - 1, 0), 3) * cast(0.005 as double)", 0.99)


_RELS = f"""heads as (select repo, path, arg_min(regexp_extract(name, '^([A-Z][A-Za-z0-9_]*)', 1), name) as cls from names where regexp_matches(name, '^[A-Z]') group by 1, 2),
  parts as (select f.repo, f.path, coalesce(h.cls, {_pascal(_STEM.replace('path', 'f.path'))}) as name, f.role, nullif(f.feature, '') as feature from (select repo, path, {_ROLE} as role, {_FEATURE} as feature from files
    where lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) in {_in(V.SOURCE_EXTENSIONS)}) f left join heads h using (repo, path) where f.role is not null),
  pairs as (select distinct i.repo, i.path, i.target, a.name as source, b.name as dest, a.role as r1, b.role as r2, a.feature as f1, b.feature as f2 from imports i join parts a on a.repo = i.repo and a.path = i.path join parts b on b.repo = i.repo and b.path = i.target),
  rule(r1, r2, kind, base, strength) as (values {', '.join(f"('{a}', '{b}', '{k}', cast({c} as double), '{s}')" for a, b, k, c, s in _RULES)}),
  matched as (select p.*, r.kind, r.base, r.strength from pairs p join rule r using (r1, r2)),
  lexicon(word, domain) as (values {_LEX}),
  hits as (select repo, path, word, domain from (select repo, path, unnest({_WORDS}) as word from files) join lexicon using (word)),
  domains as (select * from (select repo, domain, {conf('0.45 + least(count(distinct path), 8) * cast(0.06 as double) + least(count(*) / count(distinct path), 3.0) * cast(0.05 as double)')} as sure, min(path) as first from hits group by 1, 2) where sure >= 0.5),
  raw as (select repo, source, target, 'DEPENDS_ON' as kind, {_sure('least(confidence, cast(0.95 as double))', "case type when 'dynamic-import' then 'weak' when 'package' then 'strong' else 'medium' end", 'n_evidence')} as confidence,
      case type when 'dynamic-import' then 1 when 'package' then 3 else 2 end as strength, null as evidence, type from deps
    union all select repo, source, dest, kind, {_sure('base', 'strength', '2')}, case strength when 'strong' then 3 when 'medium' then 2 else 1 end, unnest(['imports ' || string_split(target, '/')[-1], r1 || ' → ' || r2]), '' from matched
    union all select repo, f1, f2, 'CONSUMES', {_sure('0.82', "'medium'", '1')}, 2, unnest([source || ' ' || lower(kind) || ' ' || dest, path || ' → ' || target]), '' from matched where f1 <> f2 and kind in ('USES', 'CALLS')
    union all select repo, source, dest, 'CONFIGURES', cast(0.92 as double), 3, unnest(['imports ' || string_split(target, '/')[-1], 'module configuration wiring']), '' from pairs where r1 = 'Module' and r2 = 'Configuration'
    union all select p.repo, p.name, regexp_extract(i.target, '^([A-Z][A-Za-z0-9_]*)', 1), 'IMPLEMENTS', {_sure('0.97', "'strong'", '1')}, 3, unnest(['implements ' || regexp_extract(i.target, '^([A-Z][A-Za-z0-9_]*)', 1), 'in ' || p.path]), '' from impl i join parts p on p.repo = i.repo and p.path = {_path('i.source')} where regexp_matches(i.target, '^[A-Z]')
    union all select repo, feature, name, 'CONTAINS', {_sure('0.86', "'strong'", '1')}, 3, path || ' lives under feature ' || feature, '' from parts where feature <> name
    union all select p.repo, p.feature, h.domain, 'PROVIDES', {_sure('least(d.sure, cast(0.9 as double))', "'medium'", '1')}, 2, unnest([h.path || ' token "' || h.word || '" maps to domain ' || h.domain, 'domain evidence: ' || d.first]), '' from parts p join hits h on h.repo = p.repo and h.path = p.path join domains d on d.repo = h.repo and d.domain = h.domain where p.feature is not null),
  gathered as (select repo, source, target, kind, max(confidence) as confidence, max(strength) as strength, count(distinct evidence) as n from raw where source <> target and kind <> 'DEPENDS_ON' group by 1, 2, 3, 4
    union all select r.repo, r.source, r.target, 'DEPENDS_ON', max(r.confidence), max(r.strength), (select count(distinct m.evidence) from mods m where m.repo = r.repo and m.source = r.source and m.target = r.target) from raw r where source <> target and kind = 'DEPENDS_ON' group by 1, 2, 3),
  looks as (select a.*, b.kind as back, exists (select 1 from gathered s where s.repo = a.repo and s.source = a.target and s.target = a.source and s.kind = a.kind) as same from gathered a join gathered b on b.repo = a.repo and b.source = a.target and b.target = a.source),
  both_ as (select * from looks where same and back = kind or not same and back in {_CROSS}),
  marked as (select repo, source, target, kind from both_ union select repo, target, source, back from both_)"""

SQL = {
    "tree_agents": f"with {_FILES} select * from present",
    "tree_owner_rules": f"""with {_FILES} select project_id as repo, 'CODEOWNERS' as path, cast(row_number() over (partition by project_id order by pattern || '  ' || owner) - 1 as int) as ord, pattern, owner as owners, 'codeowners' as source, cast(0.95 as double) as confidence
      from rules where source = 'codeowners'""",
    "tree_servers": f"with {_FILES} select repo, 'cursor' as agent, name, 'stdio' as transport, scope, ['broad', 'outside', 'outside', 'ok'][n + 1] as scope_class from scopes",
    "tree_languages": f"with {_FILES}, {_LANGS} select repo, language, cast(score as bigint) as score from scored where score > 0",
    "tree_managers": f"with {_FILES} select distinct repo, 'npm' as manager, false as at_root from pkgs",
    "tree_dependencies": f"with {_FILES}, {_DEPS} select * from deps",
    "tree_relationships": f"""with {_FILES}, {_DEPS}, {_RELS} select g.repo, g.source, g.target, g.kind, g.confidence, ['weak', 'medium', 'strong'][g.strength] as strength, m.kind is not null as bidirectional, cast(g.n as bigint) as n_evidence
      from gathered g left join marked m using (repo, source, target, kind) where g.confidence >= 0.75""",
    "rule_env_files": f"""with {_FILES}, found as (select *, case name when '.env_backup' then 'backup' else 'runtime' end as k from keys where name in ('.env', '.env.local', '.env_backup') and not ({_SAMPLE})),
      out as ({_ignored('found', 'cursor')} union {_ignored('found', 'codex')} union select repo, path from found where k = 'runtime'), pairs as (select f.*, p.agent from found f join present p using (repo)), seen as ({_SEEN.format(pairs='pairs', out='out')})
      select f.repo, 'security/env-file-exposure' as rule_id, case f.k when 'backup' then 'warning' else 'critical' end as severity, f.path, f.k as detail, s.agents from found f join seen s using (repo, path)
      union all select f.repo, 'security/env-file-exposure', case f.k when 'backup' then 'warning' else 'critical' end, f.path, f.k || '-no-agent', '' from found f where repo not in (select repo from present)""",
    "rule_private_keys": f"""with {_FILES} select k.repo, 'security/private-key-file' as rule_id, 'critical' as severity, k.path, case name when 'id_rsa' then 'SSH private key' when 'server.pem' then 'PEM private key' when 'credentials.json' then 'credentials file' else 'private key file' end as detail,
      coalesce(c.agents, '') as agents from keys k left join crew c using (repo) where name in ('id_rsa', 'server.pem', 'credentials.json', 'app.key') and not ({_SAMPLE})""",
    "rule_generated_directories": f"""with {_FILES}, {_LANGS}, php as (select repo from scored where score > 0 qualify row_number() over (partition by repo order by score desc, place) = 1 and language = 'php'),
      found as (select * from dirs where (name in ('dist', 'build', 'coverage', '.next', 'target') or name = 'vendor' and repo not in (select repo from php)) and not ({_SAMPLE})
        and not (name in ('build', 'target', 'vendor') and len(list_filter(string_split(lower(path), '/')[:-2], lambda d: d in ('bin', 'cmd', 'internal', 'lib', 'pkg', 'script', 'scripts', 'src'))) > 0)),
      git as ({_ignored('found', 'codex')}), kept as (select * from found anti join git using (repo, path)), out as ({_ignored('kept', 'cursor')}), pairs as (select f.*, p.agent from kept f join present p using (repo)), seen as ({_SEEN.format(pairs='pairs', out='out')})
      select repo, 'context/generated-directory' as rule_id, 'info' as severity, path, '' as detail, agents from seen""",
    "rule_large_logs": f"""with {_FILES}, found as (select repo, 'logs/note-' || doc_id || '.log' as path, strlen(t) * 256 as size from logs where strlen(t) * 256 >= 262144), git as ({_ignored('found', 'codex')}), kept as (select * from found anti join git using (repo, path)),
      out as ({_ignored('kept', 'cursor')}), asked as (select * from present union all select repo, unnest(['claude-code', 'codex', 'cursor']) from (select distinct repo from files where repo not in (select repo from present))), pairs as (select f.*, p.agent from kept f join asked p using (repo)), seen as ({_SEEN.format(pairs='pairs', out='out')})
      select k.repo, 'context/large-log-file' as rule_id, 'info' as severity, k.path, k.size || ' bytes' as detail, s.agents from kept k join seen s using (repo, path)""",
    "rule_large_instructions": f"with {_FILES} select repo, 'context/large-instruction-file' as rule_id, case when strlen(t) * 16 >= 32768 then 'warning' else 'info' end as severity, '.claude/rules/note-' || doc_id || '.md' as path, '' as detail, '' as agents from ruled where strlen(t) * 16 >= 16384",
    "rule_empty_instructions": f"with {_FILES} select repo, 'instructions/empty-instructions' as rule_id, 'warning' as severity, '.claude/rules/note-' || doc_id || '.md' as path, '' as detail, '' as agents from ruled where not regexp_matches(t, '[^\\s\\x0B]')",
    "rule_duplicate_instructions": f"""with {_FILES}, n as (select repo, '.claude/rules/note-' || doc_id || '.md' as path, {_FORM.replace('(text,', '(t,')} as form from ruled), c as (select repo, form, min(path) as class_id, count(*) as k from n where length(form) >= 80 group by 1, 2 having count(*) > 1)
      select n.repo, 'instructions/duplicate-content' as rule_id, 'info' as severity, n.path, 'duplicate_of=' || c.class_id as detail, '' as agents from n join c using (repo, form) where n.path <> c.class_id""",
    "rule_missing_paths": f"""with {_FILES}, {refs_of("select repo as project_id, '.claude/rules/note-' || doc_id || '.md' as path, t as text from ruled")},
      every as (select repo, path from files union select repo, path from dirs),
      held as (select distinct repo as project_id, array_to_string(ps[:i], '/') as t from (select repo, string_split(path, '/') as ps, unnest(generate_series(1, len(string_split(path, '/')))) as i from every)),
      tries as (select project_id, path, ref, base || ref as t from based union all select project_id, path, ref, ref from based where not regexp_matches(ref, '^\\.\\.?/')),
      plain as (select project_id, path, ref, array_to_string(list_filter(string_split(t, '/'), lambda p: p not in ('', '.')), '/') as t from tries)
      select project_id as repo, 'instructions/missing-path-reference' as rule_id, 'warning' as severity, path, ref as detail, '' as agents from plain p left join held h using (project_id, t) group by 1, 2, 3, 4, 5 having count(h.project_id) = 0""",
    "rule_broad_servers": f"with {_FILES} select repo, 'security/mcp-broad-filesystem' as rule_id, 'critical' as severity, '.cursor/mcp.json' as path, name || ' ' || scope || ' ' || ['broad', 'outside', 'outside'][n + 1] as detail, 'cursor' as agents from scopes where n < 3",
}
