"""SQL counterparts (DuckDB) of the queries in reports.py."""

from __future__ import annotations

from strataform.plans.reference_sql import _ARCH, _COUNTS, _EXP, _MEAN, _OWNED, _RISKS, FINDINGS, D, L, R, _score, strip, upper
from strataform.plans.store_sql import DOCS, P3_FOUND, flat, key

_HEADS = "heads as (select *, row_number() over (partition by repo order by case severity when 'critical' then 3 when 'warning' then 2 else 1 end desc, finding_id) as place from f)"
_SIDES = "b as (select distinct repo, path from f where ts < timestamp '2024-01-16'), a as (select distinct repo, path from f where ts >= timestamp '2024-01-16')"
_DOMAIN = f"select e.project_id, d.export_id, d.pos, d.name as domain from ({flat('m', 'domains', {'name': 'name'})}) d join exp e using (export_id)"
_SOME = {
    "no owner rules": "select project_id from rules",
    "no domains": f"select e.project_id from ({flat('m', 'domains', {'name': 'name'})}) join exp e using (export_id)",
    "no entrypoints": f"select e.project_id from ({flat('m', 'entrypoints', {'file': 'file'})}) join exp e using (export_id)",
    "no architectures": f"select e.project_id from ({flat('m', 'architectures', {'pattern': 'pattern'})}) join exp e using (export_id)",
}

SQL = {
    "finding_heads": f"with {FINDINGS}, {_HEADS} select repo, cast(place as int) as place, finding_id, severity, rule_id from heads where place <= 8",
    "risk_kinds": f"with {_RISKS} select project_id, kind, count(*) as n from all_risks group by 1, 2",
    "pass_rollup": f"""with c as (select project_id, r.source_pass, r.status, r.confidence from (select {key('project_id')} as project_id, {key('snapshot_id')} as s, {key('claim_id')} as c,
        arg_max({{'source_pass': {key('source_pass')}, 'status': {upper('status')}, 'confidence': confidence}}, loaded_at) as r from brain_claims group by 1, 2, 3) where project_id is not null and s is not null and c is not null)
      select source_pass, count(*) as n_claims, count(distinct project_id) as n_projects, {_MEAN.format(c='confidence')} as confidence, min(confidence) as least, count(*) filter (status = 'ACTIVE') as n_active from c where source_pass is not null group by 1""",
    "noise_leaders": f"with {D}, {R}, {DOCS}, {_EXP}, {_ARCH} select pattern, count(*) as n from inferred where pattern not in ('MVC', 'Clean Architecture', 'Modular Monolith') group by 1 order by n desc, pattern limit 5",
    "component_links": f"""with {D}, {DOCS}, {_EXP}, {L}, {_OWNED}, comp as (select distinct e.project_id, c.id, {strip('c.name')} as name, c.path from ({flat('b', 'components', {'id': 'id', 'name': 'name', 'path': 'path'})}) c join exp e using (export_id) where c.path <> ''),
      ent as (select e.project_id, f.file as path, count(*) as n from ({flat('m', 'entrypoints', {'file': 'file'})}) f join exp e using (export_id) where f.file is not null group by 1, 2),
      dom as (select d.project_id, regexp_replace(i.item, '/[^/]*$', '') as dir, max(d.domain) as domain from ({_DOMAIN}) d join ({P3_FOUND}) i on i.export_id = d.export_id and i.parent_pos = d.pos and i.entity = 'domain_path' and contains(i.item, '/') group by 1, 2),
      own as (select c.project_id, c.path, r.owner from (select distinct project_id, path from comp) c join ready r on r.project_id = c.project_id and regexp_matches(c.path, r.regex)
        qualify row_number() over (partition by c.project_id, c.path order by case r.source when 'codeowners' then 2 else 1 end desc, case r.source when 'package' then length(r.pattern) else 0 end desc, r.pattern desc, r.owner desc) = 1),
      i as (select project_id, target as k, count(*) as n from deps group by 1, 2), o as (select project_id, source as k, count(*) as n from deps group by 1, 2),
      x as (select c.*, coalesce(i.n, 0) as n_in, coalesce(o.n, 0) as n_out, coalesce(t.n, 0) as n_entries, (select max(m.domain) from dom m where m.project_id = c.project_id and starts_with(c.path, m.dir || '/')) as domain, w.owner from comp c
        left join i on i.project_id = c.project_id and i.k = {key('c.name')} left join o on o.project_id = c.project_id and o.k = {key('c.name')} left join ent t on t.project_id = c.project_id and t.path = c.path left join own w on w.project_id = c.project_id and w.path = c.path)
      select *, case when n_entries > 0 then 'entrypoint' when domain is not null then 'domain' else 'module' end as kind from x""",
    "domain_evidence": f"""with {DOCS}, {_EXP}, told as (select distinct d.project_id, d.domain, i.item as locator from ({_DOMAIN}) d join ({P3_FOUND}) i on i.export_id = d.export_id and i.parent_pos = d.pos and i.entity = 'domain_path' where d.domain is not null),
      held as (select distinct {key('project_id')} as project_id, {key('evidence_id')} as evidence_id, locator from brain_evidence where {key('evidence_id')} is not null)
      select t.project_id, t.domain, t.locator, count(*) as n_evidence from told t join held h on h.project_id = t.project_id and h.locator = t.locator group by 1, 2, 3""",
    "unknowns": f"with {D}, {DOCS}, {_EXP}, {L}, {_OWNED}, every as (select project_id from deps union select project_id from files) " + " union all ".join(f"select project_id, '{w}' as unknown from every where project_id not in ({q})" for w, q in _SOME.items()),
    "step_summary": f"""with {FINDINGS}, {_HEADS}, told as (select repo, string_agg(concat_ws(' ', severity, rule_id, finding_id), chr(10) order by place) as findings from heads where place <= 20 group by 1), c as (select repo, {_COUNTS} from f group by 1)
      select repo, n_critical, n_warning, n_info, findings from c join told using (repo)""",
    "report_json": f"""with {FINDINGS}, s as (select repo, {_score()} as score, {_COUNTS} from f group by 1)
      select repo, '{{"repo":' || repo || ',"score":' || score || ',"summary":{{"critical":' || n_critical || ',"warning":' || n_warning || ',"info":' || n_info || ',"total":' || n_total || '}}}}' as report from s""",
    "verify_report": f"""with {FINDINGS}, {_SIDES} select repo, count(*) filter (s = 'new') as n_new, count(*) filter (s = 'resolved') as n_resolved, count(*) filter (s = 'remaining') as n_remaining
      from (select coalesce(a.repo, b.repo) as repo, case when b.path is null then 'new' when a.path is null then 'resolved' else 'remaining' end as s from a full join b on a.repo = b.repo and a.path = b.path) group by 1""",
}
