"""Queries over small tables written for the test: nothing of the whole job is left out."""

from __future__ import annotations

import json

from strataform.operators import passes
from strataform.plans import reference
from strataform.plans.engine import QueryEngine
from tests.conftest import rows


def tables(spark, tmp_path, **given):
    """A directory of tables: name=(rows, schema)."""
    for name, (data, schema) in given.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


DOCUMENTS = "doc_id bigint, project_id string, path string, text string"
EVIDENCE = "project_id string, locator string"


def test_imports_are_resolved_in_their_place_and_project(spark, tmp_path):
    docs = [
        (1, "P ", "src/a/note.md", "import { X } from './x';\nimport { Y } from '../b/y';"),
        (2, "p", "src/a/main.py", "from .tool import f\nimport lib.deep"),
        (3, "p", None, "import { Z } from './src/a/x';\nimport { W } from 'src/a/x';"),
        (4, "q", "main.ts", "import { X } from './src/a/x';"),
        (5, "p", "src/a/note.md", None),
        (6, None, "src/a/note.md", "import { X } from './x';"),
    ]
    files = [("p", f) for f in ("src/a/x.ts", "x.ts", "src/b/y.ts", "src/a/tool.py", "own/lib/deep.py")] + [("q", "other.ts")]
    sf = tables(spark, tmp_path, documents=(docs, DOCUMENTS), brain_evidence=(files, EVIDENCE))
    assert rows(reference.project_imports(spark, sf)) == rows(
        spark.createDataFrame(
            [
                ("p", "src/a/note.md", "./x", "src/a/x.ts"),
                ("p", "src/a/note.md", "../b/y", "src/b/y.ts"),
                ("p", "src/a/main.py", ".tool", "src/a/tool.py"),
                ("p", "src/a/main.py", "lib.deep", "own/lib/deep.py"),
                ("p", None, "./src/a/x", ""),
                ("p", None, "src/a/x", "src/a/x.ts"),
                ("q", "main.ts", "./src/a/x", ""),
            ],
            "p string, path string, s string, t string",
        )
    )


DEPENDENCIES = "edge_id bigint, project_id string, dep_from string, dep_to string, dep_type string, confidence double, evidence array<string>, discovered_at timestamp, loaded_at timestamp"
RELATIONSHIPS = "edge_id bigint, project_id string, rel_source string, rel_target string, relationship string, confidence double, evidence array<string>, strength string, bidirectional boolean, discovered_at timestamp, loaded_at timestamp"
EXPORTS = "export_id bigint, project_id string, snapshot_id string, received_at timestamp, payload string"


def edge_tables(spark, tmp_path, dependencies=(), relationships=(), exports=()):
    """A directory with (from, to) dependencies, (source, kind, target) relationships and the models of exports, all of project p."""
    d = [(i, "p", a, b, "import", 0.9, ["e"], None, None) for i, (a, b) in enumerate(dependencies)]
    r = [(i, "p", a, b, k, 0.9, ["e"], "strong", False, None, None) for i, (a, k, b) in enumerate(relationships)]
    x = [(i, "p", "s", None, json.dumps({"model": m})) for i, m in enumerate(exports)]
    told = {"documents": ([], DOCUMENTS), "brain_claims": ([], "project_id string, subject string, predicate string, claim_object string")}
    return tables(spark, tmp_path, dependency_matches=(d, DEPENDENCIES), relationship_matches=(r, RELATIONSHIPS), brain_exports=(x, EXPORTS), **told)


def test_all_kinds_of_risks_are_listed(spark, tmp_path):
    hubs = [(f"s{i}", f"Hub{k}") for k in range(6) for i in range(3)]
    rel = [("HomeWidget", "USES", "HomeBloc"), ("OrderController", "USES", "OrderService")]
    model = {"entrypoints": [{"file": "src/main.ts", "framework": "Node", "confidence": 1}, {"file": "odd/run.py", "framework": "Python"}], "domains": [{"name": "D", "paths": ["src/a", "/b/c", "src/d", "e/f"]}]}
    sf = edge_tables(spark, tmp_path, hubs, rel, [model, model])
    project = reference.table(spark, sf, "dependency_matches").first()["project_id"]
    rules = spark.createDataFrame([(project.strip().lower(), "/src/", "@x", "codeowners")], "project_id string, pattern string, owner string, source string")
    got = rows(reference.risks(spark, sf, rules).select("kind", "target", "severity", "confidence"))
    assert got == sorted(
        [("dependency-centrality", f"hub{k}", "medium", 0.74) for k in range(6)]
        + [("critical-entrypoint", "src/main.ts", "high", 0.9), ("critical-entrypoint", "odd/run.py", "high", 0.55)]
        + [("architecture-conflict", "BLoC", "medium", 0.5)]
        + [("unclear-ownership", t, "medium", 0.7) for t in ("odd/run.py", "/b/c")],
        key=repr,
    )
    assert [(r.kind, r.target) for r in reference.top_risks(spark, sf).orderBy("place").collect()][:3] == [("critical-entrypoint", "src/main.ts"), ("critical-entrypoint", "odd/run.py"), ("dependency-centrality", "hub0")]
    # Without owner rules the five entrypoints and domain paths are unclear as well.
    assert QueryEngine(spark, sf).run("ListRisks").count == 14


def test_manifests_map_specifiers(spark):
    tree = {
        "srv/go.mod": "module example.com/app\n\ngo 1.22\n",
        "srv/cmd/run.go": 'package main\nimport (\n\t"example.com/app/internal/db"\n)',
        "srv/internal/db/conn.go": "package db",
        "srv/internal/db/conn.ts": "",
        "web/tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@/*": ["./code/*"], "@/ui/*": ["./kit/*"], "only": ["./code/one"]}}}),
        "web/code/cart/a.ts": "import '@/ui/box';\nimport '@/pay/b';\nimport 'only';\nimport '@org/lib/deep';\nimport '@org/lib';\nimport 'react';",
        "web/kit/box.ts": "", "web/code/pay/b.ts": "", "web/code/one.ts": "",
        "libs/lib/package.json": json.dumps({"name": "@org/lib"}), "libs/lib/src/deep.ts": "",
        "web/package.json": json.dumps({"name": "shop", "devDependencies": {"@org/lib": "1", "react": "1"}}),
    }
    files = spark.createDataFrame([("r", p, "file", t) for p, t in tree.items()], "repo string, path string, kind string, text string")
    cart, go = "web/code/cart/a.ts", "srv/cmd/run.go"
    refs = spark.createDataFrame([("r", go, "example.com/app/internal/db"), *[("r", cart, x) for x in ("@/ui/box", "@/pay/b", "only", "@org/lib/deep", "@org/lib", "react")]], "repo string, path string, specifier string")
    assert {r.specifier: r.target for r in passes.resolved(refs, files).collect()} == {
        "example.com/app/internal/db": "srv/internal/db/conn.go", "@/ui/box": "web/kit/box.ts", "@/pay/b": "web/code/pay/b.ts", "only": "web/code/one.ts",
        "@org/lib/deep": "libs/lib/src/deep.ts", "@org/lib": None, "react": None,
    }
    got = {(r.source, r.target, r.type) for r in passes.dependencies(files).collect()}
    # Files below a manifest carry the name of its package, so Cart and Pay are both Shop.
    assert got == {("Shop", "Lib", "package"), ("Shop", "Lib", "import"), ("Srv", "Db", "import")}
