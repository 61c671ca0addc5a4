"""The tree source and what is read from trees, over an authored tree."""

from __future__ import annotations

import json

import pytest

from strataform.operators import entrypoints, rules
from strataform.operators.resolve import resolve
from strataform.sources import repofs, servers
from tests.conftest import rows

BODY = "# Rules\n" + "Keep the agent inside the tree and read the notes before a change. " * 3


@pytest.fixture
def tree(tmp_path):
    files = {
        ".env": "A=1",
        ".env_backup": "A=1",
        ".env.example": "A=",
        "tests/.env": "A=1",
        "id_rsa": "x",
        "certs/app.pem": "x",
        "certs/public-cert.pem": "x",
        "CLAUDE.md": BODY + "\nsee `src/main.ts` and `docs/missing.md` and [x](src)\n",
        "AGENTS.md": "---\na: b\n---\n" + BODY.upper().replace("\n", "\r\n") + "\r\nSEE `SRC/MAIN.TS` AND `DOCS/MISSING.MD` AND [X](SRC)\r\n",
        "packages/api/AGENTS.md": " \n",
        ".cursor/mcp.json": json.dumps({"mcpServers": {"fs": {"command": "npx", "args": ["-y", "server-filesystem", "/", "./x"], "env": {"B": "1", "A": "2"}}, "bad": 3, "web": {"url": "http://x"}}}),
        ".mcp.json": "{",
        ".codex/config.toml": '[mcp_servers.a]\ncommand = "c"\nargs = ["x"]\n# no\n[mcp_servers.a]\nurl = "u"\nenv = { K = "v", J = "w" }\n[permissions.fs]\n".env" = "deny"\n"web/.nuxt/**" = "deny"\n',
        ".claude/settings.json": '{"permissions": {"defaultMode": "bypassPermissions", "deny": ["Read(./.env)", "Read(/**/debug.log)"]}}',
        "src/main.ts": "import { NestFactory } from '@nestjs/core';\nimport { A } from './svc/a';",
        "src/svc/a.ts": "export const a = 1",
        "src/svc/index.ts": "",
        "lib/main.dart": "void main() => runApp(x)",
        "debug.log": "l" * 300_000,
        "node_modules/x/index.js": "x",
        "apps/build/out.js": "x",
        "scripts/build/y.js": "x",
        "blob.bin": "a\0b",
        ".gitignore": "*.tmp\ncoverage/\n",
        ".cursorignore": "apps/build\n",
        "apps/.gitignore": "# no\n!keep\n",
        "coverage/x.js": "x",
        "web/.nuxt/y.js": "x",
        "vendor/z.php": "x",
    }
    for name, content in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content.encode())
    (tmp_path / "escape").symlink_to("/etc/hostname")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


@pytest.fixture
def files(spark, tree):
    repofs.register(spark)
    return spark.read.format("repofs").option("path", str(tree)).load()


def test_walk(files):
    got = {(r.path, r.kind): r for r in files.collect()}
    paths = {p for p, k in got if k == "file"}
    assert {".env", ".cursor/mcp.json", "src/svc/a.ts", "blob.bin", "debug.log"} <= paths and "escape" not in paths
    assert ("node_modules", "skipped") in got and ("apps/build", "skipped") in got and not any("node_modules/" in p for p in paths)
    assert got["blob.bin", "file"].is_binary and got["blob.bin", "file"].text is None and got["packages/api/AGENTS.md", "file"].is_empty
    assert len(paths) == len([1 for _, k in got if k == "file"])


def test_servers(files):
    found = servers.servers(files).orderBy("ord").collect()
    got = {(r.agent, r.name): r for r in found if r.agent != "codex"}
    fs = got["cursor", "fs"]
    assert (fs.transport, fs.scopes, fs.env_keys) == ("stdio", ["/", "./x"], ["A", "B"])
    assert got["cursor", "bad"].parse_error and got["claude-code", "(malformed)"].parse_error and got["cursor", "web"].transport == "http"
    codex = [r for r in found if r.agent == "codex"]
    assert [r.name for r in codex] == ["a", "a"] and codex[0].command == "c" and codex[1].env_keys == ["J", "K"]


def test_rules(files):
    found = rules.run(files).collect()
    by = lambda rule: sorted((r.path, r.detail) for r in found if r.rule_id == rule)
    agents = {(r.rule_id, r.path): r.agents for r in found}
    # The environment file is denied to two agents and left out by the third's own defaults; the backup matches no default.
    assert by("security/env-file-exposure") == [(".env_backup", "backup")]
    assert agents["security/env-file-exposure", ".env_backup"] == ["claude-code", "codex", "cursor"]
    assert by("security/private-key-file") == [("certs/app.pem", "PEM private key"), ("id_rsa", "SSH private key")]
    assert agents["security/private-key-file", "id_rsa"] == ["claude-code", "codex", "cursor"]
    assert by("security/claude-bypass-permissions") == [(".claude/settings.json", "")]
    assert by("security/mcp-broad-filesystem") == [(".cursor/mcp.json", "fs / broad")] and agents["security/mcp-broad-filesystem", ".cursor/mcp.json"] == ["cursor"]
    assert [p for p, _ in by("mcp/malformed-config")] == [".cursor/mcp.json", ".mcp.json"]
    assert by("mcp/duplicate-server") == [(".codex/config.toml", "a")]
    assert [p for p, _ in by("instructions/empty-instructions")] == ["packages/api/AGENTS.md"]
    assert by("instructions/duplicate-content") == [("CLAUDE.md", "duplicate_of=AGENTS.md")]
    assert ("CLAUDE.md", "docs/missing.md") in by("instructions/missing-path-reference") and ("CLAUDE.md", "src/main.ts") not in by("instructions/missing-path-reference")
    assert [p for p, _ in by("context/large-log-file")] == ["debug.log"] and agents["context/large-log-file", "debug.log"] == ["codex", "cursor"]
    # coverage is ignored, node_modules is no build output, vendor is one outside PHP projects.
    assert [p for p, _ in by("context/generated-directory")] == ["apps/build", "vendor", "web/.nuxt"]
    assert agents["context/generated-directory", "apps/build"] == ["claude-code", "codex"] and agents["context/generated-directory", "web/.nuxt"] == ["claude-code", "cursor"]
    only = rules.run(files, include=["mcp/duplicate-server"])
    assert {r.rule_id for r in only.collect()} == {"mcp/duplicate-server"}


def test_rules_go_by_repository(spark):
    schema = "repo string, path string, kind string, size_bytes bigint, text string, is_empty boolean"
    data = [("a", ".env", "file", 1, "x", False), ("b", ".env", "file", 1, "x", False), ("b", "AGENTS.md", "file", 9, "x", False), ("c", ".env", "file", 1, "x", False), ("c", "AGENTS.md", "file", 9, "x", False), ("c", ".codex/config.toml", "file", 9, '".env" = "deny"', False)]
    data += [("b", "dist", "skipped", None, None, None), ("a", "dist", "skipped", None, None, None), ("d", "vendor", "skipped", None, None, None), ("d", "AGENTS.md", "file", 1, "x", False), ("d", "composer.json", "file", 1, "{}", False)]
    found = {(r.repo, r.path, r.detail): r.agents for r in rules.run(spark.createDataFrame(data, schema), include=["security/env-file-exposure", "context/generated-directory"]).collect()}
    # Without agents the file is told all the same; with them it is if one may read it.
    assert found == {("a", ".env", "runtime-no-agent"): [], ("b", ".env", "runtime"): ["codex"], ("b", "dist", ""): ["codex", "cursor"]}


def test_scopes_are_folded(spark):
    from pyspark.sql import functions as F

    cases = {"/r": "ok", "/r/x": "ok", "/r/../etc": "outside", "/r/./a/../b": "ok", "/rx": "outside", "../x": "outside", "./x": "ok", "~/x": "broad", "": "unknown", "/": "broad"}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.c for r in df.select("s", servers.scope_class(F.col("s"), F.lit("/r")).alias("c")).collect()} == cases


def test_entrypoints(files):
    got = {(r.path, r.framework): r.confidence for r in entrypoints.discover(files.where("kind = 'file'")).collect()}
    assert got == {("src/main.ts", "NestJS"): 0.85, ("lib/main.dart", "Flutter"): 0.8}


def test_resolve(spark):
    files = spark.createDataFrame([("r", p) for p in ["src/a.ts", "src/b/index.ts", "pkg/mod/__init__.py", "pkg/mod/x.py", "j/src/com/acme/Foo.java", "lib/w.dart", "app/Http/K.php"]], "repo string, path string")
    refs = [
        ("src/main.ts", "./a", "src/a.ts"), ("src/main.ts", "./a.js", "src/a.ts"), ("src/main.ts", "./b", "src/b/index.ts"), ("src/main.ts", "react", None), ("pkg/mod/y.py", ".x", "pkg/mod/x.py"),
        ("pkg/z.py", "mod", "pkg/mod/__init__.py"), ("q.java", "com.acme.Foo", "j/src/com/acme/Foo.java"), ("lib/m.dart", "w.dart", "lib/w.dart"), ("r.php", "App\\Http\\K", "app/Http/K.php"), ("r.php", None, None),
    ]
    df = spark.createDataFrame([("r", p, s) for p, s, _ in refs], "repo string, path string, specifier string")
    got = rows(resolve(df, files, ["repo"]).select("path", "specifier", "target"))
    assert got == sorted(refs, key=repr)


def test_endings_are_tried_on_files_not_on_references(spark):
    # The first ending in order wins, the file as it stands before all, an index after all extensions.
    paths = [("a", "x.ts"), ("a", "x/index.ts"), ("a", "x"), ("a", "y.js"), ("a", "y/index.dart"), ("a", "z/mod.rs"), ("a", ".ts"), ("a", "w.ts.tsx"), ("a", "w.ts/v.ts"), ("a", "n7.ts"), ("b", "x.go")]
    files = spark.createDataFrame(paths, "repo string, path string")
    refs = [
        ("a", "m.ts", "./x", "x"), ("a", "m.ts", "x.js", "x"), ("a", "m.ts", "y", "y.js"), ("a", "m.ts", "z", "z/mod.rs"), ("a", "m.ts", "..", ".ts"), ("a", "m.ts", "w", "w.ts.tsx"), ("a", "m.dart", "package:q/v", "w.ts/v.ts"),
        ("a", "m.py", "x.index", "x/index.ts"), ("b", "m.ts", "x", "x.go"), ("b", "m.ts", "y", None),
    ]
    schema = "repo string, path string, specifier string"
    assert rows(resolve(spark.createDataFrame([r[:3] for r in refs], schema), files, ["repo"])) == sorted(refs, key=repr)
    # A side that Spark may send to all tasks has one row for each candidate: Spark takes it to be as large as the references.
    many = spark.createDataFrame([("a", "m.ts", f"n{i}") for i in range(600)], schema)
    done = resolve(many, files, ["repo"])
    assert len(done.collect()) == 600
    made = [n.metrics().apply("numOutputRows").value() for n in _nodes(done._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
    assert made and max(made) <= 600


def _nodes(node):
    """The nodes of a plan that ran, those of its stages too."""
    kind = node.getClass().getSimpleName()
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
    return [node, *(n for b in below for n in _nodes(b))]
