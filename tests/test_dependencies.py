"""Dependencies of trees: what is written to disk on the way to them."""

from __future__ import annotations

from strataform.operators import passes, resolve
from tests.conftest import rows

TREE = {
    "web/package.json": '{"name": "shop", "dependencies": {"kit": "1"}}', "kit/package.json": '{"name": "kit"}', "web/cart/package.json": '{"name": "cart"}',
    "web/cart/a.ts": "import '../pay/b';\nimport 'kit';", "web/pay/b.ts": "require('../cart/a')", "kit/c.ts": "", "py/d.py": "from deep.mod import f", "own/deep/mod.py": "",
}
FOUND = {("Shop", "Kit", "package"), ("Cart", "Kit", "import"), ("Cart", "Shop", "import"), ("Shop", "Cart", "require"), ("Py", "Deep", "import")}


def _files(spark):
    return spark.createDataFrame([("r", p, "file", t) for p, t in TREE.items()], "repo string, path string, kind string, text string")


def test_texts_are_read_and_references_resolved_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(passes, "written", lambda df, real=passes.written: made.append(df.columns) or real(df))
    found = passes.dependencies(_files(spark))
    assert {(r.source, r.target, r.type) for r in found.collect()} == FOUND
    assert made == [["repo", "path", "specifier", "type"], ["repo", "path", "specifier", "type", "target"], ["repo", "path", "label"]]


def test_package_roots_beyond_the_bound_are_not_repeated(spark, monkeypatch):
    """Each root is one row of the join; only directories of very many files are spread."""
    few = rows(passes.labels(_files(spark)))
    monkeypatch.setattr(passes, "is_within", lambda df, limit=0: False)
    plain = passes.labels(_files(spark))
    assert rows(plain) == few and "sequence(0, 31" not in plain._jdf.queryExecution().toString()
    monkeypatch.setattr(passes, "HOT_FILES", 0)
    assert rows(passes.labels(_files(spark))) == few


def test_ends_of_paths_are_keys_only_where_asked_for(spark):
    files = spark.createDataFrame([("r", "a/b/c.ts"), ("r", "b/c.ts")], "repo string, path string")
    assert rows(resolve.file_keys(files, ["repo"], with_ends=False)) == [("r", "a/b/c", True, 0, "a/b/c.ts"), ("r", "a/b/c.ts", True, 0, "a/b/c.ts"), ("r", "b/c", True, 0, "b/c.ts"), ("r", "b/c.ts", True, 0, "b/c.ts")]
    assert [r for r in rows(resolve.file_keys(files, ["repo"])) if not r[2]] == [("r", "b/c", False, 0, "a/b/c.ts"), ("r", "c", False, 0, "a/b/c.ts")]


def test_files_that_are_no_source_are_targets(spark):
    tree = {"src/onyx/a.ts": "import '../coral/report.provider'", "src/coral/report.provider.json": None}
    files = spark.createDataFrame([("r", p, "file", t) for p, t in tree.items()], "repo string, path string, kind string, text string")
    assert [(r.source, r.target, r.type, r.evidence) for r in passes.dependencies(files).collect()] == [("Onyx", "Coral", "import", ["src/onyx/a.ts imports src/coral/report.provider.json"])]
