from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strataform.functions import clean, ids, numbers, paths, text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_keys(spark):
    assert values(spark, clean.norm_key, [" A\t", "", "   ", None, "ß"]) == ["a", None, None, None, "ß"]
    assert values(spark, clean.norm_keys, [["A ", None, "a", " "], [], None], "array<string>") == [["a"], [], None]
    assert values(spark, clean.hundredths, [0.285, 0.88000001, float("nan"), None], "double") == [28 if 0.285 * 100 + 0.5 < 29 else 29, 88, None, None]


def test_rounding(spark):
    assert values(spark, numbers.js_round, [0.285, 1.005, 0.5], "double") == [0.28, 1.0, 0.5]
    assert values(spark, numbers.confidence, [-1.0, 2.0, 0.126], "double") == [0.0, 1.0, 0.13]


def test_tokens(spark):
    got = values(spark, paths.tokens, ["src/billingService/OrderCart.ts", "a/b1/12/x.y.md", "", None])
    assert got == [["billing", "order", "cart"], ["b1"], [], None]


@pytest.mark.parametrize(
    ("path", "kind"), [(".env", "runtime"), ("a/.env.local", "runtime"), (".env.example", "template"), (".env.local.example", "template"), (".ENV_BACKUP", "backup"), ("x.env", None), (".environment", None)]
)
def test_env_class(spark, path, kind):
    assert values(spark, paths.env_class, [path]) == [kind]


def test_key_files_and_samples(spark):
    assert values(spark, paths.key_file_class, ["id_rsa", "a/app.pem", "public-cert.pem", "x.key", "pub.key", "b.p12", "c.txt"]) == [
        "SSH private key", "PEM private key", None, "private key file", None, "PKCS#12 credential bundle", None,
    ]
    assert values(spark, paths.is_sample_path, ["tests/a.env", "src/dockerTest/x", "integration-test/x", "src/app/x", "_fixtures/x", "test.py"]) == [True, True, True, False, True, False]


def test_join_path_and_names(spark):
    assert values(spark, lambda c: paths.join_path(F.lit("a/b"), c), ["../c", "./d", "../../../e", "f/./g"]) == ["a/c", "a/b/d", "e", "a/b/f/g"]
    assert values(spark, paths.pascal_case, ["user-profile.service", "x"]) == ["UserProfileService", "X"]
    assert values(spark, paths.feature_name, ["src/billing/x.ts", "src/x.ts", "a/b.c/de/x"]) == ["Billing", None, "De"]
    assert values(spark, paths.suffixes, ["a/b/c"]) == [["a/b/c", "b/c", "c"]]
    assert values(spark, paths.ancestors, ["a/b/c", "x"]) == [["a", "a/b"], []]


@pytest.mark.parametrize(
    ("pattern", "hit", "miss"),
    [
        ("build/", ["build", "a/build", "a/build/x", "build/y/z"], ["builder/x"]),
        ("a/b/", ["a/b", "a/b/c"], ["x/a/b"]),
        ("/top.txt", ["top.txt"], ["a/top.txt"]),
        ("sub/*.log", ["sub/a.log", "sub/a.log/x"], ["sub/x/a.log"]),
        ("*.log", ["a.log", "x/y/a.log"], ["a.logs"]),
        ("name", ["name", "x/name", "x/name/y"], ["names"]),
    ],
)
def test_ignore_patterns(pattern, hit, miss):
    r = re.compile(paths.ignore_regex(pattern))
    assert all(r.search(p) for p in hit) and not any(r.search(p) for p in miss)


def test_owner_patterns_and_ignore_files():
    assert re.search(paths.owners_regex("/src/"), "src/a/b") and not re.search(paths.owners_regex("/src/"), "x/src/a")
    assert re.search(paths.owners_regex("*.md"), "a/b.md") and not re.search(paths.owners_regex("*.md"), "a/b.mdx")
    assert paths.ignore_lines("# c\n\n a \r\nb\\ c\n") == ["a", "b c"]
    assert paths.rebase_pattern("sub", "!/x") == "!sub/x" and paths.rebase_pattern("sub", "**/y") == "sub/y" and paths.rebase_pattern("", "z") == "z"


def test_hashes(spark):
    def plain(s):
        h = 0
        units = s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % 2**32
        return f"{h:08x}"

    texts = ["", "abc", "Straße\0x", "😀a"]
    assert values(spark, ids.hash31, texts) == [plain(t) for t in texts]
    assert values(spark, lambda c: ids.model_id("domain-discovery", "domain", c), ["Payments"])[0].startswith("domain_")


def test_texts(spark):
    assert values(spark, text.normal_content, ["---\na: b\n---\n Hello  \r\n\r\n\r\n\r\nWorld \n", "--- x", None]) == ["hello\n\nworld", "--- x", None]
    assert values(spark, text.redact_locator, ["src/.env", "id_rsa", "src/a.ts", "a/api_key.ts"]) == ["src/[REDACTED_NAME]", "[REDACTED_PATH]", "src/a.ts", "a/[REDACTED_NAME]"]
    assert values(spark, text.path_candidates, ["see `a/b.md` and [x](c/d.md#e) `a/b.md`"]) == [["c/d.md", "a/b.md"]]
    ok = ["src/a.ts", "./x/y", "../z.md", "notes.md", "fix/login.ts", "docs"]
    no = ["/abs/x", "io/ioutil", "net/http", "github.com/a/b", "try/finally", "dist", "dist/", ".content", "@scope/name", "a b/c", "x/*.ts", "https://a/b", "fix/some-branch", "origin/main", "asset/resource", "bases/base/...", "~/x", "a//b", "v1.2", "{name}/x"]
    assert values(spark, text.local_references, [" ".join(f"`{c}`" for c in [*ok, *no])]) == [ok[:-1]]
    got = values(spark, lambda c: text.references(c, F.lit("ts")), ["import {a} from './a';\nexport * from \"../b\";\nconst c = require('c'); import('./d')\nimport 'node:fs'"])
    assert got == [["./a", "../b", "c", "./d"]]
    assert values(spark, lambda c: text.references(c, F.lit("py")), ["from .a.b import c\nimport d.e\n"]) == [[".a.b", "d.e"]]
