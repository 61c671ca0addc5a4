from __future__ import annotations

import json

from strataform.operators import passes
from tests.conftest import rows

FILES = {
    "CODEOWNERS": "# c\n/src/ @core # x\n*.md @docs @more\nlonely\n",
    "MAINTAINERS": "Ada <a@b.c>,\n\n@x\n",
    "package.json": json.dumps({"author": {"name": "N", "email": "e"}, "maintainers": ["M", {"name": "O"}], "workspaces": ["p/*"]}),
    "p/a/package.json": json.dumps({"author": " "}),
    "tsconfig.json": "{}",
    "src/order/order.controller.ts": "import { S } from '../billing/billing.service';\nexport class OrderController {}",
    "src/billing/billing.service.ts": "import { R } from './billing.repository';\nclass BillingService {}",
    "src/billing/billing.repository.ts": "import x from 'react';",
    "src/order/index.ts": "export * from './order.controller';",
    "yarn.lock": "",
}


def frame(spark):
    return spark.createDataFrame([("r", p, "file", t) for p, t in FILES.items()], "repo string, path string, kind string, text string")


def test_owner_rules(spark):
    got = {(r.source, r.pattern): r.owners for r in passes.owner_rules(frame(spark)).collect()}
    assert got == {("codeowners", "/src/"): ["@core", "x"], ("codeowners", "*.md"): ["@docs", "@more"], ("maintainers-file", "*"): ["Ada <a@b.c>", "@x"], ("package-maintainers", "*"): ["N <e>", "M", "O"]}


def test_project_marks(spark):
    assert {r.language: r.score for r in passes.languages(frame(spark)).collect()} == {"typescript": 14, "javascript": 5}
    assert [r.manager for r in passes.package_managers(frame(spark)).orderBy("place").collect()] == ["yarn", "npm"]
    assert passes.monorepo(frame(spark)).first().kind_of_monorepo == "npm-workspaces"


def test_dependencies_and_relationships(spark):
    got = {(r.source, r.target, r.type): r.confidence for r in passes.dependencies(frame(spark)).collect()}
    assert got == {("Order", "Billing", "service"): 0.88, ("Billing", "Billing", "repository"): 0.88}
    rel = {(r.source, r.kind, r.target): (r.confidence, r.strength) for r in passes.relationships(frame(spark)).collect()}
    assert rel == {
        ("OrderController", "USES", "BillingService"): (0.99, "strong"),
        ("BillingService", "USES", "BillingRepository"): (0.99, "strong"),
        ("Order", "CONSUMES", "Billing"): (0.82, "medium"),
        ("Order", "DEPENDS_ON", "Billing"): (0.88, "medium"),
        ("Order", "CONTAINS", "OrderController"): (0.89, "strong"),
        ("Order", "CONTAINS", "Index"): (0.89, "strong"),
        ("Billing", "CONTAINS", "BillingService"): (0.89, "strong"),
        ("Billing", "CONTAINS", "BillingRepository"): (0.89, "strong"),
    }


WIDE = {
    "packages/shop/package.json": '{"name": "@acme/shop", "dependencies": {"@acme/core": "1"}}',
    "packages/core/package.json": '{"name": "@acme/core"}',
    "packages/shop/order/order.module.ts": "import { C } from './shop.config';\nexport class OrderModule {}",
    "packages/shop/order/shop.config.ts": "export const Settings = 1",
    "packages/shop/order/order.service.ts": "import { R } from './order.repository';\nexport class OrderService extends Base implements Api, Other { constructor(private readonly r: OrderRepository) { OrderRepository.find() } }",
    "packages/shop/order/order.repository.ts": "export class OrderRepository {}",
    "packages/shop/order/main.ts": "import { NestFactory } from '@nestjs/core'\nconst lazy = import('./order.service')\nrequire('./order.module')\nimport x from '@acme/core'",
    "packages/shop/payment/payment.controller.ts": "import { S } from '../order/order.service'\nexport class PaymentController {}",
    "packages/shop/payment/invoice.service.ts": "",
    "packages/shop/payment/refund.service.ts": "",
    "packages/shop/payment/charge.service.ts": "",
}


def test_every_producer_of_relations(spark):
    df = spark.createDataFrame([("r", p, "file", t) for p, t in WIDE.items()], "repo string, path string, kind string, text string")
    deps = {(r.source, r.target, r.type): r.confidence for r in passes.dependencies(df).collect()}
    # Files of a package carry its name, so relations inside it are kept for some types only.
    assert deps == {("Shop", "Core", "package"): 0.9, ("Shop", "Core", "import"): 0.97, ("Shop", "Shop", "repository"): 0.88, ("Shop", "Shop", "service"): 0.88}
    rel = {(r.source, r.kind, r.target): (r.confidence, r.strength, r.evidence) for r in passes.relationships(df).collect()}
    assert "constructor injection" in rel["OrderService", "CALLS", "OrderRepository"][2] and rel["OrderService", "CALLS", "OrderRepository"][1] == "strong"
    assert {t for s, k, t in rel if (s, k) == ("OrderService", "IMPLEMENTS")} == {"Api", "Other"}
    assert rel["OrderModule", "CONFIGURES", "Settings"][:2] == (0.92, "strong")
    assert rel["Shop", "CONTAINS", "OrderService"][1] == "strong"
    assert rel["Shop", "CONTAINS", "OrderModule"][0] == 0.9 and ("Shop", "DEPENDS_ON", "Core") in rel
    assert rel["Main", "ENTERS", "Shop"][2][0].startswith("entry")
    assert rel["Shop", "PROVIDES", "Payments"][1] == "medium"


def test_fix_plan(spark):
    f = spark.createDataFrame([("r", passes.FIXABLE[0], "a/build", ["codex", "cursor"]), ("r", passes.FIXABLE[0], "a/build", ["cursor"]), ("r", "x", "p", ["cursor"])], "repo string, rule_id string, path string, agents array<string>")
    present = spark.createDataFrame([("r", "cursor")], "repo string, agent string")
    actions, skips = passes.fix_plan(f, present)
    assert rows(actions) == [("r", "cursor", ".cursorignore", "a/build/", ["a/build"])]
    assert rows(passes.skip_histogram(skips)) == [("codex is not set up", 1), ("no safe fix for this rule", 1)]


def test_empty(spark):
    none = frame(spark).limit(0)
    for f in (passes.owner_rules, passes.languages, passes.package_managers, passes.monorepo, passes.dependencies, passes.relationships):
        assert rows(f(none)) == []
