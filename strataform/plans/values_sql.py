"""Fixed values of the SQL counterparts, written out here so that the SQL takes none from the engine it is compared with."""

from __future__ import annotations

#: Words of paths.
STOP_SEGMENTS = (
    "src lib libs app apps packages package modules module internal cmd bin dist build out public static assets styles css js ts tsx jsx mjs cjs "
    "py go rs java kt php rb dart test tests spec specs __tests__ fixtures mocks mock stub stubs types type typings interfaces interface utils "
    "util helpers helper common shared core index main init config configs constants constant models model dto entity entities repository "
    "repositories service services controller controllers handler handlers middleware route routes router api v1 v2 v3 http grpc graphql "
    "component components hook hooks page pages view views provider providers store stores context contexts domain domains feature features "
    "node_modules vendor"
).split()
SAMPLE_DIRECTORIES = (
    "example examples fixture fixtures __fixtures__ integration integrations mock mocks __mocks__ sample samples test tests testing __tests__ "
    "testdata test_data spec specs demo demos e2e bench benchmark benchmarks playground playgrounds sandbox sandboxes"
).split()
TEST_WORDS = (
    "test tests testing fixture fixtures mock mocks testdata spec specs e2e bench benchmark benchmarks playground playgrounds sandbox sandboxes "
    "example examples sample samples demo demos"
).split()
SOURCE_EXTENSIONS = "ts tsx js jsx mjs cjs py go rs java php dart".split()
NO_FEATURE = "src lib app apps packages services modules controllers controller service repositories repository routes config main java kotlin".split()
NO_LABEL = (
    "src lib libs app apps packages package services service modules module internal cmd bin dist build out public static assets test tests spec "
    "specs __tests__ fixtures node_modules vendor main java kotlin resources"
).split()

#: Words of each domain.
DOMAIN_LEXICON = {
    "Payments": "payment payments billing invoice invoices checkout stripe paypal refund refunds subscription subscriptions charge charges".split(),
    "Auth": "auth authentication authorization login logout oauth oidc sso session sessions password passwords jwt rbac".split(),
    "Users": "user users account accounts profile profiles identity identities".split(),
    "Orders": "order orders cart carts checkoutcart fulfillment".split(),
    "Notifications": "notification notifications notify email emails mailer sms push webhook webhooks".split(),
    "Inventory": "inventory stock sku skus warehouse catalog catalogue".split(),
    "Shipping": "shipping shipment shipments delivery logistics carrier".split(),
    "Admin": "admin admins backoffice dashboard".split(),
    "Analytics": "analytics metrics telemetry tracking reporting reports".split(),
    "Search": "search elasticsearch opensearch solr indexer indexing".split(),
}

#: Role and pattern of a lower-case path, in order.
ROLES = [
    ("Module", r"\.module\.(t|j)sx?$"),
    ("Configuration", r"(^|/|[-_.])config(uration)?([-_.]|$)"),
    ("Controller", r"(^|/|[-_.])controllers?([-_.]|$)|controller\.(t|j)sx?$"),
    ("Service", r"(^|/|[-_.])services?([-_.]|$)|service\.(t|j)sx?$"),
    ("Repository", r"(^|/|[-_.])repositor(y|ies)([-_.]|$)|repository\.(t|j)sx?$"),
    ("Database", r"(^|/|[-_.])(entity|entities|schema|models?|prisma|migration)([-_.]|$)"),
    ("Route", r"(^|/)routes?/|(^|/|[-_.])router([-_.]|$)|routes?\.(t|j)sx?$|web\.php$"),
    ("Widget", r"widget\.(dart|tsx?|jsx?)$|_widget\.dart$"),
    ("Bloc", r"bloc\.(dart|tsx?)$|cubit\.dart$"),
    ("EntryPoint", r"(^|/)main\.(t|j)sx?$|(^|/)main\.dart$|(^|/)index\.(t|j)sx?$"),
    ("API", r"(^|/)api/[^/]+$|api\.(t|j)sx?$"),
]

#: Secrets and sensitive names.
SECRETISH = r"(?i)(password|secret|token|api[_-]?key|private[_-]?key|credential)"
SENSITIVE_NAME = r"(?i)(^\.env(\..+)?$|credentials.*\.json$|secret|id_rsa$|id_ed25519$|\.pem$|\.key$)"

#: What is tried behind an import, in order.
TRIED = ["", *(
    ".ts .tsx .js .jsx .mjs .cjs .dart .java .go .py .rs .php /index.ts /index.tsx /index.js /index.jsx /index.mjs /index.dart /__init__.py "
    "/mod.rs"
).split()]

#: What each architecture signal counts.
RELATIONSHIP_SIGNALS = {
    "route_controller": {"kinds": ["EXPOSES"], "target": ["Controller"]},
    "controller_service": {"kinds": ["USES", "CALLS"], "source": ["Controller"], "target": ["Service"]},
    "controller_uses_service": {"kinds": ["USES"], "source": ["Controller"], "target": ["Service"]},
    "app_service": {"kinds": ["USES", "CALLS"], "source": ["Controller", "API", "Route"], "target": ["Service"]},
    "api_service": {"kinds": ["CALLS"], "source": ["API"], "target": ["Service"]},
    "widget_bloc": {"kinds": ["USES"], "source": ["Widget"], "target": ["Bloc"]},
    "bloc_repository": {"kinds": ["USES"], "source": ["Bloc"], "target": ["Repository"]},
    "viewmodel": {"evidence": ["viewmodel", "view-model"]},
    "view_model_edge": {"kinds": ["USES"], "source": ["Widget", "View"], "target": ["Service", "ViewModel", "Model"]},
    "service_repository": {"kinds": ["USES"], "source": ["Service"], "target": ["Repository"]},
    "repository_database": {"kinds": ["USES"], "source": ["Repository"], "target": ["Database", "Entity"]},
    "implements": {"kinds": ["IMPLEMENTS"]},
    "controller_repository": {"kinds": ["USES"], "source": ["Controller"], "target": ["Repository", "Database", "Entity"]},
    "controller_database": {"kinds": ["USES"], "source": ["Controller"], "target": ["Database", "Entity"]},
    "layer_1": {"kinds": ["USES", "CALLS", "EXPOSES"], "evidence": ["Controller → Service"]},
    "layer_2": {"kinds": ["USES"], "evidence": ["Service → Repository"]},
    "layer_3": {"kinds": ["USES"], "evidence": ["Repository → Database"]},
    "module_provides": {"kinds": ["PROVIDES"], "source": ["Module"]},
    "module_wires": {"kinds": ["PROVIDES", "CONFIGURES"], "source": ["Module"]},
    "configures": {"kinds": ["CONFIGURES"]},
    "contains": {"kinds": ["CONTAINS"]},
    "consumes": {"kinds": ["CONSUMES"]},
    "owns": {"kinds": ["OWNS"]},
    "provides_domain": {"kinds": ["PROVIDES"], "evidence": ["domain"]},
    "riverpod": {"evidence": ["riverpod", "provider"]},
    "redux": {"evidence": ["redux", "reducer", "store"]},
}
DEPENDENCY_SIGNALS = {
    "package": {"kinds": ["package"]},
    "declared": {"kinds": ["package"], "evidence": ["declares dependency", "package"]},
    "dynamic": {"kinds": ["dynamic-import"]},
}
