"""Fixed values which define the results (word lists, caps, texts)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------

IGNORED_DIRECTORIES = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build"]

ENTITY_TOKENS = [
    ("customer", "Customer"),
    ("client", "Customer"),
    ("lead", "Lead"),
    ("opportunity", "Lead"),
    ("order", "Order"),
    ("invoice", "Invoice"),
    ("payment", "Payment"),
    ("stock", "Stock"),
    ("inventory", "Stock"),
    ("ledger", "Ledger"),
    ("account", "Account"),
    ("shipment", "Shipment"),
]

CRUD_TOKENS = [
    ("create", "create"),
    ("insert", "create"),
    ("add", "create"),
    ("save", "update"),
    ("update", "update"),
    ("write", "update"),
    ("set", "update"),
    ("delete", "delete"),
    ("remove", "delete"),
    ("unlink", "delete"),
    ("get", "read"),
    ("fetch", "read"),
    ("read", "read"),
    ("find", "read"),
    ("search", "read"),
    ("list", "read"),
    ("browse", "read"),
]

# Names of the syntax-node classes which add one to the complexity.
BRANCH_KINDS = [
    "If",
    "For",
    "AsyncFor",
    "While",
    "Try",
    "With",
    "AsyncWith",
    "Match",
    "IfExp",
    "BoolOp",
    "ExceptHandler",
    "comprehension",
]

ENTRY_POINT_HINTS = ["confirm", "submit", "process", "assign", "post", "create", "run", "execute"]

SUGGESTIONS = {
    "complexity": [
        "Refactor into smaller functions with single responsibility",
        "Extract service layer to isolate business logic",
    ],
    "coupling": [
        "Introduce interface boundary between modules",
        "Apply dependency injection to decouple components",
    ],
    "dead_code": [
        "Safe to remove after verifying no runtime references",
        "Archive and monitor for regression",
    ],
    "test_gap": [
        "Add unit tests for critical business logic paths",
        "Prioritize integration tests for high-risk flows",
    ],
}

CAPABILITY_DOMAINS = {
    "CRM": ["crm", "lead", "opportunity", "customer", "contact", "prospect"],
    "Billing": ["invoice", "payment", "billing", "account", "ledger", "tax"],
    "Inventory": ["stock", "inventory", "warehouse", "shipment", "procure", "purchase"],
    "Reporting": ["report", "dashboard", "analytics", "kpi", "insight", "metric"],
}

INBOUND_HINTS = ["webhook", "listener", "consumer", "ingest", "receive", "callback", "route", "endpoint"]
OUTBOUND_HINTS = [
    "publish", "emit", "send", "push", "sync", "export", "request", "post", "stripe", "paypal", "queue",
]

RISK_CATEGORIES = ["complexity", "coupling", "dead_code", "test_gap"]
SEVERITIES = ["critical", "high", "medium", "low"]

STEP_PROGRESS = [
    ("ingesting", 8.0),
    ("resolving-source", 15.0),
    ("parsing-python-ast", 35.0),
    ("building-graphs", 62.0),
    ("fallback-analysis", 55.0),
    ("persisting-artifacts", 85.0),
    ("completed", 100.0),
]

SHOWN_STEPS = ["ingesting", "parsing-python-ast", "building-graphs", "persisting-artifacts", "completed"]

PLATFORMS = ["reddit", "x", "other"]
DEFAULT_PLATFORMS = ["reddit", "x"]

FRAMEWORK_SUFFIXES = ["View", "Model", "Serializer", "Controller", "Handler", "Manager", "Mixin"]
LABEL_VERBS = ["Create", "Delete", "Update", "Edit", "Select", "List", "Destroy", "Retrieve"]

DISPLAY_CRUD_WORDS = {
    "Create": ["create", "insert", "add"],
    "Read": ["read", "fetch", "get", "list", "retrieve", "query"],
    "Update": ["update", "edit", "modify", "change"],
    "Delete": ["delete", "remove", "destroy"],
}

WORKFLOW_NODES = 8
TOP_ENTITIES = 6
TOP_TRANSITIONS = 12
COMPLEXITY_FINDINGS = 3
TOP_CLUSTERS = 4
SURFACE_CALLS = 8
BOUNDARIES = 3
BOUNDARY_ENTITIES = 4
TOP_RISKS = 5
RECOMMENDATIONS = 12
PHASE_MODULES = (6, 8, 10)
CONTEXT_NODES = 12
CONTEXT_EDGES = 20
CONTEXT_FINDINGS = 8

# ---- end of fixed values ----------------------------------------------------


def string_array(values: list[str]) -> Column:
    """Literal ARRAY<STRING>; the cast keeps the type for an empty list."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def token_table(pairs: list[tuple[str, str]]) -> Column:
    """Literal ARRAY<STRUCT<token, tag>>, folded to a constant by the optimizer."""
    return F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("tag")) for t, v in pairs])


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs in the text (plain substring tests)."""
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])
