"""Chains of operators over the input tables, registered as named queries."""

from importlib import import_module

MODULES = (
    "bakery", "loans", "rides", "wealth", "bookings", "rules", "changes", "activity", "telemetry",
    "flights", "latencies", "notices", "messages", "documents", "vectors", "people", "lookups",
    "scalars", "features", "ingest", "streams", "feeds", "modes", "models",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"weir.plans.{name}")
