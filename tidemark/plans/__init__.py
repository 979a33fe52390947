"""Plans built from the operators: derived panels, the model arena and the query registry."""

from importlib import import_module

# Modules that register queries.
REGISTERING = ("prepare", "describe", "shape", "forecasts", "learners", "residual_checks", "records")


def load_all() -> None:
    for name in REGISTERING:
        import_module(f"tidemark.plans.{name}")
