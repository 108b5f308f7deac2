"""Spark-native analytics for multimodal time series recorded from interacting pairs."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names by module. They load on first use, so that tasks import only what they run.
_PUBLIC = {
    "plans.analyzer": ["Parameters", "Results", "analyse", "load_report", "prepare", "run"],
    "operators.align": ["align"],
    "operators.context": ["context_at", "contexts"],
    "operators.cascade": ["ccf", "rolling"],
    "operators.features": ["all_pairs", "features", "per_context"],
    "operators.predict": ["cross_modal", "leave_one_dyad_out", "rolling_origin_cv"],
    "operators.wcc": ["pairs", "wcc"],
    "sources.delimited": ["load_csv", "load_multimodal"],
    "sources.synthetic": ["ground_truth", "multimodal"],
}
__all__ = sorted(n for names in _PUBLIC.values() for n in names)


def __getattr__(name: str):
    for module, names in _PUBLIC.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{module}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
