"""Layer-wise autoencoders over Spark DataFrames.

Names are looked up on first use, so that a task which needs one module does not import all.
"""

from importlib import import_module

_HOMES = {
    "StackedAutoencoder": "plans.estimator",
    "StackedAutoencoderModel": "plans.estimator",
    "assemble_weights": "operators.matrices",
    "check_gradients": "plans.estimator",
    "corrupt": "operators.prepare",
    "corrupt_fixed": "operators.prepare",
    "feature_profile": "operators.profile",
    "fit_blocked": "plans.blocked",
    "flatten_weights": "operators.matrices",
    "import_text": "sources.weights",
    "model_from_weights": "plans.estimator",
    "model_table": "operators.matrices",
    "read_features": "sources.features",
    "scale_minmax": "operators.prepare",
    "score_stream": "streaming",
    "summarize_check": "operators.gradients",
    "transpose_weights": "operators.matrices",
    "validate_features": "operators.prepare",
    "weight_norms": "operators.matrices",
    "write_libsvm": "sources.features",
}

__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
