from layerstack.plans.estimator import (
    StackedAutoencoder,
    StackedAutoencoderModel,
    check_gradients,
    model_from_weights,
)

__all__ = ["StackedAutoencoder", "StackedAutoencoderModel", "check_gradients", "model_from_weights"]
