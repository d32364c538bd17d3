from layerstack.functions.activations import (
    ACTIVATIONS,
    clamp_probability,
    delu,
    dlrelu,
    drelu,
    dsigmoid,
    dtanh,
    elu,
    kl_gradient,
    kl_term,
    lrelu,
    over_array,
    relu,
    sigmoid,
    tanh,
)
from layerstack.functions.arrays import (
    cross_entropy,
    dot,
    residual,
    vector_times_matrix,
    with_bias,
    without_bias,
)

__all__ = [
    "ACTIVATIONS", "clamp_probability", "cross_entropy", "delu", "dlrelu", "dot", "drelu",
    "dsigmoid", "dtanh", "elu", "kl_gradient", "kl_term", "lrelu", "over_array", "relu",
    "residual", "sigmoid", "tanh", "vector_times_matrix", "with_bias", "without_bias",
]
