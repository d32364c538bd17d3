"""The two numeric conventions an engine run can follow."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("regular", "denoising", "sparse")
SEMANTICS = ("standard", "reference")
OUTSIDE = ("keep", "clip", "error")


@dataclass(frozen=True)
class Rules:
    """Switches between the textbook definitions and the historical ones."""

    shift_target: bool  # compare output g with input g - 1 (output 0 with the bias)
    masked_target: bool  # denoising: reconstruct the masked input, not the clean one
    fixed_mask: bool  # denoising: one mask for every row, epoch and layer
    beta_power: int  # how often the sparsity weight enters the gradient
    decay: bool  # L2 both in the gradient and as a decay factor
    guard: bool  # keep probabilities off 0 and 1 in the loss, and the step's norm off 0
    same_init: bool  # every layer starts from the same generator seed
    encoder_path: bool  # tied decoder: the gradient leaves out the path through the decoder

    @staticmethod
    def of(semantics: str) -> Rules:
        if semantics == "standard":
            return Rules(False, False, False, 1, False, True, False, False)
        if semantics == "reference":
            return Rules(True, True, True, 2, True, False, True, True)
        raise ValueError(f"semantics must be one of {SEMANTICS}, not {semantics!r}")
