"""The engine's components, under the name the training-data operators use."""

from kinweave.operators.components import components, label

__all__ = ["components", "label"]
