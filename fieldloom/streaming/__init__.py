"""Time stepping: the model has no event streams, so a step is a run over the state of the one before."""

from fieldloom.operators.stencil import steps

__all__ = ["steps"]
