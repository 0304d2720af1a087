"""Plans: a typed chain of stages with a mode and a terminal, as JSON or as objects."""

from .compile import Compiled, compile_plan, settled_columns
from .stages import STAGES, Stage

__all__ = ["Compiled", "compile_plan", "settled_columns", "STAGES", "Stage"]
