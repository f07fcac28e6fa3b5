"""Tables that cut a plan: written to the folder all executors share, dropped when replaced."""

from __future__ import annotations

from ..operators.stage import Stage


class Scratch(Stage):
    """Written tables of one run.  ``table`` writes a frame and reads it back with a fresh plan."""

    table = Stage.write
