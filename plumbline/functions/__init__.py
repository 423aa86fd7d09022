"""Column-level building blocks: naming, verdicts, small scalar helpers."""
