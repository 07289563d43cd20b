"""Column-level building blocks: no action, no shuffle."""
