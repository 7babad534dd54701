"""Building blocks as SQL text; operators pass them to ``F.expr``."""
