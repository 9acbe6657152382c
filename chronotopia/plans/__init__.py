"""Query registry and its SQL counterparts."""
