"""DataFrame-level operators (inventory sections 2.2-2.12)."""
