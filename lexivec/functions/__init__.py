"""Part of lexivec."""
