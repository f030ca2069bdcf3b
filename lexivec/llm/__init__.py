"""Operators for building training corpora; nothing else in lexivec imports this subpackage."""
