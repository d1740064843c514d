"""Relational operators on streams, frames and messages."""
