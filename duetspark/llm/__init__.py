"""Operators for preparing training corpora; nothing outside this folder imports them."""
