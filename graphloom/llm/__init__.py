"""Operators for preparing large text corpora; nothing else in graphloom imports them."""
