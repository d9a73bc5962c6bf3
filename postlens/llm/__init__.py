"""Operators for preparing training text. Nothing else in postlens imports this subpackage."""
