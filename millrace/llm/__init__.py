"""Operators for preparing training text; each module states its method and its edge cases."""
