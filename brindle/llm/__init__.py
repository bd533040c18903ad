"""Operators that prepare training text: one module each, thin queries in ``registry``."""
