"""Operators for preparing training text: ten families over `documents`, `conversations`, `labels` and `benchmark`.

Nothing outside this package imports it; deleting it leaves the rest of the library working.
"""
