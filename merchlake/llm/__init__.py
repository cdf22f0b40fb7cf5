"""Operators for preparing training data: language, duplicates, packing, mixing, search, secrets, toxicity.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library whole.
"""
