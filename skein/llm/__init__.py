"""Operators for preparing large training corpora; see the modules for each contract."""
