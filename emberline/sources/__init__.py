"""Readers of landed feed files. A feed that cannot be read gives no rows and says why."""
