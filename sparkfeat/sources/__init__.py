from sparkfeat.sources.tables import TABLES, nan_to_null, read_table  # noqa: F401
