"""Named query catalogue: each entry binds an operator to the test tables and carries
the equivalent DuckDB SQL used as an independent oracle."""

from sparkfeat.plans.registry import oracle_sql, queries  # noqa: F401
