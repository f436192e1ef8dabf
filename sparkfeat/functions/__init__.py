from sparkfeat.functions.columns import (  # noqa: F401
    as_col, hash_unit, is_close, pass_rate, round6, safe_ratio, ts_string, truthy,
)
