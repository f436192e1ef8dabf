from sparkfeat.streaming.streams import (  # noqa: F401
    file_stream, run_available, stream_to_table,
)
