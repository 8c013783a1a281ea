from millstone.streaming.stream import (  # noqa: F401
    group_stream,
    pack_stream,
    run_to_table,
    stream_filter,
)
