from millstone.sources.tables import (  # noqa: F401
    SourceSpec,
    exclude_urls,
    read_source,
    read_table,
    union_sources,
)
