from segspark.sources.build import build_missing, write_audited
from segspark.sources.extract import Extract, Segment, read_extract, stack_extracts
from segspark.sources.files import (
    Field,
    is_complete,
    layout_fields,
    materialize,
    numbered_names,
    read_columns,
    read_delimited,
    read_fixed_width,
    read_many,
    read_partitioned,
    schema_from_codes,
    with_labels,
    write_csv,
    write_fixed_width,
    write_partitioned,
)

__all__ = [
    "Extract",
    "Field",
    "Segment",
    "build_missing",
    "is_complete",
    "layout_fields",
    "materialize",
    "numbered_names",
    "read_columns",
    "read_delimited",
    "read_extract",
    "read_fixed_width",
    "read_many",
    "read_partitioned",
    "schema_from_codes",
    "stack_extracts",
    "with_labels",
    "write_audited",
    "write_csv",
    "write_fixed_width",
    "write_partitioned",
]
