from .tables import (
    changed_since, check_columns, content_fingerprint, discover_files, file_fingerprint, load_dataset,
    loader_metadata, read_headerless, read_table, read_tables, normalize_columns, normalized_names, Dataset,
)
from .sinks import evidence_catalog, write_exports, write_table

__all__ = [
    "Dataset", "changed_since", "check_columns", "content_fingerprint", "discover_files",
    "evidence_catalog", "file_fingerprint", "load_dataset", "loader_metadata", "normalize_columns",
    "normalized_names", "read_headerless", "read_table", "read_tables", "write_exports", "write_table",
]
