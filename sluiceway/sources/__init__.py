"""Readers, writers and model persistence."""

from sluiceway.sources.readers import (
    csv_layouts,
    normalize_headers,
    normalized_names,
    read_available,
    read_csv_union,
    read_parquet_cols,
    read_positional_csv,
    read_uflow,
    uflow_from,
)
from sluiceway.sources.sinks import (
    load_model,
    run_path,
    save_model,
    small_table,
    stamp,
    write_partitions,
    write_parts,
    write_run,
    write_table,
)
from sluiceway.sources.workspace import (
    balanced,
    lineage_cut,
    persisted,
    remove_folder,
    scratch,
    shared_dir,
)

__all__ = [
    "balanced", "csv_layouts", "lineage_cut", "load_model", "normalize_headers", "normalized_names",
    "persisted", "read_available", "read_csv_union", "read_parquet_cols", "read_positional_csv",
    "read_uflow", "remove_folder", "run_path", "save_model", "scratch", "shared_dir", "small_table",
    "stamp", "uflow_from", "write_partitions", "write_parts", "write_run", "write_table",
]
