"""Sources and sinks: parquet/csv/json/orc/JDBC readers, step cache, catalogue."""

from .io import (cached_step, infer_format, load_metadata, load_split, read_jdbc,
                 read_table, sample_rows, save_metadata, write_table)
from .catalog import catalog_select_list, normalize_type_expr, schema_catalog, table_alias
