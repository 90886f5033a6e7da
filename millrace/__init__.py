"""Data preparation on Spark DataFrames."""

from .functions.predicates import filter_rows, where
from .operators import routing
from .operators.aggregate import aggregate, attach_aggregates
from .operators.casting import cast_types
from .operators.dedup import deduplicate, duplicate_rows
from .operators.delta import delta
from .operators.joins import denormalize, join, join_chain, join_tables
from .operators.nulls import handle_nulls, null_audit, replace_tokens
from .operators.profile import preview, profile, run_summary, top_values, value_counts
from .operators.ranking import rank_rows
from .operators.shape import (conform, drop_columns, flatten, keep_columns, move_after,
                              prefix_columns, rename, split_columns, tag_source)
from .operators.union import union
from .plans.chains import chain, join_filter_aggregate
from .session import materialize, scratch_path, ship, tune
from .sources.archives import (archive_bad_lines, archive_tables, members, read_archive,
                               union_members)
from .sources.delimited import read_delimited
from .sources.folders import folder_inventory, normalise_output, read_any, union_folder
from .sources.html import html_cells, html_rows, read_html
from .sources.sinks import write, write_outputs
from .sources.structured import read_json, read_parquet, read_xml

__all__ = [
    "aggregate", "archive_bad_lines", "archive_tables", "attach_aggregates", "cast_types", "chain", "conform",
    "deduplicate", "delta", "denormalize", "drop_columns", "duplicate_rows", "filter_rows",
    "flatten", "folder_inventory", "handle_nulls", "html_cells", "html_rows", "join", "join_chain",
    "join_filter_aggregate", "join_tables", "keep_columns", "materialize", "members", "move_after",
    "normalise_output", "null_audit", "prefix_columns", "preview", "profile", "rank_rows",
    "read_any", "read_archive", "read_delimited", "read_html", "read_json", "read_parquet",
    "read_xml", "rename", "replace_tokens", "routing", "run_summary", "scratch_path", "ship",
    "split_columns", "tag_source", "top_values", "tune", "union", "union_folder", "union_members",
    "value_counts", "where", "write", "write_outputs",
]
