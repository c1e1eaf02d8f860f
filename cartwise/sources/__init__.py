"""Readers, writers and the semantic-name layer (inventory section 2.1)."""

from cartwise.sources.io import (  # noqa: F401
    read_area,
    read_csv,
    read_table,
    semantic_select,
    write_by_area,
    write_table,
)
