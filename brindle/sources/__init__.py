"""Tables: versioned Parquet snapshots, and the catalog that names them."""

from .catalog import Catalog, Conflict, Manifest, TableInfo
from .storage import Storage

__all__ = ["Catalog", "Conflict", "Manifest", "Storage", "TableInfo"]
