"""Tables on disk: data files, the sidecar catalog and writers."""

from .catalog import Catalog, IndexMeta
from .store import DataFile, Store
from .writer import write_table

__all__ = ["Catalog", "DataFile", "IndexMeta", "Store", "write_table"]
