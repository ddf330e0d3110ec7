from annalist.sources.files import file_manifest
from annalist.sources.tables import table

__all__ = ["file_manifest", "table"]
