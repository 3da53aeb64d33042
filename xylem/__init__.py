"""xylem: XML to relational shredding, incremental merge and reconstruction on Spark."""

from xylem.api import DataModel, Document
from xylem.errors import ConfigError, ConflictError, InvalidDocument, SchemaError
from xylem.operators.merge import LoadStats, MergeStats
from xylem.plans.config import load_config, parse_config
from xylem.plans.dialects import DIALECTS, Dialect
from xylem.plans.model import Model, Relation, Table, TargetColumn

__version__ = "0.1.0"
__all__ = ["DIALECTS", "ConfigError", "ConflictError", "DataModel", "Dialect", "Document", "InvalidDocument", "LoadStats", "MergeStats", "Model", "Relation", "SchemaError", "Table", "TargetColumn", "load_config", "parse_config"]
