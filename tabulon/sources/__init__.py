"""Readers and writers of datasets."""

from .files import read_csv, read_jdbc, read_parquet, write_csv, write_parquet
from .json_dataset import read_bindings, read_json, write_json
from .sdmx import Workflow, read_structure, read_transformations, structure_of_dataflow

__all__ = ["Workflow", "read_bindings", "read_csv", "read_jdbc", "read_json", "read_parquet", "read_structure", "read_transformations", "structure_of_dataflow", "write_csv", "write_json", "write_parquet"]
