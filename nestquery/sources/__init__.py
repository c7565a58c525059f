"""Where rows come from: JSON text, and files of any format that Spark reads."""

from .files import read_file
from .json_text import Json, from_json, from_json_column, from_json_files, parse_json

__all__ = ["Json", "from_json", "from_json_column", "from_json_files", "parse_json", "read_file"]
