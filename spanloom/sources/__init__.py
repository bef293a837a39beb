"""Where tables come from and go to."""

from .annotations import parse_annotations, read_annotations, read_raw_annotations, to_json_lines, to_json_objects
from .frame_index import FrameIndex, open_frame_index, write_frame_index
from .inventory import find_video_inventory, read_video_categories, read_video_inventory
from .sinks import write_results, write_samples, write_tables
from .tables import read_table

__all__ = [
    "FrameIndex",
    "find_video_inventory",
    "open_frame_index",
    "parse_annotations",
    "read_annotations",
    "read_raw_annotations",
    "read_table",
    "read_video_categories",
    "read_video_inventory",
    "to_json_lines",
    "to_json_objects",
    "write_frame_index",
    "write_results",
    "write_samples",
    "write_tables",
]
