"""Schemas of the rows that the engine reads and writes."""

from __future__ import annotations

ELEMENT = "struct<text:string,bbox_norm:array<int>,focused:boolean>"
ELEMENTS = f"array<{ELEMENT}>"
MANIFEST = "id string, image string, task string, query string, target_label string, target_type string, answer string, metadata map<string,string>"
LABEL = f"id string, image string, task string, query string, elements {ELEMENTS}, coordinate_system string"
#: Keys of a strict label row, in order.
LABEL_KEYS = ("id", "image", "task", "query", "elements", "coordinate_system")
PARSED = (
    f"struct<parse_ok:boolean,usable:boolean,parse_error:string,parse_errors:array<string>,elements:{ELEMENTS},"
    "element_count:int,coordinate_system:string,salvaged:boolean,salvage_reason:string,dropped_tail_element:boolean>"
)
COORDINATE_SYSTEM = "normalized_0_1000"
#: Columns of the experiment summary, in order.
SUMMARY_FIELDS = (
    "experiment", "image_count", "reference_element_count", "prediction_element_count", "element_tp", "element_fp",
    "element_fn", "element_precision", "element_recall", "bbox_iou", "matched_bbox_count",
)
