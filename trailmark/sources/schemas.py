"""Explicit schemas of the files read and written."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_METADATA = (
    "IMG_ID string, LAT double, LON double, country string, region string, city string, neighbourhood string, "
    "continent string, path string"
)
GROUND_TRUTH = "id bigint, latitude double, longitude double, country string, state string, city string"

# Message content is text or a list of parts; a list arrives as its JSON text.
TRAJECTORY = (
    "id string, gt_lat double, gt_lon double, gt_country string, gt_city string, pred_lat double, pred_lon double, "
    "km double, masked double, n_tool_calls int, n_crop_calls int, n_search_calls int, n_tavily_calls int, n_nudges int, "
    "max_turns_exceeded boolean, useful_results array<struct<turn:int,tool:string,indices:array<int>>>, "
    "messages array<struct<role:string,content:string>>, images array<string>"
)
SFT_SAMPLE = "messages array<struct<role:string,content:string>>, images array<struct<image:string>>"
REGIONS = (
    "index bigint, image_path string, ground_truth string, pred_km double, has_useful_region boolean, "
    "verified_regions array<struct<bbox:array<double>,label:string,gain:double,is_useful:boolean>>"
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
