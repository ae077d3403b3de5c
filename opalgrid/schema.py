"""Row types and codes shared by all modules."""

from __future__ import annotations

# Pixel formats: code -> channels.  Fixed values.
FORMATS = {"GRAY8": 1, "BGR24": 2, "BGRA32": 3, "RGB24": 4, "RGBA32": 5}
CHANNELS = {1: 1, 2: 3, 3: 4, 4: 3, 5: 4}

IMAGE = "image_id string, height int, width int, format int, data binary, status int, error string"
RECT = "struct<x:int,y:int,w:int,h:int>"
MATCH = "image_id string, template_index int, x int, y int, w int, h int, score double"
LINE = f"struct<box:{RECT},confidence:float,text:string>"

OK, ERROR_ARGUMENT, ERROR_IMAGE = 0, -1, -4
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
