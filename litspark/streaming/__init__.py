"""Streaming.

The analysed pipeline loads complete files and writes one result per run; it
has no watermarks, event-time windows, state or late data. The one
time-partitioned input (weekly folders of JSON lines) is a batch partition
filter, implemented by ``litspark.sources.files.read_json_folders``. No
streaming operator is provided.
"""
