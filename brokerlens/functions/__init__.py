"""Column-level helpers (all JVM-side expressions, no Python UDF)."""

from brokerlens.functions.scalar import (bin_index, class_name, has_message, message_length,
                                         ratio, round_doubles, pct)
from brokerlens.functions.temporal import (parse_timestamp, parse_timestamp_strict,
                                           temporal_features, expand_datetime, calendar_date)
from brokerlens.functions.topics import topic_filter_regex, matches_topic_filter, topic_levels

__all__ = ["bin_index", "class_name", "has_message", "message_length", "ratio", "round_doubles",
           "pct", "parse_timestamp", "parse_timestamp_strict", "temporal_features",
           "expand_datetime", "calendar_date", "topic_filter_regex", "matches_topic_filter",
           "topic_levels"]
