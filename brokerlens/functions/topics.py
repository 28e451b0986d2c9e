"""MQTT topic helpers: levels and wildcard subscription filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_levels(col: str = "mqtt_topic") -> Column:
    """Array of the '/'-separated levels."""
    return F.split(F.col(col), "/")


def topic_filter_regex(topic_filter: str) -> str:
    """Anchored regex for an MQTT subscription filter.

    ``+`` matches exactly one level (possibly empty); ``#`` must be the
    last level and matches the parent level and everything below it.
    """
    levels = topic_filter.split("/")
    for i, lv in enumerate(levels):
        if "#" in lv and (lv != "#" or i != len(levels) - 1):
            raise ValueError(f"'#' must be a whole, last level: {topic_filter!r}")
        if "+" in lv and lv != "+":
            raise ValueError(f"'+' must be a whole level: {topic_filter!r}")
    parts = []
    for i, lv in enumerate(levels):
        sep = "/" if i else ""
        if lv == "#":
            # 'a/#' also matches 'a'; a lone '#' matches every topic
            parts.append("(/.*)?" if i else ".*")
        elif lv == "+":
            parts.append(sep + "[^/]*")
        else:
            parts.append(sep + re.escape(lv))
    return "^" + "".join(parts) + "$"


def matches_topic_filter(topic_filter: str, col: str = "mqtt_topic") -> Column:
    """True when the topic matches the filter.  A filter starting with a
    wildcard does not match topics starting with '$' (broker topics)."""
    cond = F.col(col).rlike(topic_filter_regex(topic_filter))
    if topic_filter[:1] in ("+", "#"):
        cond = cond & ~F.col(col).startswith("$")
    return cond
