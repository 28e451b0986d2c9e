"""Many topic filters against many topics: a trie of topic levels, walked level by level.

The trie's nodes are the filters' beginnings.  Every distinct topic starts at the root and
moves, by an equality join on (node, level), to the child for its next level and to the one
for ``+``; a ``#`` child matches at once.  A topic is in as many nodes as filters fit its
beginning, so there is no pairing of all topics with all filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.topics import topic_filter_regex
from brokerlens.operators.basic import materialize


def _valid(filters: DataFrame) -> DataFrame:
    """Distinct non-null filters as (filter, levels); raises for a misplaced wildcard."""
    f = filters.select("filter").where("filter IS NOT NULL").distinct().withColumn("levels", F.split("filter", "/"))
    inner = F.slice("levels", F.lit(1), F.size("levels") - 1)
    whole = F.exists("levels", lambda x: (F.contains(x, F.lit("+")) & (x != "+")) | (F.contains(x, F.lit("#")) & (x != "#")))
    bad = f.where(whole | F.array_contains(inner, "#")).select("filter").first()
    if bad is not None:
        topic_filter_regex(bad["filter"])
    return f


def match_topic_filters(topics: DataFrame, filters: DataFrame) -> DataFrame:
    """(mqtt_topic, filter): every distinct topic of ``topics`` with each of ``filters`` (filter) that it matches.

    ``+`` stands for one level, ``#`` for the level above it and all below; a filter that starts with a wildcard
    does not match topics that start with ``$``.  Null topics and filters match nothing."""
    f = materialize(_valid(filters))
    depth = f.agg(F.max(F.size("levels"))).first()[0] or 0
    # (node, level, child): a node is the beginning of filters, the root is null-free text of its own
    steps = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("levels")), lambda i: F.struct(
        F.concat(F.lit("/"), F.array_join(F.slice("levels", F.lit(1), i - 1), "/")).alias("node"), (i - 1).alias("at"),
        F.element_at("levels", i).alias("level"), F.concat(F.lit("/"), F.array_join(F.slice("levels", F.lit(1), i), "/")).alias("child")))).alias("s"))
    steps = materialize(steps.select("s.*").distinct())
    ends = f.select(F.concat(F.lit("/"), "filter").alias("node"), F.size("levels").alias("at"), "filter")
    t = topics.select("mqtt_topic").where("mqtt_topic IS NOT NULL").distinct()
    found = None
    here = t.select("mqtt_topic", F.split("mqtt_topic", "/").alias("levels"), F.lit("/").alias("node"))
    for at in range(depth + 1):
        out = steps.where(F.col("at") == at)
        broker = F.lit(at == 0) & F.col("mqtt_topic").startswith("$")
        rest = out.where("level = '#'").select("node", F.substring("child", F.lit(2), F.length("child")).alias("filter"))
        hits = here.join(rest, "node").where(~broker).select("mqtt_topic", "filter")
        whole = here.where(F.size("levels") == at).join(ends.where(F.col("at") == at).select("node", "filter"), "node").select("mqtt_topic", "filter")
        hits = hits.union(whole)
        found = hits if found is None else found.union(hits)
        if at == depth:
            break
        own = F.explode(F.array_distinct(F.array(F.get("levels", F.lit(at)), F.lit("+")))).alias("level")
        going = here.where(F.size("levels") > at).select("mqtt_topic", "levels", "node", own)
        plus = (F.col("level") == "+") & broker
        # a '#' level of a topic is text, not a way to a wildcard
        here = going.where(~plus & (F.col("level") != "#")).join(out.select("node", "level", "child"), ["node", "level"]).select(
            "mqtt_topic", "levels", F.col("child").alias("node"))
        here = materialize(here)
    return found.distinct()
