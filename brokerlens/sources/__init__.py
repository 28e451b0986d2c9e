from brokerlens.sources.schema import MESSAGE_SCHEMA, available_columns, require_columns
from brokerlens.sources.readers import read_messages, cached_messages
from brokerlens.sources.fixture import mqtt_messages, MQTT_FIXTURE_SQL

__all__ = ["MESSAGE_SCHEMA", "available_columns", "require_columns", "read_messages",
           "cached_messages", "mqtt_messages", "MQTT_FIXTURE_SQL"]
