"""Query registry: each key maps to a Spark builder and, where the query is
expressible in SQL, an independent DuckDB oracle text."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from brokerlens.functions.scalar import round_doubles
from brokerlens.sources.fixture import MQTT_FIXTURE_SQL


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.build(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        rep = ", ".join(f'round("{c}", 6) AS "{c}"' for c in self.doubles)
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) oracle_q"


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None, dbl=()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, sql, tuple(dbl))
        return fn
    return deco


# ---------------------------------------------------------------------------
# Oracle building blocks (DuckDB dialect).  Fixture thresholds from
# FIXTURES.md: label 66 / 0.25 / 33.
# ---------------------------------------------------------------------------
LABEL_R, LABEL_D, LABEL_T = 66, 0.25, 33

BASE_CTES = f"""mqtt AS ({MQTT_FIXTURE_SQL}),
ipf AS (SELECT general_ip, count(*) AS requests_per_ip,
               avg(CAST(mqtt_duplicate AS DOUBLE)) AS duplicate_rate_per_ip,
               count(DISTINCT mqtt_topic) AS unique_topics_per_ip,
               avg(CAST(mqtt_qos AS DOUBLE)) AS avg_qos_per_ip,
               avg(CAST(mqtt_retained AS DOUBLE)) AS retained_rate_per_ip
        FROM mqtt WHERE general_ip IS NOT NULL GROUP BY general_ip),
labelled AS (SELECT m.*, CAST(hour(m.ts) AS INTEGER) AS hour,
                    CAST(isodow(m.ts) - 1 AS INTEGER) AS day_of_week,
                    CAST(day(m.ts) AS INTEGER) AS day, CAST(month(m.ts) AS INTEGER) AS month,
                    dayname(m.ts) AS day_name,
                    f.requests_per_ip, f.duplicate_rate_per_ip, f.unique_topics_per_ip,
                    f.avg_qos_per_ip, f.retained_rate_per_ip,
                    CASE WHEN f.requests_per_ip > {LABEL_R}
                          AND (f.duplicate_rate_per_ip > {LABEL_D} OR f.unique_topics_per_ip < {LABEL_T})
                         THEN 1 ELSE 0 END AS is_ddos
             FROM mqtt m LEFT JOIN ipf f ON m.general_ip = f.general_ip)"""


def oq(body: str) -> str:
    """Prefix the oracle body with the fixture CTEs.  ``body`` starts with
    SELECT, or with ', name AS (...)' to add more CTEs."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return f"WITH {BASE_CTES}{sep}{body}"
