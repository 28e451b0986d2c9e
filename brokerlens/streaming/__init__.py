from brokerlens.streaming.rate_limit import (deduplicate_stream, rate_limit_alerts, rate_limit_stream,
                                             read_alerts, run_rate_limit)

__all__ = ["deduplicate_stream", "rate_limit_alerts", "rate_limit_stream", "read_alerts", "run_rate_limit"]
