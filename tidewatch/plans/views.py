"""SQL entry point: the library's tables as named views of a session, and the source queries as SQL text.

``register`` names views; they are plans, so a query on them is pushed down as
one on DataFrames is.  The texts take named parameters, no string is put into
them.  Instants are those of the data: the newest row stands for now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import measurements as M
from ..sources import adapters as A

#: What there is to see of the newest rows: some bursts of the last hours and their loss.
RECENT_BURSTS = """
SELECT start_time, prb_id, dst_addr, packets_sent, packets_received,
       round(try_divide(packets_sent - packets_received, packets_sent) * 100, 2) AS loss_pct
FROM bursts
WHERE start_time >= (SELECT max(start_time) FROM bursts) - make_dt_interval(0, :hours) AND packets_sent > 0
ORDER BY start_time DESC, prb_id, dst_addr, packets_sent, packets_received
LIMIT :rows
"""

#: Bursts of chosen probes to chosen destinations over the last days, with the destination's country and region.
REGIONAL_BURSTS = """
WITH probe AS (SELECT explode(:probes) AS prb_id), destination AS (SELECT explode(:destinations) AS dst_addr)
SELECT m.start_time, m.msm_id, m.prb_id, m.dst_addr, m.destination_country, m.destination_region, m.packets_sent, m.packets_received, m.pings
FROM bursts m LEFT SEMI JOIN probe p ON m.prb_id = p.prb_id LEFT SEMI JOIN destination d ON m.dst_addr = d.dst_addr
WHERE m.start_time >= (SELECT max(start_time) FROM bursts) - make_dt_interval(:days) AND m.packets_sent > 0
"""

#: Classes by route over the labelled view.
CLASSES_BY_ROUTE = """
SELECT route, status_now, count(*) AS n, count_if(status_now = status_future) AS n_same
FROM labelled GROUP BY route, status_now
"""


def register(spark: SparkSession, sf_dir: str, chain: object | None = None) -> list[str]:
    """Makes the views bursts, burst_measurements, measurements, cards and labelled, replacing older ones; returns their names."""
    from .registry import Chain

    chain = chain or Chain(spark, sf_dir)
    bursts = A.order_bursts(spark, sf_dir)
    views = {"bursts": bursts, "burst_measurements": M.measurements(bursts), "measurements": chain.meas, "cards": chain.card, "labelled": chain.blk}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def recent_bursts(spark: SparkSession, hours: int = 24, rows: int = 20) -> DataFrame:
    return spark.sql(RECENT_BURSTS, args={"hours": hours, "rows": rows})


def regional_bursts(spark: SparkSession, probes: list[int], destinations: list[str], days: int = 7) -> DataFrame:
    return spark.sql(REGIONAL_BURSTS, args={"probes": probes, "destinations": destinations, "days": days})


def classes_by_route(spark: SparkSession) -> DataFrame:
    return spark.sql(CLASSES_BY_ROUTE)
