"""A session with the settings the engine expects, and its tunable constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of the analyses; pass another instance to change them."""

    min_strength: float = 0.1
    min_confidence: float = 0.6
    n_states: int = 4
    similarity_threshold: float = 0.7
    alpha: float = 0.05
    max_lag: int = 30


#: Where streams keep the state of their entities: on disk, so that it may outgrow memory.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def session(name: str = "seriesforge", **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and sizes shuffles; times are UTC; Arrow carries data to Python."""
    b = SparkSession.builder.appName(name)
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **STATE_STORE,
    }
    for k, v in {**own, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
