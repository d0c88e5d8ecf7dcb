"""The few expressions that Spark SQL and the checking engine spell differently."""

from __future__ import annotations


class SparkDialect:
    name = "spark"

    @staticmethod
    def ts(seconds: str) -> str:
        return f"timestamp_seconds({seconds})"

    @staticmethod
    def instant(column: str) -> str:
        """Zone-free timestamp column read as UTC."""
        return f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}))"

    @staticmethod
    def sha(expr: str) -> str:
        return f"sha2({expr}, 256)"


class DuckDialect:
    name = "duckdb"

    @staticmethod
    def ts(seconds: str) -> str:
        return f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"

    @staticmethod
    def instant(column: str) -> str:
        return column

    @staticmethod
    def sha(expr: str) -> str:
        return f"sha256({expr})"


SPARK = SparkDialect()
DUCK = DuckDialect()
