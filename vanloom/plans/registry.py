"""Registry of queries and small SQL building blocks shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_SPACE = r"[\s\x{a0}\x{85}\x{1c}-\x{1f}\x{2028}\x{2029}\p{Zs}]"


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where there is some."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def norm(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def words(t: str) -> str:
    return f"len([x for x in regexp_split_to_array(coalesce({t},''), '{_SPACE}+') if x <> ''])"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_SPACE}+', ' ', 'g'))"


def finditer(t: str, rx: str) -> str:
    """LATERAL source (k, start, "end", text) of all matches, offsets in code points."""
    rx = rx.replace("'", "''")
    return (
        f"(SELECT k, start, start + length(hit) AS \"end\", hit AS text FROM (SELECT k, h[k] AS hit, "
        f"CAST(coalesce(list_sum([length(x) for x in p[1:k]]), 0) + coalesce(list_sum([length(x) for x in h[1:k-1]]), 0) AS BIGINT) AS start "
        f"FROM (SELECT regexp_split_to_array({t}, '{rx}') AS p, regexp_extract_all({t}, '{rx}') AS h), unnest(range(1, len(h) + 1)) AS u(k)))"
    )
