"""Queries of the library over the driver's tables, each beside its SQL."""

from __future__ import annotations

from .plans import onekey, predicted, recorded, samples, streams, timelines


def queries() -> dict:
    return {**timelines.QUERIES, **samples.QUERIES, **recorded.QUERIES, **onekey.QUERIES, **streams.QUERIES, **predicted.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**timelines.SQL, **samples.SQL, **recorded.SQL, **onekey.SQL, **streams.SQL, **predicted.SQL}
