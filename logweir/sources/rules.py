"""Alert rules as versions in a folder, so that they can change while jobs run."""

import dataclasses
import datetime as dt
import json

from pyspark.sql import SparkSession

from logweir.operators.alerts import AlertRule
from logweir.sources import versions

_TIMES = ("last_triggered", "created_at")


def _as_json(rule: AlertRule) -> dict:
    row = dataclasses.asdict(rule)
    return {k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in row.items()}


def _from_json(row: dict) -> AlertRule:
    return AlertRule(**{k: dt.datetime.fromisoformat(v) if k in _TIMES and v else v for k, v in row.items()})


def read_rules(spark: SparkSession, folder: str) -> tuple[int, list[AlertRule]]:
    """The newest version and its rules in order; (0, []) before the first."""
    version, text = versions.latest(spark, folder)
    return version, [_from_json(r) for r in json.loads(text)] if text else []


def change_rules(spark: SparkSession, folder: str, change) -> int:
    """Publish ``change(rules)`` as the next version and return its number.

    The change is made again on top of any that another writer published first, so none is lost.
    """
    while True:
        version, rules = read_rules(spark, folder)
        text = json.dumps([_as_json(r) for r in change(rules)])
        if versions.publish(spark, folder, version + 1, text):
            return version + 1
