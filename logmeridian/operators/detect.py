"""Detection rules as data, evaluated together in one pass over the events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeridian.functions.exprs import attr


@dataclass(frozen=True)
class DetectionRule:
    """A predicate over event columns, narrowed by the log source where one is given."""

    id: str
    predicate: Column
    class_uid: int | None = None
    vendor: str | None = None

    def holds(self) -> Column:
        out = self.predicate
        if self.class_uid is not None:
            out = out & (F.col("ocsf_class_uid") == self.class_uid)
        if self.vendor is not None:
            out = out & (F.col("vendor") == self.vendor)
        return F.coalesce(out, F.lit(False))


def ilike(column: str, pattern: str) -> Column:
    return F.col(column).ilike(pattern)


def example_rules() -> tuple[DetectionRule, ...]:
    return (
        DetectionRule("failed-login", (F.col("action") == "login") & (F.col("outcome") == ""), class_uid=3002, vendor="Fortinet"),
        DetectionRule("error-burst", (F.col("severity_num") >= 4) & ilike("action", "ERR%")),
        DetectionRule("ssh-or-winbox", F.col("dst_port").isin(22, 8291)),
        DetectionRule("internal-peer", F.regexp_replace("src_ip", "^::ffff:", "").startswith("10.0.1.")),
        DetectionRule("web-path", attr("otel.url.path") == "/p/7", vendor="NGINX"),
    )


def detections(events: DataFrame, rules: Sequence[DetectionRule]) -> DataFrame:
    """Every event once for each rule that it meets, with ``rule_id`` added."""
    met = F.array_compact(F.array(*[F.when(r.holds(), F.lit(r.id)) for r in rules]))
    return events.withColumn("rule_id", F.explode(met))


def expectations(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``rule_id, expected, hits, passed``: a rule passes when it hits if and only if it should."""
    counted = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = expected.join(counted, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select("rule_id", "expected", "hits", ((F.col("hits") > 0) == F.col("expected")).alias("passed"))
