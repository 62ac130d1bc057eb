"""API audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.functions import net
from weftlog.schema import API, KUBEAPI, KUBEAPI_ID, POD
from weftlog.sources.snapshot import resolve_ip

_RECORD = (
    "verb string, requestReceivedTimestamp string, stageTimestamp string, user struct<username: string>, sourceIPs array<string>, objectRef struct<resource: string, subresource: string, namespace: string>, responseStatus struct<code: int>"
)


def api_events(lines: DataFrame, addresses: DataFrame, drop_control_plane: bool = True) -> DataFrame:
    """Events of (run_id, file, lineno, line). ``complete`` tells those to keep: the source resolves, and to a pod if the control plane's calls are dropped."""
    c = F.col
    # generated, so that the filter on a record does not parse it again
    rows = lines.select("*", F.explode(F.array(F.from_json("line", _RECORD))).alias("a")).drop("line")
    rows = rows.withColumn("ts_us", net.epoch_us(F.coalesce(net.present(c("a.requestReceivedTimestamp")), c("a.stageTimestamp")))).where("ts_us IS NOT NULL")
    rows = resolve_ip(rows.withColumn("ip", F.get(c("a.sourceIPs"), 0)), addresses, "ip", "src")
    out = rows.select(
        F.concat_ws(":", "run_id", "file", c("lineno").cast("string")).alias("event_id"), "run_id", (c("ts_us") / 1e6).alias("ts"), "ts_us", F.lit(API).alias("event_type"), "src_id", "src_type", F.lit(KUBEAPI_ID).alias("dst_id"), F.lit(KUBEAPI).alias("dst_type"),
        net.present(F.lower("a.verb")).alias("k8s_verb"), c("a.objectRef.resource").alias("k8s_resource"), c("a.objectRef.subresource").alias("k8s_subresource"), net.user_type(c("a.user.username")).alias("k8s_user_type"),
        c("a.responseStatus.code").alias("k8s_status_code"), F.struct(F.lit(2), F.lit(0), c("file"), c("lineno")).alias("order"),
    )
    own = F.coalesce(c("src_type") == POD, F.lit(False)) if drop_control_plane else F.lit(True)
    return out.withColumn("complete", c("src_id").isNotNull() & own)
