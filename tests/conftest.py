import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    out = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.ui.retainedExecutions", "5").config("spark.sql.maxPlanStringLength", "10000").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out


def _pod(name, ip, app, owner, node="n1", extra=()):
    return {
        "kind": "Pod", "metadata": {"name": name, "namespace": "default", "uid": f"u-{name}", "labels": {"app": app} if app else {}, "ownerReferences": [{"kind": "ReplicaSet", "name": owner}]},
        "spec": {"nodeName": node, "serviceAccountName": app or "none", "containers": [{"name": c} for c in ("main", *extra)]}, "status": {"podIP": ip},
    }


def write_run(root: Path, stamp: str, hour: int = 9, status: int = 0) -> Path:
    """A small run with one of each thing that ingest has to tell apart."""
    d = root / f"run-{stamp}"
    t = lambda minute, second=0.0: f"2025-03-04T{hour:02d}:{minute:02d}:{second:06.3f}Z"
    put = lambda name, data: ((d / name).parent.mkdir(parents=True, exist_ok=True), (d / name).write_text(data if isinstance(data, str) else json.dumps(data)))
    put("meta.json", {"benchmark": "boutique", "request": "mix", "run_id": stamp, "run_status": status})
    web, basket = "web-5b8f7c9d44-kx2lp", "basket-7d9c8b6f55-q8z4m"
    put("k8s_snapshot/objects.json", {"items": [
        {"kind": "ReplicaSet", "metadata": {"name": "web-5b8f7c9d44", "namespace": "default", "ownerReferences": [{"kind": "Deployment", "name": "web"}]}},
        _pod(web, "10.1.0.5", "web", "web-5b8f7c9d44", extra=("istio-proxy",)), _pod(basket, "10.1.0.6", "", "basket-7d9c8b6f55", extra=("istio-proxy",)), _pod("loader", "10.1.0.7", "loader", "loader"),
        {"kind": "Service", "metadata": {"name": "web", "namespace": "default"}, "spec": {"clusterIP": "10.2.0.1"}}, {"kind": "Service", "metadata": {"name": "basket", "namespace": "default"}, "spec": {"clusterIP": "None"}},
    ]})
    put("k8s_snapshot/objects_end.json", {"items": [_pod("late-6f5d4c3b2a-zz9yx", "10.1.0.7", "late", "late-6f5d4c3b2a")]})
    put("k8s_snapshot/nodes.json", {"items": [{"metadata": {"name": "n1"}, "status": {"addresses": [{"type": "InternalIP", "address": "192.168.7.2"}, {"type": "Hostname", "address": "n1"}]}}]})
    call = {"method": "POST", "path": "/shop.Basket/Add", "protocol": "HTTP/2", "response_code": 200, "grpc_status": "0", "response_flags": "-", "bytes_received": 11, "bytes_sent": 22, "duration": 7, "user_agent": "x"}
    line = lambda **kw: json.dumps(call | kw)
    put(f"istio/access_logs/{web}.log", "\n".join([
        line(start_time=t(0, 1), request_id="r1", upstream_cluster="outbound|7070||basket.default.svc.cluster.local", downstream_remote_address="10.1.0.5:4444"),
        "not a record", "{broken",
        line(start_time=t(0, 2), request_id="r2", method="GET", path="/item/AB12CD34?x=1", protocol="HTTP/1.1", grpc_status=None, upstream_cluster="inbound|8080||", downstream_remote_address="10.1.0.7:5555"),
        f'[{t(0, 3)}] "GET /plain HTTP/1.1" 503 UF,URX via_upstream - "-" 1 2 3 4 "-" "curl/8" "r3" "web" "10.1.0.5:8080" inbound|8080|| 127.0.0.1:1 10.1.0.5:8080 192.168.7.2:6000 - default',
        line(start_time=t(0, 4), request_id="r1", upstream_cluster="outbound|7070||basket.default.svc.cluster.local", downstream_remote_address="10.1.0.5:4444"),
    ]) + "\n")
    put(f"istio/access_logs/{basket}.log", line(start_time=t(0, 1.002), request_id="r1", upstream_cluster="inbound|7070||", downstream_remote_address="10.1.0.5:4444") + "\r\n")
    end = lambda pod: {"pod_name": pod, "namespace": "default"}
    flow = lambda **kw: json.dumps({"flow": {"verdict": "FORWARDED", "is_reply": False, "source": end(web), "destination": end(basket)} | kw})
    tcp = lambda port, **flags: {"TCP": {"destination_port": port, "flags": flags}}
    put("cilium/flows.jsonl", "\n".join([
        flow(time=t(1), l4=tcp(7070, SYN=True)), flow(time=t(1, 1), l4=tcp(7070, ACK=True)), "",
        flow(time=t(2), l4=tcp(9999), verdict="DROPPED", drop_reason_desc="POLICY_DENIED", destination={"labels": ["k8s:x", "reserved:world"]}),
        json.dumps({"time": t(2, 1), "verdict": "FORWARDED", "l7": {"type": "RESPONSE", "dns": {"query": "API.Example.COM.", "qtypes": ["A", "AAAA"], "rcode": 3}}, "source": {"ip": "8.8.8.8"}, "destination": end(web)}),
        flow(time=t(2, 2), l7={"type": "REQUEST", "dns": {"query": "skipped.example."}}), flow(time="soon", l4=tcp(1)),
        flow(time=t(2, 3), l4={"UDP": {"destination_port": 53}}, source={"pod_name": "gone-abc12", "namespace": "other", "workloads": [{"name": "gone"}]}, destination={"ip": "10.2.0.1"}),
    ]))
    record = {"verb": "List", "requestReceivedTimestamp": t(3), "user": {"username": "system:serviceaccount:default:web"}, "sourceIPs": ["10.1.0.5"], "objectRef": {"resource": "pods"}, "responseStatus": {"code": 200}}
    put("audit/audit.jsonl", "\n".join(json.dumps(r) for r in (record, record | {"user": {"username": "system:node:n1"}, "sourceIPs": ["192.168.7.2"]}, record | {"sourceIPs": [], "stageTimestamp": t(3)})))
    return d


@pytest.fixture(scope="session")
def run_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for i, stamp in enumerate(("20250304-090000", "20250304-100000", "20250304-110000")):
        write_run(root, stamp, 9 + i)
    write_run(root, "20250304-120000", 12, status=1)
    return root


@pytest.fixture(scope="session")
def ingested(spark, run_root, tmp_path_factory):
    from weftlog.sources import runs

    out = str(tmp_path_factory.mktemp("parquet"))
    events, entities = runs.ingest(spark, f"{run_root}/*", ["boutique"])
    runs.write_tables(events, entities, out)
    return out
