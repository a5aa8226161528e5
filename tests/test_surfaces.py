"""HTTP, imported answers and recording rules."""

import gzip
import json
import threading
import urllib.request
from datetime import datetime
from urllib.error import HTTPError

import pytest

from graticule.engine import Engine
from graticule.server import serve
from graticule.sources import importer
from graticule.sources.catalog import Catalog, Source
from graticule.streaming.recording import Rule


@pytest.fixture(scope="module")
def url(spark):
    df = spark.createDataFrame([("up", "a", 0, 1.0), ("up", "b", 0, 2.0)], "`__name__` string, job string, t long, v double")
    server = serve(Engine(spark, Catalog([Source("s", df, {"env": "x"})])), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def get(url, data=None, **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers)) as r:
            body = r.read()
            return r.status, json.loads(gzip.decompress(body) if r.headers.get("Content-Encoding") == "gzip" else body)
    except HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(url):
    code, body = get(f"{url}/api/v1/query?query=sum(up)&time=0")
    assert code == 200 and body["data"]["result"] == [{"metric": {}, "value": [0.0, "3"]}]
    assert get(f"{url}/api/v1/query", b"query=sum(up)&time=0")[1] == body
    assert get(f"{url}/api/v1/query?query=sum(up)&time=0", **{"Accept-Encoding": "gzip"})[1] == body
    assert get(f"{url}/api/v1/query_range?query=up&start=0&end=60&step=60")[1]["data"]["resultType"] == "matrix"
    assert get(f"{url}/api/v1/query_range?query=up&start=0")[0] == 400
    assert get(f"{url}/api/v1/query?query=up(")[0] == 400 and get(f"{url}/api/v1/query?query=up&limit=-1")[0] == 400
    assert get(f"{url}/api/v1/plan?query=sum(up)")[1]["data"]["expr"].startswith("sum(")
    assert get(f"{url}/api/v1/labels")[1]["data"] == ["__name__", "env", "job"]
    assert get(f"{url}/api/v1/label/job/values?limit=1")[1] == {"status": "success", "data": ["a"], "warnings": ["results truncated due to limit"]}
    assert get(f"{url}/api/v1/series?match[]=up")[1]["data"][0] == {"__name__": "up", "env": "x", "job": "a"}
    assert get(f"{url}/api/v1/status/config")[1]["data"]["endpoints"][0]["url"] == "s"
    assert get(f"{url}/-/ready")[0] == 200 and get(f"{url}/nope")[0] == 404


def answers(spark, *bodies):
    return importer.samples(spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "value string"))


def test_import(spark):
    vector = {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {"__name__": "up", "a": "é\"\\ {"}, "value": [1.9999, "NaN"]}]}}
    matrix = {"data": {"result": [{"values": [[-1.5, "+Inf"], [2, "1e3"]], "metric": {"b": "c"}}], "resultType": "matrix"}, "status": "success"}
    rows = sorted((r.t, str(r.v), tuple(sorted(r.labels.items()))) for r in answers(spark, vector, matrix).collect())
    assert rows == [(-1500, "inf", (("b", "c"),)), (1999, "nan", (("__name__", "up"), ("a", 'é"\\ {'))), (2000, "1000.0", (("b", "c"),))]


@pytest.mark.parametrize(
    "body",
    [
        {"status": "error", "errorType": "bad_data", "error": "no"}, "not json", {"status": "success", "data": {"result": [{"metric": {}}]}},
        {"status": "success", "data": {"result": [{"metric": {}, "value": [1, "1"], "values": [[1, "1"]]}]}}, {"status": "success", "data": {"result": [{"metric": {}, "histogram": [1, {}]}]}},
        {"status": "success", "data": {"result": [{"metric": {}, "value": [1, "x"]}]}}, '{"status":"success","data":{"result":[{"metric":{},"value":["x","1"]}]}}',
    ],
)
def test_import_rejects(spark, body):
    with pytest.raises(Exception):
        answers(spark, body).collect()


def test_recording_rule(spark, tmp_path):
    rows = [("up", "a", datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 30)] + [("down", "a", datetime(2024, 1, 1), 99.0)]
    df = spark.createDataFrame(rows, "`__name__` string, job string, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    rule = Rule("job:up:sum", 'up{job!=""}', "sum_over_time", "10 minutes", "5 minutes", ("job",))
    batch = {r.ts: r.v for r in rule.over(df).collect()}
    assert batch[datetime(2024, 1, 1, 0, 10)] == sum(range(1, 11))  # (0:00, 0:10], as a range selector's window
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = rule.over(stream).writeStream.outputMode("append").format("memory").queryName("rule").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {r.ts: r.v for r in spark.sql("select * from rule").collect()}
    assert live and all(batch[t] == v for t, v in live.items())
    with pytest.raises(ValueError):
        Rule("x", "up", "nope", "1 minute", "1 minute").over(df)
