"""Addresses against Python's ipaddress, the storage codec's round trip and limits, fallback, and slots by hand."""

from __future__ import annotations

import datetime as dt
import gzip
import ipaddress
import json
import random
from base64 import b64encode

import pytest
from pressloom.operators import codec, fallback, network, slots
from pyspark.sql import functions as F


def test_addresses_match_the_longest_network(spark):
    rnd = random.Random(1)
    texts = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(100)]
    for n in network.BLOCKED + [network.PUBLIC_V6, "10.1.0.0/16", "2001:db8:1::/48"]:
        net = ipaddress.ip_network(n)
        texts += [str(net[0]), str(net[-1]), str(net[0] + rnd.randrange(net.num_addresses))]
    texts += ["2a00:1450:4001:81b::200e", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "64:ff9b::8.8.8.8"]
    nets = [ipaddress.ip_network(n) for n in network.BLOCKED + ["10.1.0.0/16", "2001:db8:1::/48"]]
    df = spark.createDataFrame([(t,) for t in texts], "address string")
    for r in network.matched(df, network.networks(spark, network.BLOCKED + ["10.1.0.0/16", "2001:db8:1::/48"])).collect():
        a = ipaddress.ip_address(r.address)
        hits = [n for n in nets + [ipaddress.ip_network(network.PUBLIC_V6)] if n.version == a.version and a in n]
        best = max(hits, key=lambda n: n.prefixlen, default=None)
        assert (r.family, r.network) == (a.version, str(best) if best else None), r.address
        assert r.public == ((best is None) if a.version == 4 else str(best) == network.PUBLIC_V6), r.address


def test_what_is_no_address(spark):
    odd = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "x", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "::ffff:7f00:1", "1:2:3:4:5:6:7:8::", "fe80::1%eth0", None]
    got = network.matched(spark.createDataFrame([(t,) for t in odd], "address string"), network.networks(spark)).collect()
    assert len(got) == len(odd) and not any(r.family or r.public for r in got)
    mapped = network.matched(spark.createDataFrame([("::ffff:10.0.0.1",), ("::FFFF:8.8.8.8",)], "address string"), network.networks(spark)).collect()
    assert sorted((r.family, r.public) for r in mapped) == [(4, False), (4, True)]


def test_the_codec_gives_back_what_it_took(spark):
    texts = ["{}", json.dumps({"a": "é中\U0001f600" * 5000}), "", None, '{"version":2,"encoding":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    back = codec.decoded(codec.encoded(df, "raw"), "stored").orderBy("i").collect()
    assert [r.text for r in back] == texts
    assert gzip.decompress(__import__("base64").b64decode(json.loads(back[1].stored)["data"])).decode() == texts[1]
    with pytest.raises(Exception, match="beyond the limit"):
        codec.encoded(df, "raw", limit=100).collect()


def test_older_and_broken_forms(spark):
    data = b64encode(gzip.compress(b"x" * 1000)).decode()
    cases = [('{"version":2}', '{"version":2}'), (json.dumps({"encoding": "other", "data": data}), None), (json.dumps({"encoding": "gzip-base64", "data": "!!"}), None), (json.dumps({"encoding": "gzip-base64", "data": data[:40]}), None), (json.dumps({"encoding": "gzip-base64", "data": data}), None)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, stored string")
    assert [r.text for r in codec.decoded(df, "stored", limit=999).orderBy("i").collect()] == [t for _, t in cases]
    assert [r.text for r in codec.decoded(df, "stored").orderBy("i").collect()][-1] == "x" * 1000


def test_only_failed_windows_fall_back(spark):
    shape = "report int, candidate string, title string, url string, source string, language string, primary_category string, categories array<string>, summary string, published_at timestamp, updated_at timestamp, discovered_at timestamp, summary_status string"
    row = lambda report, c: (report, c, "t", "u", "s", "en", "ai", ["ai"], "x", None, None, None, None)
    window = spark.createDataFrame([row(1, "w1"), row(2, "half read")], shape)
    good = spark.createDataFrame([row(1, "g1"), row(2, "g2"), row(3, "g3")], shape)
    reads = spark.createDataFrame([(1, True), (2, False)], "report int, ok boolean")
    assert sorted((r.report, r.candidate, r.degraded) for r in fallback.with_last_known_good(window, reads, good).collect()) == [(1, "w1", False), (2, "g2", True), (3, "g3", True)]


def test_slots_meet_their_nearest_run(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    base = 1_704_067_200
    grid = slots.Grid(width=300, early=30, late=240)
    cron = spark.createDataFrame([("a", 1, at(5), "succeeded"), ("a", 2, at(280), "succeeded"), ("a", 3, at(575), "failed"), ("a", 4, at(900), "succeeded"), ("a", 5, at(901), "succeeded")], "log string, cron_id int, at timestamp, status string")
    run = lambda i, s, status="published", secs=10: ("a", i, at(s), status, at(s), at(s + secs), [1, 2], [1], [2], [], 3, 2, f"r{i}", None)
    runs = spark.createDataFrame([run(1, 6), run(2, 285, secs=61), run(3, 865)], "log string, run_id int, at timestamp, status string, started_at timestamp, finished_at timestamp, planned array<int>, attempted array<int>, skipped array<int>, missing array<int>, discovered int, accepted int, report_id string, outcome string")
    responses = spark.createDataFrame([(i, 200, 9, False, f"r{i}", "published", 1, 3, 2) for i in (1, 2)] + [(2, 200, 9, False, "r2", "published", 1, 3, 2)], "run_id int, status_code int, keys int, failed boolean, report_id string, body_status string, selected int, discovered int, accepted int")
    snapshots = spark.createDataFrame([(1, "r1"), (2, "other")], "run_id int, report_id string")
    wanted = slots.expected_slots(spark.createDataFrame([("a", base, base + 900)], "log string, first long, last long"), grid)
    got = {r.slot - base: r.failures for r in slots.verdicts(slots.audits(wanted, cron, runs, responses, snapshots, grid), {"own_rule": F.col("n_cron") < 9}).collect()}
    assert got[0] == []
    assert got[300] == ["pgnet_response_count", "durable_over_60_seconds", "published_snapshot_not_linked"]
    assert got[600][:3] == ["schedule_late_durable", "cron_not_succeeded", "pgnet_response_count"]
    assert {"schedule_cron_count", "schedule_duplicate_cron", "schedule_missing_durable", "pgnet_not_http_200"} <= set(got[900])
