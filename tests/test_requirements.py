"""Requirement reading on texts whose constraints are known."""

import pytest

from tallyloom.functions import requirements as rq
from tallyloom.functions import rules as R


@pytest.fixture(scope="module")
def read(spark):
    texts = {
        "wall": "NGFW appliance | NGFW throughput: 20 Gbps | IPS throughput 12 Gbps | concurrent sessions 4 million | minimum 2x 1/10G RJ45 ports and redundant power supply",
        "switch": "Data center switch with switching capacity 3.6 Tbps and 48 x 25G SFP28 ports",
        "mbps": "Router, 500 Mbps, 2 TB SSD",
        "ups": "Liebert UPS 8x 10 kva batteries, 40 kVA",
        "ha": "firewall cluster in active - passive mode with dedicated HA ports",
        "logs": "logging appliance for 1,500 GB/day and 20k events per second",
        "cell": "firewall | firewall throughput 20 Gbps, IPS throughput 12 Gbps",
        "out": "diesel generator 500 kva",
        "none": None,
        "empty": "",
        "long": "firewall " + "word " * 20_000 + "ssl vpn users: 500",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    return {r["k"]: r for r in rq.read_requirements(df).collect()}


def test_categories(read):
    want = {"wall": "NGFW", "switch": "DATACENTER_SWITCH", "mbps": "ROUTER", "ups": "UPS", "ha": "NGFW", "logs": "LOGGING", "cell": "NGFW", "out": None, "none": None, "empty": None, "long": "NGFW"}
    assert {k: r["device_type"] for k, r in read.items()} == want
    assert read["out"]["excluded"] and not read["none"]["excluded"]


def test_throughputs(read):
    assert read["wall"]["throughputs"] == {"ngfw_throughput_gbps": 20.0, "ips_throughput_gbps": 12.0}
    assert read["cell"]["throughputs"] == {"ips_throughput_gbps": 20.0}  # a cell between bars is read as a whole
    assert read["switch"]["throughputs"] == {"switching_capacity_gbps": 3600.0}
    assert read["mbps"]["throughputs"] == {"throughput_gbps": 0.5}
    assert read["ha"]["throughputs"] is None and read["out"]["throughputs"] is None


def test_counts_and_capacities(read):
    assert read["wall"]["counts"]["concurrent_sessions"] == 4e6
    assert read["mbps"]["counts"]["storage_tb"] == 2.0
    assert read["ups"]["counts"]["power_capacity_kva"] == 40.0
    assert read["logs"]["counts"]["logs_per_day_gb"] == 1500.0
    assert read["logs"]["counts"]["performance_eps"] == 20_000.0
    assert read["long"]["counts"]["ssl_vpn_users"] == 500.0
    assert read["empty"]["counts"] is None


def test_interfaces_and_flags(read):
    assert read["wall"]["interfaces"]["1_10g_rj45"] == 2
    assert read["switch"]["interfaces"]["25g_sfp28"] == 48
    assert read["wall"]["redundant_power"] and not read["wall"]["ha_port"]
    assert read["ha"]["ha_modes"] == ["active-passive", "clustering"] and read["ha"]["ha_supported"] and read["ha"]["ha_port"]
    assert not read["none"]["ha_supported"]


def test_rows_are_read_on_all_cores(spark):
    from tallyloom.sources.staged import spread

    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_signs_stand_in_whatever_their_patterns_fit(spark):
    texts = {"HA  mode": {"ha_supported"}, "active / passive": {"ha_supported"}, "Dedicated HA, ports for HA": {"ha_port"}, "dual AC power": {"redundant_power"}, "1+1\tredundancy": {"redundant_power"}, "a mgmt port": {"management_port"}, "has dual core": set(), "two console port": {"console_port"}}
    rows = rq.read_requirements(spark.createDataFrame([(k,) for k in texts], "text string")).collect()
    assert {r["text"]: {f for f in R.FLAGS if r[f]} for r in rows} == texts
    assert set(R.FLAG_SIGNS) == set(R.FLAGS) and set(R.INTERFACE_SIGNS) == set(R.INTERFACES)
