"""Text files of all five metrics: round trips, and bad lines by file and number however files are split."""

import os
import random
import tempfile

import pytest

from meshlens.sources import facts

LINES = {
    "traffic": "iface eth0\t1323766040s 992799us\t1323766042s 539807us\t274\tSome 250\tb4:a4:e3:4d:5c:01\t88:43:e1:1d:6d:01\t2048\t309884\t1409\t193.48.95.81\t134.206.1.47\t17\t304404\t54694\t49164\t302212",
    "flow": "iface eth1\tNone\tb4:a4:e3:4d:5c:01\t10.0.0.1\t88:43:e1:1d:6d:01\t10.0.0.2\t6\t1024\t80\t1323766040s 1000us\t1323766042s 5000us\t7\t900",
    "tcp": "iface eth0\tSome 250\t88:43:e1:1d:6d:01\t193.48.57.46\tb4:a4:e3:4d:5c:01\t194.98.114.133\t48242\t80\t1323766045s 962156us\t2\t1\t0.0059\t0.0059\t0.0059\t0.0",
    "dns": "iface eth0\tNone\t88:43:e1:1d:6d:01\t193.48.57.0/24\tb4:a4:e3:4d:5c:01\t194.98.114.133\t3\t1323766045s 962000us\t4\t0.1\t0.5\t0.25\t0.125\twww.example.org",
    "web": "pcap a b.pcap\tSome 0\t88:43:e1:1d:6d:01\t193.48.57.46\tb4:a4:e3:4d:5c:01\t194.98.114.133\t8080\t0\t404\t1323766045s 962000us\t1\t0.5\t0.5\t0.5\t0.0\twww.example.org\t/a?b=c",
}


def folder(**files):
    path = tempfile.mkdtemp(prefix="spark-")
    for name, lines in files.items():
        with open(os.path.join(path, name), "w") as f:
            f.write("".join(x + "\n" for x in lines))
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("metric", LINES)
def test_rows_survive_a_round_trip(spark, metric):
    good, bad = facts.load_lines(spark, metric, folder(a=[LINES[metric]] * 3, b=[LINES[metric]], c=[]))
    assert good.count() == 4 and bad.count() == 0
    assert rows(good) == rows(facts.load_text(spark, metric, folder(a=[LINES[metric]] * 4)).select(*good.columns))
    out = tempfile.mkdtemp(prefix="spark-") + "/t"
    facts.dump_text(good, out, metric)
    again, _ = facts.load_lines(spark, metric, out)
    assert rows(again) == rows(good)


def test_six_byte_addresses_and_subnets(spark):
    line = LINES["web"].replace("193.48.57.46", "2001:db8::/32").replace("194.98.114.133", "2001:db8::5")
    good, bad = facts.load_lines(spark, "web", folder(a=[line, LINES["web"]]), wide=True)
    assert {(r.ip_clt.family, r.mask_clt) for r in good.collect()} == {(6, 32), (4, 32)} and bad.count() == 0
    out = tempfile.mkdtemp(prefix="spark-") + "/t"
    facts.dump_text(good, out, "web")
    assert rows(facts.load_lines(spark, "web", out, wide=True)[0]) == rows(good)
    assert facts.load_lines(spark, "web", folder(a=[line]), stop=False)[1].first().fields == ["ip_clt", "ip_srv"]


BREAKS = {
    "start": ("1323766040s 992799us", "yesterday"), "vlan": ("Some 250", "Some x"), "mac_src": ("b4:a4:e3:4d:5c:01", "b4:a4"), "ip_src": ("193.48.95.81", "193.48.95.256"),
    "packets": ("274", "27x4"), "l4_payload": ("302212", ""),
}


def test_bad_lines_are_named(spark):
    good = LINES["traffic"]
    broken = [good, *[good.replace(*x) for x in BREAKS.values()], good, good + "\tmore", "iface eth0", ""]
    found, bad = facts.load_lines(spark, "traffic", folder(a=broken, b=[good]), stop=False)
    assert found.count() == 3
    assert [(r.line, r.fields) for r in bad.orderBy("line").collect()] == [*[(i + 2, [c]) for i, c in enumerate(BREAKS)], (9, []), (10, []), (11, [])]
    with pytest.raises(facts.BadLine, match=r"/a:2: start"):
        facts.load_lines(spark, "traffic", folder(a=broken, b=[good]))


def test_lines_are_numbered_over_splits(spark):
    rng = random.Random(4)
    files, want = {}, set()
    for name in ("a", "b", "c"):
        files[name] = [LINES["dns"] + "x" * rng.randrange(300) for _ in range(rng.randrange(100, 400))]
        for i in rng.sample(range(len(files[name])), 5):
            files[name][i] = files[name][i].replace("194.98", "nowhere")
            want.add((name, i + 1, files[name][i]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        _, bad = facts.load_lines(spark, "dns", folder(**files), stop=False)
        assert {(os.path.basename(r.file), r.line, r.text) for r in bad.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_to_load(spark):
    good, bad = facts.load_lines(spark, "flow", folder(a=[]))
    assert good.count() == bad.count() == 0
