"""Text files without a bad line are not numbered; addresses as numbers."""

import tempfile

from pyspark.sql import functions as F

from meshlens.functions import net
from meshlens.sources import facts


def test_good_files_are_not_numbered(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    columns = [x.split()[0] for x in facts.SCHEMAS["dns"].split(", ")]
    line = {"origin": "iface eth0", "vlan": "Some 7", "mac_clt": "02:00:00:00:00:01", "mac_srv": "02:00:00:00:00:02", "ip_clt": "10.1.2.3", "ip_srv": "192.168.0.255", "error": "0",
            "start": "1323766040s 992799us", "rt_count": "1", "name": ""}
    texts = ["\t".join(line.get(c, "0.5") for c in columns)] * 3
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(path)
    monkeypatch.setattr(facts, "_numbered", lambda bad, lines: _Unread())
    good, _ = facts.load_lines(spark, "dns", path)
    assert [(r.ip_clt, r.ip_srv, r.vlan, r.name) for r in good.collect()] == [((10 << 24) + (1 << 16) + 515, (192 << 24) + (168 << 16) + 255, 7, None)] * 3


class _Unread:
    def orderBy(self, *columns):
        raise AssertionError("good files were numbered")


def test_addresses(spark):
    cases = {"10.0.0.1": 167772161, "255.255.255.255": 4294967295, "010.1.1.1": 167837953, "256.1.1.1": None, "1.2.3": None, "1.2.3.4.5": None, "a.b.c.d": None, "": None, None: None,
             "1.2.3.4 ": None, "0.0.0.0": 0, "1..2.3": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", net.parse_ip(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
