from palaver.streaming import monitor


def test_leases_are_not_extended(spark):
    rows = [("a", t) for t in (0.0, 10.0, 3599.0, 3600.0, 7100.0, 7300.0)] + [("b", 5.0), (None, 1.0), ("b", None)]
    got = sorted((r.ip, r.start, r.events) for r in monitor.leases(spark.createDataFrame(rows, "ip string, at double"), "ip", "at").collect())
    assert got == [("a", 0.0, 3), ("a", 3600.0, 2), ("a", 7300.0, 1), ("b", 5.0, 1)]


def test_registry_and_queue(spark):
    beats = spark.createDataFrame([("w1", 100.0, 1.0, 5), ("w1", 190.0, 1.0, 4), ("w2", 105.0, 2.0, 1), ("w3", 150.0, 2.0, 8)], "worker string, at double, speed double, queue bigint")
    live = monitor.registry_batch(beats, 200.0)
    assert sorted(r.worker for r in live.collect()) == ["w1", "w3"]
    assert monitor.shortest_queue(live).first().worker == "w1"


def test_deltas(spark):
    rows = spark.createDataFrame([(1, 1, "ab"), (1, 2, "abcd"), (1, 3, "abcd")], "r int, s int, t string")
    assert [r.delta for r in monitor.deltas(rows, "r", "s", "t").orderBy("s").collect()] == ["ab", "cd", None]
