"""What a saved case brings back."""

from netloom.sources import exports


def test_indicators_survive_a_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/case"
    tables = {
        "indicators": spark.createDataFrame([("ip", "1.2.3.4", "bad", "feed")], "kind string, value string, description string, source string"),
        "hits": spark.createDataFrame([(1, "src", "1.2.3.4")], "no long, context string, value string"),
        "fields": spark.createDataFrame([(1, "ip", "ip.ttl", "64")], "no long, layer string, path string, value string"),
        "credentials": spark.createDataFrame([(1, "FTP-PASS", "PASS x")], "no long, kind string, value string"),
    }
    exports.case(tables, path)
    back = exports.load_case(spark, path)
    for name in ("indicators", "hits", "fields"):
        assert back[name].collect() == tables[name].collect()
    assert back["credentials"].columns == ["no", "kind"]
