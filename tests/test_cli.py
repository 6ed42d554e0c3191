import glob
import json

import pytest
from pyspark.sql import functions as F

from tributary.cli import main
from tributary.operators import display
from tributary.plans.sink import write_array


def array_of(folder):
    return json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/part-*"))))


def test_array_in_parts(spark, tmp_path):
    """Items of many tasks make one array in order; one item, and none, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (0, 1, 1000):
            rows = spark.range(0, n, 1, 3).select(((F.col("id") * 7919) % 1009).alias("cluster_id"))
            rows = rows.withColumn("x", F.to_json(F.struct("cluster_id", F.lit('a "b"\nc').alias("t"))))
            write_array(rows, str(tmp_path / str(n)), "x")
            assert array_of(tmp_path / str(n)) == [{"cluster_id": i, "t": 'a "b"\nc'} for i in sorted((k * 7919) % 1009 for k in range(n))]
        assert len(glob.glob(str(tmp_path / "1000" / "part-*"))) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("pretty", [True, False])
def test_json_chunks(pretty):
    for items in ([], [{"b": [1, {"c": "x\u2028y"}], "a": None}], [{"a": 1}, {}, {"b": {}}]):
        assert display.to_json(map(json.dumps, items), pretty) == json.dumps(items, sort_keys=True, indent=2 if pretty else None, ensure_ascii=False)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("name,email,skills\nJane Doe,jane@x.com,ML\n")
    (tmp_path / "projection_min.json").write_text(json.dumps({"name": "Minimal", "fields": [{"canonical": "full_name", "out": "n"}]}))
    assert main(["--csv", str(tmp_path / "a.csv"), "--projection", str(tmp_path / "projection_min.json"), "--stats", "--validate"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out) == [{"n": "Jane Doe"}] and "clusters 1" in out.err and '"is_valid": true' in out.err
    folder = str(tmp_path / "out")
    assert main(["--csv", str(tmp_path / "a.csv"), "--out", folder]) == 0 and capsys.readouterr().out == ""
    (candidate,), (report,) = array_of(f"{folder}/candidates"), array_of(f"{folder}/reports")
    assert candidate["full_name"]["value"] == "Jane Doe" and report["is_valid"] is True
    assert display.projection_catalog(str(tmp_path)) == [{"id": "min", "name": "Minimal", "fields": ["n"]}]
    with pytest.raises(SystemExit):
        main([])


def test_display(spark):
    row = spark.range(1).select(display.tone(F.lit(0.9)).alias("a"), display.tone(F.lit(0.75)).alias("b"), display.tone(F.lit(0.1)).alias("c"), display.initials(F.lit("jane van doe")).alias("i"), display.initials(F.lit(None).cast("string")).alias("n")).first()
    assert tuple(row) == ("high", "mid", "low", "JD", "?")
