"""Contrast files: what is read, and what is an error."""

import json

import pytest

from kontra.operators import integrity
from kontra.sources import files

HEADER = '"WB_id","logFC","AveExpr","t","P.Value","FDR"\n'


def write(tmp_path, body, header=HEADER):
    at = tmp_path / "c.csv"
    at.write_text(header + body)
    return str(at)


def test_reads_and_renames(spark, tmp_path):
    got = files.read_contrast(spark, write(tmp_path, '"g1",1.5,2,3,0.01,0.02\n"g2",-1,2,3,0.5,0.6\n'), "one", rows=2).orderBy("entity").collect()
    assert [(r.entity, r.condition, r.effect, r.fdr) for r in got] == [("g1", "one", 1.5, 0.02), ("g2", "one", -1.0, 0.6)]


@pytest.mark.parametrize("body", ['"g1",x,2,3,0.01,0.02\n', '"g1",1,2,3,1.01,0.02\n', '"g1",1,2,3,0.1,0.02\n"g1",1,2,3,0.1,0.02\n', '"",1,2,3,0.1,0.02\n', '"g1",NaN,2,3,0.1,0.02\n', '"g1",1,2,3,0.1,\n'])
def test_faults_are_errors(spark, tmp_path, body):
    with pytest.raises(Exception, match="(?i)malformed|fail their checks"):
        files.read_contrast(spark, write(tmp_path, body), "one").collect()


def test_missing_columns_and_row_counts_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        files.read_contrast(spark, write(tmp_path, '"g1",1,2,3,0.1\n', '"WB_id","logFC","AveExpr","t","P.Value"\n'), "one")
    with pytest.raises(ValueError, match="fail their checks"):
        files.read_contrast(spark, write(tmp_path, '"g1",1,2,3,0.1,0.2\n'), "one", rows=2)


def test_json_lines_have_sorted_keys(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, None), ("é\n", 2, 0.5)], "b string, a int, c double")
    files.write_jsonl(df, str(tmp_path / "out"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert [list(json.loads(x)) for x in lines] == [["a", "b", "c"]] * 2
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "out"), "b string, a int, c double").collect())) == sorted(map(tuple, df.collect()))


def test_rows_of_tables_in_folders(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    one = next((tmp_path / "many.parquet").glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(one.read_bytes())
    told = integrity.manifest(spark, str(tmp_path), digest=False)
    got = {r.file: r.rows for r in integrity.rows_by_table(told).collect()}
    assert got == {"many.parquet": 7, "none.parquet": 0, "one.parquet": spark.read.parquet(str(one)).count()}
    assert len({r.place for r in told.collect()}) == told.count()
