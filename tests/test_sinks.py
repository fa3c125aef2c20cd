"""Files that go out: compressed, with all their rows."""

from shelfspark.sources import readers as RD
from shelfspark.sources import sinks as SK


def test_plan_artifacts_and_transfers_are_gzip_files_with_all_rows(spark, tmp_path):
    plan = spark.createDataFrame(
        [("1", "price", 'a "b"', "2,5", "blocked", "r", "none"), ("2", "name", " x", None, "unavailable", "r", "none")],
        "model string, field string, current_value string, candidate_value string, classification string, reason string, approval_requirement string")
    SK.write_plan_artifacts(plan, plan.groupBy("classification").count(), str(tmp_path / "plan"))
    read = lambda name: [tuple(r) for r in RD.read_text_csv(spark, str(tmp_path / "plan" / name)).orderBy("model").collect()]
    assert [r[:4] for r in read("products")] == [("1", "price", 'a "b"', "2,5"), ("2", "name", " x", "")]
    assert [r[0] for r in read("blocked")] == ["1"]
    urls = spark.createDataFrame([(1, "https://a/1", None), (2, "https://a/2", "x")], "url_id long, url string, notes string")
    SK.write_transfer({"source_urls": urls, "runs": urls, "candidates": urls}, str(tmp_path / "transfer"))
    back = RD.read_transfer(spark, str(tmp_path / "transfer"))
    assert all(sorted(map(tuple, back[n].select("url_id", "url", "notes").collect())) == sorted(map(tuple, urls.collect())) for n in back)
    parts = [p.name for f in ("plan/products", "plan/blocked", "transfer/source_urls", "transfer/candidates") for p in (tmp_path / f).glob("part-*")]
    assert parts and all(p.endswith(".gz") for p in parts)
