"""review_file_join reads the whole ledger and still leaves some reviews without a file."""

from feedstack.plans import catalog
from feedstack.sources import testdata as TD

SF = "/root/testdata/sf0.01"


def test_whole_ledger_is_joined(spark, monkeypatch):
    seen = []
    plain = catalog.query.review_files

    def review_files(reviews, files):
        seen.append(files.count())
        return plain(reviews, files)

    monkeypatch.setattr(catalog.query, "review_files", review_files)
    got = catalog.q_review_file_join(spark, SF)
    rows = got.groupBy(got.etag.isNull().alias("none")).count().collect()
    assert seen == [TD.processed_files(spark, SF).count()]
    assert {r["none"] for r in rows} == {True, False}
