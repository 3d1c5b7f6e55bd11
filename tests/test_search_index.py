"""Searches by index give the rows of a scan and read candidate blocks only."""

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from herdwatch.operators import alerts as al
from herdwatch.operators import logs as lg
from herdwatch.operators import search_index as si

SHAPE = "id int, farm_id string, severity string, message string, description string, created_at timestamp_ntz"


def alert(i, message, description=None):
    return (i, f"F{i % 3}", ["high", "low"][i % 2], message, description, datetime(2024, 1, 1) + timedelta(hours=i))


ROWS = [alert(i, f"animal {i} has fever") for i in range(200)] + [
    alert(300, None, None), alert(301, "", "Ähnlich ÄÖ"), alert(302, "ab"), alert(303, "x\ny"), alert(304, "fev", "er"), alert(305, "100% of_it \\ 'q'"),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, SHAPE)
    index = si.alert_index(spark, str(tmp_path_factory.mktemp("index")), df.columns)
    assert index.add(df.where("id < 150"), 20) >= 6
    assert index.add(df.where("id >= 150"), 1000) == 1
    return df, index


@pytest.mark.parametrize("keyword", ["animal 17", "ANIMAL 1", "fever", "fev", "er", "a", "", "äö", "y\nz", "ev\ner", "nowhere", "al 17 has f", "% of_it \\ 'q", "animal 199"])
def test_same_rows_as_a_scan(stored, keyword):
    df, index = stored
    assert rows(si.search_alerts(index, keyword)) == rows(al.search(df, keyword))


def test_further_conditions(stored):
    df, index = stored
    assert rows(si.search_alerts(index, "animal 1", severity="HIGH", farm_id="f1")) == rows(al.search(df, "animal 1", "high", "F1"))


def test_only_candidate_blocks_are_read(stored):
    _, index = stored
    version = index.rows.version()
    found = si.search_alerts(index, "animal 17 ")
    # Alert 17 stands in one block; 17 x 20 further blocks hold the trigrams only by chance.
    blocks = index.candidates("animal 17 ")
    assert 1 <= len(blocks) < len(version.parts) / 2
    read = {f.rsplit("/", 1)[0].split("rows/")[1] for f in found.inputFiles()}
    assert read == {version.parts[b] for b in blocks}
    assert si.search_alerts(index, "nowhere").inputFiles() == [] and index.candidates("er") is None


def test_compacted_postings_answer_alike(spark, stored, tmp_path):
    df, _ = stored
    index = si.alert_index(spark, str(tmp_path / "i"), df.columns)
    for k in range(3):
        index.add(df.where(F.col("id") % 3 == k), 30)
    before = {w: index.candidates(w) for w in ("animal 17", "fever", "nowhere")}
    parts = len(index.postings.version().parts)
    index.compact()
    assert len(index.postings.version().parts) < parts and {w: index.candidates(w) for w in before} == before
    index.add(spark.createDataFrame([alert(900, "animal 17 again")], SHAPE))
    assert rows(si.search_alerts(index, "animal 17").select("id")) == [(17,), (170,), (171,), (172,), (173,), (174,), (175,), (176,), (177,), (178,), (179,), (900,)]


def test_an_index_of_nothing(spark, tmp_path):
    index = si.alert_index(spark, str(tmp_path / "i"), spark.createDataFrame([], SHAPE).columns)
    with pytest.raises(ValueError, match="no rows"):
        index.search("abc", lambda r: r)
    assert index.add(spark.createDataFrame([], SHAPE)) == 0
    assert si.search_alerts(index, "abc").count() == si.search_alerts(index, "a").count() == 0


def test_rows_without_postings_are_never_read_alone(spark, stored, tmp_path, monkeypatch):
    """An addition that stops before its rows are attached changes no answer."""
    df, _ = stored
    index = si.alert_index(spark, str(tmp_path / "i"), df.columns)
    index.add(df.where("id < 50"))

    def cut(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(index.rows, "attach", cut)
    with pytest.raises(KeyboardInterrupt):
        index.add(df.where("id >= 50"))
    monkeypatch.undo()
    assert rows(si.search_alerts(index, "fever")) == rows(al.search(df.where("id < 50"), "fever"))


def test_log_records(spark, tmp_path):
    logs = spark.createDataFrame([(i, datetime(2024, 1, 1, i % 24), "INFO", f"Step {i} \"done\"") for i in range(60)], "event_id int, timestamp timestamp_ntz, level string, message string")
    index = si.log_index(spark, str(tmp_path / "i"), logs.columns)
    index.add(logs, 10)
    for text, options in (("step 4", {}), ('Step 4', {"case_sensitive": True}), ("step 4", {"case_sensitive": True}), ('"message":"step 5', {}), ("info", {"as_of": "2024-01-02 00:00:00", "hours": 5})):
        assert rows(si.search_logs(index, text, **options)) == rows(lg.search_logs(logs, text, **options)), text


def test_the_text_of_a_row_is_made_once(spark, tmp_path):
    """Its runs are cut from a column, not from the expression that makes the text."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    index = si.SearchIndex(spark, str(tmp_path), counted("message"))
    index.add(spark.createDataFrame([(i, f"message number {i}") for i in range(50)], "id long, message string"))
    assert calls.value == 50
    assert sorted(r["id"] for r in index.search("number 7", lambda rows: rows.where(F.contains("message", F.lit("number 7")))).collect()) == [7]
