"""The two logs of a classified stream: replayed batches, lost state, frozen logs, more files."""

import pytest

from millrace.streaming import streams

TEXTS = ["피고차량이 원고차량을 충격하였다.", "아무 일도 없었다.", "", None, "차량이 사고를 냈다."]


def test_logs_are_written_once(spark, tmp_path):
    inbox, reports, candidates = (str(tmp_path / n) for n in ("inbox", "reports", "candidates"))
    add = lambda rows: spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(inbox)
    run = lambda state: streams.logged(spark.readStream.schema("id long, text string").parquet(inbox), "id", "text", reports, candidates, str(tmp_path / state)).awaitTermination()
    ids = lambda path: sorted(r["id"] for r in spark.read.parquet(path).select("id").collect())
    add(list(enumerate(TEXTS)) + [(0, "again")])
    run("a")
    assert ids(reports) == [0, 1, 2, 3, 4] and set(ids(candidates)) <= {0, 1, 2, 3, 4} and len(ids(candidates)) > 0
    first = ids(candidates)
    run("a")  # nothing new
    run("b")  # the state is lost: all files come again
    assert ids(reports) == [0, 1, 2, 3, 4] and ids(candidates) == first
    add([(4, "late copy"), (7, TEXTS[4])])
    run("b")
    run("a")
    assert ids(reports) == [0, 1, 2, 3, 4, 7] and len(ids(candidates)) == len(set(ids(candidates)))
    row = spark.read.parquet(reports).where("id = 7").first()
    assert row["used_llm"] is False and row["llm_label"] is None and row["final_label"] == row["rule_label"] and row["rule_reason"]
    streams.freeze(spark, reports)
    add([(9, "more")])
    with pytest.raises(ValueError, match="frozen"):
        run("a")
    assert 9 not in ids(reports)
