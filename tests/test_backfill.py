import json
import os

import pytest
from pyspark.errors import StreamingQueryException

from tapewire.sources import store as st
from tapewire.streaming import backfill as bf


def land(folder, day, name, articles=None, text=None):
    os.makedirs(f"{folder}/day={day}", exist_ok=True)
    feed = [{"source": "wire", "title": t, "url": f"https://x.example/{t}", "published_at": f"{day} 10:00:00"} for t in articles or []]
    with open(f"{folder}/day={day}/{name}.json", "w") as out:
        out.write(json.dumps(feed) if text is None else text)


@pytest.fixture
def landing(tmp_path):
    folder = str(tmp_path / "landing")
    land(folder, "2024-03-01", "a", ["one", "two"])
    land(folder, "2024-03-01", "b", ["two", "three"])  # one article in two files
    land(folder, "2024-03-03", "a", text='[{"source": "cut')
    land(folder, "2024-03-03", "b", ["four"])
    land(folder, "2024-03-04", "a", text='{"articles": [], "meta": {"error": "HTTP 500"}}')
    land(folder, "2024-03-05", "a", ["five"])
    return folder


def run(spark, landing, tmp_path, scorer, step=1):
    names = [str(tmp_path / n) for n in ("store", "ledger", "checkpoint")]
    bf.finish(bf.backfill(spark, landing, *names, "2024-03-01", "2024-03-06", scorer, days_per_batch=step))
    return names


def test_goes_on_behind_the_day_that_died(spark, landing, tmp_path):
    seen = []

    def scorer(dies):
        def score(df):
            days = sorted({str(r.day) for r in df.select("day").collect()})
            seen.append(days)
            if dies and "2024-03-03" in days:
                raise RuntimeError("killed")
            return df

        return score

    with pytest.raises(StreamingQueryException, match="killed"):
        run(spark, landing, tmp_path, scorer(True))
    assert seen == [["2024-03-01"], [], ["2024-03-03"]]  # oldest first, the empty second too
    del seen[:]
    store, ledger, _ = run(spark, landing, tmp_path, scorer(False))
    assert seen == [["2024-03-03"], [], ["2024-03-05"], []]
    rows = {str(r.day)[-1]: (r.calls, r.fetched, r.appended, r.corrupt, r.error) for r in spark.read.parquet(ledger).collect()}
    assert rows == {
        "1": (2, 4, 3, 0, None),
        "2": (0, 0, 0, 0, None),
        "3": (2, 1, 1, 1, "unreadable file"),
        "4": (1, 0, 0, 0, "HTTP 500"),
        "5": (1, 1, 1, 0, None),
        "6": (0, 0, 0, 0, None),
    }
    assert sorted(r.title for r in st.read_store(spark, store).collect()) == ["five", "four", "one", "three", "two"]


def test_several_days_at_a_time_and_again(spark, landing, tmp_path):
    store, ledger, _ = run(spark, landing, tmp_path, lambda df: df, step=4)
    assert st.read_store(spark, store).count() == 5 and spark.read.parquet(ledger).count() == 6
    run(spark, landing, tmp_path, lambda df: df, step=4)  # nothing is due
    assert spark.read.parquet(ledger).count() == 6


def test_offsets():
    cursor = bf._Cursor({"start": "2024-02-28", "end": "2024-03-02", "daysPerBatch": "3"})
    days, at = cursor.read(cursor.initialOffset())
    assert [str(d) for (d,) in days] == ["2024-02-28", "2024-02-29", "2024-03-01"] and at == {"day": "2024-03-01"}
    days, at = cursor.read(at)
    assert [str(d) for (d,) in days] == ["2024-03-02"] and at == {"day": "2024-03-02"}
    assert list(cursor.read(at)[0]) == [] and cursor.read(at)[1] == at
