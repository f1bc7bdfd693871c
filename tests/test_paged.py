"""The polled source: ties across page borders, failing calls, replay after a restart; answers that can't be parsed."""

import datetime as dt
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewater.sources import paged, scans

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    # many rows of one time, more than a page holds
    at = [START + dt.timedelta(seconds=60 * (i // 9)) for i in range(200)]
    path = str(tmp_path_factory.mktemp("api") / "t.parquet")
    pq.write_table(pa.table({"event_id": list(range(200)), "ts": pa.array(at, pa.timestamp("us")), "event_type": ["a"] * 200, "value": [float(i) for i in range(200)]}), path)
    return path


def us(ts):
    return int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def test_pages_follow_the_last_row(table):
    for page in (1, 4, 9, 1000):
        r = paged.PagedStreamReader(paged.TableApi(table), page, 300_000_000, 1)
        start, end = r.initialOffset(), r.latestOffset()
        got = [row[0] for p in r.partitions(start, end) for row in r.read(p)]
        assert got == list(range(200))
        # the same offsets bring the same rows, and none twice
        assert got == [row[0] for p in r.partitions(start, end) for row in r.read(p)]
    early = paged.PagedStreamReader(paged.TableApi(table, us(START) - 1), 5, 1_000_000, 1)
    assert early.partitions(early.initialOffset(), early.latestOffset()) == []


def test_failing_calls_are_tried_again(table):
    class Flaky(paged.TableApi):
        calls = 0

        def fetch(self, *args):
            Flaky.calls += 1
            if Flaky.calls % 2:
                raise OSError("busy")
            return super().fetch(*args)

    r = paged.PagedStreamReader(Flaky(table), 50, 10**12, 3)
    assert [x[0] for p in r.partitions(r.initialOffset(), r.latestOffset()) for x in r.read(p)] == list(range(200))
    r.tries, Flaky.calls = 1, 0
    with pytest.raises(OSError):
        list(r.read(r.partitions(r.initialOffset(), r.latestOffset())[0]))


def test_restart_goes_on_from_the_offset(spark, table):
    spark.dataSource.register(paged.PagedStream)
    path = tempfile.mkdtemp(prefix="shared-")
    seen = []
    for clock in (us(START + dt.timedelta(seconds=600)), us(START + dt.timedelta(seconds=600)), ""):
        stream = spark.readStream.format("paged_stream").options(path=table, page=7, slice=300, clock=clock).load()
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.event_id for r in spark.read.parquet(f"{path}/out").collect()))
    assert seen == [list(range(99)), list(range(99)), list(range(200))]


def test_answers_that_can_not_be_read(spark):
    good = '[["60000","1","2","0.5","1.5","9"],["120000","7","7","7","7","7"]]'
    rows = [("v", 1, "nope"), ("v", 2, good), ("v", 3, "[]"), ("v", 4, None), ("v", 5, '[["180000","3","3","3","3","3"]]'), ("v", 6, '[["1","2"],["3","4"]]')]
    out = scans.kline_snapshots(spark.createDataFrame(rows, "venue string, at int, text string"), "text", "venue", "at").orderBy("at").collect()
    assert [(r.open_ms, r.open, r.degraded) for r in out] == [(None, None, True), (60000, 1.0, False), (60000, 1.0, True), (60000, 1.0, True), (180000, 3.0, False), (180000, 3.0, True)]
    macro = spark.createDataFrame([("{}", "x", None), ('{"lastFundingRate":"0.0003"}', '{"openInterest":"12.5"}', '{"data":[{"value":"71"}]}')], "f string, o string, g string")
    assert [tuple(r)[3:] for r in scans.macro_snapshots(macro, "f", "o", "g").collect()] == [(0.0001, 0.0, 50.0), (0.0003, 12.5, 71.0)]


def test_a_process_holds_windows_not_the_table(table):
    class Narrow(paged.TableApi):
        WINDOW = 300_000_000

    paged._window.cache_clear()
    r = paged.PagedStreamReader(Narrow(table), 7, 300_000_000, 1)
    assert [x[0] for p in r.partitions(r.initialOffset(), r.latestOffset()) for x in r.read(p)] == list(range(200))
    assert paged._window.cache_info().misses > 2 and len(Narrow(table).fetch(us(START) - 10**12, None, 1000)) == 200
    start = us(START) // 300_000_000 * 300_000_000
    assert len(paged._window(table, start, start + 300_000_000)[2]) == 45
