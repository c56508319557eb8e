from unittest.mock import MagicMock

import pytest
from test_feed import log

from skyloom.sources.feed import Log, next_page
from skyloom.streaming.sync import drain


@pytest.mark.parametrize("paging", ["window", "adaptive window"])
def test_windows_step_over_any_gap(tmp_path, paging):
    source, cursor, seen = Log(log(tmp_path, [1, 2, 1000, 50_000.5, 50_001, 900_000]), "eso"), {}, []
    while len((step := next_page(source, paging, cursor, 3))[0]):
        page, cursor = step
        seen += page["archive_obs_id"].to_pylist()
    assert seen == [f"o{i:03d}" for i in range(6)]


def pages(n):
    stream = MagicMock()
    query = stream.writeStream.foreachBatch().option().trigger().start()
    type(query).recentProgress = property(lambda _, left=iter([1] * n + [0]): [{"numInputRows": next(left)}])
    return stream


def test_drain_goes_on_to_the_end_or_raises():
    assert drain(pages(1500), None, "") == 1500 and drain(pages(3), None, "", most_runs=4) == 3
    with pytest.raises(RuntimeError):
        drain(pages(3), None, "", most_runs=2)
