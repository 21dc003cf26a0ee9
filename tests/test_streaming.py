import uuid

import pytest
from conftest import CARD_CSV

HEADER = ["Transaction Date", "Post Date", "Description", "Category", "Type", "Amount"]


def test_stream_dedups_per_ledger_and_takes_older_months(spark, tmp_path):
    from cashweave.streaming.ingest_stream import daily_net_stream, start, stream_exports
    folder = tmp_path / "inbox"
    folder.mkdir()
    lines = CARD_CSV.splitlines(keepends=True)
    (folder / "card_a.csv").write_text(CARD_CSV + "".join(lines[1:4]))       # some rows twice
    (folder / "card_b.csv").write_text(CARD_CSV)                              # another ledger with equal rows
    name = "rows_" + uuid.uuid4().hex[:8]
    start(stream_exports(spark, str(folder), HEADER), name).awaitTermination(120)
    got = spark.sql(f"select * from {name}").collect()
    assert sorted(r.account_id for r in got) == ["card_a"] * 7 + ["card_b"] * 7
    assert all(r.category is not None for r in got)
    # an older month that arrives later is not late
    (folder / "card_c.csv").write_text(CARD_CSV.replace("/2031", "/2029"))
    name2 = "rows_" + uuid.uuid4().hex[:8]
    start(stream_exports(spark, str(folder), HEADER, max_files_per_trigger=1), name2).awaitTermination(120)
    assert spark.sql(f"select * from {name2}").count() == 21
    name3 = "daily_" + uuid.uuid4().hex[:8]
    start(daily_net_stream(stream_exports(spark, str(folder), HEADER)), name3, output_mode="update").awaitTermination(120)
    assert spark.sql(f"select account_id, date from {name3}").distinct().count() == 21


def test_start_wants_a_shared_folder():
    from types import SimpleNamespace

    from cashweave.session import shared_checkpoint_dir
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_checkpoint_dir(bare)
