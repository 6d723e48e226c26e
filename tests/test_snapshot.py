"""The snapshot that batch and streaming writers share: every row once, whoever wrote it and however often."""

import glob
import os

import pytest

from shelfcast.sources import sales as src
from shelfcast.sources import snapshot
from shelfcast.streaming.ingest import start_ingest

COLS = ",".join(src.REQUIRED_COLUMNS)


def line(article, month=2, qty=2):
    return f"S,03.{month:02d}.2024,{article},d,M,G,10,{qty},20\n"


def batch_rows(spark, articles, month=1):
    rows = [("S", f"05.{month:02d}.2024", a, "d", "M", "G", "10", "1", "10") for a in articles]
    return src.load_sales(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in src.REQUIRED_COLUMNS)))


def articles(spark, path, **kw):
    return sorted(r.article for r in src.read_snapshot(spark, str(path), **kw).collect())


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run(**options):
        q = start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "ck"), **options)
        q.awaitTermination()
    return run


def test_batch_then_stream_then_batch(spark, tmp_path, stream):
    snap = str(tmp_path / "snap")
    src.write_snapshot(batch_rows(spark, ["hist"]), snap)
    (tmp_path / "in" / "a.csv").write_text(f"{COLS}\n{line('s1')}{line('s2')}")
    stream()
    assert articles(spark, snap) == ["hist", "s1", "s2"]
    src.write_snapshot(batch_rows(spark, ["late"], 3), snap, append=True)
    (tmp_path / "in" / "b.csv").write_text(f"{COLS}\n{line('s3', 3)}")
    stream()
    assert articles(spark, snap) == ["hist", "late", "s1", "s2", "s3"]
    assert articles(spark, snap, date_from="2024-03-01") == ["late", "s3"]
    src.write_snapshot(batch_rows(spark, ["new"]), snap)  # replaces all
    assert articles(spark, snap) == ["new"]
    (tmp_path / "in" / "c.csv").write_text(f"{COLS}\n{line('s4')}")
    stream()
    assert articles(spark, snap) == ["new", "s4"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path, stream):
    snap = str(tmp_path / "snap")
    (tmp_path / "in" / "a.csv").write_text(f"{COLS}\n{line('s1')}")
    stream()
    (tmp_path / "in" / "b.csv").write_text(f"{COLS}\n{line('s2')}")
    stream()
    # the driver died after the commit: the stream's own log lacks the last batch
    last = max(int(os.path.basename(f)) for f in glob.glob(str(tmp_path / "ck" / "commits" / "[0-9]*")))
    for f in glob.glob(str(tmp_path / "ck" / "commits" / f"*{last}*")) + glob.glob(str(tmp_path / "ck" / "commits" / f".{last}*")):
        os.remove(f)
    before = snapshot.manifest(spark, snap)
    stream()
    assert snapshot.manifest(spark, snap) == before
    assert articles(spark, snap) == ["s1", "s2"]


def test_a_half_written_batch_is_written_again(spark, tmp_path):
    """A first try that left files but no manifest entry doesn't show, and is overwritten."""
    path = str(tmp_path / "snap")
    rows = batch_rows(spark, ["x", "y"])
    snapshot._write(rows, path, "stream-0")
    assert src.read_snapshot(spark, path).count() == 0
    assert snapshot.commit(rows, path, batch=("stream", 0)) and not snapshot.commit(rows, path, batch=("stream", 0))
    assert articles(spark, path) == ["x", "y"]


def test_small_commits_are_compacted(spark, tmp_path, stream):
    snap = str(tmp_path / "snap")
    for i in range(11):
        (tmp_path / "in" / f"f{i}.csv").write_text(f"{COLS}\n{line(f'a{i:02d}')}{line(f'b{i:02d}', 5)}short,line\n")
    stream(max_files_per_trigger=1, fanin=3)
    assert articles(spark, snap) == sorted([f"a{i:02d}" for i in range(11)] + [f"b{i:02d}" for i in range(11)])
    assert len(snapshot.manifest(spark, snap)["commits"]) < 3
    live = {c["name"] for c in snapshot.manifest(spark, snap)["commits"]}
    files = [f for n in live for f in glob.glob(f"{snap}/data/commit={n}/sale_month=2024-02/*.parquet")]
    assert len(files) <= 2
    assert {r.outcome: r.lines for r in src.reconciliation(spark, snap).collect()} == {"accepted": 22, "bad_line": 11}


def test_compaction_by_size_class(spark, tmp_path):
    path = str(tmp_path / "snap")
    for i in range(5):
        src.write_snapshot(batch_rows(spark, [f"x{i}"]), path, append=True)
    size = snapshot.manifest(spark, path)["commits"][0]["bytes"]
    assert src.compact_snapshot(spark, path, fanin=6) == 0
    assert src.compact_snapshot(spark, path, fanin=5, small_bytes=size * 2) == 1
    assert len(snapshot.manifest(spark, path)["commits"]) == 1 and articles(spark, path) == [f"x{i}" for i in range(5)]
    assert snapshot.remove_unlisted(spark, path, keep_versions=1) == []  # too young
    assert len(snapshot.remove_unlisted(spark, path, keep_versions=1, min_age_hours=0)) == 5
    assert articles(spark, path) == [f"x{i}" for i in range(5)]


def test_writers_that_publish_at_once(spark, tmp_path, monkeypatch):
    """The one whose number is taken reads the other's manifest and tries again."""
    path, rows = str(tmp_path / "snap"), batch_rows(spark, ["first"])
    publish, done = snapshot._Folder.publish, []

    def between(self, name, text):
        if not done:
            done.append(1)
            snapshot.commit(batch_rows(spark, ["second"]), path)
        return publish(self, name, text)
    monkeypatch.setattr(snapshot._Folder, "publish", between)
    assert snapshot.commit(rows, path)
    assert articles(spark, path) == ["first", "second"] and snapshot.manifest(spark, path)["version"] == 2
    assert not [f for f in os.listdir(f"{path}/drafts") if not f.endswith(".crc")]


def test_empty_writes(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert src.read_snapshot(spark, path).count() == 0
    src.write_snapshot(batch_rows(spark, ["x"]).limit(0), path)
    assert src.read_snapshot(spark, path).schema == src.SALES_SCHEMA and src.read_snapshot(spark, path).count() == 0
    assert src.compact_snapshot(spark, path, fanin=1 + 1) == 0


def test_lines_that_do_not_fit_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{COLS}\n{line('ok')}S,03.02.2024,long,d,M,G,10,2,20,tenth\nS,03.02.2024,cut,d,M\n"
                                    f'S,03.02.2024,"quo,ted",d,M,G,10,2,\nS,unknown,a,d,M,G,10,2,20\n')
    source = src.read_sales(spark, str(tmp_path / "a.csv"))
    assert sorted(r.article for r in src.load_sales(source).collect()) == ["ok", "quo,ted"]
    got = {r.article: r.reject_reason for r in src.rejection_reasons(source).select("article", "reject_reason").collect()}
    assert got == {"ok": None, "long": "bad_line", "cut": "bad_line", "quo,ted": None, "a": "bad_date"}
    src.ingest(source, str(tmp_path / "snap"))
    counts = {r.outcome: r.lines for r in src.reconciliation(spark, str(tmp_path / "snap")).collect()}
    assert counts == {"bad_line": 2, "bad_date": 1, "accepted": 2} and sum(counts.values()) == 5
