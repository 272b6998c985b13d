import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import collect
from corpusloom.streaming import feed

START = dt.datetime(2024, 5, 1)


def events(n=400, seed=1, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = "hot.lua" if hot and rng.random() < 0.35 else rng.choice(["a.lua", "B.lua", "c.lua"])
        rows.append((i, START + dt.timedelta(seconds=i), name, f"u{rng.randrange(3)}", rng.choice("xyz")))
    return rows


def upserted(rows):
    """Row by row, keys compared without case."""
    table = {}
    for _, ts, name, user, content in rows:
        key = (name.lower().rstrip(), user.lower())
        if key not in table:
            table[key] = [name, user, content, ts]
        elif table[key][2] != content:
            table[key][2:] = [content, ts]
    return {tuple(v) for v in table.values()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, filename string, user string, content string").repartition(4)


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_upsert_equals_row_by_row(spark, hot_rows):
    rows = events()
    got = collect.reduce_events(frame(spark, rows), collect.KEYS, "content", "ts", ["event_id"], hot_rows=hot_rows).drop("unchanged")
    assert {tuple(r) for r in got.select("filename", "user", "content", "date_modified").collect()} == upserted(rows)


def test_keys_ignore_case_accents_and_trailing_blanks(spark):
    rows = [(0, START, "Ä.lua", "Me", "1"), (1, START + dt.timedelta(1), "a.lua ", "me", "2"), (2, START + dt.timedelta(2), "b.lua", "me", "3")]
    got = collect.upsert_batch(frame(spark, rows)).orderBy("content").collect()
    assert [(r.filename, r.user, r.content) for r in got] == [("Ä.lua", "Me", "2"), ("b.lua", "me", "3")]
    assert len(collect.upsert_batch(frame(spark, rows), fold=False).collect()) == 3
    first = collect.collect_first_batch(frame(spark, rows)).orderBy("content").collect()
    assert [r.content for r in first] == ["1", "3"]


def test_table_of_batches_equals_one_batch(spark, tmp_path):
    rows = events(300, 5)
    table = feed.FilesTable(spark, str(tmp_path / "t"))
    read = lambda: {tuple(r) for r in table.read().select("filename", "user", "content", "date_modified").collect()}
    for b in range(6):
        table.append(frame(spark, rows[b * 50 : b * 50 + 50]), b)
        if b == 2:
            table.append(frame(spark, rows[b * 50 : b * 50 + 50]), b)  # a replayed batch replaces itself
            table.compact()
        if b in (2, 3):
            assert read() == upserted(rows[: b * 50 + 50])
    table.compact()
    assert read() == upserted(rows)
    table.append(frame(spark, rows[250:]), 5)  # replayed after compaction
    assert read() == upserted(rows)


def land(folder, rows, name):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "w") as f:
        for i, ts, filename, host, content in rows:
            kind = "save" if i % 5 else "autocomplete"
            event = {"type": kind, "filename": filename, "inputs": content, "host": host, "ts": ts.isoformat(), "parameters": {"n": i}}
            f.write(json.dumps(event) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    rows = events(200, 9) + [(1001, START + dt.timedelta(days=1), "skip.py", "u0", "x")]
    kept = [r for r in rows if r[0] % 5 and r[2].endswith(".lua")]
    table = feed.FilesTable(spark, str(tmp_path / "table"))
    (tmp_path / "in").mkdir()
    source = feed.event_stream(spark, str(tmp_path / "in"), feed.EVENT.replace("ts timestamp", "ts timestamp_ntz"))
    for part in range(3):  # restarts continue at the checkpoint
        land(tmp_path / "in", rows[part * 67 : part * 67 + 67], f"{part}.json")
        run = feed.collect_upsert_stream(source, table, str(tmp_path / "state"))
        run.trigger(availableNow=True).start().awaitTermination()
        seen = [r for r in rows[: part * 67 + 67] if r in kept]
        got = {tuple(r) for r in table.read().select("filename", "user", "content", "date_modified").collect()}
        assert got == upserted(seen)


def test_first_stream(spark, tmp_path):
    rows = events(120, 3)
    kept = [r for r in rows if r[0] % 5]
    table = feed.FilesTable(spark, str(tmp_path / "table"), first=True)
    (tmp_path / "in").mkdir()
    source = feed.event_stream(spark, str(tmp_path / "in"), feed.EVENT.replace("ts timestamp", "ts timestamp_ntz"))
    for part in range(3):
        land(tmp_path / "in", rows[part * 40 : part * 40 + 40], f"{part}.json")
        feed.collect_first_stream(source, table, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if part == 1:
            table.compact()
            assert [f["base"] for f in table.folders()] == [True]
    first = {}
    for r in kept:
        first.setdefault((r[2].lower(), r[3].lower()), r)
    got = {(r.filename.lower(), r.user.lower()): (r.content, r.date_modified) for r in table.read().collect()}
    assert {k: v[0] for k, v in got.items()} == {k: r[4] for k, r in first.items()}


def test_readers_outlive_compactions(spark, tmp_path):
    rows = events(200, 4)
    table = feed.FilesTable(spark, str(tmp_path / "t"))
    everything = lambda df: {tuple(r) for r in df.select("filename", "user", "content", "date_modified").collect()}
    for b in range(2):
        table.append(frame(spark, rows[b * 50 : b * 50 + 50]), b)
    opened = table.read()
    table.append(frame(spark, rows[100:150]), 2)
    table.compact()
    table.append(frame(spark, rows[150:]), 3)
    table.compact()
    assert table.vacuum(keep_hours=1) == 0
    assert everything(opened) == upserted(rows[:100]) and everything(table.read()) == upserted(rows)
    assert table.vacuum(keep_hours=0) == 5 and everything(table.read()) == upserted(rows) and len(table.folders()) == 1


def test_an_append_during_a_compaction_counts(spark, tmp_path):
    rows = events(150, 6)
    table = feed.FilesTable(spark, str(tmp_path / "t"))
    for b in range(2):
        table.append(frame(spark, rows[b * 50 : b * 50 + 50]), b)
    write = table._write

    def slow(df, name):
        folder = write(df, name)
        if name.startswith("base"):
            feed.FilesTable(spark, table.path).append(frame(spark, rows[100:]), 2)
        return folder

    table._write = slow
    table.compact()
    assert [(f["base"], f["batch"]) for f in table.folders()] == [(True, 1), (False, 2)]
    assert {tuple(r) for r in table.read().collect()} == upserted(rows)
    # Two writers of the same version: the slower one reads the faster one's and tries again.
    version, tries = table.manifest.latest, []

    def stale():
        tries.append(1)
        number, folders = version()
        return (number - 1, folders) if len(tries) == 1 else (number, folders)

    table.manifest.latest = stale
    assert table.manifest.change(lambda folders: folders) and len(tries) == 2


def test_state_of_arrivals_is_bounded_by_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    landing = tmp_path / "in"
    landing.mkdir()
    source = feed.event_stream(spark, str(landing), files_per_trigger=1)
    rows = [(start + dt.timedelta(hours=h), f"{name}.lua", f"{h}") for h in range(12) for name in ("same", "SAME", f"new{h}")]
    rows += [(start + dt.timedelta(hours=12, minutes=m), "same.lua", "late") for m in (0, 1)]
    for hour in range(13):
        with open(landing / f"{hour:02d}.json", "w") as f:
            for i, (ts, filename, content) in enumerate(rows):
                if ts.hour == hour:
                    event = {"type": "save", "filename": filename, "inputs": content, "host": "u", "ts": ts.isoformat(), "parameters": {"event_id": str(i)}}
                    f.write(json.dumps(event) + "\n")
        os.utime(landing / f"{hour:02d}.json", (1_700_000_000 + hour, 1_700_000_000 + hour))  # files arrive in this order
    arrivals = feed.first_arrivals(feed.saved_files(source), "3 hours")
    run = arrivals.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.filename.lower(), r.content) for r in spark.table("arrivals").collect()]
    assert sorted(f for f, _ in got if f.startswith("new")) == sorted(f"new{h}.lua" for h in range(12))
    # A key stays known for three hours after it was kept, as far as the watermark has come.
    again = sorted(int(c) for f, c in got if f == "same.lua" and c != "late")
    assert again[0] == 0 and 2 <= len(again) <= 4 and all(b - a >= 3 for a, b in zip(again, again[1:]))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 12 and max(sizes) <= 10
    table = feed.FilesTable(spark, str(tmp_path / "table"), first=True)
    feed.collect_arrivals_stream(source, table, str(tmp_path / "more"), "3 hours").trigger(availableNow=True).start().awaitTermination()
    firsts = {r.filename.lower(): r.content for r in table.read().collect()}
    assert firsts["same.lua"] == "0" and len(firsts) == 13


def test_equal_times_are_ordered_by_event_id(spark, tmp_path):
    at = START
    rows = [(2, at, "a.lua", "u", "a"), (1, at, "a.lua", "u", "z")]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, filename string, user string, content string")
    batch = collect.upsert_batch(df, order=["ts", "event_id"]).first().content
    for first in (False, True):
        table = feed.FilesTable(spark, str(tmp_path / f"t{first}"), first=first)
        table.append(df, 0)
        assert table.read().first().content == ("z" if first else batch) and batch == "a"


def test_keys_compare_without_case(spark):
    from corpusloom.operators.keyed import insert_if_absent

    held = spark.createDataFrame([("a.lua", "u", 1)], "filename string, user string, n int")
    new = spark.createDataFrame([("A.lua", "U", 2), ("b.lua", "u", 3), ("B.LUA ", "ü", 4)], "filename string, user string, n int")
    got = insert_if_absent(held, new, ["filename", "user"], ["n"])
    assert sorted((r.filename, r.inserted) for r in got.collect()) == [("a.lua", False), ("b.lua", True)]
    apart = insert_if_absent(held, new, ["filename", "user"], ["n"], fold=False)
    assert apart.count() == 4


def test_read_table_binds_parameters(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "'; drop")], "filename string, content string")
    assert collect.read_table(df, "SELECT filename FROM t WHERE content = ?", ["'; drop"], "t").first().filename == "b"
    assert collect.read_table(df, "SELECT filename FROM t WHERE content = :c", {"c": "x"}, "t").first().filename == "a"


def test_file_events(spark):
    from corpusloom.operators.filters import file_events

    df = spark.createDataFrame([("save", "a.lua"), ("save", "a.py"), ("autocomplete", "b.lua")], "type string, filename string")
    assert [r.filename for r in file_events(df).collect()] == ["a.lua"]
    assert file_events(df, ".py").select(F.lit(1)).count() == 1
