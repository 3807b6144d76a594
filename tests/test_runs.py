"""Runs that break off: answers are kept one by one, the pool drains, flushes go in plan order or not at all."""

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.plans import answers, completer, pipelines
from quillmesh.sources import glossary_md, ordered_text
from quillmesh.sources.folder import Folder, replace_all
from quillmesh.sources.state import EXTRACT_STATE, Options, RunStore
from quillmesh.streaming import follow, ordered

ENTRY = [f.split()[0] for f in glossary_md.ENTRY.split(", ")]


def chunk_rows(spark, n):
    return spark.createDataFrame([(f"c{i:02d}", f"<p>{i}</p>", i) for i in range(1, n + 1)], "chunk_id string, source_html string, n long")


def asked(spark, rows, call, root, **given):
    log = answers.AnswerLog(root, given.pop("job", "job1"))
    log.folder.make("answers")
    done = completer.complete_chunks(rows, call, "p", check=None, pause=lambda s: None, log=log, order="n", **given)
    return log, done


def found(spark, root):
    return {r["chunk_id"]: r for r in answers.last_of_each(answers.logged(spark, root)).collect()}


def test_a_death_at_a_call_leaves_the_answers_before_it(spark, tmp_path):
    root, marks = f"file://{tmp_path}/run", str(tmp_path / "marks")
    os.makedirs(marks)

    def dies_at_four(prefix, content, feedback):
        open(f"{marks}/{content[3]}-{time.time_ns()}", "w").close()
        if content == "<p>4</p>":
            os._exit(9)  # as when an executor is lost
        return completer.Answer(content.replace("p", "b"), "stop", 1)

    _, out = asked(spark, chunk_rows(spark, 7), dies_at_four, root, concurrency=1)
    with pytest.raises(Exception):
        out.collect()
    assert sorted(found(spark, root)) == ["c01", "c02", "c03"]
    assert {json.loads(p.read_text())["html"] for p in (tmp_path / "run" / "answers").iterdir()} == {f"<b>{i}</b>" for i in (1, 2, 3)}

    def counts(prefix, content, feedback):
        open(f"{marks}/again{content[3]}-{time.time_ns()}", "w").close()
        return completer.Answer("new")

    # The same job, run again by Spark or resumed, pays for the rest alone.
    _, out = asked(spark, chunk_rows(spark, 7), counts, root, concurrency=1, job="job2")
    got = {r["chunk_id"]: r["html"] for r in out.collect()}
    assert got == {f"c0{i}": f"<b>{i}</b>" if i < 4 else "new" for i in range(1, 8)}
    assert sorted(f[5] for f in os.listdir(marks) if f.startswith("again")) == ["4", "5", "6", "7"]


def test_one_failure_stops_all_tasks_and_drains(spark, tmp_path):
    """Two tasks of four threads each: the failure of one call ends the scheduling of both; calls in flight end and are kept."""
    root, marks = f"file://{tmp_path}/run", str(tmp_path / "marks")
    os.makedirs(marks)

    def call(prefix, content, feedback):
        open(f"{marks}/{content[3:-4]}", "w").close()
        wait = time.time() + 20
        while len(os.listdir(marks)) < 8 and time.time() < wait:  # until eight are in flight
            time.sleep(0.02)
        if content == "<p>2</p>":
            raise completer.CompletionError("no such model", False)
        time.sleep(1.5)
        return completer.Answer("done " + content)

    log, out = asked(spark, chunk_rows(spark, 40), call, root, concurrency=8)
    got = {r["chunk_id"]: r["status"] for r in out.collect()}
    assert sorted(map(int, os.listdir(marks))) == list(range(1, 9))  # in plan order, eight at a time, and none after
    assert [s for _, s in sorted(got.items())] == ["done", "error"] + ["done"] * 6 + ["pending"] * 32
    assert {k: r["status"] for k, r in found(spark, root).items()} == {k: s for k, s in got.items() if s != "pending"}
    assert log.stopped() and completer.first_failure(out.sparkSession.createDataFrame([("c02", "error", "why")], "chunk_id string, status string, reason string")) == ("c02", "why")


def test_in_flight_calls_never_pass_the_bound(spark, tmp_path):
    root, marks = f"file://{tmp_path}/run", str(tmp_path / "marks")
    os.makedirs(marks)

    def call(prefix, content, feedback):
        mine = f"{marks}/{time.time_ns()}"
        open(mine, "w").close()
        n = len(os.listdir(marks))
        time.sleep(0.1)
        os.remove(mine)
        return completer.Answer(str(n))

    _, out = asked(spark, chunk_rows(spark, 30), call, root, concurrency=5)
    assert max(int(r["html"]) for r in out.collect()) in (4, 5)


def test_a_bug_in_a_check_is_an_outcome(spark, tmp_path):
    """Whatever is raised ends the run, and is not asked again by Spark."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(prefix, content, feedback):
        (calls / str(time.time_ns())).touch()
        return completer.Answer("x")

    df = chunk_rows(spark, 3)
    out = completer.complete_chunks(df, call, "p", check=lambda s, a: 1 / 0, concurrency=1).collect()
    assert sorted((r["status"], r["reason"]) for r in out) == [("error", "ZeroDivisionError: division by zero"), ("pending", None), ("pending", None)]
    assert len(list(calls.iterdir())) == 1


def test_packed_answers_are_read_like_others(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    fails = lambda p, c, f: (_ for _ in ()).throw(completer.CompletionError("busy", True)) if "2" in c else completer.Answer("a")
    _, out = asked(spark, chunk_rows(spark, 3), fails, root, concurrency=1, retries=1)
    out.collect()
    answers.pack(spark, root)
    answers.pack(spark, root)
    assert {k: r["status"] for k, r in found(spark, root).items()} == {"c01": "done", "c02": "failed", "c03": "done"}
    log = answers.AnswerLog(root, "later")
    log.put({"chunk_id": "c02", "status": "done", "html": "late", "ended": 1.0})
    assert found(spark, root)["c02"]["html"] == "late" and answers.logged(spark, f"{tmp_path}/nothing").count() == 0


def test_files_are_replaced_together_or_not_at_all(tmp_path):
    a, b = Folder(str(tmp_path / "a")), Folder(f"file://{tmp_path}/b")
    replace_all([(a, "x/one", b"1"), (b, "two", b"2")])

    class Full(Folder):
        def write(self, name, data):
            raise OSError("no space")

    for files in ([(a, "x/one", b"9"), (b, "three", b"3"), (Full("nowhere"), "y", b"")],):
        with pytest.raises(OSError, match="no space"):
            replace_all(files)
        assert (a.read("x/one"), b.read("two"), b.read("three")) == (b"1", b"2", None)
    assert [f for _, _, files in os.walk(tmp_path) for f in files if f.startswith("_")] == []


# -- the whole extract run ------------------------------------------------------------


def editions(spark, n):
    rows = [(i, f"c{i}.xhtml", f"<h1>Chapter {i}</h1>", f"text {i}") for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "chapter_no int, file_path string, xhtml string, plain_text string")
    return df, df


def name_of(content):
    return content.split("] c")[1].split(".")[0]


def answer(n):
    return completer.Answer(f"## Name{n}\n- ru: имя{n}\n\n## Shared\n- ru: общее{n}\n- notes: from {n}.\n", "stop", 10, None, 5)


def names(path):
    return [line[3:] for line in path.read_text().splitlines() if line.startswith("## ")]


def test_flush_in_plan_order_while_calls_run(spark, tmp_path):
    """Answers come in the order 1, 3, 2; call 2 sees on disk what was ready before it, and step 3 waits for it."""
    out, state = tmp_path / "out.md", tmp_path / "run" / "state" / "state.json"
    o, t = editions(spark, 4)
    progress = io.StringIO()

    def call(prefix, content, feedback):
        n = int(name_of(content))
        if n == 2:
            wait = time.time() + 60
            while time.time() < wait and not (out.exists() and (tmp_path / "three").exists()):
                time.sleep(0.05)
            time.sleep(2)  # step 3 has been answered; it must wait
            seen = names(out)
            while time.time() < wait and "1/4" not in progress_file.read_text():
                time.sleep(0.05)
            (tmp_path / "seen").write_text(json.dumps([seen, json.loads(state.read_text())["completedSteps"], progress_file.read_text()]))
        if n == 3:
            (tmp_path / "three").touch()
        return answer(n)

    progress_file = tmp_path / "progress"
    with open(progress_file, "w") as lines:
        text = pipelines.extract(spark, o, t, "# G\n", call, options=Options(extract_concurrency=2), run=RunStore(spark, f"file://{tmp_path}/run"), out=str(out), progress=lines).first()["text"]
    seen, completed, shown = json.loads((tmp_path / "seen").read_text())
    assert seen == ["Name1", "Shared"] and completed == ["1:c1.xhtml"]
    assert "1/4 1:c1.xhtml" in shown and "4/4" not in shown  # a step's line is there before the next one ends
    assert names(out) == ["Name1", "Shared", "Name2", "Name3", "Name4"] and out.read_text() == text
    assert "- ru: общее1\n" in text and "- notes: from 1. from 2. from 3. from 4.\n" in text
    assert json.loads(state.read_text())["completedSteps"] == [f"{i}:c{i}.xhtml" for i in range(1, 5)]
    assert progress_file.read_text().splitlines()[-1].startswith("█" * 20 + " 4/4")


def test_a_flush_that_fails_leaves_glossary_and_state_as_before(spark, tmp_path, monkeypatch):
    out, run = tmp_path / "out.md", RunStore(spark, f"file://{tmp_path}/run")
    o, t = editions(spark, 3)
    steps = pipelines.extract_steps(spark, o, t, 10_000)
    docs, entries = glossary_md.parse(pipelines.one_document(spark, "# G\n\n## Old\n- ru: старое\n"))
    state = run.begin({"completedSteps": [], "pendingOutputs": {}}, EXTRACT_STATE, (), False)
    flush = follow.GlossaryFlush(run, answers.AnswerLog(run.root, "j"), docs, entries.select(*ENTRY), steps, state, str(out))
    ready = lambda *ns: spark.createDataFrame([(n, answer(n).content) for n in ns], "seq long, content string")
    flush.take(ready(1), 0)
    before = [out.read_bytes(), run.state(EXTRACT_STATE), flush.committed()]
    write = Folder.write

    def full(self, name, data):
        if name == "state/state.json":  # after the glossary
            raise OSError("no space")
        write(self, name, data)

    monkeypatch.setattr(Folder, "write", full)
    with pytest.raises(OSError):
        flush.take(ready(2), 1)
    monkeypatch.undo()
    assert [out.read_bytes(), run.state(EXTRACT_STATE), flush.committed()] == before
    flush.take(ready(2), 1)
    flush.take(ready(2), 1)  # a batch that comes again
    flush.take(ready(), 2)  # a batch without ready steps
    assert names(out) == ["Old", "Name1", "Shared", "Name2"] and run.state(EXTRACT_STATE)["completedSteps"] == ["1:c1.xhtml", "2:c2.xhtml"]
    assert "from 1. from 2." in out.read_text() and out.read_text().count("from 2.") == 1


def test_a_failed_run_goes_on_where_it_was(spark, tmp_path):
    """Steps 1 and 3 are answered, 2 fails: 1 is merged, 3 is kept and waits; the resumed run asks 2 and what was never asked."""
    o, t = editions(spark, 5)
    run = RunStore(spark, f"file://{tmp_path}/run")
    marks = tmp_path / "marks"
    marks.mkdir()

    def second_fails(prefix, content, feedback):
        n = int(name_of(content))
        if n == 2:
            wait = time.time() + 60
            while time.time() < wait and not (marks / "three").exists():
                time.sleep(0.05)
            raise completer.CompletionError("out of money", False)
        if n == 3:
            (marks / "three").touch()
            time.sleep(1)  # in flight while 2 fails
        return answer(n)

    with pytest.raises(completer.RunStopped, match="2:c2.xhtml: out of money") as stopped:
        pipelines.extract(spark, o, t, "# G\n", second_fails, options=Options(extract_concurrency=2), run=run)
    assert "Name1" in stopped.value.partial.first()["text"] and "Name3" not in stopped.value.partial.first()["text"]
    saved = run.state(EXTRACT_STATE)
    assert saved["completedSteps"] == ["1:c1.xhtml"] and list(saved["pendingOutputs"]) == ["3:c3.xhtml"] and "Name3" in saved["pendingOutputs"]["3:c3.xhtml"]

    def rest(prefix, content, feedback):
        (marks / f"asked{name_of(content)}").touch()
        return answer(int(name_of(content)))

    text = pipelines.extract(spark, o, t, "# G\n", rest, options=Options(extract_concurrency=2), run=run, resume=True).first()["text"]
    assert [line for line in text.splitlines() if line.startswith("## ")] == ["## Name1", "## Shared", "## Name2", "## Name3", "## Name4", "## Name5"]
    assert sorted(p.name for p in marks.iterdir()) == ["asked2", "asked4", "asked5", "three"]
    assert run.state(EXTRACT_STATE)["pendingOutputs"] == {}


def test_request_builders_agree(spark):
    """The client's request and the column's have the same fields, values and order of messages, whatever is set."""
    row = spark.createDataFrame([("m", "pre", "body", "note")], "m string, p string, c string, f string")
    for given in ({}, {"temperature": 0.5}, {"stream": True}, {"caching": True}, {"caching": True, "cache_ttl": "5m", "reasoning": "low", "stream": True}, {"reasoning": "none"}):
        client = completer.HttpCompleter("http://x", "m", 9, **given)
        for note in (None, "note", " "):
            column = {k: F.lit(v) if k == "temperature" else v for k, v in given.items()}
            made = row.select(completer.request_json(F.col("m"), F.col("p"), F.col("c"), F.lit(9), None if note is None else F.lit(note), **column)).first()[0]
            assert json.loads(made) == client.request("pre", "body", note), (given, note)
    assert completer.HttpCompleter("http://x", "m", 9, caching=True).request("pre", "b", None)["session_id"] == row.select(completer.session_id(F.col("p"))).first()[0]


# -- one file from many tasks, and event streams ----------------------------------------


@pytest.mark.parametrize("middle", [True, False])
def test_ordered_text(spark, tmp_path, monkeypatch, middle):
    """A file is the same however many tasks write it, and whether parts can be put in its middle or not."""
    rows = [(draw % 97, None if draw % 50 == 3 else f"{draw}é😀\n") for draw in range(2_000)]
    df = spark.createDataFrame(rows, "a int, t string").repartition(7)
    want = "head\n" + "".join(t for _, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())) if t)
    if not middle:
        monkeypatch.setattr(ordered_text.fs, "LocalFileSystem", type("None", (), {}))
    for parts in (1, 5):
        path = tmp_path / "out" / f"f{parts}.txt"
        assert ordered_text.write_ordered(df, ["a"], F.col("t"), f"file://{path}", "head\n", parts) == len(want.encode())
        assert path.read_text() == want
    ordered_text.write_ordered(df, ["a"], F.col("t"), str(path), "")  # replaces
    assert path.read_text() == want[5:]
    ordered_text.write_ordered(df.limit(0), ["a"], F.col("t"), str(path), "only")
    assert path.read_text() == "only" and sorted(os.listdir(tmp_path / "out")) == ["f1.txt", "f5.txt"]


def test_entries_file_is_what_write_gives(spark, tmp_path):
    md = "# G\n\nAbout\n\n## B\n- ru: б\n- type: name\n- notes: n\n\n## A\n- ru: а\n- type: other\n- aliases: x, y\n"
    docs, found_entries = glossary_md.parse(pipelines.one_document(spark, md))
    glossary_md.write_entries("G", "About", found_entries, str(tmp_path / "g.md"))
    assert (tmp_path / "g.md").read_text() == md == glossary_md.write(docs, found_entries).first()["text"]


def test_event_streams_over_batches_and_a_restart(spark, tmp_path):
    """Pieces cut anywhere, out of order, repeated, over micro-batches; the query is stopped in the middle of an event."""
    event = lambda c, end="": 'data: {"choices":[{"index":0,"delta":{"content":' + json.dumps(c) + "}" + end + "}]}\n\n"
    good = event("<p>При") + event("вет</p>", ',"finish_reason":"stop"') + 'data: {"usage":{"prompt_tokens":7,"completion_tokens":2}}\n\n' + "data: [DONE]\n\n"
    whole = {"a": good, "b": good.replace("вет", "\r\nдва"), "c": event("x") + "data: {oops\n\n", "d": event("cut off")}
    cut = {k: [v[i : i + 37] for i in range(0, len(v), 37)] for k, v in whole.items()}
    rows = [(k, i + 1, p) for k, ps in cut.items() for i, p in enumerate(ps)] + [("d", len(cut["d"]) + 1, None)]
    rows = rows[::2][::-1] + rows[1::2] + rows[:3]
    schema = "stream_id string, seq long, piece string"
    os.makedirs(tmp_path / "in")
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    for _ in range(2):  # two batches, then a new query from the checkpoint
        pieces = ordered.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = ordered.folded_streams(pieces).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        wait = time.time() + 60
        while _ == 0 and time.time() < wait and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
            time.sleep(0.05)
        if _ == 1:
            query.processAllAvailable()
        query.stop()
    got = {r["stream_id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and spark.read.parquet(str(tmp_path / "out")).count() == 4
    for k, v in whole.items():
        assert {c: x for c, x in got[k].items() if c != "stream_id"} == ordered.fold_events(v), k


def test_answers_are_packed_by_tasks(spark, tmp_path):
    """Files are listed by one task and read and deleted by many; hidden files are of nobody, half pairs of units do no harm."""
    root = f"file://{tmp_path}/run"
    log = answers.AnswerLog(root, "j")
    base = {"seq": 1, "status": "done", "reason": None, "attempts": 1, "prompt_tokens": None, "cached_tokens": 0, "completion_tokens": 2, "started": 1.0, "ended": 2.5}
    for k in range(40):
        log.put(base | {"chunk_id": f"c{k}", "html": "a\ud800b" if k == 7 else f"<b>{k}</b>"})
    (tmp_path / "run" / "answers" / "_half.json.1").write_text("{")
    assert answers._names(spark, root).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    answers.pack(spark, root)
    assert not log.folder.exists("answers")
    before = answers.logged(spark, root).collect()
    assert {r[0]: r[3] for r in before} == {f"c{k}": "a?b" if k == 7 else f"<b>{k}</b>" for k in range(40)}
