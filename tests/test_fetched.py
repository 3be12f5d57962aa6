"""Sources behind fetch functions: pages, keys, captions, searches, answers; retries and settings."""

import pytest

from plenaria.sources import fetched


def test_retries_wait_and_give_up():
    slept, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("429")
        return x * 2

    assert fetched.retried(call, sleep=slept.append)(4) == 8 and slept == [1, 2]
    with pytest.raises(ZeroDivisionError):
        fetched.retried(lambda: 1 / 0, tries=2, sleep=slept.append)()
    now, waits = [0.0], []

    def tick(s):
        waits.append(s)
        now[0] += s

    slow = fetched.retried(lambda: None, interval=1.5, sleep=tick, clock=lambda: now[0])
    slow(), slow()
    assert waits == [1.5]


def test_pages_are_passed_on_many_at_a_time(spark):
    import pandas as pd

    class Listings:
        """Stands for a table; keeps the function that tasks run."""

        select = distinct = lambda self, *_: self

        def mapInPandas(self, run, schema):  # noqa: N802
            return run

    def fetch(listing, token):
        if listing == "broken":
            raise OSError
        n = int(token or 0)
        return ("x" * (3 << 20) if listing == "large" else f"{listing}-{n}", str(n + 1))

    run = fetched.pages(Listings(), fetch, most=10, tries=1)
    names = [str(i) for i in range(1000)]
    got = list(run([pd.DataFrame({"listing": names[:500]}), pd.DataFrame({"listing": names[500:]})]))
    assert [tuple(x) for x in pd.concat(got)[["listing", "page", "value"]].to_numpy().tolist()] == [(x, n, f"{x}-{n}") for x in names for n in range(10)]
    assert len(got) <= 4 and max(map(len, got)) <= fetched.ROWS
    assert [len(x) for x in run([pd.DataFrame({"listing": ["large"]})])] == [3, 3, 3, 1]
    assert [len(x) for x in run([pd.DataFrame({"listing": ["broken"] * 5000})])] == [fetched.ROWS, 5000 - fetched.ROWS]


def test_pages_end(spark):
    def fetch(listing, token):
        n = int(token or 0)
        if listing == "broken" and n == 1:
            raise ValueError("gone")
        return (f"{listing}-{n}" if n < 4 else "", str(n + 1))

    rows = spark.createDataFrame([("a",), ("broken",), ("a",)], "listing string")
    got = sorted((r.listing, r.page, r.value, r.error) for r in fetched.pages(rows, fetch, tries=1).collect())
    assert got == [("a", i, f"a-{i}", None) for i in range(4)] + [("broken", 0, "broken-0", None), ("broken", 1, None, "ValueError: gone")]
    assert fetched.pages(rows, fetch, most=2, tries=1).where("listing = 'a'").count() == 2
    assert fetched.pages(rows, fetch, past=lambda v: v.endswith("-1"), tries=1).where("listing = 'a'").count() == 2
    assert fetched.pages(rows.limit(0), fetch).count() == 0


def test_keys_captions_and_sync(spark):
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nGuten Tag.\r\n\r\nnichts\n\n2\n00:00:03,000 --> 00:00:04,000\n17\n Ende \n"

    def fetch(key):
        if key == "bad":
            raise KeyError(key)
        return srt

    clips = spark.createDataFrame([("x", 1), ("bad", 2), (None, 3), ("x", 4)], "srt string, i int")
    assert sorted((r.i, r.text) for r in fetched.captions(clips, fetch).collect()) == [(1, "Guten Tag. Ende"), (2, ""), (3, ""), (4, "Guten Tag. Ende")]
    keys = spark.createDataFrame([(21, i) for i in range(4)], "wp int, nr int")
    new = fetched.synced(keys, keys.where("nr < 2"), lambda k: f"<{k}>").collect()
    assert sorted((r.nr, r.value, r.error) for r in new) == [(2, "<21/2>", None), (3, "<21/3>", None)]


def test_searches_answers_and_settings(spark):
    claims = spark.createDataFrame([(1, "Die Steuer in Berlin stieg Anfang 2024 stark"), (2, "")], "i int, text string")
    hits = fetched.searched(claims, ["i"], lambda terms: [("t", "u", terms), ("t2", "u2", "x"), ("t3", "u3", "y")], most=2).collect()
    assert sorted((r.i, r.rank, r.titel) for r in hits) == [(1, 0, "t"), (1, 1, "t2")]
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "prompt string")
    assert sorted(str(r.answer) for r in fetched.answered(asked, lambda p: p.upper(), interval=0.0).collect()) == ["A", "A", "None"]
    assert fetched.settings({"LLM_BASE_URL": "https://one.example/v1", "LLM_API_KEY": "k"}, {"one": "one.example"})["provider"] == "one"
    assert fetched.settings({"LLM_BASE_URL": "https://x", "LLM_API_KEY": "k", "LLM_PROVIDER": "p"})["provider"] == "p"
    with pytest.raises(ValueError):
        fetched.settings({"LLM_BASE_URL": "https://x"})


def test_audio_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"xx")
    (tmp_path / "b.wav").write_bytes(b"-")

    def model(content):
        if content == b"-":
            raise ValueError("empty")
        return [(0.0, 1.5, "S1", "guten tag"), (1.5, 2.0, "S2", "danke")]

    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted((r.path[-5:], r.i, r.start, r.speaker, r.text, r.error) for r in fetched.heard(files, model).collect())
    assert got == [("a.wav", 0, 0.0, "S1", "guten tag", None), ("a.wav", 1, 1.5, "S2", "danke", None), ("b.wav", None, None, None, None, "ValueError: empty")]
