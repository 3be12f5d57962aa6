"""Operators 11 to 13 against plain versions: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.llm import common, middle, names, rulelist


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    common.tune(spark)


def plain_middle(doc_id, text, rate=90, spm=20):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    if not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def middle_rows():
    rng = random.Random(4)
    parts = ["a", " ", "<", ">", "P>", "<M", "é", "漢", "😀", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 9, 255, 256, 257, 900])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "holds <S> it"), (1003, "é" * 400_000), (1004, "<"), (0, rows[0][1]), (1005, "<<P" + "x" * 50)]
    return rows


def test_fill_in_middle_equals_plain_version(spark):
    rows = middle_rows()
    df = spark.createDataFrame([(i, t, 9, "kept") for i, t in rows], "doc_id long, text string, N int, other string").repartition(3)
    made = middle.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert got == Counter((i, t, *plain_middle(i, t)) for i, t in rows)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    back = middle.restored(made.drop("text"))
    assert Counter((r.doc_id, r.restored) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert middle.fill_in_middle(df.limit(0)).count() == 0


def test_restored_rejects_broken_outputs(spark):
    rows = [("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "psm"), ("<P>a<S>b<M>c", "psm"), ("<S>b<P>a<M>c", "spm"), (None, "psm"), ("t", None)]
    got = [r.restored for r in middle.restored(spark.createDataFrame(rows, "output string, form string").coalesce(1)).collect()]
    assert got == [None, None, None, "acb", "acb", None, "t"]


def test_sentinels_may_not_overlap():
    for bad in (("ab", "ba"), ("a", "ab"), ("", "b"), ("x", "x")):
        with pytest.raises(ValueError):
            middle.Scanner(bad)


def test_scanner_counts_broken_bytes_as_units():
    seen = middle.Scanned([b"\x80\x80a\xe6\xbc\xe6\xbc\xa2", b"", b"<<M>"], middle.Scanner())
    assert seen.n.tolist() == [5, 0, 4] and seen.of.tolist() == [2]


def test_fill_in_middle_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", middle_rows()[:120] + middle_rows()[300:304])
    df = con.execute(middle.ORACLE).fetchall()
    want = {(i, n, form, a, b, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in middle_rows()[:120] + middle_rows()[300:304] for n, form, a, b, out in [plain_middle(i, t)]}
    assert set(df) == want


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines), len(set(words)), sum(x.isupper() for x in text or "")]


def counts_rows():
    rng = random.Random(5)
    texts = [None, "", "   \n\n ", "a b c", "a b c a b c", "a a a a", "x\x0by z x y", "É é #* <b>\r\nL\nL\n L\nL", "w " * 30_000]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))).replace("a b", "a\nb") for _ in range(150)]
    return list(enumerate(texts)) + [(None, "no id"), (4, "a b c a b c")]


@pytest.mark.parametrize("place", [20, 3])
def test_statistics_equal_plain_version(spark, monkeypatch, place):
    monkeypatch.setattr(rulelist, "PLACE", place)
    df = spark.createDataFrame([(i, t, "x") for i, t in counts_rows()], "doc_id long, text string, N_words string")
    counts = rulelist.statistics(df)
    assert counts.columns == ["doc_id", *rulelist.COUNTS]
    assert Counter(map(tuple, counts.collect())) == Counter((i, *plain_counts(t)) for i, t in counts_rows())
    assert rulelist.statistics(df.limit(0)).count() == 0


def written(rng, bad):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
    if bad == "symbols":
        words = [w[:-1] + "*" for w in words]
    if bad == "upper":
        words = [w.upper() for w in words]
    return " ".join(words)


def test_decision_list_learns_what_labels_say(spark):
    rng = random.Random(6)
    kinds = [None, None, None, "symbols", "upper"]
    rows = [(i, written(rng, kinds[i % 5])) for i in range(600)] + [(600 + i, "a " * 10) for i in range(20)]
    labels = [(i, int(kinds[i % 5] is None)) for i in range(400)] + [(600 + i, 1) for i in range(20)] + [(None, 0), (3, None), (9999, 0)]
    counts = rulelist.statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    found = rulelist.learned(counts, y)
    assert 2 <= len(found.rules) <= 4 and str(found).endswith("keep")
    assert rulelist.learned(counts.repartition(7), y.repartition(5)) == found
    judged = rulelist.judged(counts.withColumn("kept", F.lit("x")), found)
    got = {r.doc_id: r for r in judged.collect()}
    held = [i for i in range(400, 600)]
    assert all(got[i].kept == (kinds[i % 5] is None) for i in held)
    assert all(got[i].base_failed and not got[i].kept for i in range(600, 620))
    assert "symbols" in got[403].rule and "upper" in got[404].rule and got[400].rule is None
    nodes = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_decision_list_without_both_classes_keeps_all(spark, labels):
    rng = random.Random(8)
    counts = rulelist.statistics(spark.createDataFrame([(i, written(rng, None)) for i in range(5)], "doc_id long, text string"))
    found = rulelist.learned(counts, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert found.rules == () and all(r.kept for r in rulelist.judged(counts, found).collect())


def test_quality_rules_on_documents(spark, data):
    got = rulelist.op12_quality_rules(spark, data).collect()
    docs = {r.doc_id: r.text for r in common.table(spark, data, "documents").collect()}
    assert len(got) == len(docs)
    for r in got:
        n = plain_counts(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == n[:5]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def drawn(rng, letters, n, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_walk_of_the_trie_equals_distances(k):
    rng = random.Random(k)
    held, walking = sorted(set(drawn(rng, "abé", 400, 7))), drawn(rng, "abé😀", 150, 8)
    got = {}
    for i, j, d in names.walked(names.Forest(np.zeros(len(held), np.int64), held), np.zeros(len(walking), np.int64), walking, k):
        got |= {(x, y): e for x, y, e in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
    assert got == {(i, j): o for i, a in enumerate(walking) for j, b in enumerate(held) if (o := osa(a, b)) <= k}
    assert all(names.alignment(a, b, k) == min(osa(a, b), k + 1) for a in walking[:40] for b in held[:80])


@pytest.mark.parametrize("block", [4096, 5])
def test_pairs_equal_all_distances(spark, block):
    rng = random.Random(block)
    a = drawn(rng, "abcd", 120, 9) + ["x" * 3000, "", "ca", "abc"]
    b = drawn(rng, "abcd", 200, 9) + ["x" * 2998, "x" * 2990, "", "abc", "ca"]
    df = lambda v: spark.createDataFrame([(x,) for x in [*v, v[0], None]], "name string")
    got = Counter((r.l, r.r, r.distance) for r in names.pairs(df(a), df(b), 2, block).collect())
    want = {(x, y, 2) for x, y in [("x" * 3000, "x" * 2998)]} | {(x, y, o) for x in set(a) for y in set(b) if x and y and max(len(x), len(y)) < 50 and (o := osa(x, y)) <= 2}
    assert got == Counter(want) and ("ca", "abc", 2) not in want
    assert names.pairs(df(a).limit(0), df(b)).count() == 0 and names.pairs(df(a), df(b).limit(0)).count() == 0


def test_name_join_counts_clients(spark):
    clients = [(1, "anna"), (2, "anan"), (2, "anan"), (3, "anna b"), (None, "anna"), (4, None), (5, ""), (6, "zzzzzz")]
    vendors = [(10, "anna"), (10, "anna"), (11, "anna"), (12, None), (13, ""), (10, "zzzzzz"), (14, "q")]
    c = spark.createDataFrame([(*x, 1) for x in clients], "client_id long, name string, vendor_id int")
    v = spark.createDataFrame([(*x, 1) for x in vendors], "vendor_id long, name string, client_id int")
    crc = lambda *ids: sum(zlib.crc32(str(i).encode()) for i in ids)
    got = {tuple(r) for r in names.name_join(c, v).collect()}
    assert got == {(10, 0, 3, 1, crc(1, 6)), (10, 1, 2, 2, crc(2, 2)), (10, 2, 1, 3, crc(3)), (11, 0, 2, 1, crc(1)), (11, 1, 2, 2, crc(2, 2)), (11, 2, 1, 3, crc(3))}


def test_name_join_on_tables_equals_brute_force(spark, data):
    lower = lambda s: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s)
    clients = [(r.client_id, lower(r.name)) for r in common.table(spark, data, "clients").collect() if r.name]
    want = {}
    for r in common.table(spark, data, "vendors").collect():
        if not r.name:
            continue
        name, h = r.name, zlib.crc32(str(r.vendor_id).encode())
        if h % 2 == 0 and len(name) >= 2:
            p = h % (len(name) - 1)
            name = name[:p] + name[p + 1] + name[p] + name[p + 2 :]
        for i, c in clients:
            if abs(len(c) - len(name)) <= 2 and (d := osa(lower(name), c)) <= 2:
                n, first, crc = want.get((r.vendor_id, d), (0, i, 0))
                want[r.vendor_id, d] = (n + 1, min(first, i), crc + zlib.crc32(str(i).encode()))
    got = {(r.vendor_id, r.distance): tuple(r)[2:] for r in names.op13_edit_distance_name_join(spark, data).collect()}
    assert got == want
