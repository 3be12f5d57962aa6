import random
import tracemalloc

import pytest

from pyspark.sql import functions as F

from plenaria.operators import algorithms, factcheck, quality, resolve, retrieval, substrings
from plenaria.plans import jobs, registry


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_errors_against_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        s, n, d = quality._counts(a, b)
        assert s + n + d == plain_distance(a, b) and len(a) - d + n == len(b)


def test_word_errors(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), (None, None), ("", "x")], "ref string, hyp string")
    got = [(r.wer, r.subs, r.ins, r.dels, r.n_ref) for r in quality.word_errors(df).collect()]
    assert got == [(0.5, 1, 0, 1, 4), (0.0, 0, 0, 0, 0), (1.0, 0, 1, 0, 0)]
    blocks = [(r.edits, r.n_ref) for r in quality.block_errors(df).collect()]
    assert blocks == [(2, 4), (0, 0), (1, 0)]


def test_differences(spark):
    df = spark.createDataFrame([("a b c", "a x c d")], "ref string, hyp string")
    assert quality.differences(df).first()["diff"] == [["=", "a"], ["p", "b", "x"], ["=", "c"], ["r", "d"]]


def test_gap_report(spark):
    spoken = spark.createDataFrame([("s", "Eins zwei drei vier. Ganz andere Worte fehlen hier.", ["A", "B"])], "session_id string, text string, speakers array<string>")
    heard = spark.createDataFrame([("s", "eins zwei drei vier", ["A"])], "session_id string, text string, speakers array<string>")
    n = spark.createDataFrame([("s", 4)], "session_id string, n int")
    r = jobs.gap_report(spoken, heard, n, spark.createDataFrame([("s", 1)], "session_id string, n int")).first()
    assert (r.wer, r.dels, r.recall, r.fehlende_redner, r.luecken) == (0.556, 5, 0.25, ["B"], 1)


def test_matches_are_one_to_one(spark):
    w = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    speeches = spark.createDataFrame([("s", "k", 0, w("a", 25)), ("s", "k", 1, w("b", 25)), ("s", "k", 2, "kurz")], "session_id string, key string, idx long, text string")
    clips = spark.createDataFrame([("s", "k", 0, w("b", 30)), ("s", "k", 1, w("a", 24)), ("s", "k", 2, w("a", 500))], "session_id string, key string, clip long, text string")
    assert sorted((r.idx, r.clip) for r in quality.matched_captions(speeches, clips).collect()) == [(0, 1), (1, 0)]


def test_linked_videos_share_queues(spark):
    speeches = spark.createDataFrame([("s", 0, "otto x"), ("s", 1, "o x"), ("s", 2, "otto x"), ("s", 3, "eva z")], "session_id string, idx long, person_key string")
    clips = spark.createDataFrame([("s", 0, "otto x", "u1"), ("s", 1, "otto x", "u2")], "session_id string, ord long, person_key string, url string")
    assert sorted((r.idx, r.url) for r in quality.linked_videos(speeches, clips).collect()) == [(0, "u1"), (1, "u2")]


def test_clusters(spark):
    p = spark.createDataFrame([("p1", "Präsidentin Dr. Anna Müller", 9), ("p2", "Anna Müller", 3), ("p3", "Dr. Anna Müller", 5), ("p4", "Müller", 1), ("p5", "Präsident Müller", 1), ("p6", "Otto X", 1)], "id string, label string, deg int")
    got = resolve.clusters(p).collect()
    assert [(r.key, r.target, r.others, r.label) for r in got] == [("anna müller", "p3", ["p1", "p2"], "Dr. Anna Müller")]


def test_registry(spark):
    p = spark.createDataFrame([("a", "Julia K", None), ("b", "J. K", "SPD"), ("c", "Max M", "SPD"), ("d", "Eva M", None)], "id string, label string, fraktion string")
    r = spark.createDataFrame([("1", "Julia", "K", [21], ["SPD"]), ("2", "Max", "M", [20], ["CDU"]), ("3", "Maximilian", "M", [20], ["SPD"])], "id string, vorname string, nachname string, wp array<int>, fraktionen array<string>")
    got = {x.id: x.dip_id for x in resolve.registered(p, r).collect()}
    assert got == {"a": "1", "b": "1", "c": "3", "d": None}
    two = spark.createDataFrame([("a", "1", 2), ("b", "1", 5), ("c", "3", 1)], "id string, dip_id string, deg int")
    assert [(x.target, x.others) for x in resolve.registry_clusters(two).collect()] == [("b", ["a"])]


def test_graph_measures(spark):
    e = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("d", "e", 5), ("e", "f", 5), ("d", "f", 5), ("c", "d", 1)], "source string, target string, weight long")
    label = {r.id: r.community for r in algorithms.communities(e).collect()}
    assert label["a"] == label["b"] == label["c"] != label["d"] == label["e"] == label["f"]
    assert algorithms.modularity(e, algorithms.communities(e)).first().modularity > 0.4
    rank = {r.id: r["rank"] for r in algorithms.pagerank(e).collect()}
    assert rank["f"] > rank["d"] > rank["a"]


def test_louvain_raises_modularity(spark):
    """Two triangles and a ring of cliques, whose best communities are known; never worse than label propagation."""
    triangles = [("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("d", "e", 5), ("e", "f", 5), ("d", "f", 5), ("c", "d", 1)]
    ring = [(f"n{5 * q + i:02d}", f"n{5 * q + j:02d}", 1) for q in range(6) for j in range(5) for i in range(j)] + [(f"n{5 * q + 4:02d}", f"n{5 * ((q + 1) % 6):02d}", 1) for q in range(6)]
    for rows, want in ((triangles, [set("abc"), set("def")]), (ring, [{f"n{5 * q + i:02d}" for i in range(5)} for q in range(6)])):
        e = spark.createDataFrame(rows, "source string, target string, weight long")
        found = algorithms.louvain(e)
        groups = {}
        for r in found.collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
        assert algorithms.modularity(e, found).first().modularity >= algorithms.modularity(e, algorithms.communities(e)).first().modularity - 1e-9
    assert algorithms.louvain(spark.createDataFrame([], "source string, target string, weight long")).count() == 0


def test_evidence_by_automaton_and_by_joins(spark, monkeypatch):
    """The automaton and the joins against a plain count of keys, ties, repeated, empty and missing keys, null texts, no evidence."""
    texts = [(1, "Wege sind kaputt"), (2, "nichts"), (3, None), (4, ""), (5, "WEGEbau, x"), (6, "umwege kaputtx x"), (7, "Umwege KAPUTTX x"), (8, "Straßenbeleuchtung 🙂 y"), (9, "nichts")]
    s = spark.createDataFrame(texts, "i int, text string")
    q = F.struct(F.lit("t").alias("titel"), F.lit("").alias("stand"), F.lit("").alias("url")).alias("quelle")
    rows = [(0, ["wege", "x"], "falsch", ""), (1, ["Wege", "kaputt"], "teilweise", ""), (2, ["kaputt"], "bestätigt", ""), (3, ["x", "x", "y"], "irreführend", ""), (4, [None, "wege"], "falsch", ""), (5, None, "falsch", ""), (6, [], "falsch", ""), (7, ["straßenbeleuchtung", "🙂 y", "fehlt"], "falsch", ""), (8, ["🙂 y", "fehlt", "straßenbeleuchtung"], "bestätigt", "")]
    e = spark.createDataFrame(rows, "ev_idx int, keys array<string>, verdikt string, begruendung string").select("*", q)
    want = []
    for i, t in texts:
        best = (0.0, 0, "unbelegt")
        for j, keys, v, _ in rows:
            keys = keys or []
            share = sum(t is not None and k is not None and k.lower() in t.lower() for k in keys) / max(1, len(keys))
            if share > best[0]:
                best = (share, j, v)
        want.append((i, best[2] if best[0] >= 0.6 else "unbelegt", round(best[0], 2)))
    one = sorted(map(tuple, factcheck.check_statements(s, e, ["i"]).select("i", "verdikt", "score").collect()))
    monkeypatch.setattr(factcheck, "BROADCAST_BYTES", 100)
    two = sorted(map(tuple, factcheck.check_statements(s, e, ["i"]).select("i", "verdikt", "score").collect()))
    assert one == two == want
    spaces = e.where("ev_idx = 0").select(F.lit(9).alias("ev_idx"), F.array(F.lit(""), F.lit("wege"), F.lit("weg")).alias("keys"), "verdikt", "begruendung", "quelle")
    both = [{(r.i, r.score) for r in factcheck.check_statements(s, spaces, ["i"]).collect()}]
    monkeypatch.setattr(factcheck, "BROADCAST_BYTES", 1 << 20)
    both.append({(r.i, r.score) for r in factcheck.check_statements(s, spaces, ["i"]).collect()})
    assert both[0] == both[1] == {(i, 0.0 if t is None else 1.0 if "wege" in t.lower() else 0.33) for i, t in texts}
    none = factcheck.check_statements(s, e.limit(0), ["i"]).collect()
    assert {(r.verdikt, r.score) for r in none} == {("unbelegt", 0.0)} and factcheck.unsourced(factcheck.check_statements(s, e, ["i"])).count() == 0


def test_evidence_texts_come_to_python_in_small_batches(spark):
    name, q = "spark.sql.execution.arrow.maxRecordsPerBatch", F.struct(F.lit("t").alias("titel"), F.lit("").alias("stand"), F.lit("").alias("url")).alias("quelle")
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        e = spark.createDataFrame([(0, ["wege"], "falsch", "")], "ev_idx int, keys array<string>, verdikt string, begruendung string").select("*", q)
        got = factcheck.check_statements(spark.range(1200).select("id", F.lit("Wege").alias("text")).coalesce(1), e, ["id"])
        assert int(spark.conf.get(name)) <= 500 and got.where("verdikt = 'falsch'").count() == 1200
    finally:
        spark.conf.set(name, before)


def test_evidence_query_by_joins(spark, data, monkeypatch):
    """The whole query gives the same rows either way, in no more jobs for more evidence."""
    ask = registry.queries()["evidence_factcheck"]
    one = sorted(map(tuple, ask(spark, data).collect()))
    monkeypatch.setattr(factcheck, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, ask(spark, data).collect())) == one


def test_keys_in_texts(spark):
    """Every key of 1 to 9 letters against a plain search, over letters so few that grams repeat everywhere."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abß🙂") for _ in range(n))
    texts = [(str(i), word(rng.randint(0, 60))) for i in range(60)] + [("null", None)]
    keys = {word(rng.randint(1, 9)) for _ in range(150)}
    t = spark.createDataFrame(texts, "tid string, text string")
    k = spark.createDataFrame([(x,) for x in [*keys, "", None]], "key string")
    got = [tuple(r) for r in substrings.keys_in_texts(t, k).collect()]
    assert sorted(got) == sorted((i, x) for i, own in texts if own is not None for x in keys if x in own)
    assert substrings.keys_in_texts(t, k.where("key = ''")).count() == substrings.keys_in_texts(t.limit(0), k).count() == 0


def test_retrieval(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "id int, embedding array<float>")
    assert [(r.id, r.score) for r in retrieval.nearest(v, [1.0, 0.0], 2).collect()] == [(0, 1.0), (2, 0.707107)]
    s = spark.createDataFrame([("a", "x", None, None), ("b", "", None, None), ("c", "y", [1.0], "old"), ("d", "z", [1.0], "m")], "id string, text string, embedding array<float>, embedding_model string")
    todo = retrieval.stale(s, "m")
    assert sorted(r.id for r in todo.collect()) == ["a", "c"]
    assert retrieval.embedded(todo, lambda ts: [[float(len(t))] for t in ts], "m").count() == 2
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None)], "id int, text string")
    assert [r.id for r in retrieval.bm25(d, ["alpha"], 5).collect()] == [2, 1]


def test_word_errors_match_a_full_table():
    """Counts of one row at a time against the whole table walked back, ties to the diagonal, then to a deletion."""

    from plenaria.operators.quality import _counts

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = []  # (cost, order of precedence, counts)
                if not i and not j:
                    ways.append((0, 0, (0, 0, 0)))
                if i and j:
                    c, (s, n, d) = best[i - 1, j - 1]
                    ways.append((c + (a[i - 1] != b[j - 1]), 0, (s + (a[i - 1] != b[j - 1]), n, d)))
                if i:
                    c, (s, n, d) = best[i - 1, j]
                    ways.append((c + 1, 1, (s, n, d + 1)))
                if j:
                    c, (s, n, d) = best[i, j - 1]
                    ways.append((c + 1, 2, (s, n + 1, d)))
                c, _, counts = min(ways)
                best[i, j] = c, counts
        assert _counts(a, b) == best[len(a), len(b)][1]


def test_word_errors_keep_one_row():

    from plenaria.operators.quality import _counts

    a = [f"w{i % 501}" for i in range(20_000)]
    tracemalloc.start()
    assert _counts(a[:300], a) == (0, 19_700, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20


def test_noisy_divergences_and_samples(spark):
    from plenaria.operators import dashboards, quality, sequence

    u = spark.createDataFrame([("a", 0, "x", "es sind 150 von 200."), ("a", 1, "y", "kurz: weg damit. Ende"), ("a", 2, "z", None)], "session_id string, idx long, speaker_name string, text string")
    r = quality.noisy(u, {"150": "130"}, r"weg.*?damit\.", "kurz", ["y"]).first()
    assert (r.text, r.speakers) == ("es sind 130 von 200. kurz:  Ende", ["x"])
    e = spark.createDataFrame([("a", i, w) for i, w in enumerate([0.5, 0.01, 0.3, 0.02, 0.0])], "session_id string, idx long, wer double")
    assert [(x.idx, x.rang, x.gezeigt) for x in quality.divergences(e, 4, 2).orderBy("rang").collect()] == [(0, 1, True), (2, 2, True), (3, 3, False), (1, 4, False)]
    rows = spark.range(0, 103).selectExpr("(id * 37) % 103 AS x")
    for n in (1, 5, 10, 60, 200):
        own = list(range(103))
        step = max(1, 103 // n)
        assert sorted(r.x for r in sequence.evenly(rows, n, ["x"]).collect()) == own[::step][:n]
    assert sequence.evenly(rows.limit(0), 5, ["x"]).count() == 0
    s = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("a",)], "person string")
    assert [r.person for r in dashboards.speaker_names(s).collect()] == ["a", "b"]


def plain_counts(r, h):
    d = [[(j, 0, j) for j in range(len(h) + 1)]]
    for i in range(1, len(r) + 1):
        row = [(i, i, 0)]
        for j in range(1, len(h) + 1):
            (c, g, n), (cd, gd, nd), (cl, gl, nl) = d[i - 1][j - 1], d[i - 1][j], row[j - 1]
            c += r[i - 1] != h[j - 1]
            row.append((c, g, n) if c <= min(cd, cl) + 1 else (cd + 1, gd + 1, nd) if cd <= cl else (cl + 1, gl, nl + 1))
        d.append(row)
    c, g, n = d[-1][-1]
    return c - g - n, n, g


@pytest.mark.parametrize("band", [1, 3, 64])
def test_banded_word_errors_equal_the_whole_table(monkeypatch, band):

    monkeypatch.setattr(quality, "BAND", band)
    rng = random.Random(band)
    for _ in range(300):
        r, h = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 13))] for _ in range(2))
        assert quality._counts(r, h) == plain_counts(r, h)


def test_word_errors_of_long_texts_take_memory_by_the_band():

    rng = random.Random(2)
    ref = [str(rng.randrange(3000)) for _ in range(20_000)]
    hyp = [w for i, w in enumerate(ref) if i % 500 != 7]
    hyp[100] = "x"
    tracemalloc.start()
    got = quality._counts(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (1, 0, 40) and peak < 4e6


def test_index_equals_scan_and_leaves_ranges_out(spark, tmp_path):
    from plenaria.operators import index

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=range(300, 0, -1), k=rng.randint(1, 40)))) for i in range(900)] + [(900, None), (901, "...")]
    docs = spark.createDataFrame(rows, "id long, text string")
    index.build(docs, str(tmp_path), size=50)
    queries = spark.createDataFrame([(0, "w299 w298 w1"), (1, "w0"), (2, "nowhere"), (3, None), (4, "w290 W290 w5")], "query long, text string")
    got = index.search(spark, str(tmp_path), queries, 5).collect()
    for i, terms in ((0, ["w299", "w298", "w1"]), (1, ["w0"]), (4, ["w290", "w5"])):
        want = [(r.id, r.score) for r in retrieval.bm25(docs, terms, 5).collect()]
        assert [(r.key, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query == i] == want
    assert {r.query for r in got} == {0, 1, 4}
    _, promise = index.promised(spark, str(tmp_path), queries)
    least = {r.query: r.score for r in got if r.rank == 5}
    assert promise.where("query = 0").count() > sum(r.at_most + 1e-6 >= least[0] for r in promise.where("query = 0").collect())


def test_clips_turn_down_all_later_speeches_at_once(spark, monkeypatch):
    rng = random.Random(10)
    wants = {i: rng.sample(range(25), 20) for i in range(25)}
    wants |= {100 + i: list(range(12)) for i in range(12)}  # all of them want the same clips in the same order
    rows = [(i // 100, i, c, -n) for i, own in wants.items() for n, c in enumerate(own)]
    made, stored = [], quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: made.append(name) or stored(df, name))
    got = {r.idx: r.clip for r in quality.in_turn(spark.createDataFrame(rows, "g int, idx int, clip int, want int"), ["g"])[0].collect()}
    taken, want = set(), {}
    for i, own in sorted(wants.items()):
        left = [c for c in own if (i // 100, c) not in taken]
        if left:
            want[i] = left[0]
            taken.add((i // 100, left[0]))
    assert got == want
    pairs = [n for n in made if n == "pairs"]
    assert len(pairs) <= 13


def test_word_errors_side_by_side():
    rng = random.Random(9)
    pairs = [([str(rng.randrange(6)) for _ in range(rng.randint(0, 40))], [str(rng.randrange(6)) for _ in range(rng.randint(0, 40))]) for _ in range(400)]
    near = [str(rng.randrange(50)) for _ in range(600)]
    pairs += [(near, near[:300] + near[310:]), ([], []), (["a"], []), ([], ["a"])]
    assert quality._all_counts(pairs) == [quality._counts(*p) for p in pairs]


def test_full_text_index_moves_texts_and_blocks_once(spark, tmp_path):
    from plenaria.operators import index

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(400)], "id long, text string").repartition(4)
    index.build(docs, str(tmp_path), size=32)
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.groupBy("term", "range").count().where("count > 1").isEmpty() and blocks.select("range").distinct().count() == 13
    queries = spark.createDataFrame([(i, " ".join(rng.sample(words, 30))) for i in range(20)], "query long, text string")
    wanted, promise = index.promised(spark, str(tmp_path), queries)
    plan = index._scored(promise, wanted, blocks, 5)._jdf.queryExecution().executedPlan().toString()
    # What is exploded by queries and documents is counted and ranked where it is.
    after = plan[: plan.index("Generate explode(arrays_zip")]
    assert "Exchange" not in after


def test_vector_index(spark, tmp_path):
    from plenaria.operators import vectors

    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in middles[i % 12]]) for i in range(600)] + [(600, None), (601, [0.0] * 8), (602, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectors.build(v, str(tmp_path))
    q = v.where("id % 50 = 0")
    exact, found = vectors.search(spark, str(tmp_path), q, 5, exact=True), vectors.search(spark, str(tmp_path), q, 5)
    best = {r.query: [(x.key, x.score) for x in sorted(exact.where(f"query = {r.query}").collect(), key=lambda x: x.rank)] for r in exact.select("query").distinct().limit(3).collect()}
    for i, hits in best.items():
        assert [(r.id, r.score) for r in retrieval.nearest(v.where("id < 600"), rows[i][1], 5).collect()] == hits
    r = vectors.recall(found, exact).collect()
    assert len(r) == 12 and sum(x.hits for x in r) >= 0.9 * sum(x.wanted for x in r)
    vectors.build(v.limit(0), str(tmp_path / "none"))
    assert vectors.search(spark, str(tmp_path / "none"), q, 5).count() == 0


def test_vector_search_over_many_parts_with_ties(spark, tmp_path, monkeypatch):
    from plenaria.operators import vectors

    monkeypatch.setattr(vectors, "PART", 16)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, base[i % 60]) for i in range(300)] + [(300 + i, base[0]) for i in range(60)]  # each vector several times, one in 65 copies
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    vectors.build(v, str(tmp_path))
    held = spark.read.parquet(f"{tmp_path}/centroids").collect()
    assert max(r.parts for r in held) > 1 and sum(r.parts for r in held) >= len({r.part for r in held}) > 5
    unit = [[x / sum(y * y for y in w) ** 0.5 for x in w] for _, w in rows]
    got = vectors.search(spark, str(tmp_path), v.where("id % 50 = 0"), 7, exact=True).collect()
    for q in range(0, 360, 50):
        scores = sorted((-round(sum(a * b for a, b in zip(unit[q], w, strict=True)), 6), i) for i, w in enumerate(unit))[:7]
        assert [(-r.score, r.key) for r in sorted(got, key=lambda r: r.rank) if r.query == q] == scores
    # A query goes once to each part, so what moves grows with queries and parts, not with pairs.
    asked = vectors._asked(vectors._given(v.where("id % 50 = 0"), "id", "embedding"), vectors.np.array([r.v for r in held]), [(r.part, r.parts) for r in held], 3)
    assert asked.groupBy("key", "part").count().where("count > 1").isEmpty()


def test_components_of_chains_stars_and_loops(spark):
    from plenaria.operators import components

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(200, 200), (300, 301), (301, 300), (None, 1), (5, None)]
    links += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(110)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_merges_that_chain_end_in_one_person(spark):
    from plenaria.operators import components

    people = spark.createDataFrame([("p1", 1), ("p2", 5), ("p3", 5), ("p4", 0)], "id string, deg int")
    names = spark.createDataFrame([("p1", ["p2"])], "target string, others array<string>")
    registry = spark.createDataFrame([("p2", ["p3"]), ("gone", ["p4"])], "target string, others array<string>")
    got = {(r.old, r.new) for r in components.merged_ids([names, registry], people).collect()}
    assert got == {("p1", "p2"), ("p3", "p2"), ("gone", "p4")}


def test_matching_meets_clips_without_shared_words(spark):
    w = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    speeches = spark.createDataFrame([("s", "k", 0, w("a", 25)), ("s", "k", 1, w("a", 25)), ("s", "k", 2, w("b", 30)), ("s", "k", 3, w("c", 30))], "session_id string, key string, idx long, text string")
    clips = spark.createDataFrame([("s", "k", 0, w("b", 30)), ("s", "k", 1, w("a", 24)), ("s", "k", 2, w("z", 500))], "session_id string, key string, clip long, text string")
    assert sorted((r.idx, r.clip, r.ratio) for r in quality.matched_captions(speeches, clips).collect()) == [(0, 1, 48 / 49), (1, 0, 0.0)]


def test_rounds_read_stored_edges(spark):
    """PageRank and communities of edges with loops and doubles equal plain rounds, and join from files, not from lineage."""
    from plenaria.operators import algorithms

    e = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("d", "e", 1), ("e", "e", 4), ("a", "b", 1), ("f", "e", 1)]
    df = spark.createDataFrame(e, "source string, target string, weight int")
    names, out = sorted({x for r in e for x in r[:2]}), {}
    for a, _, w in e:
        out[a] = out.get(a, 0) + w
    rank = dict.fromkeys(names, 0.15)
    for _ in range(20):
        rank = {n: 0.15 + 0.85 * sum(rank[a] * w / out[a] for a, b, w in e if b == n) for n in names}
    got = algorithms.pagerank(df)
    assert {r.id: round(r["rank"], 9) for r in got.collect()} == {n: round(x, 9) for n, x in rank.items()}
    label = {n: n for n in names}
    for _ in range(10):
        votes = {n: {label[n]: 0.5} for n in names}
        for a, b, w in e:
            for x, y in ((a, b), (b, a)):
                votes[x][label[y]] = votes[x].get(label[y], 0) + w
        label = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    found = algorithms.communities(df)
    assert {r.id: r.community for r in found.collect()} == label
    assert all("FileScan parquet" in x._jdf.queryExecution().toString() for x in (got, found))


def test_registry_entries_that_are_alike_meet_a_person_once(spark):
    from plenaria.operators import resolve

    entries = [(i, "Anna Maria", "Klein", [20], ["SPD"]) for i in range(50)] + [(50, "Anna", "Klein", [21], ["SPD"]), (51, "Anna", "Groß", [21], ["SPD"]), (52, "Anna Eva", "Groß", [21], ["SPD"]), (53, "Anna", "Groß", [21], ["FDP"]), (54, "Bo", "Alt", None, None)]
    registry = spark.createDataFrame(entries, "id long, vorname string, nachname string, wp array<int>, fraktionen array<string>")
    persons = spark.createDataFrame([(1, "Dr. Anna Klein", "SPD"), (2, "Anna Groß", "SPD"), (3, "Anna Groß", "FDP"), (4, "Bo Alt", None), (5, "Cy Neu", "SPD")], "id long, label string, fraktion string")
    found = resolve.registered(persons, registry)
    assert {r.id: r.dip_id for r in found.collect()} == {1: 50, 2: None, 3: 53, 4: None, 5: None}
    found._jdf.queryExecution().executedPlan()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "alike" in plan and plan.count("Aggregate") == 1  # before the join, of 50 entries one row
