import re

import duckdb
import pyarrow as pa

import corpus_pipeline
from plenaria.llm import common, jaccard, mixing, toxicity, winnow
from plenaria.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, data):
    docs = table(spark, data, "documents")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out = common.staged(out, "t")
        if name == "toxicity":
            gone = docs.join(out, "doc_id", "left_anti").select(*docs.columns)
            model = toxicity.train(docs, table(spark, data, "labels"))
            assert toxicity.toxic(gone, model).where("predicted = 0").count() == 0
        if name == "ngram_jaccard_join":
            left = jaccard.jaccard_classes(out, k=5, percent=80)
            assert left.where("doc_id != component_id").count() == 0
        if name == "benchmark_decontamination":
            assert winnow.decontaminate(out, table(spark, data, "benchmark")).where("contaminated").count() == 0
        if name == "secret_scans":
            assert out.count() == docs.count()
        if name == "mixing_sources":
            assert out.count() == docs.count() and out.where("taken > 2 * size").count() == 0
        docs = out
    assert 0 < docs.count() < before


def _words(text, fold=None):
    return ((text or "").encode().lower() if fold is None else (text or "").encode().translate(fold)).split()


def brute_copies(rows):
    """doc_ids that stay: of each group of texts that links of 0.8 join, by five-word shingles, the smallest."""
    sets = []
    for r in rows:
        w = _words(r.text)
        sets.append(frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best[find(i)] = min(r.doc_id, best.get(find(i), r.doc_id))
    return {best[find(i)] if sets[i] else r.doc_id for i, r in enumerate(rows)}


def brute_clean(rows, items):
    """doc_ids of documents that hold no run of ten words of an item, nor a whole shorter one."""
    spans = set()
    for t in items:
        w = _words(t, winnow._FOLD)
        n = min(10, len(w))
        spans |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in spans}
    out = set()
    for r in rows:
        w = _words(r.text, winnow._FOLD)
        if not any(tuple(w[a : a + n]) in spans for n in sizes for a in range(len(w) - n + 1)):
            out.add(r.doc_id)
    return out


def test_stages_against_plain_versions(spark, data):
    """Each stage over what its predecessor kept, against loops over the rows, and the mix against its SQL."""
    docs = table(spark, data, "documents")
    model = toxicity.train(docs, table(spark, data, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = common.staged(stage(spark, docs, data), "t")
        got = out.collect()
        if name == "toxicity":
            scores = model.scores([(r.text or "").encode() for r in rows])
            assert {r.doc_id for r in got} == {r.doc_id for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD}
        if name == "ngram_jaccard_join":
            assert {r.doc_id for r in got} == brute_copies(rows) and len(got) == len({r.doc_id for r in got})
        if name == "benchmark_decontamination":
            assert {r.doc_id for r in got} == brute_clean(rows, [r.text for r in table(spark, data, "benchmark").collect()])
        if name == "secret_scans":
            red = {r.doc_id: r for r in got}
            for r in rows:
                plain = re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r.text or "")
                assert red[r.doc_id].text == (None if r.text is None else plain) and red[r.doc_id].n_chars == len(plain)
        if name == "mixing_sources":
            c = duckdb.connect()
            c.register("documents", pa.Table.from_pylist([r.asDict() for r in rows]))
            c.execute(f"CREATE VIEW labels AS SELECT * FROM '{data}/labels.parquet'")
            want = sorted((a, b, c_, round(d, 6), e) for a, b, c_, d, e in c.execute(mixing.ORACLE).fetchall())
            assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
        docs = out


def test_run_equals_the_stages(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, data), f"t-{name}")
    got = corpus_pipeline.run(spark, data)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_stages_on_small_cases(spark, data):
    """Nulls, empty texts, repeated rows, an empty table, and columns named like those that the stages add."""
    long = " ".join(f"word{i % 97}" for i in range(3000))
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, "some text of its own", None, "s", 20), (3, "some text of its own", None, "s", 20), (None, "no id here", "en", "t", 10), (4, long, "en", "s", len(long)), (5, long, "en", "s", len(long))]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, n_hit string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, data)
            if name != "mixing_sources":
                assert out.columns == d.columns, name
            found = out.collect()
            assert d is docs or not found, name
            kept.setdefault(name, found)
    assert all(r.score == 7 and r.n_hit == "x" for name in kept if name != "mixing_sources" for r in kept[name])
    ids = sorted(str(r.doc_id) for r in kept["ngram_jaccard_join"])
    assert ids == ["1", "2", "3", "4", "None"]
    assert len(kept["benchmark_decontamination"]) == len(kept["secret_scans"]) == len(kept["mixing_sources"]) == len(rows)
