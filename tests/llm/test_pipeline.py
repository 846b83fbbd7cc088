import pytest
from pyspark.sql import functions as F

from latticeworks.storage import materialize

from .fixtures import documents
from .test_operators import WORD, brute_lines, brute_near, check_packed, ids_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The small tables, with awkward documents beside theirs."""
    path = tmp_path_factory.mktemp("tables")
    own = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame([(10_000 + r[0], *r[1:5]) for r in documents()], own.schema)
    own.unionByName(more).withColumn("score", F.lit("clash")).withColumn("n_lines", F.lit("clash")).repartition(3).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    outs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = outs[name] = materialize(stage(spark, now, folder), "test")
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        assert outs[name].columns == corpus_pipeline.COLUMNS

    kept = [tuple(r) for r in outs["quality classifier"].collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    kept_ids = {r[0] for r in kept}
    good, bad = ({d for d in all_ids if labels.get(d) == q} for q in (1, 0))
    assert len(good & kept_ids) >= 0.95 * len(good) and len(bad & kept_ids) <= 0.3 * len(bad)
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert all(r[1] == text[r[0]] for r in kept)

    lines = [tuple(r) for r in outs["line dedup"].collect()]
    want = dict(brute_lines(kept, 8, 5))
    assert {str(r[0]): r[1] for r in lines} == {k: v for k, v in want.items() if v.strip(" \n\r\t") or v == (text[int(k)] or "")}

    first = {r[0] for r in outs["n-gram Jaccard join"].select("doc_id").collect()}
    assert first == {int(c) for _, c, _ in brute_near(lines)}

    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 4)}
    items, now_text = [grams(t) for t in bench], {r[0]: r[1] for r in lines}
    share = {d: max((len(x & g) / len(x) for x in items if x), default=0) for d in first for g in [grams(now_text[d])]}
    clean = {r[0] for r in outs["benchmark decontamination"].select("doc_id").collect()}
    assert {d for d in first if share[d] < 0.3} <= clean and not {d for d in first if share[d] >= 0.5} & clean

    pieces = outs["packing"].collect()
    check_packed(pieces, [(d, ids_of("byte_bpe_50k.json", now_text[d], 1)) for d in clean], 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES]


def test_stages_on_an_empty_table(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, folder), "empty")
        assert now.count() == 0


def test_rows_that_share_an_id_or_have_none(spark, data, tmp_path):
    """Each stage against plain loops over rows, not ids: no row goes or stays with a namesake."""
    import collections

    from .test_operators import brute_leaks

    texts = [r[1] for r in documents(3)][:24]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").limit(3).collect()]
    rows = [(k % 7 if k % 5 else None, t, "en", f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[3][0], rows[4][1], "en", "src1", 1), (None, rows[3][1], "de", None, None), (1, f"{texts[9]} {items[0][1]}", "en", "a", 2), (1, f"{texts[14]} plain words", None, None, 3), (None, items[1][1], "en", "b", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(3 if t == "benchmark" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    bag = lambda found: collections.Counter((r[0], r[1] or "") for r in found)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    first = materialize(stages["quality classifier"](spark, now, str(tmp_path)), "odd")
    kept = [tuple(r) for r in first.collect()]
    alive = {t for _, t in bag(kept)}
    assert bag(kept) == collections.Counter({k: n for k, n in bag(rows).items() if k[1] in alive}) and len(kept) > 10
    first = spark.createDataFrame(rows, schema).repartition(2)  # all rows from here on

    lines = materialize(stages["line dedup"](spark, first, str(tmp_path)), "odd")
    got = [tuple(r) for r in lines.collect()]
    as_given = {(str(r[0]), r[1] or "") for r in rows}
    assert sorted((str(r[0]), r[1]) for r in got) == [x for x in brute_lines(rows, 8, 5) if x[1].strip(" \n\r\t") or x in as_given]

    near = materialize(stages["n-gram Jaccard join"](spark, lines, str(tmp_path)), "odd")
    numbered = [(k, r[1]) for k, r in enumerate(got)]
    classes = collections.defaultdict(list)
    for k, c, _ in brute_near(numbered):
        classes[c].append(got[int(k)])
    stay = [tuple(r) for r in near.collect()]
    assert len(stay) == len(classes) < len(got)
    least = lambda own: min((r[0] is None, r[0] or 0) for r in own)
    assert collections.Counter((r[0] is None, r[0] or 0) for r in stay) == collections.Counter(least(own) for own in classes.values())
    assert not bag(stay) - bag(got)

    clean = materialize(stages["benchmark decontamination"](spark, near, str(tmp_path)), "odd")
    gone = {int(k) for k, *_ in brute_leaks([(k, r[1]) for k, r in enumerate(stay)], items)}
    assert gone and bag(map(tuple, clean.collect())) == bag(r for k, r in enumerate(stay) if k not in gone)

    pieces = stages["packing"](spark, clean, str(tmp_path)).collect()
    check_packed(pieces, [(r.doc_id, ids_of("byte_bpe_50k.json", r.text, 1)) for r in clean.collect()], 2048)
