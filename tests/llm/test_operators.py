import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import quality
from latticeworks.llm.chat import escape, format_chats, read_chats, unescape
from latticeworks.llm.decontaminate import leaks
from latticeworks.llm.lines import drop_boilerplate
from latticeworks.llm.near import banding, near_duplicates
from latticeworks.llm.packing import cut, pack
from latticeworks.llm.queries import RULES
from latticeworks.llm.rans import Coder, quantize, read_ids, write_ids
from latticeworks.llm.repeats import remove_repeats
from latticeworks.llm.search import search
from latticeworks.llm.tokens import encoder, local_path
from latticeworks.llm.urls import judge
from latticeworks.storage import new_path

from .fixtures import SCHEMA, documents, odd_rows, sentence

WORD = re.compile("[0-9A-Za-z_\u0080-\U0010ffff]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(file, text, end):
    return np.array([*encoder(local_path(file)).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_tokenizers(rows, file):
    e = encoder(local_path(file))
    more = ["", " ", "a  b", "x \n y", "it's 's 'd", "hé ĺo ́x", "a b\x85c \x1c d", "q\u00a0r s\u2003 t", "\n\nA\n b.c, d., E,", "Word, word. WORD. Ⅷ ½ ǅ", "İstanbul İ. ß"]
    for t in [r[1] or "" for r in rows] + more:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


# 1


def check_packed(got, want, capacity):
    """want: multiset of (doc_id, ids)."""
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    found = collections.Counter()
    for (doc, n), pieces in by_doc.items():
        copies = sum(1 for d, ids in want if d == doc and len(ids) == n)
        pieces.sort(key=lambda r: r.start)
        for d, ids in {(d, tuple(i)) for d, i in want if d == doc and len(i) == n}:
            own = [r for r in pieces if zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert sum(r.length for r in own) >= n
        assert sum(r.length for r in pieces) == n * copies
        found[doc] += copies
    assert found == collections.Counter(d for d, _ in want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_cut_sizes():
    for n in range(1, 6000, 7):
        assert sum(cut(n, 2048, 16)) == n and all(0 < x <= 2048 for x in cut(n, 2048, 16))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, docs, odd, empty, rows, capacity):
    got = pack(docs, "byte_bpe_50k.json", capacity=capacity).collect()
    want = [(r[0], ids_of("byte_bpe_50k.json", r[1], 1)) for r in rows]
    sequences = check_packed(got, want, capacity)
    if capacity == 64:
        assert sum(len(i) for _, i in want) / (len(sequences) * capacity) > 0.97
    check_packed(pack(odd, "byte_bpe_50k.json", capacity=capacity).collect(), [(r[0], ids_of("byte_bpe_50k.json", r[1], 1)) for r in odd_rows()], capacity)
    assert pack(empty, "byte_bpe_50k.json").count() == 0
    kept = pack(docs, "byte_bpe_50k.json", capacity=capacity, keep_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in kept)


# 2


def brute_lines(rows, percent, least):
    pages = collections.Counter(r[3] for r in rows)
    seen = collections.Counter((r[3], x) for r in rows for x in {y.strip(" ") for y in (r[1] or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n * 100 >= pages[k[0]] * percent}
    return sorted((str(r[0]), "\n".join(x for x in (r[1] or "").split("\n") if (r[3], x.strip(" ")) not in bad)) for r in rows)


def test_line_dedup(spark, docs, odd, empty, rows):
    got = drop_boilerplate(docs, percent=10, min_pages=3)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == brute_lines(rows, 10, 3)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and got.where("n_dropped > 0").count() >= 10
    assert sorted((str(r.doc_id), r.text) for r in drop_boilerplate(odd, percent=50, min_pages=2).collect()) == brute_lines(odd_rows(), 50, 2)
    assert drop_boilerplate(empty).count() == 0


# 3


def brute_repeats(rows, length):
    last = 1 << 63
    own = sorted(((r[0] if r[0] is not None else last, (r[1] or "").encode(), r[0]) for r in rows), key=lambda x: x[0])
    first = {}
    for d, b, _ in own:
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, b, name in own:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((str(name), len(b), sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark, docs, odd, empty, rows):
    for table, source in ((docs, rows), (odd, odd_rows())):
        got = remove_repeats(table, keep_text=True, bytes_a_place=1 << 12).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(source, 50)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert remove_repeats(empty).count() == 0


def test_repeats_of_frequent_anchors(spark, rows, monkeypatch):
    """Anchors taken apart into single strings give the same bytes."""
    from latticeworks.llm import repeats

    plan = repeats._plan
    monkeypatch.setattr(repeats, "_plan", lambda *a: (*plan(*a)[:3], 1))
    df = spark.createDataFrame(rows[:30], SCHEMA)
    got = remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows[:30], 50)


def test_interval_tree_groups_are_maximal_repeats():
    """Groups in one bucket against brute force: every window of a frame goes to the least document that has it."""
    import random

    from latticeworks.llm.repeats import Frames, GRAM, repeats_in

    rng = random.Random(3)
    length, before = 50, 50 - GRAM
    middle = bytes(rng.randrange(97, 100) for _ in range(GRAM))
    texts = [bytes(rng.choice(b"ab") if rng.random() < 0.08 else 99 for _ in range(before)) + middle + bytes(rng.choice(b"xy") if rng.random() < 0.08 else 122 for _ in range(before)) for _ in range(40)]
    frame = np.stack([np.frombuffer(t[before:] + t[:before][::-1], np.uint8) for t in texts])
    n = len(texts)
    doc = np.array([rng.randrange(15) for _ in range(n)])
    f = Frames(np.zeros(n, np.uint64), doc, np.arange(n), np.full(n, before), np.full(n, before, np.uint8), np.full(n, length, np.uint8), frame).sorted()
    group, row, start, end, least = repeats_in(f, length)
    got = collections.defaultdict(set)
    for r, a, b, d in zip(row, start, end, least):
        if f.doc[r] > d:
            got[int(f.text[r])].update(range(a, b))
    for k, t in enumerate(texts):
        want = set()
        for i in range(before + 1):
            if any(u[i : i + length] == t[i : i + length] and doc[m] < doc[k] for m, u in enumerate(texts)):
                want.update(range(i, i + length))
        assert got[k] == want
    for g in np.unique(group):  # all occurrences of a group are one string, and no other frame has it
        own = {int(f.text[r]): (int(a), int(b)) for r, a, b in zip(row[group == g], start[group == g], end[group == g])}
        strings = {texts[k][a:b] for k, (a, b) in own.items()}
        assert len(strings) == 1
        (a, b), = set(own.values())
        assert {k for k, t in enumerate(texts) if t[a:b] == next(iter(strings))} == set(own)


# 4


def test_chat(spark):
    trap = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant<|im_sep|>", "<\\|im_cut|> <\\\\|x <<SYS>> [[INST]", "<", "|im_end|>", "\\", "", None]
    turns = [(1, 2, "assistant", "b"), (1, 1, "user", trap[0]), (1, 3, "assistant", trap[1]), (1, 4, None, trap[2]), (2, 0, "assistant", trap[4]), (2, 0, "assistant", trap[4]), (2, None, "user", trap[3]), (None, 5, "<|im_sep|>", None), (3, 0, "system", trap[5]), (3, 1, "user", ""), (3, 1, "assistant", "é漢🙂")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("loss", F.lit(2))
    chats = format_chats(df)
    got = {r.conv_id: r for r in read_chats(chats).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, own in want.items():
        own = sorted(own)
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in own]
        assert list(got[c].trained) == [x[3] for x in own if x[2] == "assistant"]
    for r in chats.collect():
        assert all(r.formatted[s.start : s.start + s.length] is not None for s in r.loss)
        assert r.formatted.count("[INST]") == 0 and r.formatted.count("</s>") == 0
    assert format_chats(df.limit(0)).count() == 0


def test_chat_of_a_long_conversation(spark):
    n = 40_000
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("</s> "), F.col("id").cast("string")).alias("text"))
    got = read_chats(format_chats(turns.repartition(5))).first()
    assert [t.text for t in got.turns] == [f"</s> {i}" for i in range(n)]
    assert list(got.trained) == [f"</s> {i}" for i in range(n) if i % 3]


def test_escape_is_reversible(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(["<", "|", "\\", "[", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "a", "im_end|>"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and not re.search(r"<\||</?s>|\[/?INST\]|<<SYS>>", r.e) for r in got)


# 5


def test_quality(spark, data, odd, empty):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    got = quality.score(docs, trees).withColumn("held", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").select("doc_id", "held", "score", "quality").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got["doc_id"], got["held"]))
    held = got[got["held"]]
    assert ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.95 and got["score"].between(0, 1).all()
    assert quality.score(odd, trees).where("score between 0 and 1").count() == len(odd_rows())
    assert quality.score(empty, trees).count() == 0
    one = quality.score(docs.limit(3), quality.train(docs, labels.where("quality = 1")))  # a sample of one class
    assert one.where("score > 0.9").count() == 3
    assert quality.score(docs.limit(3), quality.train(empty, labels)).count() == 3


# 6


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.search("[/?#]", rest)
        host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest)[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name)) if fits else None
    return host, path, best and best.name, best and best.verdict


def test_urls(spark, data):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.COM/en/7?x", "x://example.com/en/8", "ftp://com/en/", "a://b://com/en/x", "http://com?en/", "http://xcom/en/", "http://m.example.net/de/8", "http://q.net/de/8#f", "https://É.org/es/é\nline", "http://org/es", "http://org/es/"]
    real = [r.url for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls + real + urls)] + [(None, "http://com/en/", "", "")], "page_id long, url string, host string, rule string")
    got = judge(df, RULES).collect()
    assert len(got) == 2 * len(urls) + len(real) + 1
    for r in got:
        host, path, rule, verdict = brute_rule((urls + real + urls)[r.page_id] if r.page_id is not None else "http://com/en/")
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("block", "allow") and (verdict is None or r.verdict == verdict)
    assert judge(df.limit(0), RULES).count() == 0
    labelled = spark.createDataFrame([(f"http://good{k}.org/a", "allow") for k in range(30)] + [(f"http://bad.org/{k}{k}{k}/1/2/3/4?a=1&b=2&c={k}", "block") for k in range(30)], "url string, verdict string")
    ask = spark.createDataFrame([(0, "http://good99.org/b"), (1, "http://bad.org/777/1/2/3/9?a=5&b=6&c=7")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge(ask, [], labelled).collect()} == {0: "allow", 1: "block"}


# 7


def brute_near(rows):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else {r[1] or ""} if r[1] else set()))
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (rows[a][1] or "") == (rows[b][1] or "") or both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = collections.defaultdict(list)
    for k in range(n):
        classes[find(k)].append(k)
    least = {k: min((rows[m][0] for m in own if rows[m][0] is not None), default=None) for k, own in classes.items()}
    return sorted((str(rows[k][0]), str(least[find(k)]), links[k]) for k in range(n))


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, docs, odd, empty, rows, block):
    got = near_duplicates(docs, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_near(rows)
    assert sum(r.n_links > 0 for r in got) > 5
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near_duplicates(odd, block=block).collect()) == brute_near(odd_rows())
    if block > 2:
        assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    import random

    rng = random.Random(9)
    base = sentence(rng, 200).split(" ")
    rows = []
    for k in range(80):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(200)] = f"other{k}"
        rows.append((k, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_near(rows)


def test_banding_reaches_its_recall():
    bands, rows = banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 256


# 8


def test_leaks(spark, data, docs, odd, empty, rows):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    planted = [(9000 + i, (rows[i % 30][1] or "") + " " + t + "\n" + (rows[47][1] if i % 2 else "")) for i, t in items.items()]
    table = spark.createDataFrame(source + planted, "doc_id long, text string").withColumn("item_id", F.lit(0))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 4)}
    own = {i: grams(t) for i, t in items.items()}
    want = {(d, i) for d, t in source + planted for g in [grams(t)] for i, x in own.items() if len(x & g) >= 0.5 * len(x)}
    got = {(r.doc_id, r.item_id) for r in leaks(table, bench).collect()}
    assert want <= got and {(9000 + i, i) for i in items} <= got
    assert all(len(own[i] & grams(dict(source + planted)[d])) >= 0.3 * len(own[i]) for d, i in got)
    assert {(r.doc_id, r.item_id) for r in leaks(table, bench, shard=7, shards=2).collect()} >= {(9000 + i, i) for i in items}
    for a, b in ((docs, bench), (odd, bench), (empty, bench), (table, bench.limit(0)), (table, spark.createDataFrame([(None, None), (5, ""), (6, "!!")], "item_id long, text string"))):
        assert leaks(a, b).count() >= 0
    assert leaks(empty, bench).count() == leaks(table, bench.limit(0)).count() == 0


def test_leaks_of_a_part(spark):
    """A whole question or a whole answer gives an item away however little of the item it is, and a few words don't."""
    said = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    parts = {1: (said("qa", 9), said("aa", 60)), 2: (said("qb", 60), said("ab", 9)), 3: (said("qc", 40), said("ac", 5)), 4: (said("qd", 100), said("ad", 8))}
    bench = spark.createDataFrame([(i, f"{q}. {a}.") for i, (q, a) in parts.items()], "item_id long, text string")
    around = [said("x", 300), said("y", 90)]
    texts = {10 * i + p: f"{around[0]} {part} {around[1]}" for i, own in parts.items() for p, part in enumerate(own, 1)} | {99: " ".join(around), 98: f"{around[0]} {said('aa', 7)}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(docs, bench).collect()}
    assert set(got) == {(11, 1), (12, 1), (21, 2), (22, 2), (31, 3), (41, 4), (42, 4)}
    assert got[11, 1].question_overlap == got[22, 2].answer_overlap == got[42, 4].answer_overlap == 1.0
    assert got[11, 1].score < 0.5 and got[11, 1].overlap < 0.3 and got[42, 4].score < 0.5


# 9


def brute_search(rows, asked, k):
    own = [(r[0], collections.Counter(WORD.findall((r[1] or "").lower()))) for r in rows if r[0] is not None]
    n, mean = len(own), sum(sum(c.values()) for _, c in own) / len(own)
    df = collections.Counter(w for _, c in own for w in c)
    out = []
    for q, c in own:
        if q not in asked:
            continue
        scores = []
        for d, x in own:
            size = sum(x.values())
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in c if w in x)
            if s > 0:
                scores.append((-round(s, 6), d))
        out += [(q, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 16])
def test_search(spark, docs, odd, empty, rows, shard, monkeypatch):
    from latticeworks.llm import search as module

    monkeypatch.setattr(module, "build_index", lambda d, near, make=module.build_index: make(d, near, shard_docs=shard))
    asked = docs.where("doc_id % 5 = 0 or doc_id between 40 and 49")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in search(docs, asked, k=4, near="source", block=6).collect())
    want = brute_search(rows, {r[0] for r in rows if r[0] % 5 == 0 or 40 <= r[0] <= 49}, 4)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, want))
    assert search(odd, odd, k=3).count() > 0
    assert search(empty, docs).count() == search(docs, empty).count() == search(empty, empty).count() == 0


# 10


@pytest.mark.parametrize("weight", [5e-7, 5e-10])
def test_search_of_words_in_all_documents(spark, monkeypatch, weight):
    """Words that all of a million or a billion documents have weigh next to nothing, and still find them."""
    monkeypatch.setattr("latticeworks.llm.search.idf", lambda df, n: np.full(len(df), weight))
    texts = [(k, "every page has these words") for k in range(14)] + [(20, "none of that"), (21, "every"), (22, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "every page has these words"), (2, "has"), (3, "absent"), (4, "that")], "doc_id long, text string")
    found = collections.defaultdict(set)
    for r in search(docs, asked, k=30).collect():
        found[r.query_id].add(r.doc_id)
    assert found == {1: {*range(14), 21}, 2: set(range(14)), 4: {20}}
    assert sorted(r.doc_id for r in search(docs, asked, k=5).where("query_id = 2").collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 299).astype(np.int64)
    coder = Coder(quantize(np.bincount(ids, minlength=300), 14), 14)
    data = coder.encode(ids, lanes=64, every=16)
    assert (coder.decode(data) == ids).all()
    points = -(-max(n, 1) // (64 * 16)) if n >= 64 else 1
    for k in range(points):
        assert (coder.decode(data, k, 1) == ids[k * 1024 : (k + 1) * 1024]).all()
    if n > 1000:
        assert len(data) < 2 * n
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(bytes(broken))


def test_quantize():
    for counts in ([0, 0], [1], [1, 0, 10**12], list(range(500))):
        f = quantize(np.array(counts), 12)
        assert f.sum() == 4096 and all((x > 0) == (c > 0) for x, c in zip(f, counts)) or not any(counts)


@pytest.mark.parametrize("block", [1 << 19, 50])
def test_token_store(spark, docs, odd, empty, rows, block):
    for table, source in ((docs, rows), (odd, odd_rows()), (empty, [])):
        path = new_path(spark, "store")
        write_ids(table, path, "word_bpe_49k.json", end_id=2, block_ids=block)
        got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
        want = [(r[0], ids_of("word_bpe_49k.json", r[1], 2)) for r in source]
        assert [r.doc_id is not None and r.doc_id for r in got] == sorted((r.doc_id is not None and r.doc_id for r in got), key=lambda d: (d is not False, d))
        assert sorted((str(r.doc_id), r.ids.hex()) for r in got) == sorted((str(d), i.tobytes().hex()) for d, i in want)
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
            at += r.n_tokens


def brute_leaks(rows, items, threshold=0.5, overlap=0.3, size=5, part_words=8, part_overlap=0.5):
    """Every passage against every item, in plain loops."""
    from latticeworks.llm.decontaminate import chunk_of, split

    said = lambda t: WORD.findall((t or "").lower())
    own = [(i, [said(x) for x in (t or "", *split(t or ""))]) for i, t in items if said(t)]
    df = collections.Counter(w for _, p in own for w in set(p[0]))
    n, mean = len(own), sum(len(p[0]) for _, p in own) / max(len(own), 1)

    def impacts(words):
        tf = collections.Counter(words)
        raw = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w, c in tf.items()}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    def share(words, passage):
        k = min(size, len(words))
        g, p = ({tuple(x[a : a + k]) for a in range(len(x) - k + 1)} for x in (words, passage))
        return len(g & p) / len(g) if k else 0.0

    out = []
    for d, text in rows:
        w = said(text)
        for i, parts in own:
            best = None
            for k, part in enumerate(parts):
                if k and not part_words <= len(part) < len(parts[0]):
                    continue
                c, weight = chunk_of(len(part)), impacts(part)
                for a in range(0, max(len(w) - c, 1), c):
                    passage = w[a : a + 2 * c]
                    if sum(weight.get(x, 0) for x in set(passage)) < threshold - 1e-9:
                        continue
                    shares = [share(x, passage) for x in parts]
                    if shares[k] >= (part_overlap if k else overlap):
                        whole = impacts(parts[0])
                        values = [sum(whole.get(x, 0) for x in set(passage)), *shares]
                        best = list(map(max, best or values, values))
            if best:
                out.append((str(d), str(i), *(round(x, 6) for x in best)))
    return sorted(out)


def test_leaks_are_those_of_brute_force(spark, data, odd, rows):
    """Equal rows, scores and overlaps, for shards of 1, 4 and 512 items, and passes of several."""
    import random

    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").limit(24).collect()]
    items += [(100, " ".join(sentence(rng, 9) for _ in range(22))), (101, "One two. Three"), (102, None), (103, "!!"), (items[0][0], items[0][1]), (None, sentence(rng, 12) + " " + sentence(rng, 30))]
    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    source += [(r[0], r[1]) for r in rows[38:50]] + [(r[0], r[1]) for r in odd_rows()]
    for i, (_, t) in enumerate(items):
        w = (t or "").split(" ")
        keep = [x for x in w if rng.random() < 0.95]
        source += [(500 + i, (rows[i][1] or "") + " " + (t or "")), (600 + i, " ".join(w[: len(w) // 2])), (700 + i, (rows[i][1] or "") + " " + " ".join(keep) + "\n" + (rows[47][1] if i % 3 == 0 else ""))]
    table = spark.createDataFrame(source, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_leaks(source, items)
    assert len(want) > 40 and any(x[2] < 0.5 for x in want)
    for shard, shards, block in ((512, 16, 4), (4, 2, 1), (1, 3, 4)):
        got = sorted((str(r.doc_id), str(r.item_id), *(round(x, 6) for x in r[2:])) for r in leaks(table, bench, shard=shard, shards=shards, block=block).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a - b) < 2e-6 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


def test_clean_judges_rows_by_themselves(spark, data):
    from latticeworks.llm.decontaminate import clean

    items = spark.read.parquet(f"{data}/benchmark.parquet")
    text = items.first().text
    rows = [(1, f"and {text}", "a"), (1, "another page", "b"), (None, text, "c"), (None, "fine", "d"), (2, None, "e"), (2, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lower string")
    assert sorted(r["lower"] for r in clean(docs, items).collect()) == ["b", "d", "e", "f"]
    assert clean(docs, items).columns == docs.columns and clean(docs, items, shard=3, shards=2).count() == 4
    assert clean(docs.limit(0), items).count() == 0 and clean(docs, items.limit(0)).count() == 6


def test_first_of_each_class(spark, rows):
    """A row of each class stays, whatever ids repeat or are missing."""
    from latticeworks.llm.near import first_of_each

    t, other = rows[8][1], rows[9][1]
    odd = [(1, t, "a"), (1, other, "b"), (0, t, "c"), (None, other, "d"), (None, rows[10][1], "e"), (None, rows[10][1], "f"), (5, None, "g"), (5, "", "h"), (5, "", "h"), (7, rows[12][1], "i"), (None, rows[15][1], "j"), (None, rows[16][1], "k")]
    got = first_of_each(spark.createDataFrame(odd, "doc_id long, text string, of string"))
    assert sorted(r["of"] for r in got.collect()) == ["b", "c", "e", "g", "i", "j", "k"] and got.columns == ["doc_id", "text", "of"]
    assert first_of_each(spark.createDataFrame(odd, "doc_id long, text string, of string").limit(0)).count() == 0


def test_search_skips_blocks_and_counts_null_ids(spark):
    """Blocks whose bound is under a query's bar stay closed; rows without an id count in the statistics and aren't returned."""
    import pyarrow as pa

    from latticeworks.llm import search as module

    rng = np.random.default_rng(5)
    own = [" ".join(f"{'a' if k < 500 else 'b'}{x}" for x in np.minimum(rng.zipf(1.2, 40 if k < 500 else 9), 3000)) + " a1" for k in range(1500)]  # another topic has short texts
    own[7] = own[300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(own), pa.array([0] * len(own), pa.int32())], names=["doc_id", "text", "near"])
    shards = list(module._index(8192, 1 << 30)(iter([batch])))
    (asked,) = module._query_terms(iter([batch.slice(0, 40)]))
    queries = module.Queries.of([(i, bytes(t)) for i, t in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist())])
    count = np.zeros(len(queries.terms))
    for df in module._frequencies(queries.terms)(iter(shards)):
        count[df["term"].to_numpy()] = df["df"].to_numpy()
    queries.weight = module.idf(count, len(own))
    mean = shards[0]["words"][0].as_py() / len(own)

    def found(home):
        counts = [0, 0]
        out = {}
        for rows in module._searched(queries, mean, 2, home, lambda a, b: counts.__setitem__(slice(None), [counts[0] + a, counts[1] + b]))(iter(shards)):
            for q, d, s in zip(*(rows[c].to_pylist() for c in ("query_id", "doc_id", "score"))):
                out.setdefault(q, []).append((-s, d))
        return {q: sorted(x) for q, x in out.items()}, counts

    first, _ = found(True)
    for k, q in enumerate(queries.ids.tolist()):
        queries.bar[k] = -first[q][1][0]
    again, (opened, blocks) = found(False)
    assert again == first and again[7][0][0] == again[7][1][0] and {again[7][0][1], again[7][1][1]} == {7, 300}
    assert opened < 0.7 * blocks
    rows = [(k if k % 5 else None, t) for k, t in enumerate(own[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in search(docs, docs.where("doc_id % 4 = 1"), k=3).collect())
    numbered = [(k if k % 5 else 1000 + k, t) for k, t in enumerate(own[:60])]
    want = [x for x in brute_search(numbered, {r[0] for r in rows if r[0] is not None and r[0] % 4 == 1}, 60) if x[2] < 1000]
    ranked = collections.Counter()
    top = [(q, ranked[q], d, round(s, 5)) for q, _, d, s in want if not ranked.update([q]) and ranked[q] <= 3]
    assert [x[:3] for x in got] == [x[:3] for x in top] and all(abs(a[3] - b[3]) < 2e-5 for a, b in zip(got, top))


def test_search_leaves_groups_closed_whose_parts_are_under_the_bar():
    """A group whose words meet a query's only here and there adds up to more than the bar as a whole, and in none of its parts."""
    import pyarrow as pa

    from latticeworks.llm import search as module

    rng = np.random.default_rng(3)
    own = [" ".join(f"a{x}" for x in rng.permutation(64)[:48]) for _ in range(640)]
    own += [" ".join([f"b{x}" for x in rng.permutation(200)[:60]] + [f"a{4 * (k // 64) + x}" for x in range(4)]) for k in range(1024)]
    near = [0] * 640 + [1] * 1024
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int64()), pa.array(own), pa.array(near, pa.int32())], names=["doc_id", "text", "near"])
    shards = list(module._index(8192, 1 << 30)(iter([batch])))
    (asked,) = module._query_terms(iter([batch.slice(0, 20)]))
    queries = module.Queries.of([(i, bytes(t)) for i, t in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist())])
    count = np.zeros(len(queries.terms))
    for df in module._frequencies(queries.terms)(iter(shards)):
        count[df["term"].to_numpy()] = df["df"].to_numpy()
    queries.weight = module.idf(count, len(own))
    mean = shards[0]["words"][0].as_py() / len(own)
    want = brute_search(list(enumerate(own)), set(range(20)), 5)
    for q, rank, _, score in want:
        if rank == 5:
            queries.bar[queries.ids == q] = score - 1e-6
    seen = []
    got = [r for rows in module._searched(queries, mean, 5, False, lambda a, b: seen.append((a, b)))(iter(shards)) for r in rows.to_pylist()]
    best = sorted((r["query_id"], -round(r["score"], 6), r["doc_id"]) for r in got)
    assert [(q, d) for q, _, d in best] == [(q, d) for q, _, d, _ in want]
    assert sum(b for _, b in seen) == 20 * 640 // module.BLOCK  # the other group's blocks aren't even looked at


def test_search_takes_no_bar_from_rows_without_an_id(spark):
    """Rows without an id can't be returned, and so don't keep out those that can."""
    rows = [(4, "a b c d")] + [(None, "a b c d")] * 12 + [(10 + k, f"a b x{k} y{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = search(docs, docs.where("doc_id = 4"), k=3).orderBy("rank").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(1, 4), (2, 10), (3, 11)]


def test_line_dedup_with_clashing_names(spark):
    rows = [(k, f"line {k}\nSame line", "a", "x", "y", "z", "w") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __host string, __keys string, __LINES string, __kept string")
    got = drop_boilerplate(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"line {k}", "a", "x", "y", "z", "w", 2, 1) for k in range(9)]


def test_url_trees_on_hosts_they_havent_seen(spark):
    """Held-out accuracy by host, features of a url against plain ones, and shares of suffixes without a row's own label."""
    import pyarrow as pa

    from latticeworks.llm import urls as module

    rows = [(f"http://h{k}.org/a/{'x' * (k % 5)}", "allow") for k in range(150)] + [(f"http://h{k}.org/{k}{k}{k}/1/2/3/4?a=1&b={k}", "block") for k in range(150, 300)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    right, most = module.held_out(labelled)
    assert right > 0.95 and most == 0.5
    (view,) = pa.Table.from_pandas(module._view(spark.createDataFrame([("http://A.b-c.org/x1/y.HTM?q=1&r=2#z", "")], "url string, verdict string")).toPandas()).to_batches()
    got = module.features(view, {"kind": {"HTM": (0.25, 0.5)}})[0]
    plain = []
    for name, t in (("url", "http://A.b-c.org/x1/y.HTM?q=1&r=2#z"), ("host", "a.b-c.org"), ("path", "/x1/y.HTM")):
        n, digits = len(t), sum(c.isdigit() for c in t)
        entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(t).values())
        plain += [n, digits, digits / n, entropy, t.count("-") + t.count("_"), t.count("."), t.count("/"), t.count("%")]
        plain += [t.count(c) for c in "?&=#"] if name == "url" else []
    assert np.allclose(got, [*plain, 0.25, 0.5])
    assert module.held_out(labelled.limit(0)) == (0.0, 0.0)


def test_trees_and_statistics_against_plain_ones(spark, rows):
    """Traversal of flat arrays against a walk, node by node; statistics of a text against plain counts."""
    import pyarrow as pa

    from latticeworks.llm._common import utf8
    from latticeworks.llm.gbt import fit

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    trees = fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float))
    depth = int(np.log2(trees.value.shape[1]))

    def walked(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - (2**depth - 1)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.score(x), [walked(r) for r in x])
    texts = [r[1] or "" for r in rows]
    got = quality.statistics(*utf8(pa.array(texts)))
    for t, values in zip(texts, got):
        raw, w = t.encode(), WORD.findall(t.lower())
        n, many = max(len(raw), 1), max(len(w), 1)
        plain = [sum(raw.count(c.encode()) for c in g) / n for g in quality.GROUPS] + [sum(b >= 128 for b in raw) / n]
        share = [c / n for c in collections.Counter(raw).values()]
        size = [len(x.encode()) for x in WORD.findall(t)]
        mean = sum(size) / many
        own = [x.encode() for x in WORD.findall(t)]
        lines = sum(1 for k in range(len(raw)) if not k or raw[k - 1] == 10)
        upper = lambda b: 65 <= b <= 90
        plain += [math.log1p(len(raw)), math.log1p(len(w)), -sum(p * math.log2(p) for p in share), mean, math.sqrt(max(sum(s * s for s in size) / many - mean**2, 0)), sum(s <= 3 for s in size) / many, sum(s >= 12 for s in size) / many]
        plain += [sum(upper(o[0]) for o in own) / many, sum(len(o) > 1 and upper(o[1]) for o in own) / many, sum(a == b for a, b in zip(w, w[1:])) / many, len(set(w)) / many, math.log1p(lines), len(raw) / max(lines, 1)]
        assert np.allclose(values, plain, atol=1e-9), t[:60]
