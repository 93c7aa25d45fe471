"""Line dedup, decontamination, near-duplicates, mixing and sharding: SQL, brute force and odd inputs."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, components, decontaminate, embeddings, linedup, mixing, registry, sharding, simhash

from ..compare import DATA, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, ddl):
    df = spark.createDataFrame(rows, ddl)
    return df, df.toArrow()


# line dedup


def test_lines_relative_to_their_site(spark):
    rows = [(i, f"https://Site.example/{i}", f"<p>shared line</p><p>own {i}</p>") for i in range(20)]
    rows += [(100 + i, f"http://u:p@other.example:80/{i}", "<p>shared line</p>" if i == 0 else f"<p>text {i}</p>") for i in range(20)]
    rows += [(200, None, None), (201, None, ""), (201, None, ""), (202, "no host", "<div>x<br>x<br>y</div>")]
    df, table = frame(spark, rows, "page_id long, url string, html string")
    pages = df.withColumn("text", F.lit("clash")).select("page_id", linedup.host(F.col("url")).alias("host"), linedup.page_lines(F.col("html")).alias("lines"), "text")
    got = {r["page_id"]: r for r in linedup.drop_boilerplate(pages).collect()}
    assert all(got[i]["text"] == f"own {i}" and got[i]["n_dropped"] == 1 for i in range(20))
    assert got[100]["text"] == "shared line" and got[100]["host"] == "other.example"
    assert got[200]["text"] == "" and got[202]["text"] == "x\nx\ny"
    same(linedup.drop_boilerplate(pages), linedup.OP3_SQL, pages=table)
    assert linedup.drop_boilerplate(pages.limit(0)).count() == 0


# decontamination


def brute_contamination(docs, items, width=13, slack=3):
    out = []
    items = [(i, decontaminate.words(t.encode())) for i, t in items if t is not None]
    for d, t in docs:
        w = decontaminate.words(t.encode() if t is not None else None)
        hit, found, near = set(), set(), set()
        for i, x in items:
            size = min(width, len(x))
            grams = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if x else set()
            for k in range(len(w) - size + 1 if x else 0):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found |= {str(i)} - {"None"}
            for g in grams:
                for b in range(-slack, len(w) + slack):
                    if all(v in w[max(b + k - slack, 0) : max(b + k + slack + 1, 0)] for k, v in enumerate(g)):
                        near |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), sorted(found), sorted(near), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_bytes, segment", [(8 << 20, 1 << 18), (60, 50)])
def test_contamination_is_that_of_brute_force(spark, monkeypatch, pass_bytes, segment):
    r = random.Random(3)
    vocab = ["a", "b", "c", "d", "é", "F", "7"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 13, 14, 20])))) for i in range(30)] + [(99, None), (None, "a b"), (100, ""), (101, "!!!")]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 2, 15, 60])))) for i in range(40)]
    docs += [(500 + i, "x y z " + items[i][1].upper() + ",q!" + items[i + 1][1]) for i in range(20)] + [(700, None), (None, "a"), (500, "x"), (500, "x")]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontaminate, "SEGMENT_TOKENS", segment)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    found = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"]), list(x["near_items"]), x["contaminated"]) for x in found.collect()), key=repr)
    assert got == brute_contamination(docs, items)


def test_contamination_of_empty_tables_and_proximity(spark):
    words_ = [f"w{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(words_)), (2, " ".join([*words_[:6], "extra", *words_[6:]])), (3, " ".join(reversed(words_)))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words_))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert list(got[1]["items"]) == ["7"] and got[1]["contaminated"] and not got[2]["items"] and not got[2]["contaminated"]
    assert list(got[1]["near_items"]) == list(got[2]["near_items"]) == ["7"] and not got[3]["near_items"]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("pass_bytes", [8 << 20, 40])
def test_near_passages_are_those_of_brute_force(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randint(0, 30)}" for _ in range(r.choice([2, 5, 13, 16])))) for i in range(12)]
    docs = []
    for i in range(150):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(w) + 1)
            w = r.choice([[*w[:k], "new", *w[k:]], [*w[:k], *w[k + 1 :]] or w, [*w[:k], *reversed(w[k : k + 3]), *w[k + 3 :]]])
        docs.append((i, " ".join(["x"] * r.randint(0, 4) + w)))
        # the next document goes on where this one is cut
        docs.append((1000 + i, " ".join(w[: len(w) // 2])))
        docs.append((2000 + i, " ".join(w[len(w) // 2 :])))
    docs.append((5000, "y " * 300_000 + items[0][1]))
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"]), list(x["near_items"]), x["contaminated"]) for x in found), key=repr)
    expected = brute_contamination(docs[:-1], items)
    assert [x for x in got if x[0] != 5000] == expected and any(x[4] != x[3] for x in expected)
    (long,) = (x for x in got if x[0] == 5000)
    assert long[2] == len(items[0][1].split()) and "0" in long[3]


# near-duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_anchors_cover():
    r = random.Random(5)
    words_ = np.array([r.getrandbits(31) for _ in range(300)] + [0, 2**31 - 1], np.uint32)
    index, code = simhash.anchors(words_)
    assert (simhash._syndromes(code) == 0).all()
    assert (np.bitwise_count(words_[index] ^ code) <= 2).all()
    near = {}
    for i, c in zip(index.tolist(), code.tolist(), strict=True):
        near.setdefault(i, set()).add(c)
    assert all(len(v) in (1, 16) for v in near.values())
    for _ in range(300):  # any two words up to two bits apart share an anchor
        x = r.getrandbits(31)
        y = x ^ sum(1 << b for b in r.sample(range(31), r.randint(0, 2)))
        i, c = simhash.anchors(np.array([x, y], np.uint32))
        assert set(c[i == 0].tolist()) & set(c[i == 1].tolist())


@pytest.mark.parametrize("piece", [2048, 3])
def test_links_join_all_that_are_near(spark, piece):
    r = random.Random(11)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for s in seeds for _ in range(r.choice([1, 2, 15]))} | {0, 15, 31, 2**64 - 1}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), piece=piece).collect()
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 64 for u, v in found)
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert brute_components(signed, [(x["u"], x["v"]) for x in found]) == brute_components(signed, near)


def test_near_duplicates_are_those_of_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("the of and Rain Sun é moon tree 7").replace(" ", "x") + str(r.randint(0, 40)) for _ in range(60)) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, t.upper()) for i, t in enumerate(base[:5])] + [(200 + i, t.replace(" ", "\n ", 3) + " end") for i, t in enumerate(base[:8])]
    docs += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "ONE"), (305, "a b c d"), (305, "a b c d"), (None, "nobody"), (306, "nobody")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()
    fps = {t: brute_fingerprint(t) for _, t in docs}
    nodes = sorted(set(fps.values()))
    comp = brute_components(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for d, t in docs:
        if d is not None:
            least[comp[fps[t]]] = min(least.get(comp[fps[t]], d), d)
    assert sorted(((x["doc_id"], x["fp"] % 2**64, x["component_id"]) for x in got), key=repr) == sorted(((d, fps[t], least.get(comp[fps[t]])) for d, t in docs), key=repr)


def test_near_duplicate_query(spark):
    texts = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op6_simhash_near_dedup(spark, DATA).collect()}
    fps = {d: brute_fingerprint(t) for d, t in zip(texts.doc_id, texts.text, strict=True)}
    nodes = sorted(set(fps.values()))
    comp = brute_components(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], d), d)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", least[comp[f]]) for d, f in fps.items()}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    chain = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1000), (7, 8), (2000, 2001)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 2000: 2000, 2001: 2000}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_components_of_hubs_are_dealt_out(spark):
    r = random.Random(8)
    pairs = [(i, 0) for i in range(1, 60)] + [(100 + i, 100 + r.randint(0, i)) for i in range(50)] + [(30, 120)] + [(200 + i, 260) for i in range(30)]
    ids = [(n, None if n >= 200 else n // 2 if n != 17 else -5) for n in {x for p in pairs for x in p}]
    got = components.connected_components(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(ids, "node long, id long"), hot=3).collect()
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    comp = brute_components(sorted(linked), [p for p in pairs if p[0] != p[1]])
    expected = {}
    for n in linked:
        own = [(i is None, i, k) for k, i in ids if k in linked and comp[k] == comp[n]]
        expected[n] = min(own, key=lambda x: (x[0], x[1] or 0, x[2]))[1:]
    assert {x["node"]: (x["component_id"], x["component"]) for x in got} == expected


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_hot_keys_lose_nothing(spark, how):
    left = spark.createDataFrame([(i % 3 if i < 90 else 100 + i, i) for i in range(100)] + [(None, -1)], "k long, x long")
    right = spark.createDataFrame([(k, f"v{k}") for k in [0, 1, *range(190, 195)]], "to long, v string")
    expected = sorted(((r["k"], r["x"], r["v"]) for r in left.join(right, left["k"] == right["to"], how).collect()), key=repr)
    for hot in (5, 1000):
        got = common.spread_join(left, right, "k", "to", how, hot=hot)
        assert got.columns == ["k", "x", "v"] and sorted(map(tuple, got.collect()), key=repr) == expected


# embeddings


def brute_embeddings(rows, threshold=0.93):
    fine = {}
    for k, (_, e, label) in enumerate(rows):
        if label is not None and e is not None and None not in e and len(e) and np.isfinite(e).all() and any(e):
            fine[k] = (label, np.array(e, np.float32).astype(np.float64))
    linked = []
    for a, b in itertools.combinations(fine, 2):
        x, y = fine[a][1], fine[b][1]
        if fine[a][0] == fine[b][0] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
            linked.append((a, b))
    comp = brute_components(range(len(rows)), linked)
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    degree = np.bincount([x for p in linked for x in p], minlength=len(rows))
    return sorted((rows[k][0], int(degree[k]), least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("size", [2048, 5])
def test_embedding_links_are_those_of_brute_force(spark, size):
    r = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = r.normal(size=16)
        rows += [(len(rows) + k, (centre + r.normal(size=16) * r.choice([0.05, 0.2, 0.4])).astype(np.float32).tolist(), int(c % 3)) for k in range(12)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], 99), (n + 3, rows[0][1], None), (n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [float("nan")] * 16, 0), (n + 7, [float("inf")] + [1.0] * 15, 0), (n + 8, [None] + [1.0] * 15, 0), (n + 9, [], 0), (n + 10, [1.0, 0.0], 0), (n + 11, [2.0, -0.0], 0), (n + 12, [1e30] * 16, 1), (n + 13, [1e-30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted(tuple(x) for x in embeddings.near_duplicates(df, size=size).collect())
    assert got == brute_embeddings(rows)


def test_blocks_that_can_not_meet_are_not_compared(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 8)) * np.array([9, 6, 4, 1, 1, 1, 1, 1])
    rows = [(k, v.astype(np.float32).tolist(), 0) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(x) for x in embeddings.near_duplicates(df, size=20).collect()) == brute_embeddings(rows)
    classes = common.cut(embeddings.usable(df).withColumn("node", F.monotonically_increasing_id()))
    at = embeddings.placed(classes, embeddings.principal(classes)).withColumn("d", F.size("vector"))
    places = embeddings.blocks(at, 20)
    n, met = places.select("cell").distinct().count(), embeddings.meetings(places, 0.93).count()
    assert n >= 20 and met < n * (n + 1) / 2 * 0.6
    assert places.groupBy("cell").agg(F.sum("c").alias("c")).agg(F.max("c")).first()[0] < 80


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# mixing


def mix_rows():
    rows = [(i, "w " * (i % 7), None, f"s{i % 5}", 0) for i in range(200)]
    rows += [(1000 + i, "word " * 50, "en", "big", 0) for i in range(40)] + [(2000, None, None, None, 0), (2001, "a b", None, None, 0), (2002, "", None, "empty", 0), (None, "x y z", None, "s0", 0), (5, "dup", None, "s0", 0), (5, "dup", None, "s0", 0)]
    return rows


def test_mix_on_odd_rows(spark, monkeypatch):
    df, table = frame(spark, mix_rows(), DOCS)
    clashing = df.withColumns({"target": F.lit("clash"), "copies": F.lit("c"), "row": F.lit("r"), "size": F.lit("s"), "col": F.lit("k")})
    mixed = mixing.mix(clashing)
    got = mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    same(got, mixing.OP7_SQL, documents=table)
    rows = got.collect()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    sources = {(r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in sources) == pytest.approx(sum(s for s, _ in sources)) and all(t <= 3 * s for s, t in sources)
    out = mixing.emitted(mixed)
    assert out.columns == clashing.columns and out.count() == sum(r["copies"] for r in rows) and {r["copies"] for r in out.collect()} == {"c"}
    assert mixing.mix(df.limit(0)).count() == 0
    words = df.where("source = 'empty'")
    assert [r["target"] for r in mixing.mix(words).collect()] == [0.0]


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: 7])
def test_mix_comes_near_its_targets(spark, ids):
    rows = [(ids(i), f"n{i} " * (1 + i % 9), None, "abc"[i % 3], 0) for i in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in got)


def test_very_long_texts_are_mixed_and_sharded_whole(spark):
    rows = [(1, "w " * 1_000_000, None, "a", 0), (2, "w", None, "a", 0), (3, "v" * 3_000_000, None, "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["size"] for r in mixing.mix(df).select("row.doc_id", "size").collect()} == {1: 1_000_000, 2: 1, 3: 1}
    held = sharding.shard(df, 2_000_000).groupBy("shard", "shard_page").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r["b"] for r in held) == 5_000_001 and all(r["b"] <= 2_000_000 or r["n"] == 1 for r in held)


def test_ranks_follow_code_points(spark):
    names = ["b", "a", "B", "é", "z", "", "aa", None]
    got = {r["source"]: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string").repartition(3)).collect()}
    assert got == {n: i for i, n in enumerate([*sorted(x for x in names if x is not None), None])}


# sharding


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_shards_fit_and_match_the_shortest_fitting_prefix(spark, limit):
    rows = [(i, "x" * (i % 37), None, None, 0) for i in range(300)] + [(1000, None, None, None, 0), (None, "null id", None, None, 0), (1001, "y" * 90, None, None, 0)]
    df, table = frame(spark, rows, DOCS)
    clashing = df.withColumns({"shard": F.lit("clash"), "bits": F.lit("b"), "row": F.lit("r"), "part": F.lit("p"), "root": F.lit("t")})
    out = sharding.shard(clashing, limit)
    assert out.columns == [*(c for c in clashing.columns if c != "shard"), *sharding.ADDED] and {(r["bits"], r["row"], r["part"], r["root"]) for r in out.collect()} == {tuple("brpt")}
    got = out.select("doc_id", sharding.text_bytes(F.col("text")).alias("bytes"), *sharding.ADDED)
    same(got, sharding.op10_sql(limit), documents=table)
    held = got.groupBy("shard", "shard_page").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= limit or r["n"] == 1 for r in held)
    assert sum(r["n"] for r in held) == len(rows)


def test_shards_of_one_id_are_chained(spark):
    rows = [(7, f"{i:010d}", None, None, 0) for i in range(95)] + [(8, "z" * 25, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sharding.shard(df, 100)
    held = got.groupBy("shard", "shard_page").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 100 for r in held) and sum(r["n"] for r in held) == 96
    assert sharding.shard(df.limit(0), 100).count() == 0
    mixed = [(9, "x" * (99 if i % 40 == 0 else 60 if i % 10 == 0 else 5), None, None, 0) for i in range(400)]
    pages = sharding.shard(spark.createDataFrame(mixed, DOCS).repartition(3), 100).groupBy("shard_page").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 100 for r in pages) and len(pages) <= 2 * sum(len(t[1]) for t in mixed) / 100 + 1
    huge = sharding.shard(spark.createDataFrame([(1, "q" * 500, None, None, 0), (1, "q" * 500, None, None, 0)], DOCS), 100)
    assert huge.select("shard", "shard_page").distinct().count() == 2
