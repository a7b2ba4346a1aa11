import random
from collections import Counter, defaultdict

from tessella.llm import minhash, pack, queries, simhash
from tests.llm.conftest import same_as_sql
from tests.llm.test_near_copies import jaccard, shingles

SIZED = "doc_id long, size long, source string, cluster long, bin int"


def plain_best_fit(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [
            (b["left"], n) for n, b in enumerate(bins)
            if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[n]["left"] -= size
        bins[n]["s"].add(source)
        bins[n]["c"].add(cluster)
        out.append(n)
    return out


def check(rows, want_sizes, info, capacity):
    """Pieces add up to their documents, bins hold what they say and no conflicts."""
    total, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.size
        bins[r.bin].append(r)
    assert total == want_sizes
    for held in bins.values():
        assert sum(r.size for r in held) == held[0].bin_used <= capacity and len(held) == held[0].bin_pieces
        for k in (0, 1):
            seen = [info[r.doc_id][k] for r in held if info[r.doc_id][k] is not None]
            assert len(seen) == len(set(seen))


def test_best_fit_equals_brute_force():
    rng = random.Random(7)
    for hot in (0.0, 0.4):
        items = [
            (rng.randrange(0, 101), "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None, *"defghijk"]), rng.choice([None, *range(60)]))
            for _ in range(600)
        ]
        items.sort(key=lambda x: -x[0])
        assert pack.best_fit(items, 100) == plain_best_fit(items, 100)


def by_shard(rows):
    return Counter(r.bin.split("-")[0] for r in rows)


def clusters_by_all_pairs(texts, least=0.8):
    """{id: text} → the smallest id reachable over pairs of at least that similarity."""
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    out = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if out[a] != out[b] and jaccard(sets[a], sets[b]) >= least:
                low, high = sorted((out[a], out[b]))
                out = {i: low if r == high else r for i, r in out.items()}
    return out


def test_query_packs_every_word(spark, sf):
    rows = queries.op2_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    clusters = clusters_by_all_pairs({d.doc_id: d.text for d in docs})
    assert len(set(clusters.values())) < len(docs)
    check(rows, sizes, {d.doc_id: (d.source, clusters[d.doc_id]) for d in docs}, 2048)
    # one shard here: the same bins as a plain best fit over the pieces in order
    order = sorted(rows, key=lambda r: (-r.size, r.doc_id, r.piece))
    source = {d.doc_id: d.source for d in docs}
    want = plain_best_fit([(r.size, source[r.doc_id], clusters[r.doc_id]) for r in order], 2048)
    assert [int(r.bin.split("-")[1]) for r in order] == want


def test_audit_equal_sql(spark, sf):
    same_as_sql(spark, sf, "packing_audit")


def test_audit_of_repeated_and_null_ids(spark, tmp_path):
    """Pieces are told apart by what they carry, not by their ids."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "s"), (1, text + " x", "t"), (None, text, "u"), (None, None, None), (2, "", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: tuple(r)[1:] for r in queries.packing_audit(spark, str(tmp_path)).collect()}
    assert got == {"s": (2, 30, 2, 2, 2), "t": (1, 31, 1, 1, 1), "u": (1, 30, 1, 1, 1), None: (1, 0, 1, 1, 1)}


def test_audit_finds_broken_rules(spark):
    given = "doc_id long, size long, bin string, bin_used long, bin_pieces long, source string, cluster long"
    rows = [
        (1, 5, "a", 9, 2, "s", 1), (2, 4, "a", 9, 2, "s", 2), (3, 5, "b", 9, 2, "t", 7), (4, 4, "b", 9, 2, "u", 7),
        (5, 8, "c", 12, 2, None, None), (6, 4, "c", 12, 2, None, None), (7, 3, "d", 4, 1, "t", None), (8, 3, "e", 3, 2, "u", 7),
    ]
    got = {r.source: tuple(r)[1:] for r in pack.audit(spark.createDataFrame(rows, given), capacity=10).collect()}
    assert got == {"s": (2, 9, 0, 2, 2), "t": (2, 8, 2, 1, 1), "u": (2, 7, 2, 1, 1), None: (2, 12, 2, 2, 0)}


def test_tokens_and_clusters_of_the_pipeline(spark, sf):
    """Sizes are the vocabulary's tokens; documents within 4 bits of SimHash never share a bin."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {r.doc_id: r.n_tokens for r in queries.op4_tokens(spark, sf).collect()}
    found = {r.doc_id: (r.source, r.cluster, r["size"]) for r in pack.sized_by_tokens(docs).collect()}
    assert {i: x[2] for i, x in found.items()} == sizes
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    pairs = {(near[i], found[i][1]) for i in near}
    assert len(pairs) == len(set(near.values())) == len({x[1] for x in found.values()}) < len(near)
    check(pack.pack(pack.sized_by_tokens(docs)).collect(), sizes, {i: x[:2] for i, x in found.items()}, 2048)


def test_null_and_repeated_ids_are_dealt(spark):
    """Neither one id nor one row is a shard, and copies of a null id are still copies."""
    sized = spark.range(20_000).selectExpr("cast(null as long) doc_id", "id % 90 size", "cast(id % 500 as string) source", "id cluster", "0 bin")
    alike = spark.range(20_000).selectExpr("7L doc_id", "5L size", "cast(null as string) source", "cast(null as long) cluster", "0 bin")
    for rows in (sized, alike):
        shards = [*by_shard(pack.pack(rows, capacity=100, shard=4000).collect()).values()]
        assert len(shards) == 5 and sum(shards) == 20_000 and max(shards) < 5000
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text, "a"), (None, text, "b"), (None, text + " more", "c"), (3, "x", "d")], "doc_id long, text string, source string")
    sized = minhash.clusters(docs, docs.doc_id, docs.source).withColumnRenamed("words", "size")
    bins = pack.pack(sized).collect()
    assert len({r.bin for r in bins if r.doc_id is None}) == 3 and len(bins) == 4


def test_copies_in_goes(spark, monkeypatch):
    """Many copies of a row are dealt by several tasks, with the same bins."""
    rows = spark.range(50).selectExpr("1L doc_id", "30L size", "cast(null as string) source", "cast(null as long) cluster", "0 bin")
    want = sorted(map(str, pack.pack(rows, capacity=100, shard=20).collect()))
    monkeypatch.setattr(pack, "COPIES", 7)
    assert sorted(map(str, pack.pack(rows, capacity=100, shard=20).collect())) == want and len(want) == 50


def test_large_ids_beside_nulls(spark):
    rows = [((1 << 60) + k, 10, None, None, 0) for k in range(20)] + [(None, 10, None, None, 0)]
    assert {r.doc_id for r in pack.pack(spark.createDataFrame(rows, SIZED)).collect()} == {r[0] for r in rows}


def test_odd_rows_and_shards(spark):
    rows = [(1, None, None, None), (2, -5, "a", 1), (None, 7, "a", None), (3, 0, "a", 1), (4, 10_001, "b", 2), (5, 5, None, 2), (5, 5, None, 2)]
    rows += [(100 + k, k % 90, "hot" if k % 3 else f"s{k % 11}", k // 40) for k in range(800)]
    sized = spark.createDataFrame([(*r, 0) for r in rows], SIZED)
    got = pack.pack(sized, capacity=100, shard=100).collect()
    sizes = defaultdict(int)
    for i, n, *_ in rows:
        sizes[i] += max(n or 0, 0)
    check(got, sizes, {r[0]: (r[2], r[3]) for r in rows}, 100)
    assert len({r.bin.split("-")[0] for r in got}) > 5
    assert sorted((r.start, r.size) for r in got if r.doc_id == 4) == [(100 * k, 100) for k in range(100)] + [(10_000, 1)]
    again = pack.pack(sized.repartition(7), capacity=100, shard=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " x\ty\n z ", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r["size"] for r in pack.sized_by_words(docs).collect()} == {1: 0, 2: 0, 3: 3}
    assert pack.pack(pack.sized_by_words(docs.limit(0))).collect() == []
