"""The retrieval engine on the toy collection, on edge cases and by its invariants."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loomdex.functions import codec, slabs
from loomdex.functions.text import termid_bucket, tokenize
from loomdex.functions.weights import TFIDF_FLOAT32
from loomdex.operators import boolean, export, gaps, index, layout, lookup, ranked, workload
from loomdex.sources import docstream, store

TOY = "d1 a b c a\nd2 b b b b b c\nd3 a\n\nd5 c a b a a a\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("engine")


@pytest.fixture(scope="module")
def toy(spark, folder):
    (folder / "toy.txt").write_text(TOY)
    return docstream.read_docstream(spark, str(folder / "toy.txt")).cache()


@pytest.fixture(scope="module")
def built(toy):
    return index.build(toy)


def asked(spark, folder, text):
    (folder / "q.txt").write_text(text)
    return docstream.read_queries(spark, str(folder / "q.txt"))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_toy_counts(toy, built):
    assert rows(built.lexicon, "term", "df", "cf", "last_docid") == [("a", 3, 7, 5), ("b", 3, 7, 5), ("c", 3, 3, 5)]
    s = index.collection_stats(toy, built.lexicon).first()
    assert tuple(s) == (5, 17, 9, 3, 1)
    assert rows(toy, "docid", "text_id") == [(1, "d1"), (2, "d2"), (3, "d3"), (4, None), (5, "d5")]
    assert rows(index.positional_postings(toy).where("term = 'a'"), "docid", "positions") == [(1, [1, 4]), (3, [1]), (5, [2, 4, 5, 6])]


@pytest.mark.parametrize("query, ands, ors, scores", [
    ("a b", [1, 5], [1, 2, 3, 5], [(5, 2.258443), (1, 1.757410), (2, 1.757410), (3, 0.679859)]),
    ("b", [1, 2, 5], [1, 2, 5], [(2, 1.757410), (1, 0.679859), (5, 0.679859)]),
    ("c zzz", [1, 2, 5], [1, 2, 5], [(1, 0.679859), (2, 0.679859), (5, 0.679859)]),
    ("zzz", [], [], []),
    ("", [], [], []),
    ("a b c", [1, 5], [1, 2, 3, 5], [(5, 2.938302), (1, 2.437269), (2, 2.437269), (3, 0.679859)]),
])
def test_toy_queries(spark, folder, built, query, ands, ors, scores):
    q = asked(spark, folder, f"7 {query}\n")
    assert [d for d, in rows(boolean.and_docs(q, built), "docid")] == ands
    assert [d for d, in rows(boolean.or_docs(q, built), "docid")] == ors
    got = [(r["docid"], r["score"]) for r in ranked.ranked(q, built, 10).orderBy("rank").collect()]
    assert got == scores
    assert [d for d, in rows(boolean.and_chain(query.split(), built), "docid")] == ands
    near = [(r["docid"], round(r["score"], 5)) for r in ranked.ranked(q, built, 10, ranker=TFIDF_FLOAT32).orderBy("rank").collect()]
    assert sorted(d for d, _ in near) == sorted(d for d, _ in scores)


def test_workload_with_repeats(spark, folder, built):
    q = asked(spark, folder, "1 a a b\n1 a b\n\n2 zzz\n3\n4 c")
    assert rows(q, "query_ord", "qid", "terms") == [(1, "1", ["a", "b"]), (2, "1", ["a", "b"]), (3, None, []), (4, "2", ["zzz"]), (5, "3", []), (6, "4", ["c"])]
    counts = boolean.and_count(q, built)
    assert rows(counts, "query_ord", "qid", "matches") == [(1, "1", 2), (2, "1", 2), (6, "4", 3)]
    assert tuple(workload.match_stats(counts).first()) == (3, 7 / 3, 2, 2, 3)
    assert rows(lookup.unknown_terms(q, built.lexicon), "query_ord", "term") == [(4, "zzz")]
    none = workload.match_stats(counts.where("false")).first()
    assert none["n"] == 0 and none["p50"] is None
    assert ranked.ranked(q, built, 0).count() == 0 and ranked.ranked(q, built, 5, n=0).count() == 0
    assert docstream.query_stats(q).first()["mean_terms"] == 1.0
    line = ranked.trec_run(ranked.ranked(q, built, 1)).where("query_ord = 6").first()["line"]
    assert line == "4 Q0 1 0 0.679859 loomdex"
    assert rows(boolean.or_count(q, built), "query_ord", "matches") == [(1, 4), (2, 4), (6, 3)]
    assert rows(ranked.returned_count(q, built, 2), "query_ord", "returned") == [(1, 2), (2, 2), (6, 2)]
    assert rows(workload.run_log(counts), "matches") == [(2,), (2,), (3,)]


def test_lines_and_tokens(spark, folder):
    raw = b"id1  x\ty\x0bz\x0cw \r v\r\n\nid2\nid1 \xc2\xa0q\xc2\xa0 \xc3\xa9" + b"t" * 60 + b"\n  id3 last"
    (folder / "odd.txt").write_bytes(raw)
    got = rows(docstream.read_docstream(spark, str(folder / "odd.txt")), "docid", "text_id", "tokens")
    assert got == [(1, "id1", ["x", "y", "z", "w", "v"]), (2, None, []), (3, "id2", []), (4, "id1", [" q ", "é" + "t" * 60]), (5, "id3", ["last"])]


def test_line_numbers_over_files_and_splits(spark, folder):
    (folder / "many").mkdir()
    n = 0
    for k in range(3):
        with open(folder / "many" / f"part{k}", "w") as f:
            for _ in range(400):
                n += 1
                f.write(f"doc{n} w{n}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = docstream.read_docstream(spark, str(folder / "many"))
        assert all(r["text_id"] == f"doc{r['docid']}" for r in got.collect())
        assert got.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_tokens(spark):
    d = spark.createDataFrame([("ab " + "é" * 15 + " " + "x" * 45,)], "t string")
    assert d.select(tokenize(F.col("t"), 20)).first()[0] == ["ab", "é" * 10, "x" * 20]
    assert d.select(tokenize(F.col("t"), 20, split_long=True)).first()[0] == ["ab", "é" * 15, "x" * 20, "x" * 20, "x" * 5]


def test_profile_probes(spark, folder, built):
    q = asked(spark, folder, "1 a b c\n2 zzz")
    got = rows(boolean.and_profile(q, built), "i", "term", "df", "next_geq_count")
    assert got == [(0, "a", 3, 3), (1, "b", 3, 3), (2, "c", 3, 2)]


def test_next_geq_and_term_frequency(spark, toy, built):
    t = spark.createDataFrame([("a", 0), ("a", 2), ("a", 6), ("zz", 1)], "term string, target bigint")
    assert rows(lookup.next_geq(built.postings, t), "term", "target", "docid", "tf") == [("a", 0, 1, 2), ("a", 2, 3, 1), ("a", 6, None, None), ("zz", 1, None, None)]
    pairs = spark.createDataFrame([(1, "a"), (4, "a"), (2, "zz")], "docid bigint, term string")
    assert rows(index.term_frequency(toy, pairs), "docid", "term", "tf") == [(1, "a", 2), (2, "zz", 0), (4, "a", 0)]


def test_gaps(toy, built):
    assert rows(gaps.dgaps(built.postings).where("term = 'a'"), "docid", "dgap") == [(1, 1), (3, 2), (5, 2)]
    assert rows(gaps.from_dgaps(gaps.dgaps(built.postings)), "term", "docid", "tf") == rows(built.postings, "term", "docid", "tf")
    p = gaps.positional_gaps(index.tokens(toy)).where("term = 'a'").orderBy("docid", "position")
    assert [(r["wgap"], r["dgap"]) for r in p.collect()] == [(1, 1), (3, 1), (1, 3), (2, 3), (2, 1), (1, 1), (1, 1)]


def test_lists_over_many_ranges(spark):
    """Gaps, prefix sums, places and positional gaps of lists that span ranges, against plain Python."""
    rng = random.Random(3)
    plain = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    docs = [(t, d, [rng.randint(1, 9) for _ in range(rng.randint(1, 3))]) for t in "abcd" for d in sorted(rng.sample(range(1, 60), {"a": 40, "b": 9, "c": 1, "d": 2}[t]))]
    p = spark.createDataFrame([(t, d, len(w)) for t, d, w in docs], "term string, docid bigint, tf bigint")
    gap = {}
    for t in "abcd":
        last = 0
        for d in sorted(d for u, d, _ in docs if u == t):
            gap[t, d], last = d - last, d
    want = sorted((t, d, gap[t, d]) for t, d in gap)
    for span in (1, 4, 1 << 20):
        g = gaps.dgaps(p, span)
        assert g.columns == ["term", "docid", "tf", "dgap"]
        assert plain(g, "term", "docid", "dgap") == want
        assert plain(gaps.from_dgaps(g, span=span), "term", "docid", "tf") == plain(p, "term", "docid", "tf")
        placed = sorted((t, k, v) for t in "abcd" for k, v in enumerate([sum(1 for u, _ in gap if u == t), *(d - 1 for u, d in sorted(gap) if u == t)]))
        assert plain(export.docs_lists(p, span), "term", "k", "value") == placed
        occurrences = sorted({(t, d, x) for t, d, w in docs for x in w})
        tokens = spark.createDataFrame(occurrences, "term string, docid bigint, position int")
        expect, before = [], (None, None, None)
        for t, d, x in occurrences:
            same = before[0] == t
            expect.append((t, d, x, x - before[2] if before[:2] == (t, d) else x, d if not same else 1 if before[1] == d else d - before[1] + 1))
            before = (t, d, x)
        assert plain(gaps.positional_gaps(tokens, span), "term", "docid", "position", "wgap", "dgap") == expect


CODES = [(1, 1, "01"), (1, 3, "03"), (1, 4, "0401"), (1, 5, "0402"), (32, 3, "7f"), (33, 1, "8101"), (32, 4, "800101"), (1, 130, "047f"), (1, 131, "048001"), (4096, 3, "ff7f"), (5, 200, "14c501")]


def test_codes(spark):
    d = spark.createDataFrame(CODES, "gap bigint, tf bigint, want string")
    code = codec.double_vbyte(F.col("gap"), F.col("tf"))
    for r in d.select("*", F.lower(F.hex(code)).alias("got"), F.length(code).alias("n"), codec.double_vbyte_size(F.col("gap"), F.col("tf")).alias("size"), codec.decode_double_vbyte(code).alias("back")).collect():
        assert r["got"] == r["want"] and r["n"] == r["size"] and [tuple(x) for x in r["back"]] == [(r["gap"], r["tf"])]


def test_code_lists_round_trip():
    rng = random.Random(1)
    for _ in range(100):
        posts = [(rng.choice([1, 2, 31, 32, 33, 4096, 1 << 20, (1 << 30) - 1]), rng.choice([1, 2, 3, 4, 5, 8, 200, 1 << 20])) for _ in range(rng.randint(0, 40))]
        data = b""
        for g, f in posts:
            for v in [(g - 1) * 4 + f] if f < 4 else [g * 4, f - 3]:
                while v >= 128:
                    data += bytes([v & 127 | 128])
                    v >>= 7
                data += bytes([v])
        g, f = codec.postings_of(data)
        assert list(zip(g.tolist(), f.tolist())) == posts


def test_out_of_range_is_refused(spark):
    d = spark.createDataFrame([(1 << 30, 1)], "gap bigint, tf bigint")
    with pytest.raises(Exception, match="out of range"):
        d.select(codec.double_vbyte(F.col("gap"), F.col("tf"))).collect()
    v = spark.createDataFrame([(bytes([0x81, 0x01, 0x05]),)], "b binary")
    assert v.select(codec.decode_vbyte(F.col("b"))).first()[0] == [129, 5]
    assert v.select(codec.u32_at(codec.u32(F.lit(4294967295)))).first()[0] == 4294967295
    assert v.select(termid_bucket(F.lit(70), 64)).first()[0] == 6


def test_slabs():
    t, e = slabs.slab_sizes("triangle"), slabs.slab_sizes("expon")
    assert [t.index(k) for k in range(1, 9)] == [0, 8, 20, 34, 48, 62, 77, 92] and t[-1] == 18 and len(t) == 256
    assert e[:11] == [1] * 11 and e[11:26] == [2] * 5 + [3] * 4 + [4] * 2 + [5] * 2 + [6] * 2 and e[-1] == 945


def test_layout_and_report(spark, toy, built):
    r = layout.size_report(layout.block_layout(built.postings, "fixed"), index.collection_stats(toy, built.lexicon)).first()
    assert r["total_bytes"] == 216 and round(r["bytes_per_word"], 4) == 12.7059 and r["bytes_per_posting"] == 24
    long = spark.range(1, 200).select(F.lit("t").alias("term"), (F.col("id") * 40).alias("docid"), F.lit(1).cast("bigint").alias("tf"))
    one = layout.block_layout(long, "fixed").first()
    # 64 - 18 - 1 bytes hold 22 codes of two bytes; a later block begins with the gap to the block before
    offset, first, blocks = 19, None, 1
    last = 0
    for doc in range(40, 8000, 40):
        size = layout.posting_bytes(doc - last, 1)
        if offset + size > 64:
            size = layout.posting_bytes(doc - (first or 0), 1)
            blocks, offset, first = blocks + 1, 4, doc
        offset, last = offset + size, doc
    assert one["blocks"] == one["slabs"] == blocks and one["df"] == 199


@pytest.mark.parametrize("growth", ["fixed", "triangle", "expon"])
def test_layout_of_lists_over_many_batches(spark, growth):
    """Slabs of long and short lists, in batches of a few rows, against a posting by posting fold."""
    rng = random.Random(5)
    lists = {"hot" + "x" * 50: 400, "b": 300, "c": 30, "d": 1, "e" * 44: 2, "é": 3}
    posts = [(t, d, rng.choice([1, 1, 2, 5, 300])) for t, n in lists.items() for d in sorted(rng.sample(range(1, 9000), n))]
    sizes, head, want = slabs.slab_sizes(growth), slabs.head_bytes(growth), []
    for t in lists:
        slab, room, last, link = [t, 1, sizes[0], None, None, 0, 0], 64 * sizes[0] - head - len(t.encode()), 0, 0
        for _, d, f in [x for x in posts if x[0] == t]:
            need = int(layout.posting_bytes(d - last, f))
            if need > room:
                want.append(tuple(slab))
                need, blocks = int(layout.posting_bytes(d - link, f)), sizes[min(slab[1], 255)]
                slab, room, link = [t, slab[1] + 1, blocks, None, d - link, 0, 0], 64 * blocks - 4, d
            slab[3] = slab[3] or d
            slab[5], slab[6], room, last = slab[5] + 1, slab[6] + need, room - need, d
        want.append(tuple(slab))
    p = spark.createDataFrame(posts, "term string, docid bigint, tf bigint")
    names = ("term", "slab", "blocks", "first_docid", "bgap", "postings", "payload")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = layout.slab_chain(p, growth).select(*names).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(tuple(r)[:3] + tuple(r)[5:] for r in got) == sorted(x[:3] + x[5:] for x in want)
        assert {tuple(r) for r in got} == set(want)


def test_decoding_many_lists(spark):
    lists = [(0, [(1, 4), (4, 4), (1, 1)]), (1, [(4, 1), (4, 7), (8, 8)]), (2, [(1, 4)]), (3, [(2, 4), (2, 4), (2, 4), (2, 3)])]
    d = spark.createDataFrame([(i, j, g, f) for i, l in lists for j, (g, f) in enumerate(l)], "i int, j int, g bigint, f bigint")
    d = d.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", codec.double_vbyte(F.col("g"), F.col("f")).alias("code")))).alias("l"))
    d = d.select("i", F.unhex(F.array_join(F.transform("l", lambda x: F.hex(x["code"])), "")).alias("data"))
    d = d.union(spark.sql("SELECT 4, CAST(NULL AS BINARY)")).union(spark.sql("SELECT 5, X''")).coalesce(1)
    got = {r["i"]: r["back"] for r in d.select("i", codec.decode_double_vbyte(F.col("data")).alias("back")).collect()}
    assert {i: [tuple(x) for x in got[i]] for i, _ in lists} == dict(lists) and got[4] is None and got[5] == []
    assert [len(r[0]) if r[0] is not None else None for r in d.orderBy("i").select(codec.decode_vbyte(F.col("data"))).collect()] == [5, 5, 2, 7, None, 0]


@pytest.mark.parametrize("sf, growth, blocks, payload, chain", [("0.001", "fixed", 27_873, 86_538, 4), ("0.001", "triangle", 27_880, 86_545, 4), ("0.001", "expon", 27_880, 86_545, 4)])
def test_layout_goldens(spark, sf, growth, blocks, payload, chain):
    p = index.postings(docstream.from_table(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")))
    r = layout.block_layout(p, growth).agg(F.sum("blocks"), F.sum("payload"), F.max("slabs")).first()
    assert tuple(r) == (blocks, payload, chain)


def test_exports(toy, built, folder):
    base = str(folder / "out")
    export.write_interleaved(built.postings, base)
    pairs = list(struct.iter_unpack("<II", (folder / "out.interleaved").read_bytes()))
    assert pairs == [(0, 2), (2, 1), (2, 4), (0, 1), (1, 5), (3, 1), (0, 1), (1, 1), (3, 1)]
    export.write_canonical(toy.select("docid", "text_id", F.size("tokens").cast("bigint").alias("length")), built.postings, base)
    u32 = lambda s: [v for v, in struct.iter_unpack("<I", (folder / f"out.{s}").read_bytes())]
    assert u32("docs") == [1, 5, 3, 0, 2, 4, 3, 0, 1, 4, 3, 0, 1, 4]
    assert u32("freqs") == [3, 2, 1, 4, 3, 1, 5, 1, 3, 1, 1, 1]
    assert u32("sizes") == [5, 4, 6, 1, 0, 6]
    assert (folder / "out.terms").read_text() == "a\nb\nc\n" and (folder / "out.documents").read_text() == "d1\nd2\nd3\n\nd5\n"


def test_store_append_compact(spark, toy, built, folder):
    half = toy.where("docid <= 2")
    store.save(index.build(half), str(folder / "ix"))
    store.append(spark, str(folder / "ix"), toy.where("docid > 2"))
    with pytest.raises(ValueError, match="increase"):
        store.append(spark, str(folder / "ix"), half)
    store.compact(spark, str(folder / "ix"), str(folder / "packed"), partitions=2)
    for path in ("ix", "packed"):
        at = store.load(spark, str(folder / path))
        assert rows(at.postings, "term", "docid", "tf") == rows(built.postings, "term", "docid", "tf")
        assert rows(at.lexicon, "term", "df", "cf", "last_docid") == rows(built.lexicon, "term", "df", "cf", "last_docid")
        assert at.documents.count() == 5
    plan = lookup.term_scan(store.load(spark, str(folder / "packed")).postings, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,a)]" in plan
    both = index.append(index.build(half), toy.where("docid > 2"))
    assert rows(both.lexicon, "term", "df", "cf", "last_docid") == rows(built.lexicon, "term", "df", "cf", "last_docid")
    with pytest.raises(Exception, match="docids must increase"):
        index.append(built, half).documents.collect()


def test_invariants(spark, sf):
    d = docstream.from_table(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    ix = index.build(d)
    ix = index.Index(ix.documents.cache(), ix.postings.cache(), ix.lexicon.cache())
    q = docstream.queries_from_table(spark.read.parquet(f"{sf}/benchmark.parquet").limit(10)).cache()
    ands, ors = boolean.and_docs(q, ix), boolean.or_docs(q, ix)
    assert ands.join(ors, ["query_ord", "docid"], "left_anti").isEmpty()
    least = lookup.resolve(q, ix.lexicon).groupBy("query_ord").agg(F.min("df").alias("df"))
    assert boolean.and_count(q, ix).join(least, "query_ord").where("matches > df").isEmpty()
    s = ranked.scores(q, ix)
    five, six = ranked.top_k(s, 5), ranked.top_k(s, 6)
    assert rows(five, "query_ord", "rank", "docid") == rows(six.where("rank < 5"), "query_ord", "rank", "docid")
    flipped = q.withColumn("terms", F.reverse("terms"))
    assert rows(ranked.ranked(flipped, ix, 5), "query_ord", "docid", "score") == rows(five, "query_ord", "docid", "score")
    total = ix.postings.agg(F.sum("tf")).first()[0]
    assert total == ix.documents.agg(F.sum("length")).first()[0] == index.collection_stats(d, ix.lexicon).first()["n_words"]
    e = export.interleaved(ix.postings)
    assert e.join(ix.postings.select("term", (F.col("docid") - 1).alias("docid"), "tf"), ["term", "docid", "tf"], "left_anti").isEmpty()


def test_percentiles_by_rank(spark):
    from loomdex.functions.order_stats import percentiles

    r = percentiles(spark.range(1, 11).withColumnRenamed("id", "v"), "v", (50, 90, 99)).first()
    assert (r["p50"], r["p90"], r["p99"]) == (6, 10, 10)
    assert workload.order_statistic(list(range(1, 11)), 90) == 10 and workload.order_statistic([], 50) is None
    t = workload.timed([1, 2, 3], lambda q: q - 1)
    assert t["matched"] == 2 and t["matches"]["p50"] == 2
