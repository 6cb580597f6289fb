"""Exact similarity join of word-shingle sets with a token-group matrix.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their distinct shingles of five lower-cased words. The
join is whole: it rests on bounds that no linked pair fails, never on caps; chance enters by hashes alone (below).

1. Classes. Documents with the same set are one class; copies cost nothing further.
2. Shared tokens. Each task sends its shingles, sorted and packed as gaps, to token buckets; a bucket counts in how many
   classes each token occurs and returns the tokens with two or more. A class can only link if three quarters of its
   tokens are shared; the others leave here, and for those that stay the shared tokens are all an overlap needs.
   A token that is frequent within one task is marked as frequent for everybody, and its postings go to buckets by
   class instead, so that no bucket receives the postings of a common passage.
3. Groups. Rare tokens first, a class must share a token of its prefix with each partner. Each class proposes a leader
   from its prefix tokens; verified links make groups of similar classes, split into blocks of bounded size.
4. Token-group matrix. The union of tokens of each block is stored. A class meets the blocks of other groups with which
   it shares a prefix token, the overlap with the union bounds the overlap with every member, and only blocks that
   reach the bound are opened and their members verified. Pairs within a group are connected already.
5. Components of all verified links.

Shingles are known by hashes of 64 bits and tokens by the first 48 of them: a pair of documents of 500 words sees a false
common token once in a billion pairs, which can only turn a pair at the very edge of the threshold. Classes are known by
64-bit sums of hashed shingles, and a second sum, independent of the first, checks them: different sets with the same
first sum (n * n / 2^65 of them among n sets, three at 10^10) get identifiers made of both, so that only sets that agree
in 128 bits are ever taken for one.

Buckets hold about ``BUCKET_TOKENS`` tokens and blocks about ``BLOCK_TOKENS``, however large the input, so the memory of a
task does not follow it. Very long texts are hashed a block at a time and their sets sorted whole, eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_by_id, needs, salted_lookup, stored, text_of
from .components import components
from .textarrays import mix, release, shingles, words

PERCENT = 75
#: Tokens that a task packs at a time, and members of a block of a group. Neither changes the result.
FLUSH = 500_000
BLOCK_MEMBERS = 64
#: Tokens of a token or class bucket, and of a block of a group; neither changes the result.
BUCKET_TOKENS, BLOCK_TOKENS = 2_000_000, 200_000
#: A token in this share of the texts of a pack, and in so many at least, is frequent.
FREQUENT_SHARE, FREQUENT_LEAST = 256, 32
FREQUENT = (1 << 31) - 1
LEADER_ROUNDS = 2


def _sets(column: pa.Array, split: np.ndarray | None = None, bits: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first row, set sizes, class ids, checks, sets) block by block; class 0 stands for an empty set.

    split: the ids that different sets share, told apart by their checks; bits: how many an id has, fewer in tests only.
    """
    for lo, _, counts, hashes in words(column):
        many, every = shingles(counts, hashes)
        ends = np.cumsum(many)
        sets = [np.unique(every[e - m : e]) for e, m in zip(ends.tolist(), many.tolist(), strict=True)]
        n = np.array([len(s) for s in sets], np.int64)
        with np.errstate(over="ignore"):
            flat = mix(np.concatenate(sets)) if len(sets) else np.zeros(0, np.uint64)
            ends = np.cumsum(n)
            whole = lambda flat: (s := np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat)]))[ends] - s[ends - n]
            ids, checks = mix(whole(flat) + n.astype(np.uint64)) >> np.uint64(64 - bits), mix(whole(mix(flat)) + n.astype(np.uint64))
            if split is not None and len(split):
                shared = np.isin(ids, split)
                ids[shared] = mix(ids[shared] ^ checks[shared])
        ids[n == 0] = 0
        yield lo, n, ids, checks, sets


def classes(docs: DataFrame, split: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, cls, the same for documents with the same set and null for an empty one, and chk, its check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(n, ids, checks) for _, n, ids, checks, _ in _sets(batch.column(1), split, bits)]
            n, ids, checks = (np.concatenate([p[k] for p in parts]).view(np.int64) if parts else np.zeros(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, mask=n == 0), pa.array(checks)], ["doc_id", "n_shingles", "cls", "chk"])
        release()

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, cls bigint, chk bigint")


def _counted(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The documents with their classes, the classes with their first id and copies, and the ids that had to be split."""
    split = np.zeros(0, np.uint64)
    while True:
        rows = stored(classes(docs, split, bits), "classes")
        first = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("chk").alias("_c0"), F.max("chk").alias("_c1"))
        first = stored(first, "copies")
        shared = [r["cls"] for r in first.where("_c0 <> _c1").select("cls").collect()]  # none, or a few that chance made
        if not shared or len(split):
            return rows, first.select("cls", "first", "copies"), split
        split = np.array(shared, np.int64).view(np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return needs(docs, doc_id="bigint", text="string").select("doc_id", text_of().alias("text"))


_PACK = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("ords", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])


def _packed(key: int, tokens: np.ndarray, ords: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple:
    """Sorted tokens as gaps of four bytes (eight where one is larger) and postings as ordinals in the pack's own list of classes. The ordinal len(ids) marks a frequent token."""
    mark = ords == len(ids)
    used, local = np.unique(ords[~mark], return_inverse=True)
    ord_of = np.full(len(ords), len(used), np.int64)
    ord_of[~mark] = local
    gaps = np.diff(tokens, prepend=tokens[:1])
    narrow = gaps.max(initial=0) < 1 << 32
    return key, int(tokens[0]), gaps.astype(np.uint32 if narrow else np.uint64).tobytes(), ord_of.astype(np.uint16 if len(used) < 65535 else np.uint32).tobytes(), ids[used].tobytes(), sizes[used].astype(np.uint32).tobytes()


def _unpacked(first: int, gaps: bytes, ords: bytes, ids: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, classes and set sizes of the postings, and the tokens that are marked as frequent."""
    ids_, sizes_ = np.frombuffer(ids, np.uint64), np.frombuffer(sizes, np.uint32)
    at = np.frombuffer(ords, np.uint16 if len(ids_) < 65535 else np.uint32).astype(np.int64)
    tokens = np.cumsum(np.frombuffer(gaps, np.uint32 if len(gaps) == 4 * len(at) else np.uint64).astype(np.uint64)) + np.uint64(first)
    mark = at == len(ids_)
    keep = ~mark
    return tokens[keep], ids_[at[keep]], sizes_[at[keep]], tokens[mark]


def _pack(ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], buckets: int, share: int, least: int) -> Iterator[tuple]:
    """One pack of distinct classes to rows for the token buckets, and for the class buckets (negative keys)."""
    tokens = np.concatenate(sets) >> np.uint64(16)
    ords = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, ords = tokens[order], ords[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(tokens)))
    often = runs >= max(least, len(sets) // share)
    if often.any():
        hot = np.repeat(often, runs)
        hot_tokens, hot_ords = tokens[hot], ords[hot]
        own = (ids[hot_ords] % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(own).tolist():
            at = own == b
            yield _packed(-1 - b, hot_tokens[at], hot_ords[at], ids, sizes)
        tokens, ords = np.concatenate([tokens[~hot], tokens[starts[often]]]), np.concatenate([ords[~hot], np.full(int(often.sum()), len(ids), np.uint32)])
        order = np.argsort(tokens, kind="stable")
        tokens, ords = tokens[order], ords[order]
    bucket = ((tokens >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(tokens)], strict=True):
        if hi > lo:
            yield _packed(int(bucket[lo]), tokens[lo:hi], ords[lo:hi], ids, sizes)


def _shared(key: int, rows: list[tuple], buckets: int) -> Iterator[tuple]:
    """The postings whose token occurs in two classes at least, packed for the class buckets; last the counts of the distinct tokens."""
    parts = [_unpacked(*r) for r in rows]
    tokens, ids, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
    marked = np.unique(np.concatenate([p[3] for p in parts]))
    if key >= 0:
        order = np.argsort(tokens)
        t = tokens[order]
        same = t[1:] == t[:-1]
        many = np.zeros(len(t), bool)
        many[1:] |= same
        many[:-1] |= same
        if len(marked):
            many |= np.isin(t, marked)
        order = order[many]
        tokens, ids, sizes = tokens[order], ids[order], sizes[order]
    order = np.lexsort((ids, tokens))
    tokens, ids, sizes = tokens[order], ids[order], sizes[order]
    if not len(tokens):
        return
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])])
    tokens, ids, sizes = tokens[fresh], ids[fresh], sizes[fresh]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    runs = np.diff(np.append(starts, len(tokens)))
    count = np.repeat(runs, runs)
    if key < 0:
        count[:] = FREQUENT
    elif len(marked):
        count[np.isin(tokens, marked)] = FREQUENT
    keep = count > 1
    tokens, ids, sizes, count = tokens[keep], ids[keep], sizes[keep], count[keep]
    if not len(tokens):
        return
    own = (ids % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")  # tokens stay sorted within a bucket
    tokens, ids, sizes, count, own = tokens[order], ids[order], sizes[order], count[order], own[order]
    edges = np.flatnonzero(np.diff(own)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(own)], strict=True):
        listed, at, ords = np.unique(ids[lo:hi], return_index=True, return_inverse=True)
        new = np.concatenate([[True], tokens[lo + 1 : hi] != tokens[lo : hi - 1]])
        yield *_packed(int(own[lo]), tokens[lo:hi], ords, listed, sizes[lo:hi][at]), count[lo:hi][new].astype(np.uint32).tobytes()


def _merged(rows: list[tuple], percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(class, set size, shared tokens from rare to frequent) of the classes with enough shared tokens."""
    parts = []
    for *packed, counts in rows:
        tokens, ids, sizes, _ = _unpacked(*packed)
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        parts.append((tokens, ids, sizes, np.frombuffer(counts, np.uint32)[np.cumsum(new) - 1]))
    tokens, ids, sizes, count = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((tokens, count, ids))
    tokens, ids, sizes = tokens[order], ids[order], sizes[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])])
    tokens, ids, sizes = tokens[fresh], ids[fresh], sizes[fresh]
    edges = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
        if (hi - lo) * 100 >= int(sizes[lo]) * percent:
            yield int(ids[lo : lo + 1].view(np.int64)[0]), int(sizes[lo]), tokens[lo:hi].view(np.int64)


def surviving_sets(docs: DataFrame, percent: int = PERCENT, flush: int = FLUSH, share: int = FREQUENT_SHARE, least: int = FREQUENT_LEAST, tokens: int = 0, bucket_tokens: int = BUCKET_TOKENS, split: np.ndarray | None = None, bits: int = 64) -> DataFrame:
    """cls, n, toks: the classes that can have a partner, with their shared tokens from rare to frequent.

    tokens: how many shingles there are; there are as many buckets as keep each at ``bucket_tokens``.

    ``toks`` is ordered by (number of classes, token); the n - size(toks) tokens of no other class come before them all.
    """
    usual = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(usual, -(-tokens // bucket_tokens))
    dealt = lambda df: df.repartition(buckets, "key") if buckets > usual else df  # noqa: E731  the grouping needs no other exchange

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        weight = 0

        def rows() -> pa.RecordBatch:
            ids, sets = np.fromiter(held, np.uint64, len(held)), list(held.values())
            out = list(_pack(ids, np.array([len(s) for s in sets]), sets, buckets, share, least))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACK, strict=True)], schema=_PACK)

        for batch in batches:
            for _, _, ids, _, sets in _sets(batch.column(1), split, bits):
                for cls, tokens in zip(ids.tolist(), sets, strict=True):
                    if len(tokens) and cls not in held:
                        held[cls] = tokens
                        weight += len(tokens)
                if weight >= flush:
                    yield rows()
                    held.clear()
                    weight = 0
                    release()
        if held:
            yield rows()
            held.clear()
        release()

    packed = [f.name for f in _PACK][1:]
    shared = _PACK.append(pa.field("counts", pa.binary()))
    sets = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("toks", pa.list_(pa.int64()))])

    def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def count(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in packed), strict=True))
        out = table_of(list(_shared(table.column("key")[0].as_py(), rows, buckets)), shared)
        release()
        return out

    def merge(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in [*packed, "counts"]), strict=True))
        return table_of(list(_merged(rows, percent)), sets)

    ddl = "key bigint, first bigint, gaps binary, ords binary, ids binary, sizes binary"
    sent = _texts(docs).mapInArrow(send, ddl)
    counted = dealt(sent).groupBy("key").applyInArrow(count, ddl + ", counts binary")
    return dealt(counted).groupBy("key").applyInArrow(merge, "cls bigint, n bigint, toks array<bigint>")


def _need(n: str, percent: int) -> str:
    """Least overlap of a set of n with any partner."""
    return f"({n} * {percent} + 99) div 100"


def _overlap_ok(o: str, a: str, b: str, percent: int) -> str:
    return f"{o} * {100 + percent} >= ({a} + {b}) * {percent}"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("_na"), F.col("toks").alias("_ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("_nb"), F.col("toks").alias("_tb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_overlap_ok("size(array_intersect(_ta, _tb))", "_na", "_nb", percent)).select("a", "b")


def links(sets: DataFrame, percent: int = PERCENT, block_members: int = BLOCK_MEMBERS, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """Verified links (a, b) between classes that connect all that any links connect."""
    skipped = "(n - size(toks))"
    probe = F.expr(f"greatest(0, n - {_need('n', percent)} + 1 - {skipped})")
    index = F.expr(f"greatest(0, n - ((2 * n * {percent} + {99 + percent}) div {100 + percent}) + 1 - {skipped})")
    rows = sets.select("cls", "n", F.expr(f"{skipped} / n").alias("_own_part"), "toks", index.alias("_index"), F.posexplode(F.slice("toks", F.lit(1), probe)).alias("pos", "tok"))
    # rest: tokens from this one on, the most that a pair can share whose first common token it is
    rest = F.expr("cast(size(toks) - pos as bigint)")
    prefix = stored(rows.select("cls", "n", "_own_part", "tok", rest.alias("rest"), (F.col("pos") < F.col("_index")).alias("short")), "prefix")
    found: DataFrame | None = None
    for r in range(rounds):
        ask = prefix if found is None else prefix.join(found.select(F.col("a").alias("cls")).union(found.select("b")).distinct(), "cls", "left_anti")
        # an original has few tokens of its own, its edited copies have more: it leads first; then whoever the hash says
        orders = [F.struct("_own_part", "cls")] if r == 0 else [F.struct(F.xxhash64(F.lit(r * 100 + k), "cls").alias("o"), "cls") for k in range(4)]
        lead = prefix.where("short").groupBy("tok").agg(F.array(*[F.min(o)["cls"] for o in orders]).alias("_lead"))
        said = ask.join(lead, "tok").select(F.col("cls").alias("a"), F.explode(F.array_distinct("_lead")).alias("b")).where("a <> b")
        rank = Window.partitionBy("a").orderBy(F.col("count").desc(), "b")
        best = said.groupBy("a", "b").count().withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= len(orders)).select("a", "b")
        new = _verified(best, sets, percent)
        found = stored(new if found is None else found.union(new), f"links{r}")
    groups = components(found).select(F.col("node").alias("cls"), F.col("label").alias("grp"))
    load = groups.join(sets.select("cls", F.size("toks").alias("_t")), "cls").groupBy("grp").agg(F.count("*").alias("_count"), F.sum("_t").alias("_t"))
    sizes = load.select("grp", F.greatest(F.col("_count") / F.lit(block_members), F.col("_t") / F.lit(BLOCK_TOKENS)).alias("_blocks"))
    groups = salted_lookup(groups, sizes, "grp", "cls")
    member = sets.join(groups, "cls", "left").select("cls", "n", "toks", F.coalesce("grp", "cls").alias("grp"), F.coalesce("_blocks", F.lit(1.0)).alias("_blocks"))
    blocks = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.ceil("_blocks")))
    names = stored(member.select("cls", "n", "grp", blocks.cast("int").alias("block")), "groups")
    # prefix tokens that more than one group has, and the cells (token, block) of the matrix there
    known = prefix.join(names.drop("n"), "cls")
    mixed = known.groupBy("tok").agg(F.min("grp").alias("_g0"), F.max("grp").alias("_g1")).where("_g0 <> _g1").select("tok")
    known = stored(known.join(mixed, "tok", "left_semi"), "mixed")
    cells = known.where("short").groupBy("tok", "grp").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest").alias("most"))
    asks = known.select("tok", "cls", "n", "rest", F.col("grp").alias("_own"))
    close = _overlap_ok("least(rest, most)", "n", f"greatest(n0, {_need('n', percent)})", percent)
    meet = asks.join(cells, "tok").where(f"_own <> grp and n >= n0 and n * {percent} <= n1 * 100 and {close}")
    meet = stored(meet.groupBy("cls", "grp").agg(F.first("n").alias("n")), "meetings")
    meet = meet.join(names.select("grp", "block").distinct(), "grp")
    # unions of the blocks that are met
    met = meet.select("grp", "block").distinct()
    inside = names.join(met, ["grp", "block"], "left_semi")
    inside = inside.join(sets.select("cls", "toks"), "cls")
    union = inside.groupBy("grp", "block").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("_union"), F.min("n").alias("_least"))
    bounded = meet.join(union, ["grp", "block"]).join(sets.select("cls", F.col("toks").alias("_mine")), "cls")
    least = f"greatest(_least, {_need('n', percent)})"
    opened = bounded.where(_overlap_ok("size(array_intersect(_mine, _union))", "n", least, percent)).select("cls", "n", "grp", "block")
    members = names.select(F.col("cls").alias("b"), F.col("n").alias("_nb"), "grp", "block")
    pairs = opened.join(members, ["grp", "block"]).where(f"_nb <= n and n * {percent} <= _nb * 100").select(F.col("cls").alias("a"), "b")
    across = _verified(pairs, sets, percent)
    return found.union(stored(across, "across"))


def near_components(docs: DataFrame, percent: int = PERCENT, bits: int = 64, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set) and component_id, the least doc_id that links reach.

    Defined results: a document without words (null, empty or white space) has an empty set and links with nothing, not
    even another such; one with fewer than five words has its whole sequence as one shingle; repeated rows are equal
    and link; an empty table gives no rows. Groups of copies are one class; the joins back to the documents are salted.
    Rows that share a doc_id with different texts are documents of their own. Very long texts are whole. Extra columns
    are ignored, whatever their names.
    """
    knobs = {k: options.pop(k) for k in ("flush", "share", "least", "bucket_tokens") if k in options}
    rows, first, split = _counted(docs, bits)
    tokens = rows.agg(F.sum("n_shingles")).first()[0] or 0
    sets = stored(surviving_sets(docs, percent, tokens=tokens, split=split, bits=bits, **knobs), "sets")
    edges = stored(links(sets, percent, **options), "all_links")
    labels = components(edges).select(F.col("node").alias("cls"), "label")
    first = first.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    ids = first.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    by_class = salted_lookup(first.select("cls", "label"), ids.select("label", "component_id"), "label", "cls").where("component_id is not null")
    out = salted_lookup(rows.drop("chk"), by_class.select("cls", "component_id"), "cls", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the least id of each component, with all its columns. Rows that share a doc_id are one document."""
    return keep_by_id(docs, near_components(docs, **options).where("doc_id <=> component_id").select("doc_id").distinct())
