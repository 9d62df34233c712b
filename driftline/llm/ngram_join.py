"""N-gram Jaccard self-join with several global token orders.

A document is the set of its distinct k-word shingles.  Two sets of Jaccard
similarity at least t share a token among the first n - ceil(t*n) + 1 of each,
under any one order of all tokens.  Documents with equal sets form a class;
classes are the nodes of the join.

1. Frequencies: documents are dealt into buckets; buckets exchange their token
   hashes in blocks and learn, for each token that occurs in another text too,
   in how many.  All orders put rare tokens first.  Tokens of one text only can
   match nothing, so a text whose prefix holds no others takes no further part.
2. First order: frequency, then hash.  Prefix tokens meet by token; a token
   shared by few nodes gives all their pairs, one shared by many gives pairs
   with its smallest node only.  How many prefix tokens a pair shares bounds
   its overlap; pairs below the bound go.
3. The pairs' prefixes under two more orders (frequency, then other hashes)
   must share enough tokens as well: the filters are intersected before
   anything is verified.
4. Survivors are verified by exact set intersection; links give components.
5. Tokens shared by many nodes: a star may miss links between members that are
   too far from its hub.  Where such a token's nodes lie in several components,
   they are compared block against block, only where sizes allow a link; a block
   pair gives spanning links, never its pairs.  Groups whose star links hold need
   no second look.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import buckets as B
from driftline.llm import kernels as K
from driftline.llm.common import cut, join_per_key
from driftline.llm.components import components, spanning

#: Nodes of a token up to which all pairs are formed.
SMALL = 16
#: Nodes that are compared with as many others at a time, and tokens that are compared at a time.
BLOCK = 256
COLUMNS = 8192
#: Bytes of text for each token, at least.
WORD_BYTES = 6
#: Seeds of the second and third order.
ORDER_SEEDS = (0x51ED270B7F4A7C15, 0xA24BAED4963EE407)
#: Bits of a token that buckets exchange.  Tokens that agree on them count as one in frequencies,
#: which only shape the orders.
_HASH = np.uint64(0xFFFFFFFFFFFF0000)


@dataclass(frozen=True)
class Rule:
    """Shingle length and similarity as a fraction: intersection * of >= least * union."""

    k: int = 4
    least: int = 85
    of: int = 100


def prefix_length(n: np.ndarray, rule: Rule) -> np.ndarray:
    """n - ceil(t*n) + 1 for sets of size n > 0, else 0."""
    return np.where(n > 0, n - (-(-n * rule.least // rule.of)) + 1, 0)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, row of each, set sizes): each row's distinct shingle hashes, ascending."""
    rows = len(off) - 1
    start, end, row = K.spans(data, off)
    words = K.span_hashes(K.prefix_sums(data), start, end)
    token, row = K.shingles(words, row, rows, k)
    token, row = K.distinct_by_row(token, row, rows)
    return token, row, np.bincount(row, minlength=rows)


def set_keys(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums per row; equal sets have equal keys."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(token ^ np.uint64(seed)), dtype=np.uint64)])
        out.append((c[ends[1:]] - c[ends[:-1]]).view(np.int64))
    return out[0], out[1]


def frequency_class(count: np.ndarray) -> np.ndarray:
    """0 for a token of one text, then steps of an eighth of a doubling, at most 255."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(count, 1)))).astype(np.uint64)


def _exchange(source: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Rows of ``buckets.SENT`` per bucket: the hashes of its tokens that occur in several texts, each
    block followed by the tokens' frequency classes."""

    def send(table: pa.Table) -> pa.Table:
        tokens = [shingle_sets(data, off, rule.k)[0] & _HASH for _, _, data, off in B.Bucket(table).slices()]
        token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_counts=True)
        payload = np.zeros(len(token), [("t", "<u8"), ("c", "u1")])
        payload["t"], payload["c"] = token, np.minimum(count, 255)
        return B.blocks(token, payload, parts, table.column("bucket")[0].as_py(), lambda p: p["c"].tobytes() + B.pack_sorted(p["t"]))

    def meet(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        raw = table.column("block").to_pylist()
        token = np.concatenate([B.unpack_sorted(b[n:]) for b, n in zip(raw, sizes.tolist(), strict=True)])
        count = np.concatenate([np.frombuffer(b, np.uint8, n) for b, n in zip(raw, sizes.tolist(), strict=True)]).astype(np.int64)
        by = np.argsort(token, kind="stable")
        start = B.runs(token[by])
        total = np.empty(len(token), np.int64)
        total[by] = np.repeat(np.add.reduceat(count[by], start), np.diff(np.append(start, len(by))))
        out, kept = [], []
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            several = total[a:b] > 1
            out.append(frequency_class(total[a:b][several]).astype(np.uint8).tobytes() + B.pack_sorted(token[a:b][several]))
            kept.append(int(several.sum()))
        return pa.table([table.column("part").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(kept, pa.int32()), pa.array(out, pa.binary())], schema=B.SENT)

    sent = source.groupBy("bucket").applyInArrow(K.released(send), B.SENT_DDL)
    return sent.groupBy("part").applyInArrow(K.released(meet), B.SENT_DDL).filter("n > 0")


_NODE_DDL = "id long, bucket int, n long, node long, check long, several int, first array<long>, second array<long>, third array<long>, tokens array<long>"


def nodes(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, n, node, check, several, first, second, third, tokens) of each row.

    ``several`` counts the tokens that occur in other texts too; ``first`` to ``third`` are the prefixes under the three orders without tokens of one text, and
    ``tokens`` the whole set; they are there once per distinct text of a bucket, and only if enough
    of its tokens occur elsewhere for a link."""
    source, _, total = B.deal(docs, id_col, text_col)
    known = _exchange(source, rule, B.parts_for(total, WORD_BYTES))

    def build(texts: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = B.Bucket(texts)
        raw = list(zip(replies.column("block").to_pylist(), replies.column("n").to_pylist(), strict=True))
        shared = np.concatenate([np.zeros(0, np.uint64), *(B.unpack_sorted(b[n:]) for b, n in raw)])
        level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8, n) for b, n in raw)])
        by = np.argsort(shared, kind="stable")
        shared, level = shared[by], level[by]
        sizes_of, node_of, check_of = (np.zeros(len(bucket.rows), np.int64) for _ in range(3))
        lists: dict[int, list[np.ndarray]] = {}
        for lo, hi, data, off in bucket.slices():
            token, row, sizes = shingle_sets(data, off, rule.k)
            node, check = set_keys(token, sizes)
            sizes_of[lo:hi], node_of[lo:hi], check_of[lo:hi] = sizes, node, check
            own = np.zeros(len(token), np.uint64)
            if len(shared) and len(token):
                place = np.minimum(np.searchsorted(shared, token & _HASH), len(shared) - 1)
                own = np.where(shared[place] == token & _HASH, level[place], 0).astype(np.uint64)
            several = np.bincount(row[own > 0], minlength=hi - lo)
            open_ = np.flatnonzero((sizes > 0) & (several * rule.of >= sizes * rule.least))
            ends = np.cumsum(sizes)
            for r in open_.tolist():
                a, b = int(ends[r] - sizes[r]), int(ends[r])
                first = int(prefix_length(sizes[r : r + 1], rule)[0])
                high = own[a:b] << np.uint64(56)
                orders = []
                for seed in (0, *ORDER_SEEDS):
                    value = high | (K.mix(token[a:b] ^ np.uint64(seed)) if seed else token[a:b]) >> np.uint64(8)
                    value.sort()
                    value = value[:first]
                    orders.append(value[value >> np.uint64(56) > 0])
                lists[lo + r] = [int(several[r]), *orders, token[a:b]]
        at = bucket.text_of
        once = np.full(len(bucket.rows), -1)
        once[at[::-1]] = np.arange(len(at))[::-1]  # the first row of each text carries its lists
        bearer = [lists.get(int(k)) if once[k] == i else None for i, k in enumerate(at.tolist())]
        columns = [pa.array([None if x is None else x[0] for x in bearer], pa.int32())]
        columns += [pa.array([None if x is None else x[j].view(np.int64) for x in bearer], pa.list_(pa.int64())) for j in range(1, 5)]
        return pa.table([bucket.id_column, texts.column("bucket"), pa.array(sizes_of[at]), pa.array(node_of[at]), pa.array(check_of[at]), *columns], names=["id", "bucket", "n", "node", "check", "several", "first", "second", "third", "tokens"])

    return source.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(K.released(build), _NODE_DDL)


def _can_link(na: Column, sa: Column, nb: Column, sb: Column, rule: Rule) -> Column:
    """Whether sizes, and numbers of tokens that occur elsewhere at all, allow the similarity."""
    sizes = F.least(na, nb) * rule.of >= F.greatest(na, nb) * rule.least
    return sizes & (F.least(sa, sb) * (rule.of + rule.least) >= (na + nb) * rule.least)


def _overlap_fits(na: Column, nb: Column, shared: Column, rule: Rule) -> Column:
    """Whether ``shared`` common prefix tokens allow the overlap: what lies behind the prefix that
    ends first can add its own length at most."""
    behind = F.ceil(F.greatest(na, nb) * rule.least / rule.of) - 1
    return (shared + behind) * (rule.of + rule.least) >= (na + nb) * rule.least


def _pairs(shared: DataFrame, rule: Rule) -> DataFrame:
    """Distinct (a, b), a < b, that can be similar: all pairs of tokens with few nodes, stars of the
    others.  The common prefix tokens of a pair are the small tokens that gave it and, at most, the
    lesser of its nodes' numbers of tokens with many nodes."""
    large = shared.filter(F.col("shared_by") > SMALL)
    members = shared.filter(F.col("shared_by") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n", "s"))).alias("m"))
    ok = lambda x, y: (x["node"] < y["node"]) & _can_link(x["n"], x["s"], y["n"], y["s"], rule)
    nested = F.transform("m", lambda x: F.transform(F.filter("m", lambda y: ok(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb"))))
    small = members.select(F.explode(F.flatten(nested)).alias("p")).select("p.*", F.lit(1).alias("c"))
    hub = F.col("hub")
    star = large.filter((F.col("node") != hub["node"]) & _can_link(F.col("n"), F.col("s"), hub["n"], hub["s"], rule)).select(hub["node"].alias("a"), F.col("node").alias("b"), hub["n"].alias("na"), F.col("n").alias("nb"), F.lit(0).alias("c"))
    counted = small.union(star).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    many = large.groupBy("node").agg(F.count("*").alias("many"))
    counted = counted.join(many.select(F.col("node").alias("a"), F.col("many").alias("many_a")), "a", "left").join(many.select(F.col("node").alias("b"), F.col("many").alias("many_b")), "b", "left")
    bound = F.col("c") + F.least(F.coalesce("many_a", F.lit(0)), F.coalesce("many_b", F.lit(0)))
    return counted.filter(_overlap_fits(F.col("na"), F.col("nb"), bound, rule)).select("a", "b")


def _links(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose further prefixes share enough and whose sets are similar enough.  A hub is the
    first of many pairs, so their joins with it are spread."""
    per_a = pairs.groupBy("a").agg(F.count("*").alias("pairs"))

    def with_sides(found: DataFrame, *columns: str) -> DataFrame:
        named = lambda x: held.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return join_per_key(found, named("a").join(per_a, "a"), "a", "pairs").drop("pairs").join(named("b"), "b")

    both = with_sides(pairs, "n", "second", "third")
    enough = lambda x: _overlap_fits(F.col("n_a"), F.col("n_b"), F.size(F.array_intersect(f"{x}_a", f"{x}_b")), rule)
    both = with_sides(both.filter(enough("second") & enough("third")).select("a", "b"), "tokens")
    common = F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")
    return both.withColumn("common", common).filter(F.col("common") * rule.of >= (F.size("tokens_a") + F.size("tokens_b") - F.col("common")) * rule.least).select("a", "b")


def _crowds(placed: DataFrame, mixed: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """Verified links (a, b) between nodes that share a token of many nodes but no component.

    ``placed``: (token, node, root) of tokens of many nodes; ``mixed``: (token, same) of those with
    several roots, of each set of nodes one token.  A token's nodes fall into bands of sizes, as
    wide as the similarity allows, so only nodes of one band or of neighbours can link.  A band is
    dealt into blocks by a hash, and blocks are compared in pairs; no node is numbered or sorted.
    Links of a block pair are reduced to spanning ones."""
    width = -math.log(rule.least / rule.of) * (1 + 1e-9)  # sizes that can link are never two bands apart
    band = F.floor(F.log("n") / width).cast("int")
    meeting = join_per_key(placed, mixed, "token").select("token", "node", "root").join(held.select("node", band.alias("band")), "node")
    bands = meeting.groupBy("token", "band").agg(F.count("*").alias("n")).withColumn("of", F.struct("token", "band"))
    dealt = join_per_key(meeting.select(F.struct("token", "band").alias("of"), "node", "root"), bands.select("of", "n"), "of")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = cut(dealt.select("of.token", "of.band", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "root"))
    span = members.groupBy("token", "band", "block").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    lo = span.select("token", F.col("band").alias("band_lo"), F.col("block").alias("lo"), F.col("first").alias("first_lo"), F.col("last").alias("last_lo"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    hi = span.withColumnRenamed("block", "hi")
    several = F.least("first", "first_lo") < F.greatest("last", "last_lo")
    tasks = lo.join(hi, ["token", "band"]).filter(((F.col("band") > F.col("band_lo")) | (F.col("lo") <= F.col("hi"))) & several)
    keys = ["token", "band_lo", "lo", "band_hi", "hi"]
    tasks = tasks.withColumnRenamed("band", "band_hi").select(*keys)
    side = lambda at: tasks.select(*keys, F.col(f"band_{at}").alias("band"), F.col(at).alias("block"))
    sides = members.join(side("lo").union(side("hi")).distinct(), ["token", "band", "block"])

    def verify(table: pa.Table) -> pa.Table:
        node, root, band, block = (table.column(c).to_numpy() for c in ("node", "root", "band", "block"))
        lists = table.column("tokens").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        token, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)[1:]
        common = count > 1
        keep = common[token]
        column, owner = (np.cumsum(common) - 1)[token][keep], np.repeat(np.arange(len(node)), n)[keep]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        first = {c: table.column(c)[0].as_py() for c in keys[1:]}
        a, b = (np.flatnonzero((band == first[f"band_{x}"]) & (block == first[x])) for x in ("lo", "hi"))
        both = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(common.sum()), COLUMNS):
            x, y = np.searchsorted(column, [at, at + COLUMNS])
            has = np.zeros((len(node), COLUMNS), np.float32)
            has[owner[x:y], column[x:y] - at] = 1
            both += has[a] @ has[b].T
        both = np.rint(both).astype(np.int64)
        near = (both * rule.of >= (n[a][:, None] + n[b][None, :] - both) * rule.least) & (root[a][:, None] != root[b][None, :])
        label = spanning(near, a, b, len(node))
        own = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": node[own], "b": node[label[own]]})

    found = sides.join(held.select("node", "tokens"), "node").groupBy(*keys).applyInArrow(K.released(verify), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@dataclass
class Joined:
    """``documents``: (id, n, node); ``links``: verified pairs of nodes, enough to give every
    component; ``roots``: (node, root) of linked nodes."""

    documents: DataFrame
    links: DataFrame
    roots: DataFrame


def settled(found: DataFrame) -> DataFrame:
    """``found`` with node keys that tell all sets apart: where different sets have one 64-bit key,
    as a few of 10**10 will, they take keys made from their second one."""
    for turn in range(8):
        classes = found.filter("n > 0").groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("check_to"))
        clashing = cut(classes.filter("check != check_to").select(F.col("node").alias("clashing")))
        if not clashing.limit(1).count():
            return found
        other = F.xxhash64("check", F.lit(turn), "n")
        found = found.join(clashing, F.col("node") == F.col("clashing"), "left").withColumn("node", F.when(F.col("clashing").isNotNull(), other).otherwise(F.col("node"))).drop("clashing")
        found = cut(found)
    raise RuntimeError("keys of sets do not settle")


def similarity_join(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    found = settled(cut(nodes(docs, rule, id_col, text_col)))
    known = found.select("id", "n", "node")

    # one bearer per node: equal sets in several buckets are texts that differ in white space or
    # case, or the salted copies of a hot text
    bearers = found.filter("first is not null").select("node", "id", "bucket")
    several = bearers.groupBy("node").agg(F.min(F.struct("bucket", "id")).alias("keep"), F.count("*").alias("bearers")).filter("bearers > 1")
    held = found.filter("first is not null").select("node", "id", "bucket", F.col("n").cast("int").alias("n"), F.col("several").alias("s"), "first", "second", "third", "tokens")
    if several.limit(1).count():
        held = held.join(several.select("node", "keep"), "node", "left").filter("keep is null or (bucket <=> keep.bucket and id <=> keep.id)").dropDuplicates(["node"])
    held = held.select("node", "n", "s", "first", "second", "third", "tokens")

    posted = held.select("node", "n", "s", F.explode("first").alias("token"))
    met = posted.groupBy("token").agg(F.count("*").alias("shared_by"), F.min(F.struct("node", "n", "s")).alias("hub")).filter("shared_by > 1")
    shared = cut(join_per_key(posted, met, "token", "shared_by"))
    large = shared.filter(F.col("shared_by") > SMALL)
    candidates = cut(_pairs(shared, rule))
    links = cut(_links(candidates, held, rule).distinct())
    roots = components(links)

    placed = cut(large.select("token", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    mixed = cut(tokens.filter("lo < hi").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n"))
    if mixed.limit(1).count():
        more = cut(_crowds(placed, mixed, held, rule).distinct())
        if more.limit(1).count():
            links = links.union(more)
            roots = components(links)
    return Joined(known, links, roots)


def group_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row; ``component_id`` is the smallest id reachable;
    other columns are left out.

    Ids are whole numbers, others are refused (TypeError).  Null and empty texts have an empty set,
    link with nothing and are their own component; a null id gets the smallest id of its component,
    or null alone; repeated rows share a class; ties at the threshold link; an empty table gives no
    rows."""
    joined = similarity_join(docs, rule, id_col, text_col)
    full = joined.documents.filter("n > 0")
    in_class = full.groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    rooted = cut(in_class.join(joined.roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    label = join_per_key(rooted, least, "root", "classes").select("node", "component_id", "copies")
    labelled = join_per_key(full, label, "node", "copies").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = joined.documents.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return labelled.union(empty)
