"""Jaccard join of shingle sets by token-combination prefixes.

Shingles (the tokens) are in two classes: frequent ones, which many unlike documents share, and rare
ones.  The global order puts rare before frequent, by hash within a class.  A document indexes the first
p = n - ceil(t * n) + 1 rare tokens singly; if it has only r < p, its prefix is extended by p - r + 1
frequent ones, of which it indexes every combination of two.  Any two sets with Jaccard >= t then share an
indexed key: at most p - 1 tokens of the prefix that ends first are not in the other set, so either one rare token is shared
or two frequent ones are.

Candidates are verified on whole sets.  First every document is compared with the centres of the keys it
has; the links found give components.  Then the documents of different components that still share keys are
compared: they meet once for each hub of their keys (not for each key) and only if the keys shared there leave the
threshold in reach.  So large groups of copies cost a few comparisons each, and no link that joins two components is
lost.  Equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WORD, free, mix64, random_table, repeat_filter, small_batches, steps, texts_of, tidy, word_hashes, written
from .components import components

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: A token is frequent if documents with more than so many different least shingles hold it; at most so many tokens are.
SPREAD, MAX_FREQUENT = 12, 1 << 19
#: Nodes of a hub that meet in blocks of about so many.
HUB_BLOCK = 256
#: Copies of a hub's row, each of which meets its share of the nodes.
HUB_SALTS = 16
COEFFICIENTS = random_table(SHINGLE, 11) | U(1)
SHORT = random_table(SHINGLE, 12)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text, A-Z lower-cased; of fewer words, of the whole sequence; none without words."""
    words, first = word_hashes([t.lower() for t in texts])
    n = len(words)
    whole = np.zeros(max(0, n - SHINGLE + 1), U)
    for j in range(SHINGLE):
        whole += mix64(words[j : n - SHINGLE + 1 + j]) * COEFFICIENTS[j] if len(whole) else whole
    whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(whole[a : b - SHINGLE + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else s[np.concatenate(([True], new))])
        elif b > a:
            out.append(mix64((mix64(words[a:b]) * COEFFICIENTS[: b - a]).sum(keepdims=True) + SHORT[b - a]))
        else:
            out.append(np.zeros(0, U))
    return out


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _prefix_length(n):
    """prefix_length of a column."""
    return n - F.ceil(n * NUMERATOR / float(DENOMINATOR) - 1e-9) + 1


def prefix_keys(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a set indexes, and each one's place among the set's tokens (-1 for combinations)."""
    p = prefix_length(len(s))
    if not len(s):
        return s, np.zeros(0, np.int32)
    if not len(frequent):
        return s[:p], np.arange(p, dtype=np.int32)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    rare = s[~often][:p]
    if len(rare) == p:
        return rare, np.arange(p, dtype=np.int32)
    f = s[often][: p - len(rare) + 1]
    i, j = np.triu_indices(len(f), 1)
    pairs = mix64(f[i] * COEFFICIENTS[0] + mix64(f[j]) * COEFFICIENTS[1])
    return np.concatenate((rare, pairs)), np.concatenate((np.arange(len(rare)), np.full(len(pairs), -1))).astype(np.int32)


def _sets(batch, column: int = 1):
    texts = texts_of(batch.column(column))
    for i, j in steps(texts):
        yield i, shingle_sets(texts[i:j])


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def frequent_tokens(docs: DataFrame, flush: int = 2_000_000) -> np.ndarray:
    """Sorted tokens of the frequent class, MAX_FREQUENT at most (those in most documents).

    The class only decides which index a token is in: any choice gives the same links.
    A task reports tokens that repeat within its flush, with up to 2 * SPREAD of the documents' least tokens:
    near copies mostly agree in it, documents that share no more than a passage do not.
    """

    def emit(batches):
        held, least, seen, n = [], [], set(), 0

        def out():
            u, m = np.concatenate(held), np.concatenate(least)
            held.clear(), least.clear()
            order = np.lexsort((m, u))
            u, m = u[order], m[order]
            new = np.concatenate(([True], (u[1:] != u[:-1]) | (m[1:] != m[:-1])))
            count = np.diff(np.append(np.flatnonzero(new), len(u)))
            u, m = u[new], m[new]
            begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            size = np.diff(np.append(begin, len(u)))
            place = np.arange(len(u)) - np.repeat(begin, size)
            total = np.repeat(np.add.reduceat(count, begin), size)
            keep = (place < 2 * SPREAD) & (total > 1)
            bucket = (u[keep] >> U(56)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(1, 256))
            rows = [(b, x.tobytes(), y.tobytes()) for b, (x, y) in enumerate(zip(np.split(u[keep], cut), np.split(m[keep], cut), strict=True)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "tokens", "least"])

        for batch in batches:
            for _, found in _sets(batch):
                for s in found:
                    if len(s) and (key := _node(s)) not in seen:
                        if len(seen) < 200_000:
                            seen.add(key)
                        p = prefix_length(len(s))
                        held.append(s[:p])
                        least.append(np.full(p, s[0]))
                        n += p
                if n >= flush:
                    yield out()
                    n = 0
        if n:
            yield out()

    def reduce(key, table):
        u = np.concatenate([np.frombuffer(x, U) for x in table["tokens"].to_pylist()])
        m = np.concatenate([np.frombuffer(x, U) for x in table["least"].to_pylist()])
        order = np.lexsort((m, u))
        u, m = u[order], m[order]
        new = np.concatenate(([True], (u[1:] != u[:-1]) | (m[1:] != m[:-1])))
        begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        spread, sent = np.add.reduceat(new.astype(np.int64), begin), np.diff(np.append(begin, len(u)))
        keep = (spread > SPREAD) & (2 * spread > sent)
        return pa.table({"token": pa.array(u[begin][keep].view(np.int64)), "spread": pa.array(spread[keep])})

    sent = docs.select("doc_id", "text").mapInArrow(tidy(emit), "bucket int, tokens binary, least binary")
    found = written(sent.groupBy("bucket").applyInArrow(reduce, "token bigint, spread bigint"), "frequent")
    top = found.orderBy(F.desc("spread"), "token").limit(MAX_FREQUENT).select("token").toArrow()["token"].to_numpy()
    return np.sort(top.view(U)) if len(top) else np.zeros(0, U)


def _similar(n: str, m: str, r: str, q: str):
    """Whether sets of n and m tokens, of which r and q are in other sets too, can reach the threshold at all."""
    return (NUMERATOR * F.greatest(n, m) <= DENOMINATOR * F.least(n, m)) & ((DENOMINATOR + NUMERATOR) * F.least(r, q) >= NUMERATOR * (F.col(n) + F.col(m)))


def _least_shared(n: str, m: str, after: str):
    """How many tokens of their prefixes, rare tokens only, sets of n and m must share to reach the threshold if the prefix that `after` common tokens follow ends first.

    That prefix holds all that the sets share up to its end.
    """
    return F.ceil(NUMERATOR * (F.col(n) + F.col(m)) / F.lit(float(NUMERATOR + DENOMINATOR)) - 1e-9) - F.col(after)


def _enough(shared: str, n: str, m: str, after: str, after_m: str):
    """Whether sets of n and m tokens whose prefixes, rare tokens only, share so many can reach the threshold.

    Which prefix ends first does not show here, so one of both bounds must hold.
    """
    return F.col(shared) >= F.least(_least_shared(n, m, after), _least_shared(n, m, after_m))


def _judge(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each pair (a, b) of nodes: how many tokens the whole sets share, whether that reaches the threshold, and the tokens that only a or only b has."""

    def keys(batch):
        for c in batch.columns:
            yield np.frombuffer(b"".join(x[:8] for x in c.to_pylist()), ">u8").astype(U)

    wanted = repeat_filter(pairs.select("a", "b"), keys, least=1)

    def emit(batches):
        seen = set()
        for batch in batches:
            for _, found in _sets(batch):
                nodes = [_node(s) for s in found]
                hit = wanted.value(np.frombuffer(b"".join(x[:8] for x in nodes), ">u8").astype(U)) if nodes else []
                rows = []
                for node, s, h in zip(nodes, found, hit, strict=True):
                    if h and len(s) and node not in seen:
                        if len(seen) < 200_000:
                            seen.add(node)
                        rows.append((node, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["node", "tokens"])

    sets = written(docs.select("doc_id", "text").mapInArrow(tidy(emit), "node binary, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def check(batches):
        for batch in batches:
            counts, linked, only = [], [], ([], [])
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.sort(np.concatenate((u, v)))
                both = both[:-1][both[1:] == both[:-1]]
                common = len(both)
                for held, w in zip(only, (u, v), strict=True):
                    held.append(np.setdiff1d(w, both, assume_unique=True).view(np.int64))
                counts.append(common)
                linked.append(DENOMINATOR * common >= NUMERATOR * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(linked, pa.bool_()), *(pa.array(held, pa.list_(pa.int64())) for held in only)], ["a", "b", "shared", "linked", "only_a", "only_b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a binary, b binary, shared bigint, linked boolean, only_a array<bigint>, only_b array<bigint>")


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def index_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null for an empty one), common, the repeating keys and text_key (xxhash64 of the text) of every row, as a table.

    common is at least the number of the set's tokens that other sets hold too: those that pass the repeat filter.
    Two sets share no more than the lesser of their two.  A full filter only makes it a weaker bound.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(docs))

    def keys(batch):
        for _, found in _sets(batch):
            # equal sets in a step count once
            for s in {_node(s): s for s in found}.values():
                k, at = prefix_keys(s, frequent.value)
                yield np.concatenate((s, k[at < 0]))

    repeats = repeat_filter(docs, keys)

    def emit(batches):
        for batch in batches:
            n, nodes, common, keys_, whole = [], [], [], [], []
            for _, found in _sets(batch):
                for s in found:
                    k, at = prefix_keys(s, frequent.value)
                    again = int(repeats.value(s).sum()) if len(s) else 0
                    # a set of which under the threshold's share is anywhere else has no link to another set
                    hit = repeats.value(k) if DENOMINATOR * again >= NUMERATOR * len(s) and len(s) else np.zeros(len(k), bool)
                    n.append(len(s))
                    common.append(again)
                    nodes.append(_node(s) if len(s) else None)
                    keys_.append(k[hit].view(np.int64))
                    whole.append(bool((at >= 0).all()) and len(at) == (prefix_length(len(s)) if len(s) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(common, pa.int64()), pa.array(keys_, pa.list_(pa.int64())), pa.array(whole, pa.bool_()), batch.column(2)], ["doc_id", "n_shingles", "node", "common", "keys", "whole", "text_key"])

    return written(docs.mapInArrow(tidy(emit), "doc_id bigint, n_shingles bigint, node binary, common bigint, keys array<bigint>, whole boolean, text_key bigint"), "shingles")


def _meetings(open_: DataFrame, judged: DataFrame) -> DataFrame:
    """Pairs of nodes (the lesser first) of different components that share a key, a row for each hub of such keys with the number of keys shared there.

    open_ has key, node, n, common, after, whole, component, hub.  All keys that two nodes share are in it, and each key has one
    hub, so at another hub a pair shares at most what either node has there.  A pair that is left out at some hub for
    sharing too little can't reach the threshold.  Where both were compared with the hub's set, what they share is
    bounded too (inside that set by the lesser of what they share with it, outside by their other common tokens), and
    then counted from their differences from it.  Nodes of a hub's largest component meet only the others, so a large group
    is not joined with itself.  A list of keys is no longer than one document's prefix.
    """
    lists = open_.groupBy("hub", "node").agg(F.first("n").alias("n"), F.first("common").alias("common"), F.first("after").alias("after"), F.first("whole").alias("whole"), F.first("component").alias("component"), F.collect_list("key").alias("keys"))
    every = open_.groupBy("node").agg(F.count(F.lit(1)).alias("every"))
    lists = lists.join(every, "node").withColumn("elsewhere", F.col("every") - F.size("keys")).drop("every")
    lists = lists.withColumns({"a": F.least("hub", "node"), "b": F.greatest("hub", "node")}).join(judged.select("a", "b", "shared", "only_a", "only_b"), ["a", "b"], "left")
    none, hub_first = F.array().cast("array<bigint>"), F.col("a") == F.col("hub")
    lists = lists.withColumn("missing", F.when(F.col("hub") == F.col("node"), none).when(hub_first, F.col("only_a")).otherwise(F.col("only_b")))
    lists = lists.withColumn("extra", F.when(F.col("hub") == F.col("node"), none).when(hub_first, F.col("only_b")).otherwise(F.col("only_a")))
    lists = written(lists.withColumn("inside", F.when(F.col("hub") == F.col("node"), F.col("n")).otherwise(F.col("shared"))).drop("a", "b", "shared", "only_a", "only_b"), "lists")
    largest = lists.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("hub").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.ceil(F.sum("m") / F.lit(float(HUB_BLOCK))).cast("int").alias("blocks"))
    # a hub's row in copies, so that no task has all nodes of a large hub
    copies = largest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(HUB_SALTS)).cast("int"))
    lists = written(salted.join(copies, ["hub", "salt"]).drop("salt").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "lists")

    def side(s: str) -> DataFrame:
        # the nodes of a large hub are in blocks, and every block of one side meets every block of the other in a task of its own
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return lists.select("hub", *([F.col("block").alias("block_x"), other.alias("block_y")] if s == "x" else [other.alias("block_x"), F.col("block").alias("block_y")]), *(F.col(a).alias(f"{b}_{s}") for a, b in (("node", "node"), ("n", "n"), ("common", "r"), ("after", "after"), ("whole", "w"), ("component", "c"), ("keys", "keys"), ("elsewhere", "else"), ("inside", "in"), ("missing", "missing"), ("extra", "extra"))), *(["largest"] if s == "x" else []))

    shared = F.size(F.array_intersect("keys_x", "keys_y"))
    least = F.least(*(_least_shared("n_x", "n_y", f"after_{s}") - F.col(f"else_{s}") for s in "xy"))
    met = side("x").where("c_x != largest").join(side("y"), ["hub", "block_x", "block_y"]).where((F.col("c_y") == F.col("largest")) | (F.col("c_x") < F.col("c_y"))).where("c_x != c_y")
    outside = F.least(*(F.greatest(F.col(f"r_{s}") - F.col(f"in_{s}"), F.lit(0)) for s in "xy"))
    most = F.when(F.col("in_x").isNotNull() & F.col("in_y").isNotNull(), F.least("in_x", "in_y") + outside).otherwise(F.least("r_x", "r_y"))
    met = met.where(_similar("n_x", "n_y", "r_x", "r_y")).where((DENOMINATOR + NUMERATOR) * most >= NUMERATOR * (F.col("n_x") + F.col("n_y"))).where(shared >= F.when(F.col("w_x") & F.col("w_y"), F.greatest(least, F.lit(1))).otherwise(1))
    # both as differences from the hub's set, that is exact
    exact = F.col("in_x") + F.size("missing_x") - F.size(F.array_union("missing_x", "missing_y")) + F.size(F.array_intersect("extra_x", "extra_y"))
    met = met.where(F.col("in_x").isNull() | F.col("in_y").isNull() | ((DENOMINATOR + NUMERATOR) * exact >= NUMERATOR * (F.col("n_x") + F.col("n_y"))))
    # which node is x differs by hub: one order for all hubs, so that a pair's rows can be added up
    in_order = F.col("node_x") < F.col("node_y")
    ordered = (F.when(in_order, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{o}")).alias(f"{c}_{s}") for c in ("node", "n", "after", "w") for s, o in ("xy", "yx"))
    return met.select(*ordered, shared.cast("bigint").alias("shared"))


def node_components(table: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component of all nodes that have a link."""
    nodes = table.where("node is not null and size(keys) > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("common").alias("common"), F.first("whole").alias("whole"), F.first("keys").alias("keys"))
    nodes = nodes.withColumn("after", F.col("common") - F.size("keys"))  # common tokens after the prefix

    rows = written(nodes.select("node", "n", "common", "after", "whole", F.explode("keys").alias("key")), "keys")

    # the centre of a key is its document with the most widespread keys: of a group of edited copies, the one nearest to all others
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    weight = rows.join(many, "key").groupBy("node").agg((F.sum("m") / _prefix_length(F.first("n"))).alias("weight"))
    chosen = rows.join(written(weight, "weights"), "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n", "common")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    centres = written(chosen.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), F.col("c.common").alias("cr")), "centres")
    near = rows.join(centres, "key").where("node != centre").where(_similar("n", "cn", "common", "cr"))
    pairs = written(near.select(*_ordered("node", "centre")).distinct(), "pairs")
    judged = written(_judge(pairs, docs), "judged")
    first = written(components(judged.where("linked")), "components")

    # what is left: keys whose documents are in several components
    placed = rows.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    mixed = written(mixed.join(centres, "key").select("key", F.col("centre").alias("hub")), "mixed")
    met = _meetings(placed.join(mixed, "key"), judged)
    met = met.groupBy("node_x", "node_y", "n_x", "n_y", "after_x", "after_y", "w_x", "w_y").agg(F.sum("shared").alias("shared"))
    met = met.where(~(F.col("w_x") & F.col("w_y")) | _enough("shared", "n_x", "n_y", "after_x", "after_y"))
    rest = met.select(*_ordered("node_x", "node_y")).join(pairs, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    more = written(_judge(rest, docs).where("linked").select("a", "b"), "more")
    if more.isEmpty():
        return first
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _placed(table: DataFrame, docs: DataFrame) -> DataFrame:
    """own (least doc_id), node, component of every node."""
    found = node_components(table, docs)
    own = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"))
    return own.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts without words (null, empty) are linked with nothing; component_id is then the row's doc_id.
    Equal sets are linked; a row with a null id takes part by its text, and gives null where no other row of its
    component has an id.  Repeated rows each give a row.  An empty table gives an empty result; other
    columns are not read.
    """
    small_batches(docs)
    table = index_documents(docs)
    with_component = _placed(table, docs)
    least = with_component.groupBy("component").agg(F.min("own").alias("component_id"))
    ids = written(with_component.join(least, "component").select("node", "component_id"), "component-ids")
    return (
        table.select("doc_id", "n_shingles", "node")
        .join(ids, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component of linked texts the row with the least (doc_id, text), null ids last.

    Rows are told apart by id and text, so a text stays if only other texts of its id have copies.  Rows alike in both are
    copies of each other, and the first in order of the other columns stays.  Texts without words (null, empty) are copies
    of nothing: all their rows stay.  An empty table gives an empty result.
    """
    small_batches(docs)
    table = index_documents(docs)
    placed = _placed(table, docs).select("node", "component")
    rows = table.where("node is not null").groupBy("node", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("alike"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "alike")
    first = rows.join(placed, "node").groupBy("component").agg(F.min(order).alias("first"))
    p = free(docs, "first_")
    first = written(first.select(F.col("first.doc_id").alias(f"{p}id"), F.col("first.text_key").alias(f"{p}key"), F.col("first.alike").alias(f"{p}alike")), "firsts")
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    key = free(docs, "text_key")
    d = docs.where(has_words).withColumn(key, F.xxhash64("text"))
    found = d.join(first, d["doc_id"].eqNullSafe(first[f"{p}id"]) & (F.col(key) == F.col(f"{p}key")))
    alone = found.where(F.col(f"{p}alike") == 1).select(*docs.columns)
    # rows alike in id and text: partial minima, so a group of any size is a row for each task
    one = found.where(F.col(f"{p}alike") > 1).groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return docs.where(~has_words).unionByName(alone).unionByName(one)
