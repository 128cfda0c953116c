"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens.

A document is the set of its five-word shingles. In each of `runs` repetitions a set picks, at every level, the tokens
whose hash (of run, path and token) lies below 1 / (threshold * size): one token and a quarter on average. Sets that
picked the same path share a bucket; a pair at or above the threshold meets in one with a chance that the runs raise
to the target recall. A bucket that is small enough is compared by brute force on short min-hash sketches. The sets of
larger buckets go on alone: they are signed again, in more runs, and split by their next picks down to the last level,
where what is large is compared in blocks. As every split costs recall, those runs are as many as the target needs if
all buckets are split.

The pairs that look similar are kept as stars, a row for each set and bucket, and joined to candidate groups. The texts
of a group's members then meet once, in bounded blocks, and every pair in it is checked exactly. So links are exact,
no pair is ever a row, and the recall is that of the path search. Texts of other documents never move: a filter of
bounded size (common.passing) tells on the spot which rows may be members.

Sets are told by 64-bit hashes: among 10^10 different sets about three pairs are expected to share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import at_work, components, known_id, passing, pieces, prepare, spent, with_known_id, written

WORDS, THRESHOLD, RUNS, DEPTH = 5, 0.8, 10, 3
#: The share of links the search finds at least, for pairs at the threshold and whatever is split.
RECALL = 0.9999
LIMIT, SKETCH = 2048, 64
BLOCK_SETS, BLOCK_BYTES = 256, 4 << 20
#: A pair goes on to the exact check from this estimate: 4.6 deviations of the sketch below the threshold.
LOOSE = 0.57
#: A character of a word, as word_hashes takes them.
_A_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

_rng = np.random.default_rng(20)
_BYTE = np.zeros(256, np.uint64)
_word = np.array([c for c in range(256) if c >= 0x80 or chr(c).isalnum()])
_BYTE[_word] = _rng.integers(1, 1 << 63, len(_word), dtype=np.uint64) | np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 | 5
_BACK = pow(_BASE, -1, 1 << 64)
_SEEDS = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_RUNS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_GRAM = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 16, dtype=np.uint64)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        at = 1
        while at < size:
            have[at : 2 * at] = have[:at] * np.uint64(pow(base, at, 1 << 64))
            at *= 2
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word; words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    code = _BYTE[raw]
    there = np.zeros(len(raw) + 2, np.int8)
    there[1:-1] = code != 0
    edge = np.diff(there)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code * _power(_BASE, len(raw)), out=total[1:])
    return mixed((total[end] - total[start]) * _power(_BACK, len(raw))[start])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `words` words; a shorter text that has words is one shingle."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += w[k : k + n] * _GRAM[k]
    return np.unique(mixed(out))


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name for a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    best = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(best, (s[at : at + 2048, None] * _SEEDS).min(axis=0), out=best)
    return (mixed(best) >> np.uint64(48)).astype("<u2").tobytes()


def runs_for(recall: float, runs: int, depth: int, threshold: float) -> tuple[int, int]:
    """(runs of all sets, runs of sets in split buckets) that miss a pair at the threshold with 1 - recall at most.

    The worst pair is a set and a part of it: its shared picks have a mean of 1 a level. It is missed if it shares no
    pick in any run, if all its shared picks are split and no path goes on to the last level, or if the sketches
    tell too little likeness.
    """
    need = _least_same(threshold)
    loose = sum(math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) for k in range(need))
    room = 1 - recall - loose
    if room <= 0:
        raise ValueError(f"sketches of {SKETCH} miss {loose:.2g} of the pairs alone")
    meets = 0.0
    for level in range(depth):
        meets = 1 - math.exp(-meets) if level else 1 - math.exp(-1)
    runs = max(runs, math.ceil(-math.log(room / 2)))
    most = max(runs, math.ceil(math.log(room - math.exp(-runs)) / math.log(1 - meets)))
    if most > len(_RUNS):
        raise ValueError(f"a recall of {recall} takes {most} runs; there are seeds for {len(_RUNS)}")
    return runs, most


def paths(s: np.ndarray, runs: int, depth: int, threshold: float, start: int = 0) -> tuple[list[int], list[int], list[int]]:
    """The nodes a set picks in runs from start on: level, parent's key and own key (keys are signed; the parent at level 1 is the run)."""
    room = min(np.iinfo(np.uint64).max, int(2.0**64 / (threshold * len(s))))
    roots = _RUNS[start:runs]
    levels, parents, keys = [], [], []
    for level in range(1, depth + 1):
        own: list[np.ndarray] = []
        for at in range(0, len(roots), 16):
            some = roots[at : at + 16]
            if level == 1:
                picked = s[:, None] * some <= np.uint64(room)
            else:
                picked = (s[:, None] ^ some) * np.uint64(0xD6E8FEB86659FD93) <= np.uint64(room)
            token, run = np.nonzero(picked)
            key = mixed(s[token] + some[run] * np.uint64(3))
            own.append(key)
            levels += [level] * len(key)
            parents += some[run].view(np.int64).tolist()
            keys += key.view(np.int64).tolist()
        roots = np.unique(np.concatenate(own)) if own else roots[:0]
        if not len(roots):
            break
    return levels, parents, keys


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text): fp tells the texts of a repeated doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("fp"), text.alias("text"))


def _signed(docs: DataFrame, words: int, runs: int, threshold: float) -> DataFrame:
    """(doc_id, fp, set_key, size, chars, sketch, keys) of (doc_id, fp, text): the set and its first picks in each run."""

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_work()
        for batch in pieces(batches):
            rows: list[tuple] = []
            for text in batch["text"]:
                s = shingles(text, words)
                rows.append((set_key(s), len(s), len(text), sketch(s), paths(s, runs, 1, threshold)[2]) if len(s) else (None, 0, len(text or ""), b"", []))
            out = pd.DataFrame(rows, columns=["set_key", "size", "chars", "sketch", "keys"])
            out["set_key"] = pd.array([r[0] for r in rows], dtype="Int64")
            for at, name in enumerate(("doc_id", "known", "fp")):
                out.insert(at, name, batch[name].to_numpy())
            yield out

    done = with_known_id(docs, F.col("fp"), F.col("text")).mapInPandas(sign, "doc_id long, known boolean, fp long, set_key long, size long, chars long, sketch binary, keys array<bigint>")
    return done.withColumn("doc_id", known_id()).drop("known")


def _paths(docs: DataFrame, words: int, runs: int, depth: int, threshold: float) -> DataFrame:
    """(set_key, level, parent, key): the nodes that the sets of docs (text) pick in all runs, a row each."""

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_work()
        for batch in pieces(batches, rows=50):
            found: tuple[list, list, list, list] = ([], [], [], [])
            for text in batch["text"]:
                if len(s := shingles(text, words)):
                    picks = paths(s, runs, depth, threshold)
                    for column, values in zip(found, ([set_key(s)] * len(picks[2]), *picks)):
                        column += values
            yield pd.DataFrame(dict(zip(("set_key", "level", "parent", "key"), (np.array(x, np.int32 if k == 1 else np.int64) for k, x in enumerate(found)))))

    return docs.select("text").mapInPandas(sign, "set_key long, level int, parent long, key long")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n members the least member it is linked to through the pairs (left, right)."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            break
    return root


def _least_same(threshold: float) -> int:
    """So many of the sketches' min-hashes agree in a pair that goes on to the exact check."""
    return round(LOOSE / THRESHOLD * threshold * SKETCH)


def _similar_sketches(sketches: list[bytes], sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    sk = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SKETCH)
    need = _least_same(threshold)
    left, right = [], []
    for at in range(0, len(sk), 64):
        same = np.zeros((min(64, len(sk) - at), len(sk)), np.uint8)
        for k in range(SKETCH):
            same += sk[at : at + 64, k, None] == sk[None, :, k]
        a, b = np.nonzero(same >= need)
        a = a + at
        keep = (a < b) & (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9)
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def _bucket_edges(buckets: DataFrame, threshold: float) -> DataFrame:
    """Brute force on sketches in each bucket (arrays of keys, sizes and sketches): a star for each likeness."""

    def compare(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_work()
        for batch in batches:
            a, b = [], []
            for keys, sizes, sketches in zip(batch["keys"], batch["sizes"], batch["sketches"]):
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                left, right = _similar_sketches([sketches[i] for i in order], sizes[order], threshold)
                if len(left):
                    root = _forest(len(keys), left, right)
                    far = np.flatnonzero(root != np.arange(len(keys)))
                    a += keys[far].tolist()
                    b += keys[root[far]].tolist()
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return buckets.mapInPandas(compare, "a long, b long").distinct()


def _met(rows: DataFrame, held: list[DataFrame]) -> DataFrame:
    """(set_key, key, n) of rows (set_key, key) whose bucket has n members, two at least.

    Counts are partial sums, so a hot bucket is no hot task. They are written before they are joined: both sides of the
    join are then plain shuffles, of which Spark splits a skewed one, and it is merged at every size, since the counts
    grow with the documents. What is written is added to held.
    """
    counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    held.append(written(rows.join(counts.hint("merge"), "key"), "buckets"))
    spent(counts)
    return held[-1]


def _leaves(nodes: DataFrame, depth: int, limit: int, held: list[DataFrame]) -> DataFrame:
    """The path search over nodes (set_key, level, parent, key): (set_key, key, blocks) for each set in a bucket to
    compare; buckets over limit are split until the last level, and there dealt into blocks."""
    rows, leaves = nodes.where("level = 1").select("set_key", "key"), []
    for level in range(1, depth + 1):
        met = _met(rows, held)
        if level == depth:
            leaves.append(met.select("set_key", "key", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
            break
        leaves.append(met.where(f"n <= {limit}").select("set_key", "key", F.lit(1).alias("blocks")))
        large = met.where(f"n > {limit}").select("set_key", F.col("key").alias("parent"))
        if large.isEmpty():
            break
        rows = nodes.where(f"level = {level + 1}").join(large.hint("merge"), ["set_key", "parent"]).select("set_key", "key")
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    return leaf


def _candidates(leaf: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of set keys that share a bucket and whose sketches look similar, as stars."""
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    leaf = leaf.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leaf = leaf.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set_key")
    member = F.struct("set_key", "size", "sketch")
    buckets = leaf.join(sets.select("set_key", "size", "sketch").hint("merge"), "set_key").groupBy("key", "i", "j").agg(F.collect_list(member).alias("members"))
    apart = [F.col("members")[k].alias(n) for k, n in (("set_key", "keys"), ("size", "sizes"), ("sketch", "sketches"))]
    return _bucket_edges(buckets.select(*apart), threshold)


def _exact(groups: DataFrame, words: int, threshold: float) -> DataFrame:
    """Exact Jaccard within each block of a group, or between its two blocks, where `members` is an array of
    (set_key, copies, block, text): per member a row (set_key, root, links, copies), root the least set_key that
    its links in the block lead to."""

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_work()
        for batch in batches:
            out: list[tuple] = []
            for i, j, many, members in zip(batch["i"], batch["j"], batch["many"], batch["members"]):
                found: dict[int, tuple] = {}
                for m in members:
                    s = shingles(m["text"], words)
                    if set_key(s) == m["set_key"]:  # else another row of a repeated doc_id
                        found[m["set_key"]] = (s, m["copies"], m["block"])
                keys = np.array(sorted(found), dtype=np.int64)
                if len(keys) < 2:
                    continue
                sets = [found[k][0] for k in keys.tolist()]
                copies = np.array([found[k][1] for k in keys.tolist()], dtype=np.int64)
                block = np.array([found[k][2] for k in keys.tolist()])
                alike = similar_pairs(sets, threshold)
                if i != j:
                    alike &= block[:, None] != block[None, :]
                links = alike @ copies
                left, right = np.nonzero(np.triu(alike, 1))
                root = keys[_forest(len(keys), left, right)]
                out += zip(keys.tolist(), root.tolist(), links.tolist(), [bool(many)] * len(keys))
            yield pd.DataFrame(out, columns=["set_key", "root", "links", "many"]).astype({"set_key": "int64", "root": "int64", "links": "int64", "many": "bool"})

    return groups.mapInPandas(check, "set_key long, root long, links long, many boolean")


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have a Jaccard similarity of threshold or more, as a symmetric matrix without its diagonal."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    token = np.cumsum(first) - 1
    shared = np.bincount(token)[token] > 1
    token, owner = np.unique(token[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    at = 0
    while at < len(token):
        stop = int(np.searchsorted(token, token[at] + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[at:stop], token[at:stop] - token[at]] = 1
        both += part @ part.T
        at = stop
    both = both.astype(np.int64)
    alike = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(alike, False)
    return alike


def jaccard_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, limit: int = LIMIT, recall: float = RECALL) -> DataFrame:
    """Self-join of documents (doc_id, text) by Jaccard similarity of word shingles at or above threshold.

    Returns a row for each row of docs: doc_id, class_id (the least doc_id that links lead to), set_id (the least
    doc_id with the same shingles), n_links (other rows at or above the threshold; rows with the same shingles
    count). Null text and text without a word have no shingles: class_id and set_id are the own doc_id, n_links 0. A
    null doc_id is never linked. Rows of one doc_id with one text are copies of each other. Fewer words than `words`
    are one shingle. Copies are grouped first, so a group of copies is one set; other columns are ignored. `runs` is
    the least number of runs, `recall` the share of links found at least, also where buckets over `limit` are split.
    """
    found = _linked(_named(docs), words, threshold, runs, depth, limit, recall)
    return found.select("doc_id", "class_id", "set_id", "n_links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, fp, text) once for each of wanted (doc_id, fp, ...) and its columns; other texts stay where they lie."""
    near = passing(docs, wanted, ["doc_id", "fp"])
    # repeated rows are folded before they move
    once = near.groupBy("doc_id", "fp").agg(F.first("text").alias("text"))
    return once.join(wanted.hint("merge"), ["doc_id", "fp"])


def _placed(members: DataFrame, threshold: float) -> DataFrame:
    """members with the block of each (a number), the blocks it is compared with, and whether its group has several.

    A group that is too large for one task falls into classes by size, such that two sets at the threshold are in one
    class or in neighbours, and each class into blocks of bounded sets and bytes; only blocks of one class or of
    neighbours meet. What is written before it is counted and joined leaves plain shuffles, of which Spark splits a
    skewed one.
    """
    def blocks(rows: DataFrame, *keys: str) -> DataFrame:
        sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        return sums.select(*keys, F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("chars") / BLOCK_BYTES)).cast("int").alias("blocks"))

    # a little wider than the threshold, so that rounding parts no pair
    kind = F.floor(F.log("size") / math.log(1.001 / threshold)).cast("long")
    whole = written(blocks(members, "group").select("group", (F.col("blocks") > 1).alias("many")), "sums")
    members = written(members.join(whole.hint("merge"), "group").withColumn("kind", F.when(F.col("many"), kind).otherwise(F.lit(0).cast("long"))), "kinds")
    sums = written(blocks(members, "group", "kind"), "sums")
    near = sums.select("group", "kind", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.shiftleft("kind", 32) + k).alias("others"))
    near = near.select("group", F.explode(F.array(*[F.col("kind") + d for d in (-1, 0, 1)])).alias("beside"), "others").withColumnRenamed("beside", "kind")
    near = near.groupBy("group", "kind").agg(F.flatten(F.collect_list("others")).alias("others"))
    near = written(near.join(sums.hint("merge"), ["group", "kind"]), "near")
    own = F.shiftleft("kind", 32) + F.pmod(F.xxhash64("set_key"), F.col("blocks"))
    out = written(members.join(near.hint("merge"), ["group", "kind"]).withColumn("block", own), "placed")
    spent(whole, members, sums, near)
    return out


def _linked(docs: DataFrame, words: int, threshold: float, runs: int, depth: int, limit: int, recall: float) -> DataFrame:
    """jaccard_join for each (doc_id, fp) of _named, with two further columns: set_key, and root, the same in all sets
    of a class (both null without shingles)."""
    prepare(docs.sparkSession)
    runs, most = runs_for(recall, runs, depth, threshold)
    signed = written(_signed(docs, words, runs, threshold), "signed")
    there = signed.where("set_key is not null and doc_id is not null")
    # each set once, in its first row's words
    first = written(there.groupBy("set_key").agg(F.min(F.struct("doc_id", "fp")).alias("at"), F.count("*").alias("copies")).select("set_key", "at.*", "copies"), "first")
    sets = there.join(first.drop("copies").hint("merge"), ["set_key", "doc_id", "fp"]).groupBy("set_key")
    sets = written(sets.agg(*[F.first(c).alias(c) for c in ("doc_id", "fp", "size", "chars", "sketch", "keys")]), "sets")
    held: list[DataFrame] = []
    met = _met(sets.select("set_key", F.explode("keys").alias("key")), held)
    leaf = met.where(f"n <= {limit}").select("set_key", "key", F.lit(1).alias("blocks"))
    large = met.where(f"n > {limit}").select("set_key").distinct()
    if not large.isEmpty():
        split = written(sets.select("set_key", "doc_id", "fp").join(large.hint("merge"), "set_key"), "split")
        again = written(_paths(_texts(docs, split), words, most, depth, threshold), "paths")
        spent(split)
        leaf = leaf.union(_leaves(again, depth, limit, held))
        held.append(again)
    group = written(components(_candidates(leaf, sets, threshold), "candidates").select(F.col("node").alias("set_key"), F.col("root").alias("group")), "groups")
    spent(*held)
    members = sets.select("set_key", "doc_id", "fp", "size", "chars").join(group.hint("merge"), "set_key").join(first.select("set_key", "copies").hint("merge"), "set_key")
    members = written(members, "members")
    spent(sets, group)
    placed = _placed(members, threshold)
    spent(members)
    told = _texts(docs, placed.select("doc_id", "fp", "set_key", "group", "copies", "block", "many", F.explode("others").alias("other")))
    told = told.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    told = told.groupBy("group", "i", "j", "many").agg(F.collect_list(F.struct("set_key", "copies", "block", "text")).alias("members"))
    found = written(_exact(told.select("i", "j", "many", "members"), words, threshold), "links")
    spent(placed)
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if not (split := found.where("many")).isEmpty():  # links of groups over several blocks are joined once more
        joined = components(split.select(F.col("set_key").alias("a"), F.col("root").alias("b")), "classes")
        links = links.join(joined.select(F.col("node").alias("set_key"), F.col("root").alias("wider")), "set_key", "left").select("set_key", "links", F.coalesce("wider", "root").alias("root"))
    sets = first.select("set_key", F.col("doc_id").alias("set_id"), "copies")
    # only sets of groups have heads to look for; both sides are written, so that a large class can be split
    linked = written(links.join(sets.hint("merge"), "set_key"), "linked")
    heads = written(linked.groupBy("root").agg(F.min("set_id").alias("class_id")), "heads")
    linked = linked.join(heads.hint("merge"), "root").select("set_key", "root", "class_id", "links")
    classes = sets.join(linked.hint("merge"), "set_key", "left")
    classes = classes.select("set_key", F.coalesce("root", "set_key").alias("root"), "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(classes.hint("merge"), "set_key", "left")
    return out.select("doc_id", "fp", "set_key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, runs: int = RUNS, depth: int = DEPTH, limit: int = LIMIT, recall: float = RECALL) -> DataFrame:
    """The rows of docs less all but one of each class of jaccard_join: a row of the least doc_id stays.

    Rows with a null doc_id take part and come after the others in their class. Where doc_ids repeat, a class keeps one
    doc_id with one text, and of equal such rows one. Texts without a word all stay, but for rows equal in a doc_id
    that is not null and in text. All columns stay as they are. Rows that go or are repeated move with their texts, and
    rows that a filter of bounded size can't tell from them; the others are only read.
    """
    # a null doc_id's stand-in: of its text, and above any usual doc_id
    stand_in = F.xxhash64(F.col("text").cast("string")).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string").rlike(_A_WORD), F.lit(False))
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), stand_in), "__fp": F.xxhash64(F.col("text").cast("string"), F.octet_length(F.col("text").cast("string"))), "__bare": bare})
    told = rows.where("not __bare").select(F.col("__id").alias("doc_id"), "text")
    found = written(_linked(_named(told), words, threshold, runs, depth, limit, recall).select("doc_id", "fp", "root"), "classes")
    stays = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("head")).select("head.*")
    pairs = found.groupBy("doc_id", "fp").agg(F.count("*").alias("n"), F.max("root").alias("root"))
    pairs = pairs.join(stays.withColumn("stays", F.lit(True)).hint("merge"), ["doc_id", "fp"], "left")
    pairs = pairs.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), (F.col("root").isNotNull() & F.col("stays").isNull()).alias("gone"), "n")
    touched = written(pairs.where("gone or n > 1"), "touched")
    keys = ["__id", "__fp"]
    near = passing(rows.where("not __bare"), touched, keys).dropDuplicates(keys)
    near = near.join(touched.where("gone").select(*keys).hint("merge"), keys, "left_anti")
    far = passing(rows.where("not __bare"), touched, keys, keep=False)
    return far.select(docs.columns).unionByName(near.select(docs.columns)).unionByName(rows.where("__bare").select(docs.columns))
