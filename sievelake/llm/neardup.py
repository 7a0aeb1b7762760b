"""Near-duplicate texts as an exact set-similarity join on words.

Signatures are token-combination prefixes: words are ordered from rare to frequent and put
into frequency classes; class 1 words are indexed singly, class k words in combinations of
k, taken inside hash groups to keep them few. A prefix is extended until removing as many
words as the threshold allows cannot destroy all of its signatures: a group of n words of
class k survives n-k removals. So two sets at or above
the threshold share a signature, whatever else they hold, and nothing is lost or capped.

Word order needs only to be the same everywhere, so frequencies come from a counting
sketch of SKETCH buckets over *all* word sets: a bounded broadcast at any scale; two words
in one bucket only make a class coarser. Texts with equal word sets are one representative;
their copies are kept beside it.

Words are compared as 32-bit hashes: among u words about u * u / 2**33 pairs collide, which moves
a similarity by about u / 2**33, a millionth for texts of 10,000 distinct words. A pair can be
misjudged only if it lies so close to the threshold.

Which class a word gets, how many groups there are and which frequent words share one decides only the
work, never the answer; from PLAN_FROM sets on, the plan with the least rows and comparisons in a sample is
taken, because the best one changes with the number of sets. A list is sorted by size and compared in tiles
by parities, in one task, which holds the part of it that the sizes allow.

Null and empty texts have no words and match nothing; rows with a null id are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.words import words
from sievelake.operators.components import connected_components
from sievelake.session import materialize

SKETCH = 1 << 18
#: Expected length of a signature's list up to which no larger combination is taken.
LIST_GOAL = 20_000
MAX_CLASS = 3
#: Frequent word buckets that are dealt to groups by how often they come together.
DEALT, SAMPLE = 800, 4000
#: Sets below this size index single words only; from it on, each doubling is a regime.
FIRST_REGIME = 20
#: Hash groups of the classes 2 and 3, as a share of the threshold times a regime's least size: together (0.5 + 2 * 2.75) / 7 of what a set of that size keeps.
GROUP_SHARES = (0.5 / 7, 2.75 / 7)
#: Goals and group shares to choose from, for PLAN_FROM sets or more; comparisons that cost as much as one row of a list.
PLANS = ((20_000, (5 / 7, 0.5 / 7)), (10_000, (4 / 7, 1 / 7)), (50_000, (2 / 7, 2 / 7)), (20_000, GROUP_SHARES), (3_000, GROUP_SHARES))
PLAN_FROM, PAIRS_A_ROW = 200_000, 1000
#: Bits of the bound that candidates have to meet; a multiple of 64.
PARITIES = 192
#: Rows of signature lists, and pairs of them, that a task holds at once.
ROWS_AT_ONCE = 300_000
PAIRS_AT_ONCE = 50_000
#: Long lists are compared in tiles of so many rows; up to FOLDED differences by 64 parities first.
TILE, FOLDED = 256, 22
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def token_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toks): sorted distinct word hashes; ids without words are left out, repeated ids count once."""
    toks = F.sort_array(F.array_distinct(F.transform(words(F.col(text_col)), lambda w: F.hash(w))))
    return df.select(F.col(id_col).alias("id"), toks.alias("toks")).filter(F.col("id").isNotNull() & (F.size("toks") > 0))


def sketch_counts(sets: DataFrame) -> np.ndarray:
    """Counts by word bucket over all word sets (at most SKETCH rows reach the driver)."""
    rows = sets.select(F.explode("toks").alias("t")).groupBy(F.pmod("t", F.lit(SKETCH)).alias("b")).count().toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["b"].to_numpy()] = rows["count"].to_numpy()
    return out


def word_classes(counts: np.ndarray, n: int, goal: float | None = None) -> np.ndarray:
    """Class of each bucket: the least k at which n * p**k falls to the goal."""
    p = np.clip(counts / max(1, n), 1e-12, 0.999999)
    k = np.ceil(math.log(max(1.0, n / (goal or LIST_GOAL))) / -np.log(p))
    return np.clip(k, 1, MAX_CLASS).astype(np.int8)


def regime(n: np.ndarray) -> np.ndarray:
    """Index of the size range that n falls in; a pair is found in the regime of its smaller set."""
    return np.frexp(n // FIRST_REGIME)[1]


def group_counts(r: int, threshold: float, shares: tuple | None = None) -> list[int]:
    """Numbers of hash groups of the classes 1..MAX_CLASS (from index 1) in regime r.

    A group of class k costs k-1 units; all groups together cost less than the words that a
    partner at the threshold has in common with any set looking in the regime, so every
    prefix can be completed.
    """
    least = FIRST_REGIME << (r - 1)
    return [0, 1, *(max(1, int(round(least * threshold * share, 6))) for share in shares or GROUP_SHARES)]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def dealt_groups(sample: list[np.ndarray], counts: np.ndarray, threshold: float, shares: tuple | None = None) -> dict[int, np.ndarray]:
    """Group of each bucket by regime, -1 for those that are hashed: frequent words that come together are dealt to different groups.

    Words of one phrase are no rarer together than alone, so that their combinations have long lists.
    Any assignment is right; the sample only decides how long lists become.
    """
    top = np.argsort(-counts, kind="stable")[:DEALT]
    place = np.full(SKETCH, -1)
    place[top] = np.arange(len(top))
    held = np.zeros((len(sample), len(top)), np.float32)
    for i, t in enumerate(sample):
        at = place[np.mod(t, SKETCH)]
        held[i, at[at >= 0]] = 1
    norm = np.maximum(1, held.sum(0))
    alike = (held.T @ held) ** 2 / (norm * norm[:, None])
    out = {}
    for r in range(1, int(regime(np.array(max((len(t) for t in sample), default=0)))) + 1):
        g = group_counts(r, threshold, shares)
        of = np.full((MAX_CLASS + 1, SKETCH), -1, np.int64)
        for k in range(2, MAX_CLASS + 1):
            load = np.zeros((g[k], len(top)), np.float32)
            for w in range(len(top)):
                best = int(load[:, w].argmin())
                of[k, top[w]] = best
                load[best] += alike[w]
        out[r] = of
    return out


def prefixes(sets: list[np.ndarray], counts: np.ndarray, classes: np.ndarray, threshold: float, shares: tuple | None = None, dealt: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signature, short) of a batch of sets, as the larger of a pair; short: as the smaller, too.

    The larger set of a pair may miss n - t*n words, the smaller n - 2t/(1+t)*n. A prefix ends
    when its units pass that number. As the larger, a set looks in the regimes of all sizes that its
    smaller partner can have; its short prefix is the beginning of the long one in its own regime.
    Signatures have 32 bits: an accidental match is one candidate more.
    """
    sizes = np.array([len(t) for t in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    bucket = np.mod(flat, SKETCH)
    order = np.lexsort((flat, counts[bucket], of))
    places = bucket[order]
    mixed, cls = _mix(flat[order].astype(np.int64).view(np.uint64)), classes[places].astype(np.int64)
    least = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    need, need_short = sizes - least + 1, sizes - np.ceil(2 * threshold / (1 + threshold) * sizes - 1e-9).astype(np.int64) + 1
    lowest, own = regime(least), regime(sizes)
    owners, sigs, shorts = [], [], []
    for r in range(lowest.min(), own.max() + 1):
        at = np.flatnonzero(((lowest <= r) & (own >= r))[of])
        if not len(at):
            continue
        i, x = of[at], mixed[at]
        k = cls[at] if r else np.ones(len(at), np.int64)
        groups = np.array(group_counts(r, threshold, shares) if r else [1] * (MAX_CLASS + 1))
        group = (x % groups[k].astype(np.uint64)).astype(np.int64)
        if dealt and r in dealt:
            fixed = dealt[r][k, places[at]]
            group = np.where(fixed < 0, group, fixed)
        key = (i * (MAX_CLASS + 1) + k) * (groups.max() + 1) + group
        by = np.argsort(key, kind="stable")
        starts, lengths = _runs(key[by])
        unit = np.empty(len(at), np.int64)
        unit[by] = np.arange(len(at)) - np.repeat(starts, lengths) >= k[by] - 1
        starts, lengths = _runs(i)
        before = np.cumsum(unit) - unit
        before -= np.repeat(before[starts], lengths)
        ends = starts + lengths - 1
        short_of = (before[ends] + unit[ends]) < need[i[starts]]
        if short_of.any():
            raise ValueError(f"no complete prefix for {lengths[short_of][0]} words at threshold {threshold}")
        short = (before < need_short[i]) & (own[i] == r)
        kept = np.flatnonzero(before < need[i])
        kept = kept[np.lexsort((x[kept], key[kept]))]
        starts, lengths = _runs(key[kept])
        form = lengths * (MAX_CLASS + 1) + k[kept[starts]]
        for f in np.unique(form):
            m, c = divmod(int(f), MAX_CLASS + 1)
            if m < c:
                continue
            first = starts[form == f]
            picks = np.array(list(itertools.combinations(range(m), c)))
            step = max(1, 2_000_000 // picks.size)
            for part in (first[j : j + step] for j in range(0, len(first), step)):
                words = kept[part[:, None, None] + picks].reshape(-1, c)
                h = np.full(len(words), r * 16 + c, np.uint64)
                for j in range(c):
                    h = _mix(h * _MIX[0] + x[words[:, j]])
                owners.append(i[words[:, 0]])
                sigs.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
                shorts.append(short[words].all(1))
    return np.concatenate(owners), np.concatenate(sigs), np.concatenate(shorts)


def signatures(sets: list[np.ndarray], counts: np.ndarray, classes: np.ndarray, threshold: float, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of a batch of sets, as the smaller of a pair or, as probe, the larger."""
    owner, sig, short = prefixes(sets, counts, classes, threshold)
    return (owner, sig) if probe else (owner[short], sig[short])


def plan_for(sample: list[np.ndarray], counts: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, tuple, dict[int, np.ndarray]]:
    """(classes, group shares, dealt groups) for n sets: the plan with the least rows and comparisons in a sample.

    Every plan finds the same pairs; the best one depends on the number of sets and on how common their words are.
    """
    if n < PLAN_FROM:
        return word_classes(counts, n), GROUP_SHARES, {}
    best = None
    some = sample[: SAMPLE // 2]
    for goal, shares in PLANS:
        classes, dealt = word_classes(counts, n, goal), dealt_groups(sample, counts, threshold, shares)
        with np.errstate(over="ignore"):
            owner, sig, short = prefixes(some, counts, classes, threshold, shares, dealt)
        size = np.array([len(t) for t in some])[owner]
        by = np.lexsort((size * 2 + ~short, sig))
        sig, size, short = sig[by], size[by], np.flatnonzero(short[by])
        starts, lengths = _runs(sig)
        run = np.repeat(np.arange(len(starts)), lengths) * (size.max() + 1)
        low = np.searchsorted((run + size)[short], run + np.ceil(threshold * size - 1e-9).astype(np.int64))
        pairs = np.maximum(0, np.searchsorted(short, np.arange(len(sig))) - low).sum() * n / len(some)
        cost = (len(sig) * PAIRS_A_ROW + pairs) / len(some)
        if best is None or cost < best[0]:
            best = cost, (classes, shares, dealt)
    return best[1]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """PARITIES parities of each set's words by hash, as longs: two sets differ in at least as many words as parities."""
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    h = _mix(flat.astype(np.int64).view(np.uint64) * _MIX[0] + np.uint64(7)) % np.uint64(PARITIES)
    odd = np.bincount(of * PARITIES + h.astype(np.int64), minlength=PARITIES * len(sets)).reshape(-1, PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def in_lists(batches, threshold: float):
    """Candidate pairs (a, b) from Arrow batches of (sig, size, rid, parities), sorted by sig and size; size is 2n, and one more if only the long prefix has the signature.

    A row is compared with the rows before it in its list whose size allows the threshold and whose
    short prefix has the signature. Of what was compared, only such rows of the list that goes on are kept.
    """
    names = [f"p{j}" for j in range(PARITIES // 64)]
    limit = (1 - threshold) / (1 + threshold)
    held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in names))
    more, rows = [], 0

    def pairs():
        """Of what is held and new."""
        nonlocal held, more, rows
        old = len(held[0])
        sig, size, rid, *par = (np.concatenate(x) for x in zip(held, *more))
        more, rows = [], 0
        n = size >> 1
        fold = [np.bitwise_xor.reduce(par)]  # 64 parities of the same words
        short = np.flatnonzero((size & 1) == 0)
        starts, lengths = _runs(sig)
        run = np.repeat(np.arange(len(starts)), lengths)
        place = run * (n.max() + 1) + n
        new = np.arange(old, len(sig))
        low = np.searchsorted(place[short], run[new] * (n.max() + 1) + np.ceil(threshold * n[new] - 1e-9).astype(np.int64))
        high = np.searchsorted(short, new)
        some = np.flatnonzero(high > low)
        new, low, high = new[some], low[some], high[some]

        def fitting(a, b):
            """Numbers of the pairs of rows that fit, their positions the other way round where sizes are equal."""
            apart = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in par)
            fits = (a < b) & (n[a] >= threshold * n[b] - 1e-9) & (apart <= limit * (n[a] + n[b]) + 1e-9)
            a, b = a[fits], b[fits]
            swap = (n[a] == n[b]) & (rid[a] > rid[b])
            return np.where(swap, rid[b], rid[a]), np.where(swap, rid[a], rid[b])

        short_par, short_fold, short_n = [x[short] for x in par], [fold[0][short]], n[short]
        first, count = _runs(run[new])
        heavy = np.add.reduceat(high - low, first) >= TILE * TILE // 8 if len(first) else np.zeros(0, bool)
        for f, c in zip(first[heavy].tolist(), count[heavy].tolist()):
            for at in range(f, f + c, TILE):
                to = min(at + TILE, f + c)
                rows_b = slice(new[at], new[to - 1] + 1)
                for left in range(int(low[at]), int(high[to - 1]), 2 * TILE):
                    right = min(left + 2 * TILE, int(high[to - 1]))
                    most = int(limit * (short_n[right - 1] + n[rows_b][-1]) + 1e-9)
                    mine, theirs = (short_fold, fold) if most <= FOLDED else (short_par, par)
                    apart = np.bitwise_count(mine[0][left:right, None] ^ theirs[0][None, rows_b])
                    for x, y in zip(mine[1:], theirs[1:]):
                        apart += np.bitwise_count(x[left:right, None] ^ y[None, rows_b])
                    close = apart <= most
                    if close.any():
                        i, j = np.nonzero(close)
                        yield fitting(short[left + i], new[at] + j)
        light = np.repeat(~heavy, count)
        new, low, many = new[light], low[light], (high - low)[light]
        ends = np.cumsum(many)
        at = 0
        while at < len(new):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE)))
            m = many[at:to]
            a = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - low[at:to], m)
            yield fitting(short[a], np.repeat(new[at:to], m))
            at = to
        stay = short[(sig[short] == sig[-1]) & (n[short] >= threshold * n[-1] - 1e-9)]
        held = tuple(x[stay] for x in (sig, size, rid, *par))

    def found():
        ab = [np.stack(x, 1) for x in pairs() if len(x[0])]
        if ab:
            ab = np.unique(np.concatenate(ab), axis=0)
            yield pa.record_batch({"a": ab[:, 0], "b": ab[:, 1]})

    for batch in batches:
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        if batch.num_rows:
            more.append((get("sig"), get("size").astype(np.int64), get("rid"), *(get(x).view(np.uint64) for x in names)))
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from found()
    if rows:
        yield from found()


def candidate_pairs(reps: DataFrame, counts: np.ndarray, n: int, threshold: float) -> DataFrame:
    """(a, b) row numbers of representatives that share a signature and whose sizes and parities allow the threshold.

    A superset of the answer: every test is a bound that true pairs meet.
    """
    sample = reps.filter(F.pmod(F.xxhash64("rid"), F.lit(max(1, n // SAMPLE))) == 0).select("toks").collect()  # about SAMPLE rows
    plan = plan_for([np.array(x["toks"], np.int32) for x in sample], counts, n, threshold)
    shared = reps.sparkSession.sparkContext.broadcast((counts, *plan))  # SKETCH entries each, whatever the data

    def run(batches):
        counts, classes, shares, dealt = shared.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    toks, rid = part.column("toks"), part.column("rid").to_numpy()
                    sets = np.split(toks.flatten().to_numpy(), np.cumsum(toks.value_lengths().to_numpy())[:-1])
                    size = np.array([len(t) for t in sets], np.int32)
                    owner, sig, short = prefixes(sets, counts, classes, threshold, shares, dealt)
                    par = parities(sets)
                    yield pa.record_batch({"sig": sig, "size": 2 * size[owner] + ~short, "rid": rid[owner]} | {f"p{j}": par[owner, j] for j in range(PARITIES // 64)})

    rows = reps.select("rid", "toks").mapInArrow(run, "sig int, size int, rid long, " + ", ".join(f"p{j} long" for j in range(PARITIES // 64)))
    return rows.repartition("sig").sortWithinPartitions("sig", "size").mapInArrow(lambda batches: in_lists(batches, threshold), "a long, b long").distinct()


def verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b, similarity) of the candidates at or above the threshold, by exact intersection."""
    left = reps.select(F.col("rid").alias("a"), F.col("rep").alias("rep_a"), F.col("toks").alias("ta"))
    right = reps.select(F.col("rid").alias("b"), F.col("rep").alias("rep_b"), F.col("toks").alias("tb"))

    def run(batches):
        for pdf in batches:
            common = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(pdf["ta"], pdf["tb"])), np.int64, len(pdf))
            sim = common / (pdf["ta"].map(len).to_numpy() + pdf["tb"].map(len).to_numpy() - common)
            keep = sim >= threshold - 1e-12
            yield pd.DataFrame({"rep_a": pdf["rep_a"][keep], "rep_b": pdf["rep_b"][keep], "similarity": sim[keep]})

    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "rep_a string, rep_b string, similarity double")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, reps, copies): links (rep_a, rep_b, similarity) between different word sets; reps, one row for each word set;
    copies (id, rep) of the ids that are not their word set's representative."""
    # membership through a 128-bit digest of the word set, so that no set is shuffled for it; texts are split once
    sets = materialize(token_sets(df, id_col, text_col).withColumns({"d": F.xxhash64("toks"), "e": F.xxhash64(F.lit(1), "toks")}), "neardup-sets")
    reps = materialize(sets.groupBy("d", "e").agg(F.min("id").alias("rep"), F.first("toks").alias("toks")).select(F.monotonically_increasing_id().alias("rid"), "rep", "toks", "d", "e"), "neardup-reps")
    pairs = candidate_pairs(reps, sketch_counts(reps), reps.count(), threshold)
    members = sets.select("id", "d", "e").join(reps.select("rep", "d", "e"), ["d", "e"])
    copies = materialize(members.filter("id <> rep").select("id", "rep").distinct(), "neardup-copies")
    return verified(pairs, reps, threshold), reps, copies


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids at or above the threshold, copies included."""
    links, _, copies = near_duplicates(df, id_col, text_col, threshold)
    links = materialize(links, "neardup-links")
    for side in ("rep_a", "rep_b"):  # each end stands for itself and for its copies
        links = links.withColumn("x" + side, F.col(side)).unionByName(links.join(copies.select(F.col("rep").alias(side), F.col("id").alias("x" + side)), side))
    # within a word set the answer itself is all pairs; hot sets are spread by AQE's skew join
    own = copies.unionByName(copies.select(F.col("rep").alias("id"), "rep").distinct())
    within = own.alias("p").join(own.alias("q"), "rep").filter("p.id < q.id").select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))
    return links.select(F.least("xrep_a", "xrep_b").alias("id_a"), F.greatest("xrep_a", "xrep_b").alias("id_b")).unionByName(within)


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """(id, group_id, links): one row for each id; group_id is the smallest id that links lead to, links the links to other word sets."""
    links, reps, copies = near_duplicates(df, id_col, text_col, threshold)
    links = materialize(links, "neardup-links")
    group = connected_components(links.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    members = copies.unionByName(reps.select(F.col("rep").alias("id"), "rep"))
    return (
        members.join(group.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )
