"""Bootstrap and permutation inference over sessions, as block products.

A statistic of a resample is a function of weighted sums over sessions. So every
session is one sparse row of components (an action count, a transition, a length,
a distance ...), a replicate is one weight a session, and all sums of all
replicates are the product of the two matrices. A task multiplies blocks of its
sessions with blocks of weights and adds up; what it sends on is one vector a
component and block of replicates, however many sessions it had. No row is ever
made of a session and a replicate.

A weight is a hash of seed, replicate and session key in 32-bit steps, so any
engine and any partitioning has the same. Every vector has one place more than
there are replicates: the last is the plain sum, in which each session counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fidelity
from .scoring import holm
from .sessionize import SEMANTIC_ACTIONS

REPLICATES = 10_000
SEED = 42
BLOCK_ROWS = 2_000  # sessions of one product
BLOCK_REPLICATES = 1_000
HELD_COMPONENTS = 1_000  # components that a task adds up before it sends them on
#: Cumulative probabilities of a Poisson count with mean 1; what lies beyond the last counts as 6.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Multipliers of the 32-bit finalizer of a public hash function.
MIX = (0x85EBCA6B, 0xC2B2AE35)
_SUMS = "component long, block int, sums array<double>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit values in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX[0])
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX[1])
    x ^= x >> np.uint32(16)
    return x


def key_halves(key: Column) -> list[Column]:
    """Two 32-bit numbers of a key, from its text."""
    digest = F.md5(key.cast("string"))
    return [F.conv(F.substr(digest, F.lit(at), F.lit(8)), 16, 10).cast("long").alias(name) for at, name in ((1, "ka"), (9, "kb"))]


def hashes(ka: np.ndarray, kb: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Uniform 32-bit values of keys (rows) in replicates (columns)."""
    each = _mix(replicates.astype(np.uint32) ^ np.uint32(seed))
    return _mix(ka.astype(np.uint32)[:, None] ^ _mix(kb.astype(np.uint32)[:, None] ^ each[None, :]))


def poisson_weights(h: np.ndarray) -> np.ndarray:
    """How often a session is drawn: a Poisson count with mean 1."""
    out = np.zeros(h.shape)
    for cut in POISSON:
        out += h >= np.uint32(cut * 4294967296)
    return out


def coin_flips(h: np.ndarray) -> np.ndarray:
    """1 where the labels of a pair are swapped, else 0."""
    return (h >= np.uint32(1 << 31)).astype(float)


def _products(weights: Callable[[np.ndarray], np.ndarray], replicates: int, seed: int):
    blocks = [np.arange(at, min(at + BLOCK_REPLICATES, replicates)) for at in range(0, replicates, BLOCK_REPLICATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for c, total in held.items():
                parts = [np.append(total[b], total[replicates]) for b in blocks]
                yield pa.record_batch([pa.array([c] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["component", "block", "sums"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                ka, kb = (some.column(c).to_numpy().astype(np.uint32) for c in ("ka", "kb"))
                comps, values = some.column("components"), some.column("values")
                sizes = comps.value_lengths().to_numpy(zero_copy_only=False)
                names, column = np.unique(comps.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                if not len(names):
                    continue
                row = np.repeat(np.arange(some.num_rows), sizes)
                x = np.bincount(row * len(names) + column, values.flatten().to_numpy(zero_copy_only=False), some.num_rows * len(names)).reshape(some.num_rows, len(names)).T
                sums = np.empty((len(names), replicates + 1))
                for b in blocks:
                    sums[:, b] = x @ weights(hashes(ka, kb, b, seed))
                sums[:, replicates] = x.sum(1)
                for c, s in zip(names.tolist(), sums, strict=True):
                    if c in held:
                        held[c] += s
                    else:
                        held[c] = s.copy()
                if len(held) > HELD_COMPONENTS:
                    yield from flush()
        yield from flush()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one component and block added up; all of them are in one partition."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        keys = zip(batch.column("component").to_pylist(), batch.column("block").to_pylist(), strict=True)
        sums = batch.column("sums")
        for i, key in enumerate(keys):
            v = sums[i].values.to_numpy(zero_copy_only=False)
            held[key] = held[key] + v if key in held else v
    for (c, b), v in held.items():
        yield pa.record_batch([pa.array([c], pa.int64()), pa.array([b], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["component", "block", "sums"])


def replicate_sums(stats: DataFrame, key: str, replicates: int = REPLICATES, seed: int = SEED, weights: Callable[[np.ndarray], np.ndarray] = poisson_weights) -> DataFrame:
    """(component, block, sums): weighted sums of each component over sessions, one place a replicate of the block and one for the plain sum.

    stats is (key, components array<long>, values array<double>), one row a
    session; a component may stand in a row more than once. Rows without a key
    are left out. An empty table gives no rows.
    """
    if replicates < 1:
        raise ValueError("there must be at least one replicate")
    rows = stats.where(F.col(key).isNotNull()).select(*key_halves(F.col(key)), F.col("components").cast("array<long>").alias("components"), F.col("values").cast("array<double>").alias("values"))
    parts = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "ka", "kb").mapInArrow(_products(weights, replicates, seed), _SUMS)
    return parts.repartition("component", "block").mapInArrow(_added, _SUMS)


def _of_blocks(sums: DataFrame, function: Callable[[dict[int, np.ndarray], np.ndarray], pa.Table], schema: str, replicates: int) -> DataFrame:
    """`function` of the vectors by component and the replicates' numbers, for each block; the last place of the first block is the plain sum, numbered -1."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        numbers = np.arange(block * BLOCK_REPLICATES, min((block + 1) * BLOCK_REPLICATES, replicates))
        keep = slice(None) if block == 0 else slice(-1)
        vectors = {c: v.values.to_numpy(zero_copy_only=False)[keep] for c, v in zip(table.column("component").to_pylist(), table.column("sums").combine_chunks(), strict=True)}
        return function(vectors, np.append(numbers, -1)[keep])

    return sums.groupBy("block").applyInArrow(run, schema)


def bootstrap_ratio(stats: DataFrame, key: str, total: str, count: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(replicate, total, count, value): a ratio of sums over resampled keys; null where no key is drawn. Whole totals stay exact below 2**53."""
    rows = stats.select(key, F.array(F.lit(0), F.lit(1)).alias("components"), F.array(F.col(total).cast("double"), F.col(count).cast("double")).alias("values"))

    def ratio(sums: dict[int, np.ndarray], numbers: np.ndarray) -> pa.Table:
        t, n = sums[0], sums[1]
        value = np.divide(t, n, out=np.zeros(len(t)), where=n != 0)
        return pa.table({"replicate": numbers, "total": t, "count": n, "value": pa.array(value, mask=n == 0)})

    found = _of_blocks(replicate_sums(rows, key, replicates, seed), ratio, "replicate long, total double, count double, value double", replicates)
    return found.where("replicate >= 0")


def permutation_p(pairs: DataFrame, key: str, a: str, b: str, rounds: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(difference, p): mean paired difference, and its two-sided add-one p-value under random swaps of the pair."""
    d = (F.col(a) - F.col(b)).cast("double")
    rows = pairs.select(key, F.array(F.lit(0), F.lit(1)).alias("components"), F.array(d, F.lit(1.0)).alias("values")).where(d.isNotNull())

    def swapped(sums: dict[int, np.ndarray], numbers: np.ndarray) -> pa.Table:
        return pa.table({"round": numbers, "sum": sums[0], "n": sums[1]})

    found = _of_blocks(replicate_sums(rows, key, rounds, seed, coin_flips), swapped, "round long, sum double, n double", rounds)
    base = found.where("round = -1").select(F.col("sum").alias("whole"), F.col("n").alias("pairs"))
    both = found.where("round >= 0").crossJoin(F.broadcast(base))  # one row
    extreme = F.abs(F.col("whole") - 2 * F.col("sum")) >= F.abs("whole") - 1e-9
    return both.groupBy("whole", "pairs").agg(((F.count_if(extreme) + 1) / (F.count("*") + 1)).alias("p")).select((F.col("whole") / F.col("pairs")).alias("difference"), "p")


# --- the eight metrics of real against synthetic sessions ---------------------------------

#: Metrics in the order of the report, and when a lower one is better (by its size for the ratio).
METRICS = (
    "outcome_jsd",
    "action_freq_jsd",
    "session_length_jsd",
    "transition_matrix_L1",
    "trajectory_lev_distance",
    "product_coherence_gap",
    "product_diversity_ratio",
    "product_sim_per_session",
)
HIGHER_IS_BETTER = ("product_sim_per_session",)
SIZE_IS_WORSE = ("product_diversity_ratio",)
N_ACTIONS = len(SEMANTIC_ACTIONS)
#: Places of a side's components: sessions, flags, actions, transitions, coherence and similarity (sum, sessions that have one), distance, then lengths.
COUNT, FLAGS, ACTIONS = 0, 1, 5
MOVES = ACTIONS + N_ACTIONS
COHERENCE = MOVES + N_ACTIONS * N_ACTIONS
DISTANCE, SIMILARITY, LENGTHS = COHERENCE + 2, COHERENCE + 3, COHERENCE + 5
SIDE = 1 << 32


def session_components(steps: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(session_id, word, components, values) of one side: flags, action counts, transitions, length, and the scores that there are.

    steps is (session_id, ord, action); scores is (session_id, coherence,
    similarity), each null where a session has none.
    """
    places = F.create_map(*[F.lit(x) for i, a in enumerate(SEMANTIC_ACTIONS) for x in (a, i)])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "action"))), lambda s: s["action"])
    s = steps.groupBy("session_id").agg(ordered.alias("actions"))
    s = s.withColumn("codes", F.transform("actions", lambda a: F.element_at(places, a)))
    has = lambda *some: F.exists("actions", lambda a: F.coalesce(a.isin(*some), F.lit(False)))
    browsing = F.forall("actions", lambda a: F.coalesce(a.isin(*fidelity.BROWSING), F.lit(False)))
    flags = [has("checkout"), has("add"), browsing, has("add") & ~has("checkout")]
    s = s.join(scores.select("session_id", "coherence", "similarity"), "session_id", "left") if scores is not None else s.withColumns({"coherence": F.lit(None).cast("double"), "similarity": F.lit(None).cast("double")})
    none = F.array().cast("array<long>")
    long = lambda c: c.cast("long")
    follows = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda i, j: long(F.lit(MOVES) + i * N_ACTIONS + j))
    ones = F.concat(
        F.array(long(F.lit(COUNT)), long(F.lit(LENGTHS) + F.size("codes"))),
        *[F.when(f, F.array(long(F.lit(FLAGS + k)))).otherwise(none) for k, f in enumerate(flags)],
        F.filter(F.transform("codes", lambda c: long(F.lit(ACTIONS) + c)), lambda c: c.isNotNull()),
        F.when(F.size("codes") > 1, F.filter(follows, lambda c: c.isNotNull())).otherwise(none),
    )
    scored = lambda c, at: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.array(long(F.lit(at)), long(F.lit(at + 1)))).otherwise(none)
    value = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.array(F.col(c).cast("double"), F.lit(1.0))).otherwise(F.array().cast("array<double>"))
    s = s.withColumn("ones", ones)
    return s.select(
        "session_id",
        "codes",
        F.concat("ones", scored("coherence", COHERENCE), scored("similarity", SIMILARITY)).alias("components"),
        F.concat(F.transform("ones", lambda _: F.lit(1.0)), value("coherence"), value("similarity")).alias("values"),
    )


def _word(codes: str) -> Column:
    """Actions as one character each, so that edit distance counts actions."""
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.substr(F.lit("abcdefghi"), c + 1, F.lit(1)), F.lit("O"))), "")


def _shared_sides(real: DataFrame, synths: dict[str, DataFrame], scores: dict[str, DataFrame]) -> DataFrame:
    """(session_id, c0, v0, c1, v1 ...): the components of the real side and of each method, of sessions that all of them have."""
    sides = session_components(real, scores.get("real")).select("session_id", F.col("codes").alias("codes0"), F.col("components").alias("c0"), F.col("values").alias("v0"))
    for k, (name, steps) in enumerate(synths.items(), 1):
        one = session_components(steps, scores.get(name)).select("session_id", F.col("codes").alias("codes"), F.col("components").alias(f"c{k}"), F.col("values").alias(f"v{k}"))
        both = sides.join(one, "session_id")
        away = F.levenshtein(_word("codes0"), _word("codes")) / F.greatest(F.size("codes0"), F.size("codes"))
        sides = both.withColumns({f"c{k}": F.concat(f"c{k}", F.array(F.lit(DISTANCE).cast("long"))), f"v{k}": F.concat(f"v{k}", F.array(away))}).drop("codes")
    return sides.drop("codes0")


def _at_side(components: str, k: int) -> Column:
    return F.transform(components, lambda c: c + F.lit(k * SIDE))


def _divergence(p: np.ndarray, q: np.ndarray, there: np.ndarray | float = 1.0) -> np.ndarray:
    """Jensen-Shannon divergence of columns; `there` marks the rows that are part of a column."""
    p, q = (x + fidelity.EPSILON * there for x in (p, q))
    p, q = p / p.sum(0), q / q.sum(0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(m > 0, 0.5 * (p * np.log(p / m) + q * np.log(q / m)), 0.0)
    return terms.sum(0)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def metric_values(real: dict[int, np.ndarray], synth: dict[int, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """The eight metrics from the summed components of two sides, a column a replicate."""
    zero = np.zeros(width)
    rows = lambda side, at, n: np.array([side.get(at + i, zero) for i in range(n)])
    out = {}
    out["outcome_jsd"] = _divergence(*(_over(rows(s, FLAGS, 4), s.get(COUNT, zero)) for s in (real, synth)))
    counts = [rows(s, ACTIONS, N_ACTIONS) for s in (real, synth)]
    out["action_freq_jsd"] = _divergence(*(c / np.maximum(c.sum(0), 1) for c in counts))
    bins = sorted({c for s in (real, synth) for c in s if c >= LENGTHS})
    most = np.zeros(width)
    for c in bins:
        most = np.where((real.get(c, zero) > 0) | (synth.get(c, zero) > 0), c - LENGTHS, most)
    hist = [np.array([s.get(LENGTHS + n, zero) for n in range(int(most.max()) + 1)]) for s in (real, synth)]
    out["session_length_jsd"] = _divergence(*(_over(h, h.sum(0)) for h in hist), np.arange(len(hist[0]))[:, None] <= most)
    moves = [rows(s, MOVES, N_ACTIONS * N_ACTIONS).reshape(N_ACTIONS, N_ACTIONS, width) for s in (real, synth)]
    shares = [m / np.where(m.sum(1, keepdims=True) == 0, 1, m.sum(1, keepdims=True)) for m in moves]
    out["transition_matrix_L1"] = np.abs(shares[0] - shares[1]).sum((0, 1))
    out["trajectory_lev_distance"] = _over(synth.get(DISTANCE, zero), synth.get(COUNT, zero))
    coherent = [(s.get(COHERENCE, zero), s.get(COHERENCE + 1, zero)) for s in (real, synth)]
    out["product_coherence_gap"] = np.abs(_over(*coherent[0]) - _over(*coherent[1]))
    n_real, n_synth = coherent[0][1], coherent[1][1]
    out["product_diversity_ratio"] = np.where(n_real > 0, _over(n_synth, n_real) - 1.0, 0.0)
    out["product_sim_per_session"] = _over(synth.get(SIMILARITY, zero), synth.get(SIMILARITY + 1, zero))
    return out


def _side(sums: dict[int, np.ndarray], k: int) -> dict[int, np.ndarray]:
    return {c - k * SIDE: v for c, v in sums.items() if c // SIDE == k}


def _long(numbers: np.ndarray, values: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    n = len(numbers)
    names = [key for key in values for _ in range(n)]
    ours, theirs = (np.concatenate([v[i] for v in values.values()]) for i in (0, 1))
    return pa.table({"replicate": np.tile(numbers, len(values)), "method": [m for m, _ in names], "metric": [x for _, x in names], "ours": ours, "theirs": theirs})


_LONG = "replicate long, method string, metric string, ours double, theirs double"


def metric_replicates(real: DataFrame, synths: dict[str, DataFrame], ours: str, scores: dict[str, DataFrame] | None = None, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(replicate, method, metric, ours, theirs): the eight metrics of `ours` and of each other method on resampled sessions; replicate -1 is the sessions as they are.

    real and the methods are steps (session_id, ord, action); sessions that one of
    them lacks take no part. All methods of a replicate share its weights. scores
    has, for "real" and by method, (session_id, coherence, similarity).
    """
    names = [ours, *[m for m in synths if m != ours]]
    sides = _shared_sides(real, {m: synths[m] for m in names}, scores or {})
    every = range(len(names) + 1)
    rows = sides.select("session_id", F.concat(*[_at_side(f"c{k}", k) for k in every]).alias("components"), F.concat(*[f"v{k}" for k in every]).alias("values"))

    def metrics(sums: dict[int, np.ndarray], numbers: np.ndarray) -> pa.Table:
        by = [metric_values(_side(sums, 0), _side(sums, k), len(numbers)) for k in range(1, len(names) + 1)]
        return _long(numbers, {(m, x): (by[0][x], by[k][x]) for k, m in enumerate(names) if k for x in METRICS})

    return _of_blocks(replicate_sums(rows, "session_id", replicates, seed), metrics, _LONG, replicates)


def swapped_metrics(real: DataFrame, synths: dict[str, DataFrame], ours: str, scores: dict[str, DataFrame] | None = None, rounds: int = REPLICATES, seed: int = SEED + 1) -> DataFrame:
    """As `metric_replicates`, with the labels of `ours` and the other method swapped in about half of the sessions of each round.

    A swap only exchanges the two rows of a session, so its effect on a side's sums
    is the flipped sessions' difference.
    """
    names = [ours, *[m for m in synths if m != ours]]
    sides = _shared_sides(real, {m: synths[m] for m in names}, scores or {})
    every, others = range(len(names) + 1), range(2, len(names) + 1)
    apart = len(names) + 1  # sides from here on hold differences
    comps = [_at_side(f"c{k}", k) for k in every] + [_at_side(f"c{j}", apart + k) for k in others for j in (k, 1)]
    minus = F.transform("v1", lambda v: -v)
    values = [F.col(f"v{k}") for k in every] + [v for k in others for v in (F.col(f"v{k}"), minus)]
    # Plain sums of all sides travel as the last place; their flipped sums are not used.
    rows = sides.select("session_id", F.concat(*comps).alias("components"), F.concat(*values).alias("values"))

    def metrics(sums: dict[int, np.ndarray], plain: dict[int, np.ndarray], numbers: np.ndarray) -> pa.Table:
        width, out = len(numbers), {}
        whole = [{c: np.full(width, v) for c, v in _side(plain, k).items()} for k in every]
        for k in others:
            flipped = _side(sums, apart + k)
            keys = set(whole[1]) | set(whole[k]) | set(flipped)
            zero = np.zeros(width)
            a = {c: whole[1].get(c, zero) + flipped.get(c, zero) for c in keys}
            b = {c: whole[k].get(c, zero) - flipped.get(c, zero) for c in keys}
            one, two = metric_values(whole[0], a, width), metric_values(whole[0], b, width)
            out |= {(names[k - 1], x): (one[x], two[x]) for x in METRICS}
        return _long(numbers, out)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        numbers = np.arange(block * BLOCK_REPLICATES, min((block + 1) * BLOCK_REPLICATES, rounds))
        vectors = {c: v.values.to_numpy(zero_copy_only=False) for c, v in zip(table.column("component").to_pylist(), table.column("sums").combine_chunks(), strict=True)}
        return metrics({c: v[:-1] for c, v in vectors.items()}, {c: float(v[-1]) for c, v in vectors.items()}, numbers)

    return replicate_sums(rows, "session_id", rounds, seed, coin_flips).groupBy("block").applyInArrow(run, _LONG)


def fidelity_table(real: DataFrame, synths: dict[str, DataFrame], ours: str, scores: dict[str, DataFrame] | None = None, replicates: int = REPLICATES, rounds: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """One row a method and metric against `ours`: both values, their difference, its 95 % interval, and both p-values of the permutation test.

    One-sided tests ask whether ours is better: lower, but higher for the similarity
    and nearer to 0 for the diversity ratio. p-values count the observed
    arrangement as one more round, so none is 0.
    """
    boot = metric_replicates(real, synths, ours, scores, replicates, seed)
    d = F.col("ours") - F.col("theirs")
    drawn = F.col("replicate") >= 0
    at = lambda share: F.percentile(F.when(drawn, d), F.lit(share))
    point = lambda c: F.max(F.when(~drawn, F.col(c)))
    table = boot.groupBy("method", "metric").agg(point("ours").alias("ours_value"), point("theirs").alias("method_value"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))
    table = table.withColumn("delta", F.col("ours_value") - F.col("method_value"))
    swaps = swapped_metrics(real, synths, ours, scores, rounds, seed + 1).join(F.broadcast(table.select("method", "metric", "ours_value", "method_value", "delta")), ["method", "metric"])  # eight rows a method
    size = F.abs("ours") - F.abs("theirs") <= F.abs("ours_value") - F.abs("method_value")
    better = F.when(F.col("metric").isin(*HIGHER_IS_BETTER), d >= F.col("delta")).when(F.col("metric").isin(*SIZE_IS_WORSE), size).otherwise(d <= F.col("delta"))
    share = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    p = swaps.groupBy("method", "metric").agg(share(F.abs(d) >= F.abs("delta")).alias("p_two_sided"), share(better).alias("p_one_sided"))
    out = table.join(p, ["method", "metric"])
    return out.select("method", "metric", "ours_value", "method_value", "delta", "ci_low", "ci_high", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant_interval"), "p_two_sided", "p_one_sided", (F.col("p_two_sided") < 0.05).alias("significant_permutation"))


# --- contrasts of conditions over training seeds -------------------------------------------

BASELINE = "real_to_real"
MARGIN = 2.0  # percentage points


def contrast_replicates(scores: DataFrame, metrics: list[str], baseline: str = BASELINE, replicates: int = REPLICATES, seed: int = SEED, resample_seeds: bool = False) -> DataFrame:
    """(replicate, method, condition, metric, arm, base): means of both arms over the same drawn sessions; replicate -1 is the data as they are.

    scores is (method, condition, seed, session, example, one column a metric). A
    mean is over the examples of the drawn sessions and over seeds; with
    `resample_seeds` the seeds of each arm are drawn again as well, each arm by
    itself. Methods without the baseline are left out. An arm whose examples are
    not the baseline's cannot be paired and raises.
    """
    runs = scores.select("method", "condition", "seed").distinct().orderBy("method", "condition", "seed").collect()  # one row a training run
    plan = [(r["method"], r["condition"], r["seed"]) for r in runs]
    based = {m for m, c, _ in plan if c == baseline}
    sizes = scores.groupBy("method", "condition", "seed").agg(F.count("*").alias("n"), F.sum(F.xxhash64("session", "example").cast("decimal(20,0)")).alias("h")).groupBy("method").agg(F.countDistinct("n", "h").alias("k")).where("k > 1")
    uneven = [r["method"] for r in sizes.collect() if r["method"] in based]  # one row a method
    if uneven:
        raise ValueError(f"examples differ between the runs of {uneven}")
    runs_frame = scores.sparkSession.createDataFrame([(*key, i) for i, key in enumerate(plan) if key[0] in based] or [(None, None, None, -1)], "method string, condition string, seed long, run long")
    m = len(metrics) + 1
    sums = scores.join(F.broadcast(runs_frame), ["method", "condition", "seed"]).groupBy("session", "run").agg(*[F.sum(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(metrics)], F.count("*").cast("double").alias(f"m{m - 1}"))
    each = F.struct(F.array(*[F.col("run") * m + k for k in range(m)]).alias("c"), F.array(*[f"m{k}" for k in range(m)]).alias("v"))
    rows = sums.groupBy("session").agg(F.collect_list(each).alias("all"))  # a few values a training run
    rows = rows.select("session", F.flatten(F.transform("all", lambda x: x["c"])).alias("components"), F.flatten(F.transform("all", lambda x: x["v"])).alias("values"))
    arms: dict[tuple[str, str], list[int]] = {}
    for i, (method, condition, _) in enumerate(plan):
        arms.setdefault((method, condition), []).append(i)

    def contrasts(vectors: dict[int, np.ndarray], numbers: np.ndarray) -> pa.Table:
        zero = np.zeros(len(numbers))

        def mean(arm: tuple[str, str], k: int) -> np.ndarray:
            of_seed = np.array([_over(vectors.get(i * m + k, zero), vectors.get(i * m + m - 1, zero)) for i in arms[arm]])
            if not resample_seeds:
                return of_seed.mean(0)
            slots = np.arange(len(of_seed), dtype=np.uint32) + np.uint32(arms[arm][0] << 8)
            drawn = (hashes(slots, slots, numbers & 0xFFFFFFFF, seed + 1).astype(np.uint64) * np.uint64(len(of_seed)) >> np.uint64(32)).astype(int)
            drawn[:, numbers < 0] = np.arange(len(of_seed))[:, None]
            return np.take_along_axis(of_seed, drawn, 0).mean(0)

        out = [(numbers, *arm, name, mean(arm, k), mean((arm[0], baseline), k)) for arm in arms if arm[0] in based and arm[1] != baseline for k, name in enumerate(metrics)]
        column = lambda i: [row[i] for row in out for _ in range(len(numbers))]
        joined = lambda i: np.concatenate([row[i] for row in out]) if out else np.zeros(0)
        return pa.table({"replicate": pa.array(joined(0), pa.int64()), "method": pa.array(column(1), pa.string()), "condition": pa.array(column(2), pa.string()), "metric": pa.array(column(3), pa.string()), "arm": joined(4), "base": joined(5)})

    return _of_blocks(replicate_sums(rows, "session", replicates, seed), contrasts, "replicate long, method string, condition string, metric string, arm double, base double", replicates)


def contrast_table(contrasts: DataFrame, margin: float = MARGIN, relative_margin: float | None = None) -> DataFrame:
    """One row a contrast, in percentage points: difference, 95 % interval, one-sided lower bound, deviation, p and Holm's p, and both verdicts.

    p is twice the smaller share of replicates on one side of 0. An arm is not
    inferior if its lower bound lies above -margin, and equivalent if the whole
    interval lies within it; with `relative_margin` the margin is that share of
    the baseline.
    """
    # Equal arms differ by the order of their sums at most: what is left of that counts as 0.
    drawn, d = F.col("replicate") >= 0, F.round((F.col("arm") - F.col("base")) * 100, 9)
    of = F.when(drawn, d)
    point = lambda c: F.max(F.when(~drawn, F.col(c)))
    share = lambda c: F.count_if(drawn & c) / F.count(of)
    t = contrasts.groupBy("method", "condition", "metric").agg(
        (point("arm") * 100).alias("arm"), (point("base") * 100).alias("baseline"), F.percentile(of, F.lit(0.025)).alias("ci_low"), F.percentile(of, F.lit(0.975)).alias("ci_high"),
        F.percentile(of, F.lit(0.05)).alias("lower_bound"), F.stddev_samp(of).alias("se"), F.least(F.lit(1.0), 2 * F.least(share(d <= 0), share(d >= 0))).alias("p"),
    )
    t = t.withColumn("delta", F.col("arm") - F.col("baseline"))
    t = t.withColumn("relative", F.when(F.col("baseline") != 0, F.col("delta") / F.col("baseline")))
    t = t.withColumn("margin", F.lit(float(margin)) if relative_margin is None else relative_margin * F.col("baseline"))
    t = t.withColumns({"non_inferior": F.col("lower_bound") > -F.col("margin"), "equivalent": (F.col("ci_low") > -F.col("margin")) & (F.col("ci_high") < F.col("margin"))})
    named = t.withColumns({"name": F.concat_ws("|", "method", "metric", "condition"), "__all": F.lit(1)})
    return holm(named, "p", "__all").withColumnRenamed("adjusted", "p_holm").drop("name", "__all")
