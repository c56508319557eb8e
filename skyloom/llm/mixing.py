"""Mixing sources to target shares of the tokens.

Every document has a rate, the expected number of its copies. Entropy balancing takes the rates nearest to one
copy of each (least Kullback-Leibler divergence) that give every source its token budget. They are
exp(lambda_s * tokens / mean tokens of s), cut at the source's max_repeats, and lambda solves the convex dual.
Newton steps for all sources run together: a step is one aggregation per source over the distinct document
lengths, bracketed so that it can't diverge. Rates become whole copies by a threshold on a hash of the id,
which is shifted per source until the copies' tokens meet the budget as nearly as the bins allow.

A source that can't supply its share even at max_repeats supplies all it has, and what it lacks is spread over
the others in proportion to their shares, so the total stays.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import source_key
from skyloom.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BINS, STEPS = 4096, 60


def _counter(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(documents: DataFrame, text: str, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """documents with n_tokens in place of the text column; null and empty texts have 0. The vocabulary file is
    read by the driver and sent along, so the executors need no file."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in documents.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _counter(sent.value, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            n = pa.array([len(encoder.encode_ordinary(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema) + ", n_tokens bigint"
    return documents.select(*kept, text).mapInArrow(count, schema)


def budgets(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Token budget per source: total * share, at most max_repeats times what there is; the rest is spread over
    the sources that have more, by share."""
    most = {s: m * available.get(s, 0) for s, (_, m) in targets.items()}
    total = min(sum(available.get(s, 0) for s in targets) if total is None else total, sum(most.values()))
    out: dict[str, float] = {}
    open_ = {s for s, (w, _) in targets.items() if w > 0}
    while open_:
        left, weight = total - sum(out.values()), sum(targets[s][0] for s in open_)
        full = {s for s in open_ if left * targets[s][0] / weight >= most[s]}
        if not full:
            return out | {s: left * targets[s][0] / weight for s in open_}
        out |= {s: float(most[s]) for s in full}
        open_ -= full
    return out


def _rate(tokens: Column, lam: Column, mean: Column, cap: Column) -> Column:
    return F.least(F.exp(F.least(lam * tokens / mean, F.lit(50.0))), cap)


def _solve(
    lengths: DataFrame, want: dict[str, float], caps: dict[str, int], sums: dict[str, tuple[int, int]], tolerance: float
) -> tuple[dict[str, float], dict[str, float]]:
    """lambda per source and the relative miss of its budget there, the gradient of the dual, which is at most `tolerance`
    where the steps converged. lengths: source, n_tokens, n."""
    spark = lengths.sparkSession
    mean = {s: t / n for s, (n, t) in sums.items()}
    lam = {s: 0.0 for s in want if 0 < want[s] < caps[s] * sums[s][1]}
    best = dict(lam)
    low, high = dict.fromkeys(lam, -np.inf), dict.fromkeys(lam, np.inf)
    todo, misses = set(lam), dict.fromkeys(lam, float("inf"))
    for _ in range(STEPS):
        if not todo:
            break
        state = spark.createDataFrame([(s, lam[s], mean[s], float(caps[s])) for s in sorted(todo)], "source string, lam double, mean double, cap double")
        r = _rate(F.col("n_tokens"), F.col("lam"), F.col("mean"), F.col("cap"))
        mass = F.col("n") * F.col("n_tokens")
        got = (
            lengths.join(F.broadcast(state), "source").groupBy("source")
            .agg(F.sum(mass * r).alias("value"), F.sum(F.when(r < F.col("cap"), mass * r * F.col("n_tokens") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        for row in got.collect():
            s, miss = row["source"], row["value"] - want[row["source"]]
            if abs(miss) < misses[s] * want[s]:
                best[s], misses[s] = lam[s], abs(miss) / want[s]
            if abs(miss) <= tolerance * want[s]:
                todo.discard(s)
                continue
            low[s], high[s] = (low[s], min(high[s], lam[s])) if miss > 0 else (max(low[s], lam[s]), high[s])
            most = 0.5 + abs(lam[s])
            step = lam[s] - (np.clip(miss / row["slope"], -most, most) if row["slope"] > 0 else np.sign(miss) * most)
            lam[s] = float(step) if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return best, misses


def mix_sources(
    documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY, pattern: str | None = None,
    seed: str = "mix", tolerance: float = 1e-6, max_targets: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: doc_id, source, n_tokens, rate, copies for every document of a target source; copies may be 0 and
    never exceeds the source's max_repeats. report: for each target source target_share, max_repeats, documents,
    tokens (what there is), budget, used_tokens, share (reached), most_copies, limited (true if it could not
    supply its share), gradient and converged.

    Sources are compared by source_key; repeated targets add up, taking the larger max_repeats; a null or
    non-positive share or max_repeats means none of it. gradient (relative miss of the budget by the rates) and
    converged say how well the dual was solved; where it was not to within `tolerance`, the best step is used. Documents of other or null sources are in no mix,
    those without tokens have no copies. total_tokens defaults to all tokens of the target sources. Equal ids
    round alike. More than max_targets targets are refused."""
    rows = (
        targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("m"))
        .filter("source IS NOT NULL").groupBy("source").agg(F.sum("w").alias("w"), F.max("m").alias("m")).limit(max_targets + 1).collect()
    )
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    spark = documents.sparkSession
    aims = {r["source"]: (r["w"], r["m"]) for r in rows}
    listed = spark.createDataFrame([(s,) for s in aims], "source string")
    mine = documents.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), F.col("text")).join(F.broadcast(listed), "source", "left_semi")
    counted = cut(count_tokens(mine, "text", vocabulary, pattern))
    sums = {r["source"]: (r["n"], r["t"]) for r in counted.filter("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    want = budgets(aims, {s: t for s, (_, t) in sums.items()}, total_tokens)
    want = {s: b for s, b in want.items() if b > 0}
    caps = {s: m for s, (_, m) in aims.items()}
    lengths = cut(counted.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    lam, misses = _solve(lengths, want, caps, sums, tolerance)
    state = spark.createDataFrame(
        [(s, lam.get(s, 1e9), sums[s][1] / sums[s][0], float(caps[s]), float(want[s])) for s in want], "source string, lam double, mean double, cap double, budget double"
    )
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    rated = (
        counted.join(F.broadcast(state), "source", "left")
        .withColumn("rate", F.when(F.col("n_tokens") > 0, F.coalesce(_rate(F.col("n_tokens"), F.col("lam"), F.col("mean"), F.col("cap")), F.lit(0.0))).otherwise(0.0))
        .withColumn("_base", F.floor("rate"))
        .withColumn("_at", F.when(F.col("rate") < F.coalesce("cap", F.lit(0.0)), F.when(F.col("n_tokens") > 0, u - (F.col("rate") - F.col("_base")))))
    )
    bin_ = F.floor((F.col("_at") + 1) / 2 * BINS).cast("int")
    gains = rated.filter("budget IS NOT NULL").groupBy("source", "budget", F.coalesce(bin_ + 1, F.lit(0)).alias("edge")).agg(
        F.sum(F.col("_base") * F.col("n_tokens")).alias("base"), F.sum(F.when(bin_.isNotNull(), F.col("n_tokens")).otherwise(0)).alias("gain")
    )  # at most BINS + 2 rows a source: what all copies come to if the bins below an edge round up
    zero = spark.createDataFrame([(s, float(want[s])) for s in want], "source string, budget double").select("source", "budget", F.lit(0).alias("edge"), F.lit(0.0).alias("base"), F.lit(0).alias("gain"))
    of = Window.partitionBy("source")
    reach = F.sum("gain").over(of.orderBy("edge")) + F.sum("base").over(of)
    edges = (
        gains.unionByName(zero).withColumn("_miss", F.abs(reach - F.col("budget")))
        .groupBy("source").agg(F.min_by("edge", F.struct("_miss", "edge")).alias("edge"))
    )
    copies = (
        rated.withColumn("_bin", bin_).join(F.broadcast(edges), "source", "left")
        .select("doc_id", "source", "n_tokens", "rate", (F.col("_base") + F.coalesce((F.col("_bin") < F.col("edge")).cast("int"), F.lit(0))).cast("int").alias("copies"))
    )
    used = copies.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    whole = spark.createDataFrame(
        [(s, float(w), int(m), float(want.get(s, 0.0)), bool(w > 0 and want.get(s, 0.0) >= m * sums.get(s, (0, 0))[1]), misses.get(s, 0.0), misses.get(s, 0.0) <= tolerance) for s, (w, m) in aims.items()],
        "source string, target_share double, max_repeats int, budget double, limited boolean, gradient double, converged boolean",
    )
    joined = whole.join(used, "source", "left").na.fill(0, ["documents", "tokens", "used_tokens", "most_copies"])
    total = joined.agg(F.sum("used_tokens").alias("_total"))
    report = joined.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "documents", "tokens", "budget", "used_tokens",
        F.when(F.col("_total") > 0, F.col("used_tokens") / F.col("_total")).otherwise(0.0).alias("share"), "most_copies", "limited", "gradient", "converged",
    )
    return copies, report
