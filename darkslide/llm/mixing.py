"""A mixture of sources at target shares of a total size in tokens, with a capped number of repeats.

Token weights of the cells (source, language, topic) are raked: iterative proportional fitting scales them to the
marginals of languages and topics and, last, of sources, so that the shares of sources hold exactly. Documents are then
drawn by the calibrated weight of their cell, systematically in order of size, so that a cell's tokens come out within
one document of what they should be."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.llm.tokenizer import TOKENIZERS, count_tokens
from darkslide.sources.tables import written

ROUNDS = 200
CLOSE = 1e-9
EXACT_SIZES = 2048  # sizes up to this many tokens are ranked one by one, larger ones in bands of one percent
ROWS_A_BUCKET = 500_000


@dataclass
class Cell:
    source: str
    lang: str
    topic: str
    tokens: float
    documents: int


def budgets(
    targets: list[tuple[str, float, int]], available: dict[str, float], total: float
) -> dict[str, float]:
    """Tokens each listed source contributes: its share of the total, at most its tokens times its repeats. What a
    source can't give goes to the others in proportion to their shares, so the total is reached wherever it can be."""
    share = {s: max(p or 0.0, 0.0) for s, p, _ in targets}
    most = {s: available.get(s, 0.0) * max(r or 0, 0) for s, _, r in targets}
    out = dict.fromkeys(share, 0.0)
    open_ = {s for s in share if share[s] > 0 and most[s] > 0}
    left = total
    while open_ and left > 1e-9:
        whole = sum(share[s] for s in open_)
        full = {s for s in open_ if share[s] / whole * left >= most[s]}
        if not full:
            for s in open_:
                out[s] = share[s] / whole * left
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
        open_ -= full
    return out


def _filled(weights: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """`weights` scaled to sum to `total`, none above its `most`; what is cut off goes to the others in proportion."""
    out, free = np.zeros_like(weights), weights > 0
    left = total
    while free.any() and left > 0:
        scaled = weights * (left / weights[free].sum())
        over = free & (scaled >= most)
        if not over.any():
            out[free] = scaled[free]
            break
        out[over] = most[over]
        left -= most[over].sum()
        free &= ~over
    return out


def rake(cells: list[Cell], budget: dict[str, float], repeats: dict[str, int]) -> np.ndarray:
    """Expected uses of a document of each cell."""
    return fitted(cells, budget, repeats)[0]


def fitted(cells: list[Cell], budget: dict[str, float], repeats: dict[str, int]) -> tuple[np.ndarray, int, float]:
    """(expected uses of a document of each cell, rounds, share of the tokens that the last round still moved).

    The marginals of languages and topics are those of the listed sources' own tokens. They are met as far as sources
    and repeats allow; the marginal of sources is met exactly."""
    tokens = np.array([c.tokens for c in cells], dtype=float)
    most = tokens * np.array([repeats.get(c.source) or 0 for c in cells], dtype=float)
    total = sum(budget.values())
    sides = []
    for field in ("lang", "topic"):
        names = sorted({getattr(c, field) for c in cells})
        of = np.array([names.index(getattr(c, field)) for c in cells])
        sums = np.bincount(of, tokens, len(names))
        sides.append((of, sums / max(tokens.sum(), 1e-300) * total, len(names)))
    sources = sorted(budget)
    of_source = np.array([sources.index(c.source) for c in cells])
    x = tokens.copy()

    def to_sources(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for i, s in enumerate(sources):
            mine = of_source == i
            if mine.any():
                x[mine] = _filled(x[mine], most[mine], budget[s])
        return x

    rounds, moved = 0, 0.0
    for rounds in range(1, ROUNDS + 1):
        old = x
        for of, wanted, n in sides:
            sums = np.bincount(of, x, n)
            x = x * np.divide(wanted, sums, out=np.zeros(n), where=sums > 0)[of]
            x = np.maximum(x, tokens * 1e-9)
        x = to_sources(x)
        moved = float(np.abs(x - old).sum() / max(total, 1.0))
        if moved <= CLOSE:
            break
    return np.divide(x, tokens, out=np.zeros_like(x), where=tokens > 0), rounds, moved


def sized(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document, counted once and kept in the shared folder."""
    unknown = F.lit("?")
    return written(
        count_tokens(
            documents.select(
                "doc_id",
                "source",
                F.coalesce("lang", unknown).alias("lang"),
                F.coalesce("doc_kind", unknown).alias("topic"),
                "text",
            ),
            tokenizers=tokenizers,
        ),
        "sizes",
    )


def plan(sizes: DataFrame, targets: DataFrame, fraction: float) -> tuple[DataFrame, list, dict[str, float], float]:
    """(cells with their weight, the targets, tokens by source, tokens in all). The driver sees one row per source,
    language and topic, never a document."""
    listed = [
        (r["source"], r["target_share"], r["max_repeats"])
        for r in targets.groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .where(F.col("source").isNotNull())
        .collect()
    ]
    names = {s for s, _, _ in listed}
    rows = (
        sizes.groupBy("source", "lang", "topic")
        .agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
        .collect()
    )
    everything = float(sum(r["tokens"] for r in rows))
    cells = [
        Cell(r["source"], r["lang"], r["topic"], float(r["tokens"]), r["documents"])
        for r in rows
        if r["source"] in names and r["tokens"] > 0
    ]
    cells.sort(key=lambda c: (c.source, c.lang, c.topic))
    available: dict[str, float] = {}
    for c in cells:
        available[c.source] = available.get(c.source, 0.0) + c.tokens
    budget = budgets(listed, available, everything * fraction)
    weights = rake(cells, budget, {s: r for s, _, r in listed}) if cells else np.zeros(0)
    table = [(c.source, c.lang, c.topic, float(w), c.documents) for c, w in zip(cells, weights, strict=True)]
    made = sizes.sparkSession.createDataFrame(
        table, "source string, lang string, topic string, weight double, documents bigint"
    )
    return made, listed, budget, everything


def mix(
    documents: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 11, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of the documents of the mixture; each is to be used `uses` times.

    Sources that aren't listed, and null, empty and other texts without a token, are never used; a listed source without
    documents gives nothing, and its share goes to the others. No document is used more than max_repeats times.
    Documents are ranked by size within their cell through counts for each size and hash bucket, so no task ever sees
    more than one bucket, however many documents a cell, a size or a copied text has."""
    used = _drawn(sized(documents, tokenizers), targets, fraction, seed)[0]
    return used.select("doc_id", "source", "n_tokens", "uses")


def _drawn(sizes: DataFrame, targets: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, list, dict, float]:
    cells, listed, budget, everything = plan(sizes, targets, fraction)
    buckets = max(16, sizes.count() // ROWS_A_BUCKET)
    n = F.col("n_tokens")
    band = F.when(n <= EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(F.log(n / EXACT_SIZES) * 100))
    cell = ["source", "lang", "topic"]
    chance = F.xxhash64(F.col("doc_id"), F.lit(seed))
    placed = (
        sizes.where(n > 0)
        .join(cells.where("weight > 0"), cell)
        .withColumn("band", band.cast("bigint"))
        .withColumn("chance", chance)
        .withColumn("bucket", F.pmod(chance, F.lit(buckets)))
    )
    group = [*cell, "band", "bucket"]
    # Two levels of running sums, over the bands of a cell and over the buckets of a band, so neither is ever long.
    counts = placed.groupBy(*group).agg(F.count("*").alias("here"))
    earlier = (Window.unboundedPreceding, -1)
    bands = counts.groupBy(*cell, "band").agg(F.sum("here").alias("all"))
    by_band = Window.partitionBy(*cell).orderBy("band").rowsBetween(*earlier)
    bands = bands.select(*cell, "band", F.coalesce(F.sum("all").over(by_band), F.lit(0)).alias("below"))
    by_bucket = Window.partitionBy(*cell, "band").orderBy("bucket").rowsBetween(*earlier)
    before = (
        counts.withColumn("beside", F.coalesce(F.sum("here").over(by_bucket), F.lit(0)))
        .join(bands, [*cell, "band"])
        .select(*group, (F.col("below") + F.col("beside")).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy(*group).orderBy("n_tokens", "chance", "doc_id"))
    rank = F.col("before") + within
    rest = F.col("weight") - F.floor("weight")
    # A start between 0 and 1 for each cell; the k-th document is drawn where start + k * rest passes a whole number.
    start = F.pmod(F.xxhash64(*cell, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    extra = F.floor(start + rank * rest) - F.floor(start + (rank - 1) * rest)
    used = (
        placed.join(before, group)
        .withColumn("uses", (F.floor("weight") + extra).cast("int"))
        .where("uses > 0")
        .select("doc_id", "source", "lang", "topic", "n_tokens", "uses")
    )
    return used, listed, budget, everything


def shares(
    documents: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 11, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """One row per listed source: what it should contribute, what it could, and what the mixture really has of it."""
    used, listed, budget, everything = _drawn(sized(documents, tokenizers), targets, fraction, seed)
    spark = documents.sparkSession
    table = spark.createDataFrame(
        [(s, p, r, float(budget[s])) for s, p, r in listed],
        "source string, target_share double, max_repeats int, planned_tokens double",
    )
    got = used.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"),
        F.count("*").alias("documents"),
        F.max("uses").alias("most_uses"),
    )
    zero = F.lit(0)
    joined = table.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "planned_tokens",
        F.coalesce("used_tokens", zero).alias("used_tokens"),
        F.coalesce("documents", zero).alias("documents"),
        F.coalesce("most_uses", zero).cast("int").alias("most_uses"),
    )
    whole = Window.partitionBy(F.lit(1))  # one row per listed source
    return joined.withColumn("actual_share", F.try_divide("used_tokens", F.sum("used_tokens").over(whole))).withColumn(
        "of_corpus", F.try_divide(F.sum("used_tokens").over(whole), F.lit(everything))
    )


def marginals(
    documents: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 11, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """(side, name, wanted_share, used_share, gap, rounds, moved): how far the mixture is from the marginals it was raked to,
    for each source, language and topic of the listed sources. The wanted share of a source is what it was planned to
    give, of a language or topic its share in the listed sources' own tokens. rounds and moved, the share of the tokens
    that the last round still moved, say whether the fit converged."""
    sizes = sized(documents, tokenizers)
    used, listed, budget, _ = _drawn(sizes, targets, fraction, seed)
    names = [s for s, _, _ in listed]
    keys = ["source", "lang", "topic"]
    had = sizes.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).groupBy(*keys)
    had = {tuple(r[k] for k in keys): float(r["n"]) for r in had.agg(F.sum("n_tokens").alias("n")).collect()}
    got = used.groupBy(*keys).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n")).collect()
    got = {tuple(r[k] for k in keys): float(r["n"]) for r in got}
    cells = [Cell(*k, n, 1) for k, n in sorted(had.items())]
    rounds, moved = fitted(cells, budget, {s: r for s, _, r in listed})[1:] if cells else (0, 0.0)
    rows = []
    for i, side in enumerate(keys):
        wanted: dict[str, float] = dict(budget) if side == "source" else {}
        reached: dict[str, float] = {}
        for k, n in had.items() if side != "source" else ():
            wanted[k[i]] = wanted.get(k[i], 0.0) + n
        for k, n in got.items():
            reached[k[i]] = reached.get(k[i], 0.0) + n
        whole, all_ = sum(wanted.values()), sum(reached.values())
        for name in sorted(wanted.keys() | reached.keys()):
            want = wanted.get(name, 0.0) / whole if whole else 0.0
            have = reached.get(name, 0.0) / all_ if all_ else 0.0
            rows.append((side, name, want, have, have - want, rounds, moved))
    kind = "side string, name string, wanted_share double, used_share double, gap double, rounds int, moved double"
    return documents.sparkSession.createDataFrame(rows, kind)


def violations(
    documents: DataFrame, targets: DataFrame, fraction: float = 0.5, seed: int = 11, tokenizers: str = TOKENIZERS
) -> DataFrame:
    """(doc_id, uses) of documents that the mixture uses against its rules: of a source that isn't listed, more often than
    its source allows, twice in the list, or without a token. There must be none."""
    rules = targets.groupBy("source").agg(F.max("max_repeats").alias("most"))
    used = mix(documents, targets, fraction, seed, tokenizers).groupBy("doc_id", "source").agg(
        F.sum("uses").alias("uses"), F.count("*").alias("rows"), F.min("n_tokens").alias("least")
    )
    bad = F.col("most").isNull() | (F.col("uses") > F.col("most")) | (F.col("rows") > 1) | (F.col("least") <= 0)
    return used.join(rules, "source", "left").where(bad).select("doc_id", "uses")
