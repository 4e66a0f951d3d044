"""Exact top-k inner-product search by multi-resolution segment statistics.

Vectors are turned by a fixed rotation that a bounded sample was learned from
(principal components: the parts that vary most come first), which leaves inner
products as they are. A vector is then cut into segments; with the mean m and
deviation s of a segment of L components, Cauchy-Schwarz gives for a pair (x, q)

    <x, q> <= sum over segments of L * (m_x * m_q + s_x * s_q),

that is, a lower bound on the squared distance |x|^2 + |q|^2 - 2 <x, q>. The
coarsest level has one segment; finer ones cut the leading components out one by
one and keep the rest as one segment, so each level adds a few products to those
of the level before. A query's candidates pass the levels from coarse to fine
against the k-th best score so far, and only the survivors get an exact integer
product. Bounds are widened by more than float64 can lose, so no true neighbour
is dropped. A level that drops next to nothing in a block is left out there.

Rows are numbered and written once. Queries are dealt into blocks and candidates
into stripes of bounded rows, each by row number; a task has one block and one
stripe, and partial top-k lists are merged per query by aggregation.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; vectors of another length than a query's are no candidates of
it. Rows are the unit: repeated ids are separate candidates and separate queries
(each gets its own k ranks), and only a query's own row is no candidate of it.
Ties go to the smaller id. Scores are exact: components of 2**62 or more raise an
error, products that float64 or int64 could spoil are made with Python's
integers, and a score that is no long raises an error. Other columns than the two
named ones are not read. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

LEVELS = (0, 0.25, 0.5, 0.75, 0.875)  # share of the components that are segments of their own, coarse to fine
STRIPE_ROWS = 16_384  # candidates that one task holds
BLOCK_ROWS = 16_384  # queries that one task holds
ASK_ROWS = 1_024  # queries that are searched together
TILE_ROWS = 2_048  # candidates that are bounded together
SAMPLE_ROWS = 4_096  # rows that the rotation is learned from, at most about
LARGEST_ROTATION = 1_024  # components; longer vectors are not turned
IDLE = 0.05  # a level that drops a smaller share of the pairs is left out
TOP = 2**62


def rotation(sample: np.ndarray) -> np.ndarray:
    """The principal components of a sample, those of the largest variance first, as columns of an orthogonal matrix."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1].copy()


def segment_statistics(x: np.ndarray, share: float) -> np.ndarray:
    """The means of the segments of one component each that a share of the components makes (their deviation is 0), and
    mean and deviation of the segment that the others are, scaled so that a plain product of two rows is the bound."""
    head = int(share * x.shape[1])
    rest = x[:, head:]
    mean = rest.mean(axis=1, keepdims=True)
    deviation = np.sqrt(np.maximum((rest * rest).mean(axis=1, keepdims=True) - mean * mean, 0))
    return np.concatenate([x[:, :head], mean * np.sqrt(rest.shape[1]), deviation * np.sqrt(rest.shape[1])], axis=1)


def _products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, small: bool, safe: bool) -> np.ndarray:
    """Exact inner products of the given pairs."""
    if small and len(rows) > 0.05 * len(q) * len(c):
        return (q.astype(np.float64) @ c.astype(np.float64).T)[rows, cols].astype(np.int64)  # products of integers of this size are exact in float64
    if safe:
        return np.einsum("ij,ij->i", q[rows], c[cols])
    exact = [sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(q[rows].tolist(), c[cols].tolist(), strict=True)]
    if any(not -(2**63) <= s < 2**63 for s in exact):
        raise OverflowError("a score does not fit a long")
    return np.array(exact, np.int64)


def search_block(
    qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, turn: np.ndarray | None = None, levels: tuple[float, ...] = LEVELS, report: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) places of each query's k best of these candidates, ties to the smaller id. report gets (survivors, pairs) of each tile."""
    n, d = q.shape
    shares = {int(d * s): s for s in levels if int(d * s) < d}
    heads = sorted(shares)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    long_q, long_c = np.sqrt((qf * qf).sum(1)), np.sqrt((cf * cf).sum(1))
    reach = long_q.max(initial=0) * long_c.max(initial=0)
    small, safe = reach < 2**52 and _small(q, c), reach < 2**61
    if turn is not None:
        qf, cf = qf @ turn, cf @ turn
    qs, cs = ({h: segment_statistics(x, s)[:, -2:] for h, s in shares.items()} for x in (qf, cf))
    slack = 1e-9 * long_q[:, None] * long_c.max(initial=0) + 1e-6
    kth = np.full(n, -np.inf)
    best_q, best_c, best_s = (np.zeros(0, np.int64) for _ in range(3))
    order = np.argsort(-long_c, kind="stable")  # long vectors first: they raise the k-th best early
    kept = heads
    for number, at in enumerate(range(0, len(c), TILE_ROWS)):
        tile = order[at : at + TILE_ROWS]
        alive = qrow[:, None] != crow[tile][None, :]
        if np.isfinite(kth).any():
            head, done, share, useful = np.zeros((n, len(tile))), 0, 1.0, []
            for h in kept:
                if h > done:
                    head += qf[:, done:h] @ cf[tile, done:h].T
                    done = h
                alive &= head + qs[h] @ cs[h][tile].T + slack >= kth[:, None]
                now = float(alive.mean())
                if h == kept[-1] or share - now >= IDLE:
                    useful.append(h)
                share = now
            kept = useful
        rows, cols = np.nonzero(alive)
        if report is not None and number:
            report.append((len(rows), alive.size))
        if not len(rows):
            continue
        exact = _products(q, c[tile], rows, cols, small, safe)
        good = exact >= kth[rows]
        best_q, best_c, best_s = np.concatenate([best_q, rows[good]]), np.concatenate([best_c, tile[cols[good]]]), np.concatenate([best_s, exact[good]])
        by = np.lexsort((crow[best_c], cid[best_c], -best_s, best_q))
        best_q, best_c, best_s = best_q[by], best_c[by], best_s[by]
        first = np.searchsorted(best_q, np.arange(n))
        nth = np.arange(len(best_q)) - first[best_q]
        full = nth == k - 1
        kth[best_q[full]] = best_s[full]
        best_q, best_c, best_s = best_q[nth < k], best_c[nth < k], best_s[nth < k]
    return best_q, best_c, best_s


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return top(a) * top(b) * max(1, a.shape[1]) < 2**52


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of every component, without vectors that hold null or non-finite ones."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(F.coalesce(v, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < F.lit(float(TOP)), F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return df.filter(sound).select(F.col(id_col).alias("id"), F.transform(v, whole).alias("v"))


def _turns(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """A rotation for each length of vectors, from about SAMPLE_ROWS rows with a small hash of their number."""
    cut = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * SAMPLE_ROWS // max(1, n))
    sample: dict[int, list] = {}
    for r in rows.filter((F.xxhash64("row") <= F.lit(cut)) & (F.size("v") <= LARGEST_ROTATION)).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    return {d: rotation(np.array(v, np.float64)) for d, v in sample.items() if len(v) > 2 and d > 1}


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of a frame (id, v array<long>): each query row against every other row."""
    rows = stored(vectors.select("id", "v", F.coalesce(is_query, F.lit(False)).alias("q")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asks = rows.agg(F.count("row"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    turns = _turns(rows, n)
    stripes, blocks = max(1, -(-n // STRIPE_ROWS)), max(1, -(-asks // BLOCK_ROWS))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    asked = rows.filter("q").select("id", "v", "row", "q", dealt(blocks).alias("block"), all_of(stripes).alias("stripe"))
    given = rows.select("id", "v", "row", F.lit(False).alias("q"), all_of(blocks).alias("block"), dealt(stripes).alias("stripe"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_NOTHING]
        size = pdf["v"].map(len)
        for d, same in pdf.groupby(size):
            ask, give = same[same["q"]], same[~same["q"]]
            if not len(ask) or not len(give):
                continue
            cid, crow, c = give["id"].to_numpy(np.int64), give["row"].to_numpy(np.int64), np.stack(give["v"].to_numpy()).astype(np.int64)
            for at in range(0, len(ask), ASK_ROWS):
                some = ask.iloc[at : at + ASK_ROWS]
                qid, qrow = some["id"].to_numpy(np.int64), some["row"].to_numpy(np.int64)
                a, b, score = search_block(qrow, np.stack(some["v"].to_numpy()).astype(np.int64), crow, c, cid, k, turns.get(int(d)))
                out.append(pd.DataFrame({"query": qrow[a], "query_id": qid[a], "vec_id": cid[b], "row": crow[b], "score": score}))
        return pd.concat(out, ignore_index=True)

    found = asked.unionByName(given).groupBy("stripe", "block").applyInPandas(run, "query long, query_id long, vec_id long, row long, score long")
    ranked = found.selectExpr("query_id", "vec_id", "score", "row_number() over (partition by query order by score desc, vec_id, row) as rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


_NOTHING = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query", "query_id", "vec_id", "row", "score")})
