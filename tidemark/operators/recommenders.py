"""Neighbourhood, graph and linear recommenders over (row, col, value) frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sampling import dense_index
from .sparse import multiply, normalise, top_per, transpose

#: The largest item catalogue whose dense Gram matrix may go to the driver (8 bytes a cell: 200 MB).
DENSE_LIMIT = 5000


def gram(x: DataFrame) -> DataFrame:
    """(i, j, dot, common) over columns that share a row: the self join of a row's entries, summed up map-side. Cells i < j only are
    joined; the others follow by symmetry, which halves the shuffle."""
    a = x.select("row", F.col("col").alias("i"), F.col("value").alias("vi"))
    b = x.select("row", F.col("col").alias("j"), F.col("value").alias("vj"))
    half = a.join(b, "row").where("i < j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("dot"), F.count("*").alias("common"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "dot", "common"))


def centred(x: DataFrame, by: str) -> DataFrame:
    """Values less their row's (adjusted cosine) or column's (Pearson) mean."""
    return x.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy(by)))


def similarity(x: DataFrame, kind: str = "cosine", shrink: float = 0.0, k: int = 100, alpha: float = 0.5, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """The top k columns i for each column j: (i, j, value); diagonal left out, 1e-6 added to denominators.

    kinds: cosine, adjusted, pearson, asymmetric (norms to 2 alpha and 2 (1 - alpha)), jaccard (tanimoto), dice, tversky (a, b). The last three
    take values as they are and are meant for 0/1 matrices.
    """
    if kind == "adjusted":
        x = centred(x, "row")
    elif kind == "pearson":
        x = centred(x, "col")
    squares = x.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    g = gram(x).join(squares.select(F.col("col").alias("i"), F.col("q").alias("qi")), "i").join(squares.select(F.col("col").alias("j"), F.col("q").alias("qj")), "j")
    dot, qi, qj = F.col("dot"), F.col("qi"), F.col("qj")
    if kind in ("cosine", "adjusted", "pearson"):
        below = F.sqrt(qi) * F.sqrt(qj)
    elif kind == "asymmetric":
        below = F.pow(qi, F.lit(alpha)) * F.pow(qj, F.lit(1 - alpha))
    elif kind == "jaccard":
        below = qi + qj - dot
    elif kind == "dice":
        dot, below = 2 * dot, qi + qj
    elif kind == "tversky":
        below = dot + (qi - dot) * a + (qj - dot) * b
    else:
        raise ValueError(kind)
    s = g.select("i", "j", (dot / (below + shrink + 1e-6)).alias("value")).where("value <> 0")
    return top_per(s, "j", "value", ["i"], k)


def dense_knn(vectors: DataFrame, asked: Column, k: int, key: str = "article", vector: str = "vector", block: int = 1 << 21) -> DataFrame:
    """(i, j, value): the k rows i of highest cosine (1e-6 added to the denominator) for each row j that `asked` holds for, by value and i, j itself
    left out. Rows without a vector are as far as can be (null).

    Vectors are dense, so every pair has a value and a sparse product would move each of its terms. Here rows are packed into blocks of so many bytes,
    each block meets each block of asked rows in one product, and only its k best a row are shuffled. The product picks the rows that can be among the k best;
    their values are then summed up in the order of the vector, so that equal vectors tie wherever they are.
    """
    import pyarrow as pa

    def pack(batches):
        """Rows (id, v) as blocks of one width, 0 where there is no vector."""
        for batch in batches:
            ids, v = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            width = np.array(v.value_lengths().fill_null(0))
            for n in np.unique(width):
                at = np.flatnonzero(width == n)
                data = np.array(v.take(pa.array(at)).flatten()).reshape(len(at), n)
                step = max(1, block // max(8, 8 * int(n)))
                parts = [slice(x, x + step) for x in range(0, len(at), step)]
                yield pa.RecordBatch.from_pydict({"ids": [ids[at[x]].astype(np.int64).tobytes() for x in parts], "width": pa.array([int(n)] * len(parts), pa.int32()), "data": [data[x].tobytes() for x in parts]})

    def nearest(ids, a, jds, b):
        n = a.shape[1]
        squares = lambda x: sum((x[:, t] * x[:, t] for t in range(n)), np.zeros(len(x)))  # noqa: E731  in the order of the vector
        na, nb = np.sqrt(squares(a)), np.sqrt(squares(b))
        near = (b @ a.T) / (nb[:, None] * na[None, :] + 1e-6)
        for r, j in enumerate(jds):
            others = np.flatnonzero(ids != j)
            v = near[r, others]
            if len(others) > k and np.isfinite(v).all():
                others = others[v >= np.partition(v, -k)[-k] - 1e-9]
            chosen = a[others]
            v = sum((chosen[:, t] * b[r, t] for t in range(n)), np.zeros(len(others))) / (na[others] * nb[r] + 1e-6)
            order = np.lexsort((ids[others], -v, ~np.isnan(v)))[:k]  # NaN is the largest, as for Spark and SQL
            yield ids[others[order]], j, v[order].tolist()

    def best(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, jds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["jds"], np.int64)
                n, m = row["width"], row["jwidth"]
                if n and m and n != m:
                    raise ValueError(f"vectors of {n} and of {m} components")
                if n and m:
                    with np.errstate(all="ignore"):
                        found = list(nearest(ids, np.frombuffer(row["data"]).reshape(-1, n), jds, np.frombuffer(row["jdata"]).reshape(-1, m)))
                else:
                    found = [(x := np.sort(ids[ids != j])[:k], j, [None] * len(x)) for j in jds]
                if found:
                    i, value = np.concatenate([x[0] for x in found]), [v for x in found for v in x[2]]
                    yield pa.RecordBatch.from_pydict({"i": i, "j": np.repeat(jds, [len(x[0]) for x in found]), "value": pa.array(value, pa.float64())})

    # Blocks come in pairs: without a bound in bytes, an Arrow batch has 10,000 of them.
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    whole = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector).cast("array<double>"))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"), asked.alias("asked"))
    schema = "ids binary, width int, data binary"
    blocks = rows.select("id", "v").mapInArrow(pack, schema)
    # Behind a shuffle, which each pair of partitions reads again instead of the table.
    wanted = rows.where("asked").select("id", "v").mapInArrow(pack, schema).select(F.col("ids").alias("jds"), F.col("width").alias("jwidth"), F.col("data").alias("jdata")).repartition(F.xxhash64("jds"))
    return top_per(blocks.crossJoin(wanted).mapInArrow(best, "i long, j long, value double"), "j", "value", ["i"], k)


def euclidean(x: DataFrame, k: int, mode: str = "lin", shrink: float = 0.0) -> DataFrame:
    """1 / (distance + shrink + 1e-9) (or of its logarithm or exponential) between all columns, top k per column.

    Columns without a shared row are sqrt(qi + qj) apart, so of those only the k of smallest norm can be among the nearest. They are among the
    first n + k + 1 columns by norm, n being the number of columns that share a row: about as many rows more as the Gram matrix has cells.
    """
    squares = x.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    g = gram(x).select("i", "j", "dot")
    by_norm = dense_index(squares, ["q", "col"], "at").select("at", F.col("col").alias("i"))
    reach = squares.select(F.col("col").alias("j")).join(g.groupBy("j").agg(F.count("*").alias("n")), "j", "left").crossJoin(F.broadcast(squares.agg(F.count("*").alias("all"))))
    last = F.least(F.coalesce("n", F.lit(0)) + k, F.col("all") - 1)
    apart = reach.select("j", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at")).join(by_norm, "at").where("i <> j").join(g, ["i", "j"], "left_anti")
    apart = top_per(apart.withColumn("near", -F.col("at")), "j", "near", ["i"], k).select("i", "j", F.lit(0.0).alias("dot"))
    g = g.unionByName(apart).join(squares.select(F.col("col").alias("i"), F.col("q").alias("qi")), "i").join(squares.select(F.col("col").alias("j"), F.col("q").alias("qj")), "j")
    distance = F.sqrt(F.greatest(F.col("qi") + F.col("qj") - 2 * F.col("dot"), F.lit(0.0)))
    below = {"lin": distance, "log": F.log1p(distance), "exp": F.exp(distance)}[mode] + shrink + 1e-9
    return top_per(g.select("i", "j", (1 / below).alias("value")), "j", "value", ["i"], k)


def bm25(x: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows are documents, columns terms."""
    n = x.agg(F.count_distinct("row").alias("n"), F.sum("value").alias("t"))
    length = x.groupBy("row").agg(F.sum("value").alias("length"))
    df = x.groupBy("col").agg(F.count("*").alias("df"))
    y = x.join(length, "row").join(df, "col").crossJoin(F.broadcast(n))
    norm = (1 - b) + b * F.col("length") / (F.col("t") / F.col("n"))
    return y.select("row", "col", (F.ln(F.col("n") / (1 + F.col("df"))) * F.col("value") * (k1 + 1) / (k1 * norm + F.col("value"))).alias("value"))


def tf_idf(x: DataFrame) -> DataFrame:
    """sqrt(tf) * ln(N / (1 + df))."""
    n = x.agg(F.count_distinct("row").alias("n"))
    df = x.groupBy("col").agg(F.count("*").alias("df"))
    return x.join(df, "col").crossJoin(F.broadcast(n)).select("row", "col", (F.sqrt("value") * F.ln(F.col("n") / (1 + F.col("df")))).alias("value"))


def p3alpha(x: DataFrame, alpha: float = 1.0, beta: float = 0.0, k: int = 100) -> DataFrame:
    """Two steps of a random walk, item to user to item, each to the power alpha; with beta divided by the target's degree^beta.
    Top k per start, rows normalised, then top k per target: (i, j, value)."""
    ones = x.withColumn("value", F.lit(1.0))
    power = lambda m: normalise(m, "row").withColumn("value", F.pow("value", F.lit(alpha)))
    w = multiply(power(transpose(ones)), power(ones)).where("row <> col")
    if beta:
        degree = ones.groupBy("col").agg(F.sum("value").alias("d"))
        w = w.join(degree, "col").select("row", "col", (F.col("value") / F.pow("d", F.lit(beta))).alias("value"))
    w = normalise(top_per(w, "row", "value", ["col"], k), "row")
    return top_per(w.select(F.col("row").alias("i"), F.col("col").alias("j"), "value"), "j", "value", ["i"], k)


def score(profile: DataFrame, w: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(row, col, value): profile times similarity, kept to the candidates (row, col) if given. Candidates without a path score 0."""
    s = multiply(profile, w.select(F.col("i").alias("row"), F.col("j").alias("col"), "value"))
    if candidates is None:
        return s
    return candidates.join(s, ["row", "col"], "left").select(*candidates.columns, F.coalesce("value", F.lit(0.0)).alias("value"))


def dense_gram(x: DataFrame) -> tuple[list, np.ndarray]:
    """The columns in order and their Gram matrix, on the driver. Catalogues over DENSE_LIMIT items are refused rather than truncated."""
    n = x.select("col").distinct().count()
    if n > DENSE_LIMIT:
        raise ValueError(f"{n} items: the dense Gram matrix is bounded at {DENSE_LIMIT}")
    squares = x.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("q")).collect()
    ids = sorted(r["col"] for r in squares)
    at = {c: i for i, c in enumerate(ids)}
    g = np.zeros((n, n))
    for r in gram(x).where("i < j").select("i", "j", "dot").toLocalIterator():
        g[at[r["i"]], at[r["j"]]] = g[at[r["j"]], at[r["i"]]] = r["dot"]
    for r in squares:
        g[at[r["col"]], at[r["col"]]] = r["q"]
    return ids, g


def easer(spark: SparkSession, x: DataFrame, penalty: float, k: int) -> DataFrame:
    """B = P / -diag(P), P the inverse of the Gram matrix plus penalty; top k by size per column.

    The inverse is dense; catalogues over DENSE_LIMIT items are refused rather than truncated.
    """
    ids, g = dense_gram(x)
    n = len(ids)
    p = np.linalg.inv(g + penalty * np.eye(n))
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0.0)
    rows = []
    for j in range(n):
        order = np.lexsort((np.arange(n), -np.abs(b[:, j])))[:k]
        rows += [(int(ids[i]), int(ids[j]), float(b[i, j])) for i in order if b[i, j]]
    return spark.createDataFrame(rows, "i long, j long, value double")


def pure_svd(spark: SparkSession, x: DataFrame, rank: int) -> DataFrame:
    """The right singular vectors of the matrix as it is (not centred), as (col, value, vector): `value` is the column's norm among them. Scores are
    x V V', so V alone is the model; the largest entry of each vector is made positive.

    The vectors are those of the dense Gram matrix; catalogues over DENSE_LIMIT items are refused rather than truncated.
    """
    ids, g = dense_gram(x)
    values, vectors = np.linalg.eigh(g)
    v = vectors[:, np.argsort(-values, kind="stable")[:rank]]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return spark.createDataFrame([(int(c), float(np.linalg.norm(r)), r.tolist()) for c, r in zip(ids, v, strict=True)], "col long, value double, vector array<double>")


def svd_scores(x: DataFrame, factors: DataFrame) -> DataFrame:
    """(row, col, value) of every row against every column that has a factor: each row's position among the factors is summed up first."""
    held = x.join(factors.select("col", F.posexplode("vector").alias("k", "f")), "col").groupBy("row", "k").agg(F.sum(F.col("value") * F.col("f")).alias("u"))
    wide = factors.select("col", F.posexplode("vector").alias("k", "f"))
    return held.join(wide, "k").groupBy("row", "col").agg(F.sum(F.col("u") * F.col("f")).alias("value"))


def k_core(x: DataFrame, k: int, materialize, rounds: int = 1000) -> DataFrame:
    """Rows and columns of less than k entries leave until none is left. `materialize` cuts the plan after each round; a matrix that still
    shrinks after so many rounds is an error, not a result."""
    n = x.count()
    for _ in range(rounds):
        x = x.join(x.groupBy("row").count().where(F.col("count") >= k).select("row"), "row", "left_semi")
        x = x.join(x.groupBy("col").count().where(F.col("count") >= k).select("col"), "col", "left_semi")
        x = materialize(x.select("row", "col", "value"))
        m = x.count()
        if m == n:
            return x
        n = m
    raise RuntimeError(f"the core still shrinks after {rounds} rounds")


def global_effects(x: DataFrame, item_shrink: float = 25.0, user_shrink: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean, item bias sum(r - mean) / (n + shrink), user bias of what is left."""
    mean = x.agg(F.avg("value").alias("mean"))
    y = x.crossJoin(F.broadcast(mean)).withColumn("value", F.col("value") - F.col("mean"))
    items = y.groupBy("col").agg((F.sum("value") / (F.count("*") + item_shrink)).alias("item_bias"))
    z = y.join(items, "col").withColumn("value", F.col("value") - F.col("item_bias"))
    users = z.groupBy("row").agg((F.sum("value") / (F.count("*") + user_shrink)).alias("user_bias"))
    return mean, items, users


def factor_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Dot products of factor arrays for (row, col) pairs."""
    from ..functions.vectors import dot

    both = pairs.join(users.select("row", F.col("vector").alias("u")), "row").join(items.select("col", F.col("vector").alias("v")), "col")
    return both.select("row", "col", dot("u", "v").alias("value"))


def slim(x: DataFrame, l1: float, l2: float, k: int, sweeps: int = 10_000) -> DataFrame:
    """For each item an elastic-net regression (non-negative) on all other items, by coordinate descent over the Gram matrix until no
    weight moves; the k largest weights stay. Every task holds the Gram matrix, so catalogues over DENSE_LIMIT items are refused rather than
    truncated. Where no product is negative, items whose product with the target is l1 or less have weight 0 and are left out; that is exact.
    """
    import pandas as pd

    spark = x.sparkSession
    ids, g = dense_gram(x)
    held, exact = spark.sparkContext.broadcast((np.array(ids), g)), not (g < 0).any()

    def solve(batches):
        ids, g = held.value
        for pdf in batches:
            out = []
            for t in pdf["at"]:
                near = np.flatnonzero((g[:, t] > l1) | (not exact))
                near = near[near != t]
                m, y, w = np.ascontiguousarray(g[np.ix_(near, near)]), g[near, t], np.zeros(len(near))
                fit = np.zeros(len(near))
                for _ in range(sweeps):
                    moved = 0.0
                    for i in range(len(near)):
                        new = max(0.0, y[i] - fit[i] + m[i, i] * w[i] - l1) / (m[i, i] + l2)
                        if new != w[i]:
                            fit += m[i] * (new - w[i])
                            moved, w[i] = max(moved, abs(new - w[i])), new
                    if moved <= 1e-10:
                        break
                else:
                    raise ValueError(f"item {ids[t]}: weights still move after {sweeps} sweeps")
                out += [(int(ids[i]), int(ids[t]), float(v)) for i, v in zip(near, w, strict=True) if v > 0]
            yield pd.DataFrame(out, columns=["i", "j", "value"])

    targets = spark.range(len(ids)).select(F.col("id").alias("at"))
    return top_per(targets.mapInPandas(solve, "i long, j long, value double"), "j", "value", ["i"], k)
