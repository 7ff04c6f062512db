"""Expected match-up counts under independence, and their fit to the observed ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import slope_p_value


def with_total(edge_rows: DataFrame, node_rows: DataFrame, side: str) -> DataFrame:
    """Edges whose `side` is a counted node, with its count as total_<side>.

    Tables bucketed by source and by archetype (write_bucketed) meet on the
    source without a shuffle of either.
    """
    known = node_rows.where(F.col("count") > 0).select(F.col("archetype").alias(side), F.col("count").alias(f"total_{side}"))
    return edge_rows.join(known, side)


def predictions(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edges with both node totals and count_source * count_target / total.

    The total is the sum of all node counts, which is 2 C(8,k) per game, while
    edges sum to 2 C(8,k)^2: predictions lie below the counts by about C(8,k).
    Spark picks broadcast or sort-merge from the node table's size.
    """
    total = node_rows.agg(F.sum("count").alias("total"))
    return (
        with_total(with_total(edge_rows, node_rows, "source"), node_rows, "target")
        .crossJoin(F.broadcast(total.where(F.col("total") > 0)))
        .select(
            "source",
            "target",
            F.col("count").alias("observed"),
            "wins",
            "total_source",
            "total_target",
            (F.col("total_source").cast("double") * F.col("total_target") / F.col("total")).alias("prediction"),
        )
    )


def prediction_ratio(predicted: DataFrame) -> DataFrame:
    """observed / predicted, on predictions rounded to four decimals and above zero."""
    return (
        predicted.select("source", "target", "observed", F.round("prediction", 4).alias("predicted"))
        .where(F.col("predicted") > 0)
        .withColumn("ratio", F.col("observed") / F.col("predicted"))
    )


def _fit(ratio: DataFrame) -> DataFrame:
    """Sums of the fit in one row; what a constant column or too few rows leave undefined is NULL."""
    y, x = "predicted", "observed"
    zero, none = F.lit(0.0), F.lit(0)
    sums = ratio.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.avg(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_mean"),
        F.avg(F.when(F.col(x).isNotNull(), F.col(y))).alias("y_mean"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )
    slope = F.col("sxy") / F.nullif("sxx", zero)
    r = F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), zero)
    # a constant y is fitted without any rest
    rest = F.greatest(F.col("syy") - slope * F.col("sxy"), zero)
    return sums.select(
        "n",
        slope.alias("slope"),
        (F.col("y_mean") - slope * F.col("x_mean")).alias("intercept"),
        r.alias("r"),
        F.when((F.col("sxx") > 0) & (F.col("syy") == 0), 1.0).otherwise(r * r).alias("r2"),
        F.sqrt(rest / F.nullif("sxx", zero) / F.nullif(F.col("n") - 2, none)).alias("stderr"),
        "x_min",
        "x_max",
    )


def linear_fit(ratio: DataFrame, digits: int | None = 6) -> DataFrame:
    """Least squares of predicted on observed over all rows: one row."""
    names = ["slope", "intercept", "r", "r2", "stderr"]
    return _fit(ratio).select("n", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in names])


def linear_fit_p(ratio: DataFrame, digits: int | None = None, p_digits: int | None = None) -> DataFrame:
    """The fit with the two-sided p-value of its slope, all in one plan."""
    p = slope_p_value(F.col("r"), F.col("n"))
    rounded = lambda c, d: (F.round(c, d) if d is not None else c)
    names = ["slope", "intercept", "r", "r2", "stderr"]
    return _fit(ratio).select("n", *[rounded(F.col(c), digits).alias(c) for c in names], rounded(p, p_digits).alias("p_value"))


def source_fits_p(ratio: DataFrame, digits: int = 6, p_digits: int = 8) -> DataFrame:
    """By source: targets, correlation of predicted with observed counts, and the p-value of a zero slope."""
    y, x = "predicted", "observed"
    zero = F.lit(0.0)
    sums = ratio.groupBy("source").agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    fits = sums.select("source", "n", (F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), zero)).alias("r"))
    return fits.select("source", "n", F.round("r", digits).alias("r"), F.round(slope_p_value(F.col("r"), F.col("n")), p_digits).alias("p_value"))


def slope_t(ratio: DataFrame, digits: int = 4) -> DataFrame:
    """One row: rows, degrees of freedom and t of a zero slope; NULL where undefined."""
    df, r = F.col("n") - 2, F.col("r")
    t = r * F.sqrt(df / F.nullif(1 - r * r, F.lit(0.0)))
    return _fit(ratio).select("n", df.alias("df"), F.round(F.when(df > 0, t), digits).alias("t"))


def fit_line(ratio: DataFrame, digits: int = 6) -> DataFrame:
    """End points of the fitted line."""
    ends = F.array(F.col("x_min"), F.col("x_max"))
    return _fit(ratio).select(F.posexplode(ends).alias("point", "x"), "slope", "intercept").select("point", "x", F.round(F.col("intercept") + F.col("slope") * F.col("x"), digits).alias("y"))


#: Leading hexadecimal digits of a row's hash that the sample's histogram counts by: 65,536 cells at most.
CELL_DIGITS = 4


def sample_points(ratio: DataFrame, n: int = 50_000, seed: int = 42) -> DataFrame:
    """The first n rows in hash order, so the same on each run; all rows if there are fewer.

    Rows are counted by the head of their hash.  The counts name the cell in
    which the n-th row lies: rows of lower cells are taken as they are, and only
    that cell's are ordered, of which few are wanted.  No task holds n rows.
    """
    hashed = ratio.withColumn("hash of row", F.md5(F.concat("source", "target", F.lit(str(seed)))))
    head = F.substring("hash of row", 1, CELL_DIGITS)
    cells = sorted(hashed.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect())
    taken = 0
    for cell, rows in cells:
        if taken + rows > n:
            last = hashed.where(head == cell).orderBy("hash of row", "source", "target").limit(n - taken)
            return hashed.where(head < cell).unionByName(last).drop("hash of row")
        taken += rows
    return ratio
