"""Logical grid views over the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.session import shuffled

SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "yrs": ("""SELECT DISTINCT CAST(YEAR(l_shipdate) AS INT) AS year FROM lineitem""", ()),
    "lyrs": ("""SELECT year FROM yrs WHERE year + 1 IN (SELECT year FROM yrs)""", ("yrs",)),
    "cell": ("""SELECT p_partkey AS k, CONCAT('CELL_', LPAD(CAST(p_partkey AS VARCHAR), 6, '0')) AS cell_id,
        CAST(p_partkey % 100 AS INT) AS ix, CAST(FLOOR(p_partkey / 100) AS INT) AS iy,
        CAST(p_partkey % 100 AS INT) * 1000 AS x0, CAST(FLOOR(p_partkey / 100) AS INT) * 1000 AS y0
        FROM part""", ()),
    "burn": ("""SELECT l_partkey AS k, CAST(YEAR(l_shipdate) AS INT) AS year,
        LEAST(CAST(1 AS DOUBLE), CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / 100) AS share
        FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45
        GROUP BY l_partkey, CAST(YEAR(l_shipdate) AS INT)""", ()),
    "clim": ("""SELECT CAST(FLOOR(c.ix / 10) AS INT) AS lon_idx, CAST(FLOOR(c.iy / 10) AS INT) AS lat_idx,
        CAST(YEAR(l.l_shipdate) AS INT) AS year, CAST(MONTH(l.l_shipdate) AS INT) AS month,
        CASE WHEN (FLOOR(c.ix / 10) + 3 * FLOOR(c.iy / 10)) % 7 = 0 THEN NULL
             ELSE 280 + 100 * CAST(SUM(CAST(l.l_discount AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) END AS t2m_k,
        CASE WHEN (FLOOR(c.ix / 10) + 3 * FLOOR(c.iy / 10)) % 7 = 0 THEN NULL
             ELSE CAST(SUM(CAST(l.l_tax AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) / 10 END AS tp_m
        FROM lineitem l JOIN cell c ON c.k = l.l_partkey
        WHERE MONTH(l.l_shipdate) BETWEEN 6 AND 9
        GROUP BY FLOOR(c.ix / 10), FLOOR(c.iy / 10), CAST(YEAR(l.l_shipdate) AS INT),
                 CAST(MONTH(l.l_shipdate) AS INT)""", ("cell",)),
    "axis_src": ("""SELECT lon_idx, lat_idx, BOOL_AND(t2m_k IS NOT NULL AND tp_m IS NOT NULL) AS valid,
        CAST(lon_idx * 10000 + 5000 AS DOUBLE) AS sx, CAST(lat_idx * 10000 + 5000 AS DOUBLE) AS sy,
        CAST(lat_idx * 1000 + lon_idx AS BIGINT) AS sid
        FROM clim GROUP BY lon_idx, lat_idx""", ("clim",)),
    "rect": ("""SELECT o_orderkey AS poly_id, CAST(YEAR(o_orderdate) AS INT) AS year,
        CASE WHEN o_orderpriority LIKE '1%' THEN '112' WHEN o_orderpriority LIKE '2%' THEN '311' ELSE '211' END AS code,
        (o_orderkey * 250) % 100000 AS xmin, (o_custkey * 250) % 20000 AS ymin,
        (o_orderkey * 250) % 100000 + 250 * (1 + o_orderkey % 8) AS xmax,
        (o_custkey * 250) % 20000 + 250 * (1 + o_custkey % 8) AS ymax
        FROM orders""", ()),
    # the 250 m lattice square of every rectangle; distinct squares are the exact union area
    "lat": ("""SELECT r.poly_id, r.year, r.code, r.xmin + gx.i * 250 AS x, r.ymin + gy.i * 250 AS y
        FROM rect r JOIN range(0, 8) gx(i) ON r.xmin + gx.i * 250 < r.xmax
        JOIN range(0, 8) gy(i) ON r.ymin + gy.i * 250 < r.ymax""", ("rect",)),
    "pix": ("""SELECT c.k, c.cell_id, s.sub, c.x0 + 125 + 250 * (s.sub % 4) AS x,
        c.y0 + 125 + 250 * CAST(FLOOR(s.sub / 4) AS INT) AS y,
        CAST((c.k * 7 + s.sub * s.sub * 3 + CAST(FLOOR(c.k / 9) AS BIGINT)) % 7 AS INT) AS code
        FROM cell c CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15)) AS s(sub)""",
        ("cell",)),
    "pred": ("""SELECT c.cell_id, y.year AS observation_year, COALESCE(b.share, CAST(0 AS DOUBLE)) AS target,
        CAST((c.k * 31 + y.year * 17) % 97 AS DOUBLE) / 97 AS score_a,
        CAST((c.k * 13 + y.year) % 11 AS DOUBLE) / 11 AS score_b
        FROM cell c CROSS JOIN lyrs y LEFT JOIN burn b ON b.k = c.k AND b.year = y.year + 1""",
        ("cell", "lyrs", "burn")),
    "pred_long": ("""SELECT cell_id, observation_year, target, 'score_a' AS model, score_a AS score FROM pred
        UNION ALL SELECT cell_id, observation_year, target, 'score_b', score_b FROM pred""", ("pred",)),
    "scoped": ("""SELECT *, 'overall' AS scope FROM pred_long
        UNION ALL SELECT *, CAST(observation_year AS VARCHAR) FROM pred_long""", ("pred_long",)),
    "req": ("""SELECT event_id, CAST((event_id * 37) % 100000 AS DOUBLE) + 0.5 AS x,
        CAST((event_id * 91) % 20000 AS DOUBLE) + 0.5 AS y,
        CASE WHEN event_id % 50 = 0 THEN '1,1' WHEN event_id % 51 = 0 THEN 'a' ELSE '1,3,5' END AS buffers_km
        FROM events""", ()),
    "panel": ("""SELECT c.k, c.cell_id, y.year AS observation_year,
        CASE WHEN y.year <= 1997 THEN 'train' WHEN y.year <= 1999 THEN 'validation' ELSE 'final_test' END AS split,
        CAST(COALESCE(a.n, 0) AS INT) AS n_items, a.qty, a.disc, a.tax, CAST(p.p_size AS DOUBLE) AS size,
        p.p_retailprice AS price, CAST(COALESCE(h.n, 0) AS INT) AS events, COALESCE(b.share, CAST(0 AS DOUBLE)) AS target
        FROM cell c CROSS JOIN lyrs y JOIN part p ON p.p_partkey = c.k
        LEFT JOIN (SELECT l_partkey AS k, CAST(YEAR(l_shipdate) AS INT) AS year, COUNT(*) AS n,
              CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty,
              CAST(SUM(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS disc,
              CAST(SUM(CAST(l_tax AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS tax
              FROM lineitem GROUP BY l_partkey, CAST(YEAR(l_shipdate) AS INT)) a ON a.k = c.k AND a.year = y.year
        LEFT JOIN (SELECT c2.k, y2.year, COUNT(*) AS n FROM burn c2 JOIN lyrs y2 ON c2.year BETWEEN y2.year - 3 AND y2.year - 1
              GROUP BY c2.k, y2.year) h ON h.k = c.k AND h.year = y.year
        LEFT JOIN burn b ON b.k = c.k AND b.year = y.year + 1""", ("cell", "lyrs", "burn")),
}


def with_views(sql: str, names: Sequence[str]) -> str:
    """Inline the named views and what they read, in order, as one WITH clause."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in SQL_VIEWS[name][1]:
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return sql
    ctes = ", ".join(f"{name} AS ({SQL_VIEWS[name][0]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def cut_id(cell_id: str = "cell_id") -> Column:
    """The id of the SQL from an uncut one."""
    return F.substring(cell_id, 1, len("CELL_") + 6)


def cut_keys(rows: DataFrame) -> DataFrame:
    """Rows of a gate that ran on uncut ids, with the ids in ``key`` as the SQL cuts them."""
    return rows.withColumn("key", F.regexp_replace("key", r"CELL_(\d{6})\d+", "CELL_$1"))


class Views:
    """DataFrame twins of the SQL views for one data folder.

    The SQL cuts a ``cell_id`` to six digits, so in larger tables cells share one. With ``uncut`` every cell
    has an id of its own, for work that needs a key; :func:`cut_id` gives the id of the SQL back.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, uncut: bool = False):
        self.spark, self.sf, self.uncut = spark, sf_dir, uncut
        self._span: tuple[int, int] | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def year_span(self) -> tuple[int, int]:
        """First and last year of the fact table (one two-value aggregate)."""
        if self._span is None:
            row = self.table("lineitem").agg(
                F.year(F.min("l_shipdate")).alias("lo"), F.year(F.max("l_shipdate")).alias("hi")
            ).first()
            self._span = (row["lo"], row["hi"])
        return self._span

    def years(self) -> list[int]:
        lo, hi = self.year_span()
        return list(range(lo, hi + 1))

    def labelled_years(self) -> list[int]:
        return self.years()[:-1]

    def cell(self) -> DataFrame:
        k = F.col("p_partkey")
        digits = F.greatest(F.lit(6), F.length(k.cast("string"))) if self.uncut else F.lit(6)
        return self.table("part").select(
            k.alias("k"),
            F.concat(F.lit("CELL_"), F.lpad(k.cast("string"), digits, F.lit("0"))).alias("cell_id"),
            (k % 100).cast("int").alias("ix"),
            F.floor(k / 100).cast("int").alias("iy"),
            ((k % 100).cast("int") * 1000).alias("x0"),
            (F.floor(k / 100).cast("int") * 1000).alias("y0"),
        )

    def burn(self) -> DataFrame:
        total = F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double") / 100
        return (
            self.table("lineitem")
            .where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
            .groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("year"))
            .agg(F.least(F.lit(1.0), total).alias("share"))
        )

    def clim(self) -> DataFrame:
        # aggregate the facts per part before they meet the grid, so a hot part is one row per month
        facts = (
            self.table("lineitem")
            .where(F.month("l_shipdate").between(6, 9))
            .groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
            .agg(
                F.sum(F.col("l_discount").cast("decimal(12,2)")).alias("d"),
                F.sum(F.col("l_tax").cast("decimal(12,2)")).alias("t"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        coarse = facts.join(shuffled(self.cell()), "k").groupBy(
            F.floor(F.col("ix") / 10).cast("int").alias("lon_idx"),
            F.floor(F.col("iy") / 10).cast("int").alias("lat_idx"),
            "year",
            "month",
        ).agg(F.sum("d").cast("double").alias("d"), F.sum("t").cast("double").alias("t"), F.sum("n").alias("n"))
        valid = (F.col("lon_idx") + 3 * F.col("lat_idx")) % 7 != 0
        return coarse.select(
            "lon_idx", "lat_idx", "year", "month",
            F.when(valid, 280 + 100 * F.col("d") / F.col("n")).alias("t2m_k"),
            F.when(valid, F.col("t") / F.col("n") / 10).alias("tp_m"),
        )

    def rect(self) -> DataFrame:
        ok, ck, prio = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
        xmin, ymin = (ok * 250) % 100000, (ck * 250) % 20000
        return self.table("orders").select(
            ok.alias("poly_id"),
            F.year("o_orderdate").alias("year"),
            F.when(prio.startswith("1"), "112").when(prio.startswith("2"), "311").otherwise("211").alias("code"),
            xmin.alias("xmin"),
            ymin.alias("ymin"),
            (xmin + 250 * (1 + ok % 8)).alias("xmax"),
            (ymin + 250 * (1 + ck % 8)).alias("ymax"),
        )

    def polygons(self) -> DataFrame:
        """``rect`` as closed rings, the form every vector operator takes."""
        from gridpanel.functions.geometry import rect_ring

        return self.rect().select(
            "poly_id", "year", "code", F.array(rect_ring("xmin", "ymin", "xmax", "ymax")).alias("rings")
        )

    def pix(self) -> DataFrame:
        sub, k = F.col("sub"), F.col("k")
        return self.cell().withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
            "k", "cell_id", "sub",
            (F.col("x0") + 125 + 250 * (sub % 4)).alias("x"),
            (F.col("y0") + 125 + 250 * F.floor(sub / 4).cast("int")).alias("y"),
            ((k * 7 + sub * sub * 3 + F.floor(k / 9)) % 7).cast("int").alias("code"),
        )

    def cell_years(self) -> DataFrame:
        years = F.array(*[F.lit(y) for y in self.labelled_years()])
        return self.cell().withColumn("observation_year", F.explode(years))

    def pred(self) -> DataFrame:
        outcome = self.burn().select("k", (F.col("year") - 1).alias("observation_year"), "share")
        k, year = F.col("k"), F.col("observation_year")
        return self.cell_years().join(outcome, ["k", "observation_year"], "left").select(
            "cell_id", "observation_year",
            F.coalesce("share", F.lit(0.0)).alias("target"),
            (((k * 31 + year * 17) % 97).cast("double") / 97).alias("score_a"),
            (((k * 13 + year) % 11).cast("double") / 11).alias("score_b"),
        )

    def req(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            "event_id",
            (((e * 37) % 100000).cast("double") + 0.5).alias("x"),
            (((e * 91) % 20000).cast("double") + 0.5).alias("y"),
            F.when(e % 50 == 0, "1,1").when(e % 51 == 0, "a").otherwise("1,3,5").alias("buffers_km"),
        )

    def panel(self) -> DataFrame:
        facts = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("observation_year"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("qty"),
                (F.sum(F.col("l_discount").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))).alias("disc"),
                (F.sum(F.col("l_tax").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))).alias("tax"),
            )
        )
        burn = self.burn()
        outcome = burn.select("k", (F.col("year") - 1).alias("observation_year"), F.col("share").alias("target"))
        history = (
            burn.select("k", F.explode(F.sequence(F.col("year") + 1, F.col("year") + 3)).alias("observation_year"))
            .groupBy("k", "observation_year").agg(F.count(F.lit(1)).alias("events"))
        )
        part = self.table("part").select(
            F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
        )
        year = F.col("observation_year")
        key = ["k", "observation_year"]
        return (
            self.cell_years().join(shuffled(part), "k").join(shuffled(facts), key, "left")
            .join(shuffled(history), key, "left").join(shuffled(outcome), key, "left")
            .select(
                "k", "cell_id", "observation_year",
                F.when(year <= 1997, "train").when(year <= 1999, "validation").otherwise("final_test").alias("split"),
                F.coalesce("n", F.lit(0)).cast("int").alias("n_items"),
                "qty", "disc", "tax", "size", "price",
                F.coalesce("events", F.lit(0)).cast("int").alias("events"),
                F.coalesce("target", F.lit(0.0)).alias("target"),
            )
        )
