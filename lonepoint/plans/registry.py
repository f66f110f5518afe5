"""Every query on the driver's tables, with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonepoint.functions import lsh as lsh_functions
from lonepoint.functions import vectors
from lonepoint.operators import counts, lsh_join, neighbors, sets
from lonepoint.params import LshParams, Params
from lonepoint.plans.ship import ship
from lonepoint.plans.storage import shared_folder
from lonepoint.sources import points as source
from lonepoint.streaming import replay, structured

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EVENTS = Params(window=1000, slide=100, radius=0.505, k=5)
TUMBLING = Params(window=500, slide=500, radius=0.505, k=5)
VECTORS = Params(window=200, slide=50, radius=1.25, k=3)
ITEMS = Params(window=1000, slide=250, radius=2.55, k=2)
LSHOD = LshParams(tables=10, hashes=4, width=0.505, seed=5)
HYBRID = LshParams(tables=10, hashes=5, width=0.7575, seed=6)
DIMS = 64


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *keep) -> DataFrame:
    return source.points(table(spark, sf_dir, "events"), F.col("event_id") + 1, [F.col("value")], *keep)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select((F.col("vec_id") + 1).alias("id"), source.checked(F.col("embedding").cast("array<double>")).alias("values"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in an order of its own: the key pair repeats, so the values take part."""
    df = table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    values = F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    return source.ranked(df.select(*order), *order).select("id", source.checked(values).alias("values"))


def first_value(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("values")[0]).drop("values")


# Fragments of the oracles: points with slides, ordered neighbour pairs of residents, counts at the ends of batches.


def _e(p: Params) -> str:
    return f"e AS (SELECT event_id + 1 AS id, value AS v, event_id // {p.slide} + 1 AS s FROM events), b AS (SELECT max(s) AS last FROM e)"


def _nb(p: Params, radius: float | None = None) -> str:
    r = radius or p.radius
    return f"""nb AS (SELECT x.id, q.id AS nbr_id, x.s, q.s AS t, sqrt((x.v - q.v) * (x.v - q.v)) AS d FROM e x JOIN e q
    ON x.id <> q.id AND abs(x.s - q.s) < {p.n} AND sqrt((x.v - q.v) * (x.v - q.v)) <= {r})"""


def _wc(p: Params) -> str:
    return f"""w AS (SELECT id, s, unnest(range(s, least(s + {p.n - 1}, last) + 1)) AS batch FROM e, b),
wc AS (SELECT w.id, w.batch, count(nb.nbr_id) AS cnt FROM w LEFT JOIN nb ON nb.id = w.id AND nb.t BETWEEN w.batch - {p.n - 1} AND w.batch GROUP BY ALL)"""


_V = f"""e AS (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS v, vec_id // {VECTORS.slide} + 1 AS s FROM embeddings), b AS (SELECT max(s) AS last FROM e),
r AS (SELECT x.id, q.id AS nbr_id, x.s, q.s AS t, sqrt(list_sum(list_transform(list_zip(x.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
    FROM e x JOIN e q ON x.id <> q.id AND abs(x.s - q.s) < {VECTORS.n}),
nb AS (SELECT * FROM r WHERE d <= {VECTORS.radius})"""
_PURE = "SELECT id FROM wc GROUP BY id HAVING max(cnt) < {k}"


# Sources and projections


@query("SELECT event_id + 1 AS id, value AS v FROM events")
def load_points(spark, sf_dir):
    return first_value(events(spark, sf_dir))


@query("SELECT event_id + 1 AS id, value AS v FROM events")
def csv_round_trip(spark, sf_dir):
    """The points written as lines of text with a class, and read back without it."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    with_class = events(spark, sf_dir).withColumn("values", F.array_append("values", F.lit(-1.0)))
    source.write_csv(with_class, path)
    return first_value(source.read_csv(spark, path, contains_class=True))


@query("SELECT event_id + 1 AS id FROM events")
def id_file_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    source.write_ids(events(spark, sf_dir), path)
    return source.read_ids(spark, path)


@query("SELECT min(len(embedding)) AS low, max(len(embedding)) AS high FROM embeddings")
def dimension_probe(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.min(F.size("values")).alias("low"), F.max(F.size("values")).alias("high"))


@query("""SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS id,
l_quantity AS quantity, l_extendedprice / 1000 AS price FROM lineitem""")
def ranked_items(spark, sf_dir):
    return items(spark, sf_dir).select("id", F.col("values")[0].alias("quantity"), F.col("values")[1].alias("price"))


# Windows


@query(f"SELECT event_id + 1 AS id, event_id // {EVENTS.slide} + 1 AS slide_no FROM events")
def slide_number(spark, sf_dir):
    return neighbors.with_slide(events(spark, sf_dir), EVENTS.slide).select("id", "slide_no")


@query(f"""WITH b AS (SELECT unnest(range(1, max(event_id) // {EVENTS.slide} + 2)) AS batch, max(event_id) + 1 AS n FROM events)
SELECT batch, greatest(0, batch - {EVENTS.n}) * {EVENTS.slide} + 1 AS first_id, least(batch * {EVENTS.slide}, n) AS last_id FROM b""")
def window_bounds(spark, sf_dir):
    last = events(spark, sf_dir).agg(F.max("id").alias("n"))
    b = last.select("n", F.explode(F.sequence(F.lit(1).cast("long"), vectors.slide_number("n", EVENTS.slide))).alias("batch"))
    return b.select("batch", (F.greatest(F.lit(0), F.col("batch") - EVENTS.n) * EVENTS.slide + 1).alias("first_id"), F.least(F.col("batch") * EVENTS.slide, "n").alias("last_id"))


@query(f"WITH {_e(EVENTS)} SELECT id, unnest(range(s, least(s + {EVENTS.n - 1}, last) + 1)) AS batch FROM e, b")
def window_members(spark, sf_dir):
    pts = events(spark, sf_dir)
    last = F.least(F.col("slide_no") + EVENTS.n - 1, counts.last_batch(pts, EVENTS.slide))
    return neighbors.with_slide(pts, EVENTS.slide).select("id", F.explode(F.sequence("slide_no", last)).alias("batch"))


@query(f"SELECT event_id + 1 AS id, event_id + 1 + {EVENTS.window} + 1 AS expires FROM events")
def expiration_stamp(spark, sf_dir):
    return events(spark, sf_dir).select("id", vectors.expiration_stamp("id", EVENTS.window).alias("expires"))


@query(f"WITH {_e(EVENTS)} SELECT s + {EVENTS.n} AS batch, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM e, b WHERE s + {EVENTS.n} <= last GROUP BY ALL")
def expired_points(spark, sf_dir):
    """By batch the points that leave the window when it comes."""
    pts = events(spark, sf_dir)
    gone = neighbors.with_slide(pts, EVENTS.slide).select("id", (F.col("slide_no") + EVENTS.n).alias("batch"))
    return gone.filter(F.col("batch") <= counts.last_batch(pts, EVENTS.slide)).groupBy("batch").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


# Scalar functions and similarity joins


@query("SELECT vec_id + 1 AS id, row_number() OVER (ORDER BY embedding::DOUBLE[], vec_id) AS place FROM embeddings")
def point_order(spark, sf_dir):
    """Points in lexicographic order of their values."""
    return source.ranked(embeddings(spark, sf_dir), "values", "id", name="place").select("id", "place")


@query(f"WITH {_V} SELECT id, nbr_id, d FROM r")
def euclidean_pairs(spark, sf_dir):
    return neighbors.all_resident_pairs(embeddings(spark, sf_dir), VECTORS, DIMS).select("id", "nbr_id", "d")


@query("SELECT a.vec_id + 1 AS id, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] * z[2])) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_product(spark, sf_dir):
    """Of each vector with the next one."""
    x = embeddings(spark, sf_dir)
    y = x.select((F.col("id") - 1).alias("id"), F.col("values").alias("next"))
    return x.join(y, "id").select("id", vectors.dot("values", "next", DIMS).alias("dot"))


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT id, nbr_id, d FROM nb")
def range_join_1d(spark, sf_dir):
    return neighbors.pairs(events(spark, sf_dir), EVENTS, 1).select("id", "nbr_id", "d")


_ITEMS = f"""i AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS id,
    l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c, l_tax * 100 AS g FROM lineitem),
e AS (SELECT *, (id - 1) // {ITEMS.slide} + 1 AS s FROM i),
nb AS (SELECT x.id, q.id AS nbr_id, sqrt((x.a - q.a) * (x.a - q.a) + (x.b - q.b) * (x.b - q.b) + (x.c - q.c) * (x.c - q.c) + (x.g - q.g) * (x.g - q.g)) AS d
    FROM (SELECT *, unnest([(s - 1) // {ITEMS.n} - 1, (s - 1) // {ITEMS.n}, (s - 1) // {ITEMS.n} + 1]) AS t FROM e) x JOIN (SELECT *, (s - 1) // {ITEMS.n} AS t FROM e) q
    ON x.t = q.t AND x.id <> q.id AND abs(x.s - q.s) < {ITEMS.n} AND abs(x.a - q.a) < 3 AND abs(x.b - q.b) < 3)"""


@query(f"WITH {_ITEMS} SELECT id, nbr_id, d FROM nb WHERE d <= {ITEMS.radius}")
def range_join_nd(spark, sf_dir):
    return neighbors.pairs(items(spark, sf_dir), ITEMS, 4).select("id", "nbr_id", "d")


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS, EVENTS.radius / 2)} SELECT id, nbr_id, d FROM nb")
def range_join_half_r(spark, sf_dir):
    return neighbors.pairs(events(spark, sf_dir), EVENTS, 1, radius=EVENTS.radius / 2).select("id", "nbr_id", "d")


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS, EVENTS.radius * 1.5)} SELECT id, count(*) AS n, count(*) FILTER (d <= {EVENTS.radius}) AS inside FROM nb GROUP BY id")
def range_join_wide(spark, sf_dir):
    """Neighbours within one and a half radii, the range in which clusters are searched, and those within the radius."""
    found = neighbors.pairs(events(spark, sf_dir), EVENTS, 1, radius=EVENTS.radius * 1.5)
    return found.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("d") <= EVENTS.radius).alias("inside"))


@query(f"WITH {_V} SELECT id, nbr_id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr_id) AS rank FROM r) WHERE rank <= 3")
def knn(spark, sf_dir):
    return neighbors.nearest(neighbors.all_resident_pairs(embeddings(spark, sf_dir), VECTORS, DIMS), 3).select("id", "nbr_id", "d", "rank")


@query(f"WITH {_V} SELECT id, nbr_id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nbr_id) AS rank FROM nb) WHERE rank <= 2")
def range_knn(spark, sf_dir):
    return neighbors.nearest(neighbors.pairs(embeddings(spark, sf_dir), VECTORS, DIMS), 2).select("id", "nbr_id", "d", "rank")


@query(f"""WITH {_e(EVENTS)}, c AS (SELECT min(id) AS centre_id, arg_min(v, id) AS v, s FROM e GROUP BY s),
d AS (SELECT e.id, c.centre_id, sqrt((e.v - c.v) * (e.v - c.v)) AS d FROM e JOIN c ON c.s <= e.s AND e.s - c.s < {EVENTS.n}),
f AS (SELECT id, centre_id, d, row_number() OVER (PARTITION BY id ORDER BY d, centre_id) AS r FROM d)
SELECT id, centre_id, d, d <= {EVENTS.radius / 2} AS inside FROM f WHERE r = 1""")
def nearest_centre(spark, sf_dir):
    """The first point of each slide as its centre."""
    pts = neighbors.with_slide(events(spark, sf_dir), EVENTS.slide)
    centres = pts.groupBy("slide_no").agg(F.min_by("values", "id").alias("values"), F.min("id").alias("id"))
    return neighbors.nearest_centre(pts, centres, 1, EVENTS.radius / 2, EVENTS.n)


@query("SELECT event_id + 1 AS id, count(*) OVER (PARTITION BY value) AS n_refs, min(event_id) OVER (PARTITION BY value) + 1 AS first_id FROM events")
def equal_points(spark, sf_dir):
    return neighbors.equal_points(events(spark, sf_dir))


@query(f"""WITH {_e(EVENTS)} SELECT x.id, q.id AS nbr_id, abs(x.v - q.v) AS d FROM e x JOIN e q
ON x.id < q.id AND abs(x.s - q.s) < {EVENTS.n} AND abs(x.v - q.v) <= {EVENTS.radius / 4}""")
def range_join_manhattan(spark, sf_dir):
    """Another distance in the same join, each pair once."""
    pts = neighbors.with_slide(events(spark, sf_dir), EVENTS.slide)
    found = neighbors.earlier_pairs(pts, EVENTS, 1, EVENTS.radius / 4, distance=vectors.manhattan).filter("x_id > q_id")
    return found.select(F.col("q_id").alias("id"), F.col("x_id").alias("nbr_id"), "d")


@query(f"""WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT id, coalesce(string_agg(nbr_id, ',' ORDER BY nbr_id) FILTER (t < s), '') AS before,
coalesce(string_agg(nbr_id, ',' ORDER BY nbr_id) FILTER (t >= s), '') AS after FROM nb GROUP BY id""")
def neighbour_sets(spark, sf_dir):
    """The ordered neighbours of each point as a list: of earlier slides, and of the own or later ones."""
    found = neighbors.neighbour_sets(neighbors.pairs(events(spark, sf_dir), EVENTS, 1))
    return found.select("id", *(F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))).alias(c) for c in ("before", "after")))


@query(f"""WITH e AS (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS v, vec_id // {VECTORS.slide} + 1 AS s FROM embeddings),
c AS (SELECT s, arg_min(v, id) AS v FROM e GROUP BY s) SELECT a.s AS slide_no, b.s AS other, CASE WHEN a.v = b.v THEN 0 WHEN a.v < b.v THEN -1 ELSE 1 END AS comparison FROM c a JOIN c b ON b.s = a.s + 1""")
def centre_comparison(spark, sf_dir):
    """The first point of each slide as its centre, compared with the next slide's by coordinates."""
    pts = neighbors.with_slide(embeddings(spark, sf_dir), VECTORS.slide)
    centres = pts.groupBy("slide_no").agg(F.min_by("values", "id").alias("v"))
    other = centres.select((F.col("slide_no") - 1).alias("slide_no"), F.col("slide_no").alias("other"), F.col("v").alias("w"))
    return centres.join(other, "slide_no").select("slide_no", "other", neighbors.same_centre(F.col("v"), F.col("w")).alias("comparison"))


# Counts


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT id, t AS nbr_slide, count(*) AS n FROM nb GROUP BY ALL")
def slide_neighbor_counts(spark, sf_dir):
    return counts.slide_counts(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)} SELECT * FROM wc")
def window_neighbor_counts(spark, sf_dir):
    return counts.window_counts(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT e.id, count(nbr_id) AS a FROM e LEFT JOIN nb ON nb.id = e.id AND nbr_id < e.id GROUP BY e.id")
def arrival_counts(spark, sf_dir):
    return counts.arrival_counts(events(spark, sf_dir), EVENTS, 1)


@query(f"""WITH {_e(EVENTS)}, {_nb(EVENTS)}, w AS (SELECT id, s, unnest(range(s + 1, least(s + {EVENTS.n - 1}, last) + 1)) AS batch FROM e, b)
SELECT w.id, w.batch, count(nb.nbr_id) AS cnt FROM w LEFT JOIN nb ON nb.id = w.id AND nb.t BETWEEN w.batch - {EVENTS.n - 1} AND w.batch - 1 GROUP BY ALL""")
def post_expiry_counts(spark, sf_dir):
    return counts.post_expiry_counts(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT e.id, count(*) FILTER (nb.t < e.s) AS preceding, count(*) FILTER (nb.t >= e.s) AS succeeding FROM e LEFT JOIN nb ON nb.id = e.id GROUP BY e.id")
def preceding_succeeding_counts(spark, sf_dir):
    return counts.before_and_after(events(spark, sf_dir), EVENTS, 1)


@query(f"""WITH {_e(EVENTS)}, {_nb(EVENTS)}, w AS (SELECT id, s, unnest(range(s, least(s + {EVENTS.n - 1}, last) + 1)) AS batch FROM e, b)
SELECT w.id, w.batch, count(nb.nbr_id) AS n FROM w LEFT JOIN nb ON nb.id = w.id AND nb.t < w.s AND nb.t >= w.batch - {EVENTS.n - 1} GROUP BY ALL""")
def live_preceding_counts(spark, sf_dir):
    return counts.live_preceding_counts(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)} SELECT id, min(nbr_id) AS oldest, min(nbr_id) + {EVENTS.window + 1} AS expires FROM nb WHERE t < s GROUP BY id")
def oldest_preceding(spark, sf_dir):
    return counts.oldest_preceding(events(spark, sf_dir), EVENTS, 1)


@query(f"""WITH {_e(EVENTS)}, {_nb(EVENTS)}, per AS (SELECT id, s, t, count(*) AS n FROM nb WHERE t >= s GROUP BY ALL),
run AS (SELECT id, t, sum(n) OVER (PARTITION BY id ORDER BY t) AS c FROM per) SELECT id, min(t) AS safe_from FROM run WHERE c >= {EVENTS.k} GROUP BY id""")
def safe_inliers(spark, sf_dir):
    return counts.safe_inliers(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS, EVENTS.radius / 2)} SELECT id, count(*) AS n FROM nb WHERE nbr_id < id GROUP BY id HAVING count(*) >= {EVENTS.k}")
def core_points(spark, sf_dir):
    return counts.core_points(events(spark, sf_dir), EVENTS, 1)


# Outliers


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)} SELECT id, batch FROM wc WHERE cnt < {EVENTS.k}")
def window_outliers(spark, sf_dir):
    return counts.window_outliers(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)} SELECT batch, count(*) AS residents, count(*) FILTER (cnt < {EVENTS.k}) AS outliers FROM wc GROUP BY batch")
def outliers_per_window(spark, sf_dir):
    return counts.outliers_per_window(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)} {_PURE.format(k=EVENTS.k)}")
def pure_outliers(spark, sf_dir):
    return counts.pure_outliers(events(spark, sf_dir), EVENTS, 1)


@query(f"WITH {_V}, {_wc(VECTORS)} {_PURE.format(k=VECTORS.k)}")
def pure_outliers_embeddings(spark, sf_dir):
    return counts.pure_outliers(embeddings(spark, sf_dir), VECTORS, DIMS)


@query(f"WITH {_e(TUMBLING)}, {_nb(TUMBLING)}, {_wc(TUMBLING)} {_PURE.format(k=TUMBLING.k)}")
def pure_outliers_tumbling(spark, sf_dir):
    return counts.pure_outliers(events(spark, sf_dir), TUMBLING, 1)


_LIFE = f"""WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)},
a AS (SELECT e.id, count(nbr_id) AS cnt FROM e LEFT JOIN nb ON nb.id = e.id AND nbr_id < e.id GROUP BY e.id),
p AS (SELECT w.id, count(nb.nbr_id) AS cnt FROM w LEFT JOIN nb ON nb.id = w.id AND nb.t BETWEEN w.batch - {EVENTS.n - 1} AND w.batch - 1 WHERE w.batch > w.s GROUP BY w.id, w.batch),
f AS (SELECT id, max(cnt) >= {EVENTS.k} AS i, min(cnt) < {EVENTS.k} AS o FROM (SELECT id, cnt FROM wc UNION ALL SELECT id, cnt FROM a UNION ALL SELECT id, cnt FROM p) GROUP BY id),
c AS (SELECT count(*) FILTER (i AND NOT o) AS only_in, count(*) FILTER (o AND NOT i) AS only_out, count(*) FILTER (i AND o) AS both_ FROM f)"""


@query(_LIFE + f"SELECT id, count(*) FILTER (cnt >= {EVENTS.k}) AS n_inlier, count(*) FILTER (cnt < {EVENTS.k}) AS n_outlier FROM (SELECT id, cnt FROM wc UNION ALL SELECT id, cnt FROM a UNION ALL SELECT id, cnt FROM p) GROUP BY id")
def assignment_counts(spark, sf_dir):
    return counts.assignments(events(spark, sf_dir), EVENTS, 1)


@query(_LIFE + 'SELECT only_in, only_out, both_ AS "both" FROM c')
def lifecycle_counts(spark, sf_dir):
    return counts.lifecycle_counts(events(spark, sf_dir), EVENTS, 1)


@query(_LIFE + "SELECT " + ", ".join(f"round({c} * 100.0::DOUBLE / (only_in + only_out + both_), 1) AS {c.rstrip('_')}_pct" for c in ("only_in", "only_out", "both_")) + " FROM c")
def lifecycle_percentages(spark, sf_dir):
    return counts.percentages(counts.lifecycle_counts(events(spark, sf_dir), EVENTS, 1))


# Hashing


def _hashes(p: LshParams) -> list[list[str]]:
    return [[f"floor(((0.0::DOUBLE + {a[0]!r}::DOUBLE * v) + {b!r}::DOUBLE) / {p.width!r}::DOUBLE)::BIGINT" for a, b in t] for t in lsh_functions.projections(p, 1)]


def _lsh(p: Params, lsh: LshParams, verify: bool) -> str:
    keys = ", ".join(f"concat_ws(',', {', '.join(t)}) AS k{i}" for i, t in enumerate(_hashes(lsh)))
    same = " OR ".join(f"x.k{i} = q.k{i}" for i in range(lsh.tables))
    near = f" AND sqrt((x.v - q.v) * (x.v - q.v)) <= {p.radius}" if verify else ""
    return f"""{_e(p)}, h AS (SELECT *, {keys} FROM e), nb AS (SELECT x.id, q.id AS nbr_id, x.s, q.s AS t, sqrt((x.v - q.v) * (x.v - q.v)) AS d
    FROM h x JOIN h q ON x.id <> q.id AND abs(x.s - q.s) < {p.n}{near} AND ({same}))"""


@query(f"SELECT event_id + 1 AS id, {', '.join(f'{h} AS h{i}' for i, h in enumerate(_hashes(LSHOD)[0]))} FROM (SELECT event_id, value AS v FROM events)")
def pstable_hash(spark, sf_dir):
    hashes = lsh_functions.projections(LSHOD, 1)[0]
    return events(spark, sf_dir).select("id", *(lsh_functions.hash_value(F.col("values"), a, b, LSHOD.width).alias(f"h{i}") for i, (a, b) in enumerate(hashes)))


@query(" UNION ALL ".join(f"SELECT event_id + 1 AS id, {i} AS tbl, concat_ws(',', {', '.join(t)}) AS key FROM (SELECT event_id, value AS v FROM events)" for i, t in enumerate(_hashes(LSHOD))))
def lsh_keys(spark, sf_dir):
    return lsh_join.keys(events(spark, sf_dir), LSHOD, 1)


@query("SELECT tbl, key, count(*) AS n FROM (" + ORACLES["lsh_keys"] + ") GROUP BY ALL")
def lsh_buckets(spark, sf_dir):
    return lsh_join.buckets(events(spark, sf_dir), LSHOD, 1)


@query(f"WITH {_lsh(EVENTS, LSHOD, False)} SELECT id, nbr_id, d FROM nb")
def lsh_candidates(spark, sf_dir):
    return lsh_join.candidates(events(spark, sf_dir), EVENTS, LSHOD, 1)


@query(f"WITH {_lsh(EVENTS, HYBRID, True)} SELECT id, nbr_id, d FROM nb")
def lsh_verified_pairs(spark, sf_dir):
    return lsh_join.candidates(events(spark, sf_dir), EVENTS, HYBRID, 1, verify=True)


@query(f"WITH {_lsh(EVENTS, LSHOD, False)}, {_wc(EVENTS)} {_PURE.format(k=EVENTS.k)}")
def lshod_pure(spark, sf_dir):
    return lsh_join.lsh_pure_outliers(events(spark, sf_dir), EVENTS, LSHOD, 1)


@query(f"WITH {_lsh(EVENTS, HYBRID, True)}, {_wc(EVENTS)} {_PURE.format(k=EVENTS.k)}")
def mclshod_pure(spark, sf_dir):
    return lsh_join.lsh_pure_outliers(events(spark, sf_dir), EVENTS, HYBRID, 1, verify=True)


# Sets and accuracy


_BOTH = f"""WITH base AS (WITH {_e(EVENTS)}, {_nb(EVENTS)}, {_wc(EVENTS)} {_PURE.format(k=EVENTS.k)}),
test AS (WITH {_lsh(EVENTS, LSHOD, False)}, {_wc(EVENTS)} {_PURE.format(k=EVENTS.k)}) """


@query(_BOTH + "SELECT id FROM base WHERE id IN (SELECT id FROM test)")
def common_outliers(spark, sf_dir):
    return sets.common(pure_outliers(spark, sf_dir), lshod_pure(spark, sf_dir))


@query(_BOTH + """, n AS (SELECT (SELECT count(*) FROM base) AS n_base, (SELECT count(*) FROM test) AS n_test, (SELECT count(*) FROM base WHERE id IN (SELECT id FROM test)) AS n_common)
SELECT *, n_common * 100.0::DOUBLE / nullif(n_base, 0) AS recall, n_common * 100.0::DOUBLE / nullif(n_test, 0) AS precision, n_common * 200.0::DOUBLE / nullif(n_base + n_test, 0) AS f1 FROM n""")
def accuracy_recall(spark, sf_dir):
    return sets.accuracy(pure_outliers(spark, sf_dir), lshod_pure(spark, sf_dir))


@query("SELECT min(value) AS low, max(value) AS high FROM events")
def min_max(spark, sf_dir):
    return sets.min_max(events(spark, sf_dir).select(F.col("values")[0].alias("v")), "v")


@query("SELECT event_id + 1 AS id FROM events ORDER BY ((event_id + 1 + 7) * 48271) % 2147483647, event_id LIMIT 25")
def random_sample(spark, sf_dir):
    return sets.sample(events(spark, sf_dir).select("id"), 25, seed=7)


# Stateful detectors: a stream for each type of event, each with ids of its own.


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type as the stream, seq as the id in it, by rank of a total order within the stream."""
    return replay.numbered(events(spark, sf_dir, F.col("event_type").alias("stream_id")))


STREAM = Params(window=500, slide=50, radius=0.505, k=3)
_STREAMS = f"""e AS (SELECT event_id + 1 AS orig, event_type AS y, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events),
f AS (SELECT *, (seq - 1) // {STREAM.slide} + 1 AS s FROM e), b AS (SELECT y, max(s) AS last FROM f GROUP BY y),
nb AS (SELECT x.orig, q.s AS t FROM f x JOIN f q ON x.y = q.y AND x.orig <> q.orig AND abs(x.s - q.s) < {STREAM.n} AND sqrt((x.v - q.v) * (x.v - q.v)) <= {STREAM.radius}),
w AS (SELECT orig, f.y, seq, s, unnest(range(s, least(s + {STREAM.n - 1}, last) + 1)) AS batch FROM f JOIN b USING (y)),
wc AS (SELECT w.orig, w.y, w.seq, w.batch, count(nb.t) AS cnt FROM w LEFT JOIN nb ON nb.orig = w.orig AND nb.t BETWEEN w.batch - {STREAM.n - 1} AND w.batch GROUP BY ALL)"""


@query(f"WITH {_STREAMS} SELECT y AS stream_id, seq AS id FROM wc GROUP BY ALL HAVING max(cnt) < {STREAM.k}")
def stateful_exact(spark, sf_dir):
    return replay.replay(streams(spark, sf_dir), replay.Exact(STREAM)).filter("kind = 'outlier'").select("stream_id", "id")


@query(f"""WITH {_STREAMS} SELECT y AS stream_id, batch AS id, count(*) AS residents, count(*) FILTER (cnt < {STREAM.k}) AS outliers FROM wc GROUP BY ALL""")
def stateful_slides(spark, sf_dir):
    """The detector's row for each slide of each stream."""
    return replay.replay(streams(spark, sf_dir), replay.Exact(STREAM)).filter("kind = 'slide'").select("stream_id", "id", "residents", "outliers")


@query(ORACLES["stateful_exact"])
def structured_exact(spark, sf_dir):
    """The same through Structured Streaming, file by file."""
    found = structured.run_over_files(streams(spark, sf_dir), replay.Exact(STREAM))
    return found.filter("kind = 'outlier'").select("stream_id", "id")


@query()
def approx_mcod(spark, sf_dir):
    """The approximate detector with a bounded list of unclustered points; its choices are random by seed."""
    d = replay.MicroClusters(STREAM, pd_limit=100, ring=0.1, seed=7)
    return replay.replay(streams(spark, sf_dir), d).filter("kind = 'outlier'").select("stream_id", "id")


@query(f"WITH {_STREAMS} SELECT y AS stream_id, seq AS id FROM wc GROUP BY ALL HAVING max(cnt) < {STREAM.k}")
def approx_mcod_unlimited(spark, sf_dir):
    """With a list of at least a window, the approximate detector is exact."""
    d = replay.MicroClusters(STREAM, pd_limit=STREAM.window, ring=0.0, seed=7)
    return replay.replay(streams(spark, sf_dir), d).filter("kind = 'outlier'").select("stream_id", "id")


@query(f"""WITH {_STREAMS}, r AS (SELECT y, batch, count(*) AS residents, count(*) FILTER (cnt < {STREAM.k}) AS outliers FROM wc GROUP BY ALL)
SELECT y AS stream_id, batch AS id, residents, outliers, residents AS listed_or_clustered, 0 AS unbalanced FROM r""")
def micro_cluster_state(spark, sf_dir):
    """By slide the residents and outliers of the micro-cluster detector, the points that are in clusters or in its list, and the clusters
    that aren't accounted for by those made and dissolved so far."""
    d = replay.MicroClusters(STREAM, pd_limit=STREAM.window, ring=0.0, seed=7)
    slides = replay.replay(streams(spark, sf_dir), d).filter("kind = 'slide'")
    # One row for each slide of a stream: far fewer than points, and a window's worth of work for each.
    so_far = F.sum(F.col("made") - F.col("dissolved")).over(Window.partitionBy("stream_id").orderBy("id"))
    return slides.select("stream_id", "id", "residents", "outliers", (F.col("clustered") + F.col("unclustered")).alias("listed_or_clustered"), (F.col("clusters") - so_far).alias("unbalanced"))


@query()
def bounded_lsh(spark, sf_dir):
    """The hashing detector with bounded buckets, which lose safe inliers at random by seed."""
    d = replay.BoundedLsh(STREAM, LshParams(10, 4, STREAM.radius, 5), capacity=STREAM.k, seed=7)
    return replay.replay(streams(spark, sf_dir), d).filter("kind = 'outlier'").select("stream_id", "id")


@query()
def clustered_lsh(spark, sf_dir):
    """Micro-clusters whose unclustered points are found by hashing and verified."""
    d = replay.MicroClusters(STREAM, pd_limit=STREAM.window, ring=0.0, seed=7, lsh=LshParams(10, 5, STREAM.radius * 1.5, 6))
    return replay.replay(streams(spark, sf_dir), d).filter("kind = 'outlier'").select("stream_id", "id")


@query(f"""WITH {_STREAMS}, o AS (SELECT y, seq, max(cnt) < {STREAM.k} AS pure FROM wc GROUP BY ALL)
SELECT y AS stream_id, count(*) AS points, count(*) FILTER (pure) AS pure_outliers, round(count(*) FILTER (pure) * 100.0::DOUBLE / count(*), 1) AS pct,
count(*) AS range_queries, max(seq - 1) // {STREAM.slide} + 1 AS slides FROM o GROUP BY y""")
def run_report(spark, sf_dir):
    """By stream what a run reports about its results; time and memory are the command line's to tell, as no two runs agree on them."""
    pts = streams(spark, sf_dir)
    rows = replay.replay(pts, replay.Exact(STREAM)).groupBy("stream_id").agg(F.count_if(F.col("kind") == "outlier").alias("pure_outliers"), F.sum("queries").alias("range_queries"), F.count_if(F.col("kind") == "slide").alias("slides"))
    total = pts.groupBy("stream_id").agg(F.count("*").alias("points"))
    return total.join(rows, "stream_id").select("stream_id", "points", "pure_outliers", F.round(F.col("pure_outliers") * 100.0 / F.col("points"), 1).alias("pct"), "range_queries", "slides")
