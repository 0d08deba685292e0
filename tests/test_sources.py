import os
import tempfile

import pytest

from recsim import session
from recsim.operators import evaluate as H
from recsim.params import Params
from recsim.sources import files as A


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_fold_users_genres_occupations_items(spark):
    d = tempfile.mkdtemp(prefix="recsim-files-", dir="/tmp")
    fold = _write(d, "x1.test", "1\t6\t5\t887431973\n1\t10\t3\t875693118\n2\t6\t4\t874724710\n")
    users = _write(d, "x.user", "1|24|M|technician|85711\n2|53|F|other|T8H1N\n")
    genres = _write(d, "x.genre", "unknown|0\nAction|1\n\n")
    occ = _write(d, "x.occupation", "doctor\nother\n\n")
    items = _write(d, "x.item", "1|Toy Story (1995)|01-Jan-1995||http://x|0|0|0|1|1|1|0|0|0|0|0|0|0|0|0|0|0|0|0\n")
    r = A.read_rating_folds(spark, fold).collect()
    assert [(x.userId, x.movieId, x.rating, x.timestamp) for x in r][0] == (1, 6, 5.0, 887431973)
    stamps = A.read_rating_folds(spark, fold).selectExpr("unix_timestamp(ts) AS u", "date_format(ts, 'yyyy-MM') AS m").collect()
    assert [x.u for x in stamps] == [887431973, 875693118, 874724710] and stamps[0].m == "1998-02"
    u = A.read_users(spark, users).collect()
    assert u[1].zip == "T8H1N" and u[0].age == 24
    g = A.read_genres(spark, genres).collect()
    assert [(x.name, x.genre_id) for x in g] == [("unknown", 0), ("Action", 1)]
    assert [x.occupation for x in A.read_occupations(spark, occ).collect()] == ["doctor", "other"]
    it = A.read_item_file(spark, items).first()
    assert it.title == "Toy Story (1995)" and it.genres == ["Animation", "Children's", "Comedy"]


def test_csv_round_trips_and_metric_append(spark, mk):
    d = tempfile.mkdtemp(prefix="recsim-csv-", dir="/tmp")
    ratings = mk([(1, 1, 5.0), (2, 1, 3.5)])
    ratings.write.option("header", True).csv(d + "/r")
    back = A.read_ratings_csv(spark, d + "/r").collect()
    assert sorted((x.userId, x.movieId, x.rating, x.timestamp) for x in back) == [(1, 1, 5.0, None), (2, 1, 3.5, None)]
    _write(d, "movies.csv", 'movieId,title,genres\n1,"Heat, The (1995)",Action\n')
    m = A.read_items_csv(spark, d + "/movies.csv").first()
    assert m.title == "Heat, The (1995)"
    metrics = spark.createDataFrame([(1.0, 0.5)], "rmse double, mae double")
    rec = H.metrics_record(metrics, Params(), "ds", stamp="20250101_000000")
    A.append_metrics(rec, d + "/m")
    A.append_metrics(rec, d + "/m")
    rows = A.read_metrics(spark, d + "/m").collect()
    assert len(rows) == 2 and rows[0].numHashTables == 3 and rows[0].timestamp == "20250101_000000"


def test_a_run_that_is_written_again_replaces_its_record(spark):
    path = A.scratch_path(spark, "metrics-test")
    rec = lambda rmse: H.metrics_record(spark.createDataFrame([(rmse, 0.5)], "rmse double, mae double"), Params(), "ds", stamp="x")
    A.append_metrics(rec(1.0), path, "a")
    A.append_metrics(rec(2.0), path, "b")
    A.append_metrics(rec(3.0), path, "a")
    assert sorted(r.rmse for r in A.read_metrics(spark, path).collect()) == [2.0, 3.0]
    assert A.read_metrics(spark, path).columns == ["dataset", "rmse", "mae", "bucketLength", "numHashTables", "threshold", "top_k", "timestamp"]


def test_scratch_path_is_under_checkpoint_dir(spark):
    p = A.scratch_path(spark, "x")
    assert p.startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))


def test_csv_columns_are_found_by_name(spark):
    d = tempfile.mkdtemp(prefix="recsim-csv-", dir="/tmp")
    swapped = _write(d, "swapped.csv", "rating,movieId,extra,userId\n4.0,7,x,1\n")
    assert [tuple(r) for r in A.read_ratings_csv(spark, swapped).collect()] == [(1, 7, 4.0, None)]
    with pytest.raises(ValueError, match="movieId"):
        A.read_ratings_csv(spark, _write(d, "short.csv", "userId,rating\n1,4.0\n"))


def test_quoted_titles_survive_a_round_trip(spark):
    d = tempfile.mkdtemp(prefix="recsim-csv-", dir="/tmp")
    titles = ['Plain', 'Comma, The', 'The "Quoted" One', '"', "back\\slash"]
    df = spark.createDataFrame(list(enumerate(titles)), "movieId long, title string")
    df.write.options(**A.CSV).csv(d + "/items")
    assert {r.movieId: r.title for r in A.read_items_csv(spark, d + "/items").collect()} == dict(enumerate(titles))


def test_item_file_is_latin_1(spark):
    d = tempfile.mkdtemp(prefix="recsim-files-", dir="/tmp")
    with open(d + "/u.item", "wb") as f:
        f.write(("1|Café (1995)|01-Jan-1995||http://x|" + "|".join(["0"] * 19) + "\n").encode("latin-1"))
    assert A.read_item_file(spark, d + "/u.item").first().title == "Café (1995)"


def test_a_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())
