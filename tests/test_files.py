import pytest
from pyspark.sql import functions as F

from filmfold import schemas
from filmfold.session import materialise, scale_settings, scratch_path, shared_dir
from filmfold.sources import readers, writers

MOVIES = [(1, 'Double, The (Véronique "V") (1991)', "Drama|War"), (2, "Plain, with comma", "")]


def test_dat_keeps_accents_quotes_and_commas(spark):
    path = scratch_path(spark, "movies.dat")
    df = spark.createDataFrame(MOVIES, schemas.MOVIES)
    writers.write_dat(df, path, readers.LATIN_1)
    raw = spark.read.format("binaryFile").load(path + "/part-*").select("content").collect()
    assert any("Véronique".encode("latin-1") in r.content for r in raw)
    rows = sorted(tuple(r) for r in readers.read_dat_movies(spark, path).collect())
    assert rows == [MOVIES[0], (2, "Plain, with comma", None)]


def test_csv_round_trip(spark):
    path = scratch_path(spark, "movies.csv")
    writers.write_csv(spark.createDataFrame(MOVIES, schemas.MOVIES), path)
    rows = sorted(tuple(r) for r in readers.read_csv(spark, path, schemas.MOVIES).collect())
    assert rows[0] == MOVIES[0] and rows[1][:2] == MOVIES[1][:2]


def test_zip_keeps_its_zeros(spark):
    path = scratch_path(spark, "users.csv")
    user = (1, "F", 25, 3, "00713")
    writers.write_csv(spark.createDataFrame([user], schemas.USERS), path)
    assert tuple(readers.read_csv(spark, path, schemas.USERS).first()) == user


def test_missing_inputs_are_empty(spark):
    assert readers.read_links(spark, "/tmp/filmfold-no-such-file.csv").count() == 0
    assert readers.read_json_map(spark, "/tmp/filmfold-no-such-file.json").count() == 0
    assert readers.rows_to_table(spark, [], schemas.MOVIES).count() == 0


def test_json_map_in_one_object_or_many_and_with_junk(spark, tmp_path):
    file = tmp_path / "posters.json"
    file.write_text('{"1":"http://a/w342/x.jpg","2":"u2"}\nnot json\n{"x":"no id"}\n{"3":"u3"}\n')
    rows = sorted(tuple(r) for r in readers.read_json_map(spark, str(file)).collect())
    spread = tmp_path / "spread.json"
    spread.write_text('{\n "1": "a",\n "x": "b"\n}\n')
    assert [tuple(r) for r in readers.read_json_map(spark, str(spread), whole=True).collect()] == [(1, "a")]
    with pytest.raises(ValueError, match="whole=True"):
        readers.read_json_map(spark, str(spread))
    assert rows == [(1, "http://a/w342/x.jpg"), (2, "u2"), (3, "u3")]


def test_film_lines_escape_titles(spark):
    path = scratch_path(spark, "films")
    schema = "movieId int, title string, year int, mask int, cnt int, mean10 int, q array<int>"
    films = [(7, 'A "quoted", Title\\ é (1990)', 1990, 3, 50, 42, list(range(10))), (8, "B", 0, 0, 60, 10, [0] * 10)]
    writers.write_film_lines(spark.createDataFrame(films, schema), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].startswith('[8,"B",0,0,60,10,0,')
    got = {r.movieId: r for r in readers.read_film_lines(spark, path).collect()}
    assert got[7].title == films[0][1] and got[7].mean == 4.2 and got[7].genres == ["Action", "Adventure"]
    assert got[7].features == [i / 1000 for i in range(10)]


def test_pick_sinks(spark):
    schema = "userId int, picks array<struct<movieId:int,score:double>>"
    picks = spark.createDataFrame([(2, [(5, 4.5)]), (1, [])], schema)
    table, lines = scratch_path(spark, "picks"), scratch_path(spark, "pick-lines")
    writers.write_pick_table(picks, table)
    writers.write_pick_lines(picks, lines)
    assert readers.read_pick_table(spark, table).filter("userId = 2").first().picks[0].movieId == 5
    day = spark.range(1).select(F.current_date().cast("string")).first()[0]
    assert {r.value for r in spark.read.text(lines).collect()} == {
        f'{{"userId":2,"picks":[{{"movieId":5,"score":4.5}}],"generated":"{day}"}}',
        f'{{"userId":1,"picks":[],"generated":"{day}"}}',
    }


def test_tsv_is_ordered(spark):
    path = scratch_path(spark, "tsv")
    writers.write_tsv(spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["1\ta", "2\tb"]


def test_shared_folder_follows_the_session(spark):
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir", shared_dir(spark)).rstrip("/") == shared_dir(spark)
    assert materialise(spark.range(5), "five").count() == 5


def test_settings_follow_the_input():
    assert scale_settings(1e6)["spark.sql.shuffle.partitions"] == "200"
    assert int(scale_settings(100e12)["spark.sql.shuffle.partitions"]) > 500_000
