"""Files with broken lines: the good rows, and exactly the broken lines with their reasons."""

import pytest

from filmfold import schemas
from filmfold.operators import recommend
from filmfold.sources import readers, rejects


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _rejects(checked):
    return sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in checked.rejects().collect())


def test_ratings_with_broken_lines(spark, tmp_path):
    file = tmp_path / "ratings.dat"
    file.write_text("1::10::5::978300760\n\n2::11::x::978300761\n3::12::4\n4::13::4::978300763::extra\n::14::3::1\n"
                    "5::15::::1\n6::16::3::\n7::17::3.5::1\n8::99999999999999999999::3::1\n 9 ::18::2::7\nnonsense\n\"10\"::1::1::1\n")
    found = rejects.read_dat_ratings(spark, str(file))
    assert _rows(found.good()) == [(1, 10, 5, 978300760), (6, 16, 3, None), (9, 18, 2, 7)]
    assert found.good().schema == schemas.RATINGS
    assert _rejects(found) == sorted(("ratings.dat", line, reason) for line, reason in [
        ("2::11::x::978300761", "rating: 'x' is no int"), ("3::12::4", "not 4 fields"),
        ("4::13::4::978300763::extra", "not 4 fields"), ("::14::3::1", "userId is missing"), ("5::15::::1", "rating is missing"),
        ("7::17::3.5::1", "rating: '3.5' is no int"), ("8::99999999999999999999::3::1", "movieId: '99999999999999999999' is no bigint"),
        ("nonsense", "not 4 fields"), ('"10"::1::1::1', "userId: '\"10\"' is no bigint")])


def test_good_files_read_as_before(spark, tmp_path):
    file = tmp_path / "movies.dat"
    file.write_bytes('1::Double, The (Véronique "V") (1991)::Drama|War\n2::\'Til There: Was (1997)::\n'.encode("latin-1"))
    found = rejects.read_dat_movies(spark, str(file))
    assert _rows(found.good()) == _rows(readers.read_dat_movies(spark, str(file))) and not _rejects(found)


def test_csv_with_quotes_in_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('movieId,title,genres\n1,"One, ""the"" first",Drama\nx,Two,War\n3,,War\n')
    (tmp_path / "b.csv").write_text("movieId,title,genres\n4,Four,\n5,Five\n6,Six,War,more\n")
    found = rejects.read_csv(spark, str(tmp_path), schemas.MOVIES, ["movieId", "title"])
    assert _rows(found.good()) == [(1, 'One, "the" first', "Drama"), (4, "Four", None)]
    assert _rejects(found) == [
        ("a.csv", "3,,War", "title is missing"), ("a.csv", "x,Two,War", "movieId: 'x' is no bigint"),
        ("b.csv", "5,Five", "not 3 fields"), ("b.csv", "6,Six,War,more", "not 3 fields")]


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    file = tmp_path / "users.dat"
    file.write_text("".join(f"{i if i % 5 else 'n'}::F::{i % 60 if i % 7 else 'old'}::3::{i:05}\n" for i in range(1000)))
    found = rejects.read_dat_users(spark, str(file))
    good, bad = found.good().count(), found.rejects().count()
    assert bad == sum(i % 5 == 0 or i % 7 == 0 for i in range(1000)) and good + bad == 1000
    assert found.good().select("zip").count() == good  # however few columns are read


def test_json_map(spark, tmp_path):
    file = tmp_path / "posters.json"
    file.write_text('{"1":"a","x":"b"}\nnot json\n\n{}\n{"2":null}\n["3"]\n{"4":"c"\n')
    found = rejects.read_json_map(spark, str(file))
    assert _rows(found.good()) == [(1, "a"), (2, None)]
    assert _rejects(found) == [
        ("posters.json", '["3"]', "not a JSON object"), ("posters.json", "not json", "not a JSON object"),
        ("posters.json", '{"1":"a","x":"b"}', "key 'x' is no film id"), ("posters.json", '{"4":"c"', "not a JSON object")]


def test_request_ids(spark):
    raw = spark.createDataFrame([(" 42 ",), ("",), (None,), (" ",), ("abc",), ("12345678",), ("1.5",), ("1234567",)], "raw_id string")
    assert _rows(recommend.rejected_requests(raw)) == [
        (" ", "blank"), ("", "blank"), ("1.5", "not a number"), ("12345678", "too long"), ("abc", "not a number"), (None, "blank")]


@pytest.mark.parametrize("text", ["", "\n\n"])
def test_empty_files(spark, tmp_path, text):
    file = tmp_path / "ratings.dat"
    file.write_text(text)
    found = rejects.read_dat_ratings(spark, str(file))
    assert found.good().count() == 0 and found.rejects().count() == 0
