"""Landing of raw CSVs: file order, counted rejects, odd files."""

import os

import pytest
from pyspark.sql import functions as F

from murmur.operators import clean, textchunks
from murmur.sources import files

HEADER = "score,title,id,created_utc,author\n"


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_the_first_row_in_file_order_stays(spark, tmp_path):
    put(tmp_path, "b.csv", HEADER + '1,"x\ny",p,0,a\n9,"x\ny",p,0,a\n5,t,q,0,a\n')
    put(tmp_path, "a.csv", HEADER + "7,t,q,0,a\n2,t,q,0,a\n" + "".join(f"{i},t,r,0,a\n" for i in range(500, 0, -1)))
    rows = files.ingest(spark, str(tmp_path), files.POSTS_SCHEMA).rows
    got = {r["id"]: r["score"] for r in clean.dedup_posts(rows).collect()}
    assert got == {"p": 1, "q": 7, "r": 500}


def test_order_holds_whatever_the_partitions_of_the_landed_rows(spark, tmp_path):
    for i in range(6):
        put(tmp_path, f"{i}.csv", HEADER + "".join(f"{i * 100 + j},t,id{j},0,a\n" for j in range(50)))
    rows = files.ingest(spark, str(tmp_path), files.POSTS_SCHEMA).rows.repartition(7, "score")
    kept = clean.dedup(rows, ["id"])
    assert sorted(r["score"] for r in kept.collect()) == list(range(50))


def test_day_texts_are_joined_in_file_order(spark, tmp_path):
    put(f"{tmp_path}/p", "1.csv", HEADER + "1,zulu,9,0,a\n1,alpha,1,0,a\n")
    put(f"{tmp_path}/p", "0.csv", HEADER + "1,first,5,0,a\n")
    put(f"{tmp_path}/c", "1.csv", "id,author,body,created_utc,score,link_id\nz,a,comment two,0,1,t3_9\na,a,comment three,0,1,t3_9\n")
    posts = clean.add_date(files.ingest(spark, f"{tmp_path}/p", files.POSTS_SCHEMA).rows)
    comments = clean.add_date(files.ingest(spark, f"{tmp_path}/c", files.COMMENTS_SCHEMA).rows)
    items = clean.union_items(comments, posts)
    text = textchunks.daily_chunks(items, order_cols=clean.item_order(items)).first()["text"]
    assert text == "comment two comment three first zulu alpha"


def test_every_row_is_kept_or_in_quarantine_with_its_reasons(spark, tmp_path):
    put(tmp_path, "x.csv", HEADER + '1,ok,a,0,u\nmany,odd,b,later,u\n1,,c,0,u\n1,short\n1,long,d,0,u,more\n5.0,NaN,e,1e3,u\n')
    got = files.ingest(spark, str(tmp_path), files.POSTS_SCHEMA, required=("title",))
    assert got.counts == {"rows": 6, "malformed": 2, "bad_created_utc": 1, "bad_score": 1, "missing_title": 2}
    assert {r["id"]: (r["score"], r["created_utc"]) for r in got.rows.collect()} == {"a": (1, 0.0), "b": (None, None)}
    rejects = [(r["reasons"], r["record"]) for r in got.rejects.orderBy(*files.ORDINAL).collect()]
    assert [r[0] for r in rejects] == [["bad_created_utc", "bad_score"], ["missing_title"], ["malformed"], ["malformed"], ["missing_title"]]
    assert "many" in rejects[0][1] and rejects[2][1] == "1,short"


def test_a_file_with_another_header_is_an_error_not_a_mix_up(spark, tmp_path):
    put(tmp_path, "a.csv", HEADER + "1,t,p,0,a\n")
    put(tmp_path, "b.csv", "id,title,score,created_utc,author\nq,t,1,0,a\n")
    with pytest.raises(Exception, match="header"):
        files.ingest(spark, str(tmp_path), files.POSTS_SCHEMA).rows.collect()


@pytest.mark.parametrize("text", ["", HEADER])
def test_files_without_rows(spark, tmp_path, text):
    put(tmp_path, "x.csv", text)
    got = files.ingest(spark, str(tmp_path), files.POSTS_SCHEMA, required=("id",))
    assert got.rows.columns == [*files.POSTS_SCHEMA.names, *files.ORDINAL]
    assert got.rows.count() == got.rejects.count() == got.counts["rows"] == 0
    assert files.read_bars(spark, f"{tmp_path}/x.csv").count() == 0


def test_bars_without_dates_use_the_fallback_and_keep_its_symbols(spark, tmp_path):
    put(tmp_path, "none.csv", "Close,Volume\n1,2\n")
    put(tmp_path, "merged.csv", "Volume,Open,Low,High,Close,Date,Symbol,Extra\n5,1,1,1,1,2024-01-02,ABC,x\n5,1,1,1,nan,2024-01-03,ABC,x\n5,1,1,1,1,2024-01-04,,x\n")
    got = files.ingest_bars(spark, f"{tmp_path}/none.csv", f"{tmp_path}/merged.csv", symbol="DEF")
    assert [(r["symbol"], str(r["date"])) for r in got.rows.orderBy("date").collect()] == [("ABC", "2024-01-02"), ("DEF", "2024-01-04")]
    assert got.rejects.select(F.explode("reasons")).collect()[0][0] == "missing_close"


def test_quotes_survive_the_csv_sink(spark, tmp_path):
    rows = [('say "hi", there',), ("back\\slash",), ("two\nlines",), ('"',)]
    files.write_table(spark.createDataFrame(rows, "title string"), f"{tmp_path}/out", fmt="csv")
    back = files.ingest(spark, f"{tmp_path}/out", files.POSTS_SCHEMA).rows.select("title").collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)
