import os

from vellum.session import local_path, scratch_dir
from vellum.streaming import land_stream

CONTRACT = {"description": "users", "schema": {"fields": [
    {"name": "id", "type": "int", "required": True},
    {"name": "name", "type": "str", "required": True},
]}}


def test_stream_lands_clean_files_and_rejects_bad(spark):
    inbox = local_path(scratch_dir(spark, "inbox"))
    os.makedirs(inbox)
    with open(os.path.join(inbox, "good.csv"), "w") as f:
        f.write("id,name\n1,Ana\n2,Bo\n")
    with open(os.path.join(inbox, "bad.csv"), "w") as f:
        f.write("id,name\nx,Ana\n3, \n")
    root = scratch_dir(spark, "stream-out")
    q = land_stream(spark, inbox, CONTRACT, root, scratch_dir(spark, "stream-ckpt"),
                    {"subject": "s", "sub_subject": "u"})
    q.awaitTermination(120)
    data = spark.read.option("header", True).csv(root + "/data")
    assert sorted(r["id"] for r in data.collect()) == ["1", "2"]
    man = spark.read.parquet(root + "/manifest").collect()
    assert [(r["original_filename"], r["row_count_text"]) for r in man] == [("good.csv", "2")]
    rej = spark.read.parquet(root + "/rejected").collect()
    assert len(rej) == 1 and rej[0]["file"].endswith("bad.csv") and rej[0]["problems"] == 2
    dead = spark.read.parquet(root + "/dead_letters").collect()
    assert sorted(r["line"] for r in dead) == ["3, ", "id,name", "x,Ana"]
    assert all(r["source_file"].endswith("bad.csv") for r in dead)


def test_stream_gate_goes_by_header_name(spark):
    inbox = local_path(scratch_dir(spark, "inbox"))
    os.makedirs(inbox)
    files = {"reordered.csv": 'name,id\n"Ana ""A"", x",7\n', "missing.csv": "id\n1\n", "renamed.csv": "id,nome\n1,Bo\n",
             "extra.csv": "id,name,x\n1,Bo,z\n", "header_only.csv": "id,name\n", "blank.csv": "\n"}
    for name, text in files.items():
        with open(os.path.join(inbox, name), "w") as f:
            f.write(text)
    root = scratch_dir(spark, "stream-out")
    for run in (1, 2):  # a second checkpoint on one root overwrites nothing
        land_stream(spark, inbox, CONTRACT, root, scratch_dir(spark, "stream-ckpt"),
                    {"subject": "s", "sub_subject": "u"}, max_files_per_trigger=4).awaitTermination(240)
        data = spark.read.option("header", True).option("escape", '"').csv(root + "/data").collect()
        assert [(r["id"], r["name"]) for r in data] == [("7", 'Ana "A", x')] * run
        rejected = spark.read.parquet(root + "/rejected").collect()
        assert len(rejected) == 5 * run
        assert {r["file"].rsplit("/", 1)[-1]: r["reason"] for r in rejected} == {
            "missing.csv": "missing column name", "renamed.csv": "missing column name; extra column nome",
            "extra.csv": "extra column x", "header_only.csv": "no data line",
            "blank.csv": "missing column id; missing column name"}


def test_streamed_uploads_meet_their_manifest(spark):
    from vellum.operators import manifest as mf
    from vellum.sources.listing import list_landed
    inbox = local_path(scratch_dir(spark, "inbox"))
    os.makedirs(os.path.join(inbox, "sub"))
    files = {"a b.csv": 'id,name\n1,"x\ny"\n2,z\n', "sub/a b.csv": "id,name\n3,w\n", "c;d.csv": "name,id\nq,4\n", "bad.csv": "id,name\nx,y\n"}
    for name, text in files.items():
        with open(os.path.join(inbox, name), "w") as f:
            f.write(text)
    root, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ckpt")
    run = lambda: land_stream(spark, inbox + "/{*,sub/*}", CONTRACT, root, checkpoint, {"subject": "s", "sub_subject": "u"},
                              max_files_per_trigger=2).awaitTermination(240)
    run()
    data = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(root + "/data").collect()
    assert sorted((r["id"], r["name"]) for r in data) == [("1", "x\ny"), ("2", "z"), ("3", "w"), ("4", "q")]
    listed = list_landed(spark, root)
    assert listed.count() == 3
    got = mf.attach_metadata(listed, spark.read.parquet(root + "/manifest").drop("upload"))
    assert sorted((r.original_filename, r.row_count, r.file_size_bytes > 0) for r in got.collect()) == [
        ("a b.csv", 1, True), ("a b.csv", 2, True), ("c;d.csv", 1, True)]
    sizes = {r.file_key: r.file_size_bytes for r in listed.collect()}
    man = spark.read.parquet(root + "/manifest").collect()
    assert {r.file_key: r.file_size_bytes for r in man} == sizes
    assert mf.manifest_stats(got, got.first().upload_date.date()).first().total_rows == 4
    run()  # nothing new: nothing changes
    assert list_landed(spark, root).count() == 3
